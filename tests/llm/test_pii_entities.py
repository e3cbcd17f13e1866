"""Entities that the base patterns do not know, whole: account numbers with letters, long keys."""

import random

import pytest

from weftmark.llm import pii

IBANS = (
    "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78",
    "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "SC18 SSCB 1101 0000 0000 0000 1497 USD", "MU17 BOMM 0101 1010 3030 0200 000M UR",
    "FR14 2004 1010 0505 0001 3M02 606", "BR18 0036 0305 0000 1000 9795 493C 1",
)


@pytest.mark.parametrize("number", IBANS)
@pytest.mark.parametrize("grouped", (True, False))
def test_account_numbers_are_found_whole(number, grouped):
    weights = pii.train()
    number = number if grouped else number.replace(" ", "")
    for before, after in (("iban ", ". then"), ("please pay to account ", " THE REST OF IT"), ("IBAN: ", ""), ("7 OF 9 TO account ", ", thanks")):
        text = before + number + after
        assert pii.field_spans(text, weights) == [("iban", len(before), len(before) + len(number))], text


def test_capitals_after_a_number_are_no_account():
    weights = pii.train()
    for text in ("CHAPTER 12 THE MAN WHO SAT AT THE BAR", "account GB30 NWBK 6016 1331 9268 19.", "ROOM AB12 THIS MANY WORD FORM LIST"):
        assert pii.field_spans(text, weights) == [], text
    assert pii.field_spans("7 " + "ABCD " * 20_000, weights) == []


HEX, BASE62 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("signs", (HEX, BASE62, BASE62 + "-_"))
@pytest.mark.parametrize("size", (24, 32, 40, 64, 86, 100, 128))
def test_secrets_of_every_length_are_found_whole(signs, size):
    weights, r = pii.train(), random.Random(size)
    right = 0
    for _ in range(40):
        key = r.choice(signs[10:16]) + "".join(r.choice(signs) for _ in range(size - 2)) + "7"
        before, after = r.choice((('token = "', '" and'), ("my api_key=", " here"), ("password: ", ", then")))
        right += pii.field_spans(before + key + after, weights) == [("secret", len(before), len(before) + size)]
        assert not [s for s in pii.field_spans("checksum sha256 " + key + " ok", weights) if s[2] - s[1] == size]
    assert right >= 39


def test_keys_alternating_in_every_letter():
    key = "a1" * 64
    assert pii.field_spans(f"token={key};", pii.train()) == [("secret", 6, 134)]
    assert pii.field_spans(f"token={key * 2};", pii.train()) == [("secret", 6, 262)]  # keys in one piece have no bound


@pytest.mark.parametrize("size", (105, 130, 200, 300, 1000, 20_000))
def test_tokens_of_any_length_are_found_whole(size):
    weights, r = pii.train(), random.Random(size)
    some = lambda n: "".join(r.choice(BASE62 + "-_") for _ in range(n - 1)) + r.choice(BASE62)
    right = 0
    for _ in range(30):
        part = (size - 25) // 3
        jwt = f"eyJhbGciOiJIUzI1NiJ9.eyJ{some(part)}.{some(size - 25 - part)}"
        prefixed = "sk-proj-" + some(size - 8)
        for before, token, after in (("Authorization: Bearer ", jwt, "\nthen 7"), ('key = "', prefixed, '" ok')):
            right += ("secret", len(before), len(before) + len(token)) in pii.field_spans(before + token + after, weights)
        assert not pii.field_spans("commit checksum " + some(size) + " ok", weights)
    assert right >= 57


def brute_candidates(text):
    """Every span of tokens that the rules of candidates admit, by looking at all of them."""
    tokens = [(m.start(), m.end()) for m in pii._TOKEN.finditer(text)]
    out = {}
    for j in range(1, len(tokens) + 1):
        for i in range(j):
            start, end = tokens[i][0], tokens[j - 1][1]
            span, parts = text[start:end], [text[a:b] for a, b in tokens[i:j]]
            gaps = [text[tokens[x][1] : tokens[x + 1][0]] for x in range(i, j - 1)]
            spaced, letters = any(gaps), any(p[0].isalpha() for p in parts)
            digits = sum(len(p) for p in parts if "0" <= p[0] <= "9")
            cues = pii.cues_before(text, start)
            announced = {"title", "naming", "secret"} & set(cues)
            if (
                any(g not in ("", " ", "  ") for g in gaps) or sum(map(bool, gaps)) > 7 or not 4 <= len(span) <= (64 if spaced else 140)
                or (not span[-1].isalnum() and span[-1] not in "-_=.") or (not span[0].isalnum() and span[0] not in "+(_")
                or letters and (pii._joined(text, start) or pii._joined(text, end)) or not digits and "@" not in span and not announced
                or spaced and parts[0][0].islower() or spaced and not letters and not 6 <= digits <= 20
                or not letters and pii._within_number(text, start)
            ):
                continue
            features = pii.span_features(text, start, end)
            if features:
                out[i, j] = (start, end, features)
    return len(tokens), out


POOL = [
    "a1", "b2c3", "-", "_", " ", "9", "4", "GB", "Xy", ".", "@", "+", "(", "  ", "\n", "1 " * 8, "a1b2c3d4e5f6", "日本", "password: ", "Mr. ",
    " Lee", "555", "0100", " 4111 1111 1111 1111", "10.0.0.1", "a@b.co", "Road", " 12 ", "=", "born on ",
]


def test_candidates_are_all_that_the_rules_admit():
    r = random.Random(11)
    for _ in range(300):
        text = "".join(r.choice(POOL) for _ in range(r.randint(1, 30)))
        n, found = pii._candidates(text)
        want_n, want = brute_candidates(text)
        assert n == want_n and {(i, j): rest for i, j, *rest in map(tuple, found)} == {k: list(v) for k, v in want.items()}, text


def test_decoding_finds_the_best_of_all_segmentations(monkeypatch):
    """Against every way to choose spans that do not overlap; also when it commits after every token."""
    r, rng = random.Random(12), pii.np.random.default_rng(1)
    many = 0
    for at in range(250):
        text = "".join(r.choice(POOL) for _ in range(r.randint(1, 16)))
        weights = pii.train() if at % 2 else rng.normal(0, 1, (len(pii.KINDS), len(pii.FEATURES)))
        n, spans = brute_candidates(text)
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max([best[j - 1], *[best[i] + weights[:, f].sum(1).max() for (i, e), (_, _, f) in spans.items() if e == j]])
        by_place = {(s, e): f for s, e, f in spans.values()}
        for every in (512, 1):
            monkeypatch.setattr(pii, "COMMIT_EVERY", every)
            got = list(pii.decode(text, 0, len(text), weights))
            assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
            worth = sum(weights[pii.KINDS.index(kind), by_place[s, e]].sum() for kind, s, e in got)
            assert abs(worth - best[n]) < 1e-9, text
        many += len(got) > 1
    assert many > 20


def test_entities_across_a_long_run_of_signs_are_found_at_every_place():
    """A run that once was cut into regions of 4,096 characters."""
    weights = pii.train()
    filler = "12-34 " * 900
    for shift in range(0, 60, 7):
        text = "x" * shift + " " + filler + "ssn 123-45-6789, token=a1" + "b2" * 20 + "; " + filler
        kinds = [kind for kind, *_ in pii.field_spans(text, weights)]
        assert "ssn" in kinds and "secret" in kinds, shift
