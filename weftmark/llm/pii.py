"""Personal data by patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.  The
field segments the neighbourhood of digits, at signs and announcing words.  Features look
at a whole candidate span: its shapes, check digits, make-up (digits, length, words,
how varied its characters are), what stands around it, and which cue words come before
it.  Any word with a digit is a candidate, of a shape or not.  A dynamic program over
spans of bounded length chooses boundaries and types together; it runs along a text,
however long, and commits where all paths meet.  The field is trained here, on sentences
made from rules, by the gradient of the likelihood.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmark.llm.texts import bounded_batches, slices

Span = tuple[str, int, int]

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits fails as the run's first digit does, so it is skipped
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "birth", "name", "address", "document")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}


#: The digit sum of twice a digit.
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    doubled = digits[-2::-2].translate(_DOUBLED)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, doubled))) % 10 == 0


def _octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by kind as listed and then by start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---- the semi-Markov field

#: A run of LONG_RUN or more characters of keys, with a letter and a digit among the first of them, is one token, and so a candidate of any length.
LONG_RUN = 100
_HEAD = rf"(?=[A-Za-z_+/.-]{{0,{LONG_RUN}}}[0-9])(?=[0-9_+/.-]{{0,{LONG_RUN}}}[A-Za-z])"
_TOKEN = re.compile(rf"(?<![A-Za-z0-9_+/.-]){_HEAD}[A-Za-z0-9_-][A-Za-z0-9_+/.-]{{{LONG_RUN - 2},}}(?<![./+])={{0,2}}|[^\W\d_]+|[0-9]+|[^\s\w]|_")
#: An entity stands at a digit or at sign, or within some words after a word that announces one.
_SIGN = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_RUN = re.compile(r"\S*(?:\s+[^\s0-9@]*[0-9@]\S*|\x20[^\W\d_a-z][^\s0-9@]{0,24}(?!\S)|(?:\x20[^\W\d_A-Z]{1,10}){1,2}(?=\x20(?:[^\W\d_a-z]|[0-9])))*")
_ANNOUNCED = re.compile(r"\S*(?:\s+\S+){0,6}")
# Words that announce an entity without digits.
ANNOUNCING = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Name", "name", "Signed", "signed",
    "Patient", "Dear", "password", "Password", "passwd", "pwd",
)
_ANCHOR = re.compile(rf"[0-9@]|\b(?:{'|'.join(ANNOUNCING)})\b")
_BEFORE = re.compile(r"(?:(?<!\S)\S+ ){0,4}\Z")
#: Characters of an entity of several tokens at most, of one with spaces in it, and looked at around it.  A single token has no bound.
MAX_ENTITY, MAX_SPACED, CONTEXT_CHARS = 140, 64, 40
#: Tokens after which the search looks for a boundary that all paths pass.
COMMIT_EVERY = 512
#: Weight of the Gaussian prior against one sentence.
PRIOR = 0.0003

_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
    "plus_phone": re.compile(r"\+[0-9](?:[ ().-]{0,2}[0-9]){8,14}"),
    "local_phone": re.compile(r"\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){2,4}|0[0-9]{8,11}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "key": re.compile(r"(?=[A-Za-z0-9_+/=.-]*[0-9])(?=[A-Za-z0-9_+/=.-]*[A-Za-z])[A-Za-z0-9_-][A-Za-z0-9_+/=.-]{14,}[A-Za-z0-9_=-]"),
    "prefixed": re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk_|xox[abp]-|eyJ|AIza|glpat-)[A-Za-z0-9_.-]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}"),
    "date": re.compile(r"[0-9]{1,2}[./ -](?:[0-9]{1,2}|[^\W\d_]{3,9}\.?)[./ -](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}|[A-Z][a-z]{2,8}\.? [0-9]{1,2},? (?:19|20)[0-9]{2}"),
    "number_first": re.compile(r"[0-9]{1,5}[a-z]?,?(?: [^\W\d_][^\W\d_'’.-]*){2,5}"),
    "number_last": re.compile(r"[^\W\d_a-z][^\W\d_'’.-]+(?: [^\W\d_][^\W\d_'’.-]*){0,3},? [0-9]{1,4}[a-z]?"),
    "names": re.compile(r"[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z](?:[^\W\d_]+|\.)){0,3}"),
    "document": re.compile(r"(?=[A-Z0-9]*[0-9])[A-Z0-9]{6,12}"),
}
# Words that announce a kind, and words inside addresses.
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write to)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pan)\b", re.I),
    "phone": re.compile(r"\b(?:phone|telephone|call|tel|mobile|mob|fax|cell|dial|ring|telefon|téléphone|tél|teléfono|handy)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|acct|bank|konto)\b", re.I),
    "secret": re.compile(r"(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|key|bearer|auth|credential)\w{0,12}\W{0,6}$", re.I),
    "birth": re.compile(r"(?:born|birth|dob|d\.o\.b\.|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)(?:[\s:.]+(?:on|am|le|el|date|is|de))*[\s:.]*$", re.I),
    "title": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? $"),
    "naming": re.compile(r"(?:\b(?:full |first |last |sur)?name|\bsigned(?: by)?|\bpatient|\bdear)\W{1,3}$", re.I),
    "living": re.compile(r"\b(?:lives? at|living at|resid\w+ (?:at|in)|address|ship(?:ped)? to|deliver(?:ed)? to|home|wohnhaft|adresse|dirección|domicil\w+)\b", re.I),
    "document": re.compile(r"\b(?:passport|passeport|pasaporte|reisepass|driver'?s? licen[cs]e|id card|identity card|personalausweis|national id|tax id|nif|dni)\b", re.I),
    "other": re.compile(r"\b(?:order|invoice|part|ticket|isbn|version|serial|no|commit|checksum|sha\d*|md5|digest|uuid|page|pages|chapter|section|room|flight|model|ref|article|item|sku|hash|build)\b", re.I),
}
_STREET = re.compile(r"\b(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|boulevard|blvd|square|terrace|rue|place|chemin|allée|calle|plaza|avenida|paseo|straße|weg|platz|gasse|allee)\b|\w(?:straße|strasse|str|weg|platz|gasse|allee)\b", re.I)
_MONTH = re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|jän|mär|mai|okt|dez|fév|avr|juin|juil|août|déc|ene|abr|ago|dic)[^\W\d_]*\b", re.I)
_UNIT = re.compile(r"\s?(?:%|€|\$|£|eur|usd|kg|km|mm|cm|mb|gb|ms|pages?|items?|years?|pieces?)\b", re.I)
DIGIT_BINS, LENGTH_BINS, WORD_BINS = (1, 5, 7, 9, 13, 20), (8, 12, 16, 24, 33, 65), (2, 3, 5)
FEATURES = (
    "bias", *[f"shape_{s}" for s in _SHAPES], "no_shape", "octets_ok", "octets_bad", "luhn_ok", "luhn_bad", "mod97_ok", "mod97_bad",
    "joined_left", "joined_right", *[f"cue_{c}" for c in _CUES], *[f"cued_{s}" for s in ("names", "document", "date", "key", "hex", "local_phone")],
    "mixed_case", "street", "ends_lower", "month", "unit_after", "quoted", "assigned", "varied", "pronounceable", "few_signs",
    *[f"digits_{n}" for n in range(len(DIGIT_BINS) + 1)], *[f"length_{n}" for n in range(len(LENGTH_BINS) + 1)], *[f"words_{n}" for n in range(len(WORD_BINS) + 1)],
)
_AT = {name: i for i, name in enumerate(FEATURES)}
#: Shapes by what a span holds: digits alone, letters alone, both in one word, both in several.
_BY_MAKE_UP = {
    (True, False): ("ip", "card", "plus_phone", "local_phone", "ssn", "date"),
    (False, False): ("email", "names"),
    (False, True): ("email", "iban", "key", "prefixed", "hex", "date", "document"),
    (True, True): ("iban", "date", "number_first", "number_last"),
}
#: Cues that make a shape stand for an entity when both are there.
_CUED = {"names": ("title", "naming"), "document": ("document",), "date": ("birth",), "key": ("secret",), "hex": ("secret",), "local_phone": ("phone",)}


def _mod97(text: str) -> bool:
    bare = text.replace(" ", "")
    turned = bare[4:] + bare[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _joined(text: str, at: int) -> bool:
    """Whether a boundary lies inside a word; a change of script between letters is none."""
    if not 0 < at < len(text):
        return False
    left, right = text[at - 1], text[at]
    return left.isalnum() and right.isalnum() and left.isascii() == right.isascii()


def _within_number(text: str, at: int) -> bool:
    """Whether a place continues a run of digit groups: after a joint, or after a space unless a sign or zero opens it."""
    if at < 2 or not "0" <= text[at - 2] <= "9":
        return False
    return text[at - 1] in "-./" or text[at - 1] == " " and text[at] not in "+(0"


def cues_before(text: str, start: int) -> list[str]:
    """Names of the cues that stand before a place."""
    before = text[max(0, start - CONTEXT_CHARS) : start]
    if before.upper() == before.lower():
        return []
    return [name for name, cue in _CUES.items() if cue.search(before)]


def span_features(text: str, start: int, end: int, cues: list[str] | None = None) -> list[int] | None:
    """Features of a whole span: its shapes, check digits, make-up and surroundings.

    None for a span that can be no entity: one without a shape that is not one word with
    a digit, or one that runs over a line's end.
    """
    span = text[start:end]
    bare = _NO_DIGIT.sub("", span)
    size, digits, spaced = len(span), len(bare), " " in span
    lower, upper = span.upper() != span, span.lower() != span
    lettered = lower or upper
    if not lettered:
        make_up = _BY_MAKE_UP[True, False]
    elif not digits:
        make_up = _BY_MAKE_UP[False, False]
    else:
        make_up = _BY_MAKE_UP[spaced, True]
    found = [name for name in make_up if _SHAPES[name].fullmatch(span)]
    if "names" in found and not all(w[0].isupper() for w in span.split()):
        found.remove("names")
    cues = cues_before(text, start) if cues is None else cues
    if not found and (spaced or size < 6 or not (digits or "secret" in cues)) or "\n" in span:
        return None
    names = ["bias", *[f"shape_{name}" for name in found]] if found else ["bias", "no_shape"]
    if "ip" in found:
        names.append("octets_ok" if _octets(span) else "octets_bad")
    if "card" in found:
        names.append("luhn_ok" if luhn(bare) else "luhn_bad")
    if "iban" in found:
        names.append("mod97_ok" if _mod97(span) else "mod97_bad")
    before, after = text[start - 1 : start], text[end : end + 1]
    if _joined(text, start) or before and (before in "(/" or before in "-_.@+" and start > 1 and text[start - 2].isalnum()):
        names.append("joined_left")
    if _joined(text, end) or span[-1] in "-_" and after.isalnum() or after and after in "-_@./" and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] in "-_"):
        names.append("joined_right")
    names += [f"cue_{name}" for name in cues]
    names += [f"cued_{shape}" for shape in found if shape in _CUED and any(c in cues for c in _CUED[shape])]
    if digits and lower and upper:
        names.append("mixed_case")
    if spaced and lettered:
        if _STREET.search(span):
            names.append("street")
        if span[span.rindex(" ") + 1 :][:1].islower():
            names.append("ends_lower")
        if "date" in found and _MONTH.search(span):
            names.append("month")
    if digits and _UNIT.match(text, end):
        names.append("unit_after")
    if before and before == after and before in "\"'`":
        names.append("quoted")
    if text[max(0, start - 3) : start].rstrip(" \"'`").endswith(("=", ":")):
        names.append("assigned")
    if lettered and not spaced and size >= 8:
        signs = len(set(span))
        names.append("few_signs" if 3 * signs < size and signs < 10 else "varied")
        if digits * 3 < size:
            letters = [c for c in span.lower() if c.isalpha()]
            if len(letters) >= 6 and 0.28 <= sum(c in "aeiouyäöüéèáíóú" for c in letters) / len(letters) <= 0.6:
                names.append("pronounceable")
    names.append(f"digits_{bisect_right(DIGIT_BINS, digits)}")
    names.append(f"length_{bisect_right(LENGTH_BINS, size)}")
    names.append(f"words_{bisect_right(WORD_BINS, span.count(' ') + 1)}")
    return [_AT[name] for name in names]


class _Tokens:
    """Tokens of a region that the search may still need: their places and running counts."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] = []
        self.end: list[int] = []
        self.kind: list[str] = []  # digits, word, Word or sign
        self.cues: dict[int, list[str]] = {}

    def add(self, start: int, end: int) -> None:
        c = self.text[start]
        kind = "9" if "0" <= c <= "9" else "-" if not c.isalpha() else "A" if not c.islower() else "a"
        self.start.append(start)
        self.end.append(end)
        self.kind.append(kind)

    def drop(self, n: int) -> None:
        """Forget the first n tokens."""
        self.cues = {at: c for at, c in self.cues.items() if n < len(self.start) and at >= self.start[n]}
        del self.start[:n], self.end[:n], self.kind[:n]

    def spans(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """(first token, start, end, features) of every candidate that ends with the last token.

        A candidate of several tokens has up to MAX_ENTITY characters, up to MAX_SPACED and
        eight words with spaces in it; a long run of key characters is one token.
        One that begins or ends inside a word holds no letters, and one without letters
        begins where a number does.
        """
        text, j = self.text, len(self.start)
        end, kind = self.end[-1], self.kind[-1]
        if kind == "-" and text[end - 1] not in "-_=.":
            return
        cut = _joined(text, end)
        letters = spaced = False
        digits = words = 0
        for i in range(j - 1, -1, -1):
            start = self.start[i]
            gap = i < j - 1 and self.end[i] < self.start[i + 1]
            if gap and text[self.end[i] : self.start[i + 1]] not in (" ", "  "):
                return  # entities do not run over lines or wide gaps
            spaced = spaced or gap
            words += gap
            size = end - start
            if i < j - 1 and size > (MAX_SPACED if spaced else MAX_ENTITY) or words > 7:
                return
            kind = self.kind[i]
            letters = letters or kind in "aA"
            digits += size and kind == "9" and self.end[i] - start
            if cut and letters:
                return
            if size < 4 or kind == "-" and text[start] not in "+(_":
                continue
            if _joined(text, start) and letters:
                continue
            if spaced and kind == "a" or spaced and not letters and not 6 <= digits <= 20:
                continue
            if not letters and _within_number(text, start):
                continue
            cues = self.cues.get(start)
            if cues is None:
                cues = self.cues[start] = cues_before(text, start)
            if not digits and "@" not in text[start:end] and not ("title" in cues or "naming" in cues or "secret" in cues):
                continue  # words alone are only candidates where they are announced
            features = span_features(text, start, end, cues)
            if features:
                yield i, start, end, features


def decode(text: str, low: int, high: int, weights: np.ndarray) -> Iterator[Span]:
    """The best segmentation of a region: spans with their kinds, everything else outside.

    Tokens come one by one; spans are given out as soon as every path that is left has
    them, and only the tokens that an entity could still reach are kept.
    """
    tokens = _Tokens(text)
    best: list[float] = [0.0]  # by boundary: the best score up to it, and its last step
    back: list[tuple[int, str, int, int] | None] = [None]
    due, columns = COMMIT_EVERY, np.ascontiguousarray(weights.T)

    def path(j: int) -> list[Span]:
        out = []
        while j:
            step = back[j]
            if step is None:
                j -= 1
            else:
                out.append(step[1:])
                j = step[0]
        return out[::-1]

    for match in _TOKEN.finditer(text, low, high):
        tokens.add(match.start(), match.end())
        top, step = best[-1], None
        for i, start, end, features in tokens.spans():
            worth = columns[features].sum(0)
            kind = int(worth.argmax())
            if best[i] + worth[kind] >= top and worth[kind] > 0:  # of equals the longer
                top, step = best[i] + float(worth[kind]), (i, KINDS[kind], start, end)
        best.append(top)
        back.append(step)
        if len(best) > due:
            j = len(best) - 1
            live = {j}
            while j and tokens.start[j - 1] >= match.end() - MAX_ENTITY:
                j -= 1
                live.add(j)
            while len(live) > 1:
                far = max(live)
                live.remove(far)
                live.add(far - 1 if back[far] is None else back[far][0])
            meet = live.pop()
            yield from path(meet)
            base = best[meet]
            best = [b - base for b in best[meet:]]
            back = [None, *[s and (s[0] - meet, *s[1:]) for s in back[meet + 1 :]]]
            tokens.drop(meet)
            due = len(best) + COMMIT_EVERY
    yield from path(len(best) - 1)


def _candidates(text: str) -> tuple[int, list[tuple[int, int, int, int, list[int]]]]:
    """Number of tokens, and all candidates (first token, token after the last, start, end, features)."""
    tokens, out = _Tokens(text), []
    for match in _TOKEN.finditer(text):
        tokens.add(match.start(), match.end())
        out += [(i, len(tokens.start), start, end, features) for i, start, end, features in tokens.spans()]
    return len(tokens.start), out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _gradient(n: int, spans: list[tuple[int, int]], marks: np.ndarray, gold: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient of the log likelihood of one sentence by the forward-backward sums over spans.

    ``spans`` are (first token, token after the last), ``marks`` their features as rows of
    0 and 1, ``gold`` is 1 where a span (row) has a kind (column).
    """
    scores = marks @ weights.T
    top = scores.max(1)
    totals = (top + np.log(np.exp(scores - top[:, None]).sum(1))).tolist()
    begin, finish = {}, {}
    for k, (i, j) in enumerate(spans):
        begin.setdefault(i, []).append(k)
        finish.setdefault(j, []).append(k)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        here = finish.get(j)
        forward[j] = _log_sum([forward[j - 1], *[forward[spans[k][0]] + totals[k] for k in here]]) if here else forward[j - 1]
    for i in range(n - 1, -1, -1):
        here = begin.get(i)
        backward[i] = _log_sum([backward[i + 1], *[backward[spans[k][1]] + totals[k] for k in here]]) if here else backward[i + 1]
    around = np.array([forward[i] + backward[j] - forward[n] for i, j in spans])
    return (gold - np.exp(scores + around[:, None])).T @ marks


def _made_sentences(seed: int, count: int) -> Iterator[tuple[str, list[Span]]]:
    """Sentences from rules with their entities: about half hold one, the rest look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    parts = ["er", "an", "ti", "or", "the", "ou", "en", "sch", "ción", "la", "re", "mo"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    plain = lambda: word().replace("ó", "o")
    proper = lambda: (word() + r.choice(parts)).capitalize()

    def card(valid: bool) -> str:
        body = r.choice("3456") + digits(14)
        check = next(d for d in "0123456789" if luhn(body + d))
        last = check if valid else r.choice([d for d in "0123456789" if d != check])
        number = body + last
        return number if r.random() < 0.6 else r.choice(" -").join(number[i : i + 4] for i in range(0, 16, 4))

    def iban(valid: bool = True) -> str:
        country, bank, rest, end = r.choice((
            ("DE", 0, 18, ""), ("GB", 4, 14, ""), ("NL", 4, 10, ""), ("IE", 4, 14, ""), ("FR", 0, 23, ""), ("SC", 4, 20, "USD"),
        ))
        body = letters(bank) + digits(rest) + end
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        check = check if valid else 2 + (check + r.randint(0, 94)) % 97
        bare = f"{country}{check:02d}{body}"
        return bare if r.random() < 0.5 else " ".join(bare[i : i + 4] for i in range(0, len(bare), 4))

    def token() -> str:
        if r.random() < 0.5:
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64, 128))))
        signs = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + r.choice(["", "-_"])
        return r.choice(signs[10:]) + "".join(r.choice(signs) for _ in range(r.randint(22, 126))) + r.choice("0123456789")

    def password() -> str:
        return proper() + r.choice("!#_$") + digits(r.randint(2, 4)) + r.choice(["", letters(2), word()])

    def local_phone() -> str:
        return r.choice([
            f"({r.randint(2, 9)}{digits(2)}) 555-{digits(4)}", f"{r.randint(2, 9)}{digits(2)}-555-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}",
            f"0{r.randint(1, 7)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(10)}",
        ])

    def date() -> str:
        day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1930, 2015)
        name = r.choice(["March", "June", "October", "mai", "Juli", "diciembre"])
        return r.choice([f"{day}.{month}.{year}", f"{day:02d}/{month:02d}/{year}", f"{year}-{month:02d}-{day:02d}", f"{day} {name} {year}", f"{name.capitalize()} {day}, {year}"])

    def address() -> str:
        return r.choice([
            f"{r.randint(1, 999)} {proper()} {r.choice(['Street', 'Road', 'Avenue', 'Lane'])}", f"{r.randint(1, 99)} rue de {proper()}",
            f"{proper()}straße {r.randint(1, 199)}", f"Calle {proper()} {r.randint(1, 99)}", f"{r.randint(1, 99)} {proper()} {proper()} Drive",
        ])

    def person() -> str:
        return r.choice([f"{proper()} {proper()}", f"{proper()} {letters(1)}. {proper()}", proper()])

    octet = lambda top: str(r.randint(0, top))
    secret_cues = ['token = "', "api_key=", "password: ", "secret: '", "Bearer ", "access_key = ", "key="]
    made = {
        "email": (lambda: f"{plain()}.{digits(2)}@{plain()}{digits(1)}.example.com", ["mail ", "contact: ", ""]),
        "ip": (lambda: ".".join(octet(255) for _ in range(4)), ["from ", "host ", ""]),
        "card": (lambda: card(True), ["card ", "visa: ", ""]),
        "phone": (
            lambda: r.choice([f"+1 ({digits(3)}) 555-{digits(4)}", local_phone()]),
            ["call ", "phone: ", "tel ", "mobile "],
        ),
        "ssn": (lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", ["ssn ", "SSN: "]),
        "iban": (lambda: iban(), ["iban ", "account "]),
        "secret": (lambda: r.choice([token, token, token, password, lambda: "AKIA" + letters(12) + digits(4)])(), secret_cues),
        "birth": (date, ["born ", "born on ", "date of birth: ", "geboren am ", "DOB "]),
        "name": (person, ["Mr. ", "Mrs ", "Dr. ", "name: ", "Frau ", "Monsieur ", "signed by "]),
        "address": (address, ["lives at ", "address: ", "ship to ", "", "wohnhaft "]),
        "document": (lambda: letters(r.randint(1, 2)) + digits(r.randint(6, 8)), ["passport ", "passport no. ", "ID card "]),
    }
    decoys = [
        lambda: card(False), lambda: "order " + digits(12), lambda: ".".join(octet(9) for _ in range(3)),
        lambda: f"{r.randint(300, 999)}.{octet(99)}.{octet(99)}.{octet(99)}", lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
        lambda: "version " + r.choice(["2.0", "3", "4.0"]), lambda: "commit " + token(), lambda: "sha256 " + token(),
        lambda: f"part {r.randint(200, 999)}-{digits(3)}-{digits(4)}", lambda: "isbn 978-" + digits(10),
        lambda: f"invoice {r.randint(100, 665)}-{digits(2)}-{digits(4)}", lambda: token(), lambda: digits(18),
        lambda: f"{r.randint(200, 999)} {digits(3)} {digits(4)}", lambda: r.choice(["", "account "]) + iban(False),
        lambda: r.choice(["", "on ", "since ", "the "]) + date(), lambda: f"{proper()} {proper()} {word()}", lambda: f"{r.randint(1, 99)} {proper()} {proper()} {word()}",
        lambda: f"{proper()} {r.randint(1, 99)} {word()}", lambda: "model " + letters(2) + digits(6), lambda: letters(3) + digits(5),
        lambda: f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: f"{digits(3)} {digits(3)} {r.choice(['EUR', 'kg', 'pages'])}",
        lambda: f"{digits(2)}-{digits(2)} {digits(2)}-{digits(2)} {digits(2)}-{digits(2)}", lambda: f"{word()}{digits(4)}{word()}", lambda: "file_" + word() + "_" + digits(8),
        lambda: f"Dr. {word()} the {word()}", lambda: "password " + word(), lambda: f"ref {digits(4)}-{digits(4)}-{digits(4)}", lambda: f"{digits(1)}, {digits(2)}, {digits(3)} and {digits(4)}",
    ]
    kinds = list(made)
    for at in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(1, 4))) + " ", []
        if at % 2:
            kind = kinds[at // 2 % len(kinds)]
            make, cues = made[kind]
            text += r.choice(cues)
            entity = make()
            spans.append((kind, len(text), len(text) + len(entity)))
            text += entity
        else:
            text += decoys[at // 2 % len(decoys)]()
        yield text + r.choice([" ", ". ", '" ', ", "]) + word(), spans


_trained: dict[tuple[int, int, int], np.ndarray] = {}


def train(seed: int = 7, sentences: int = 1800, epochs: int = 30) -> np.ndarray:
    """Weights (kinds x features) by gradient ascent with a small Gaussian prior; the same on every run."""
    name = (seed, sentences, epochs)
    if name in _trained:
        return _trained[name]
    examples = []
    for text, entities in _made_sentences(seed, sentences):
        n, found = _candidates(text)
        if not found:
            continue
        marks, gold = np.zeros((len(found), len(FEATURES))), np.zeros((len(found), len(KINDS)))
        true = {(start, end): _ORDER[kind] for kind, start, end in entities}
        for k, (_, _, start, end, features) in enumerate(found):
            marks[k, features] = 1.0
            if (start, end) in true:
                gold[k, true[start, end]] = 1.0
        examples.append((n, [f[:2] for f in found], marks, gold))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    mean, speed = np.zeros_like(weights), np.zeros_like(weights)
    for epoch in range(1, epochs + 1):  # steps by running means of the gradient and its square
        step = -PRIOR * len(examples) * weights
        for example in examples:
            step += _gradient(*example, weights)
        mean, speed = 0.9 * mean + 0.1 * step, 0.99 * speed + 0.01 * step**2
        weights = weights + 0.3 * (mean / (1 - 0.9**epoch)) / (np.sqrt(speed / (1 - 0.99**epoch)) + 1e-8)
    _trained[name] = weights
    return weights


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with a digit or an at sign, and some words after an announcing word.

    Of a long word only what an entity could hold before the sign is taken in.
    """
    anchor = _ANCHOR if any(w in text for w in ANNOUNCING) else _SIGN
    done, sign = 0, anchor.search(text)
    while sign:
        low = sign.start()
        while low > done and sign.start() - low < MAX_ENTITY and not text[low - 1].isspace():
            low -= 1
        if sign.group() not in ANNOUNCING:  # the words of a line before it
            low = max(done, low - MAX_SPACED) + _BEFORE.search(text[max(done, low - MAX_SPACED) : low]).start()
            done = _RUN.match(text, sign.start()).end()
        else:
            done = _ANNOUNCED.match(text, sign.start()).end()
            last = _SIGN.search(text, low, done)
            if last:
                done = max(done, _RUN.match(text, last.start()).end())
        yield low, done
        sign = anchor.search(text, done)


def field_spans(text: str, weights: np.ndarray) -> list[Span]:
    """Entities that the field finds, over the whole text."""
    return [span for low, high in _regions(text) for span in decode(text, low, high, weights)]


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, base and field spans), each by kind and start; the field adds where no base span is."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    more = []
    for kind, start, end in field_spans(text, weights):
        if not any(s < end and start < e for s, e in _near(taken, start, end)):
            more.append((kind, start, end))
    return base, sorted([*base, *more], key=lambda s: (_ORDER[s[0]], s[1]))


def _near(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Base spans that may overlap start..end: those that begin before its end, back to one that ends before its start.

    Base spans of one kind do not overlap, so four in a row that end before the start leave none behind them.
    """
    at, clear, out = bisect_left(taken, (end, 0)), 0, []
    while at and clear < 4:
        at -= 1
        clear = clear + 1 if taken[at][1] <= start else 0
        out.append(taken[at])
    return out


def find_pii(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, base and spans (arrays of kind, start, end).

    Offsets are code points, the end is exclusive.  ``base`` has the pattern matches,
    ``spans`` these and what the trained field adds beside them.  Null text counts as
    empty; texts are read whole, however long.  Base patterns have no bound and neither
    has a key in one piece; other entities of the field have MAX_ENTITY characters at
    most, and MAX_SPACED and eight words if there are spaces in them.  Rows are judged on their own, so null
    and repeated keys pass through; other columns are ignored whatever their names; empty
    in, empty out.
    """
    bounded_batches(df.sparkSession)
    weights = train()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = T.StructType(
        [*rows.select("k").schema.fields, *T.StructType.fromDDL(f"base {kind}, spans {kind}").fields]
    )
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                made = [all_spans(t, weights) if t else ([], []) for t in batch.column("t").to_pylist()]
                columns = [
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in pair[side]] for pair in made], arrow)
                    for side in (0, 1)
                ]
                yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], names=["k", "base", "spans"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
