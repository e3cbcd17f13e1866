"""The codec against the public library's encoder, and round trips."""

import random

import pytest

from weftmark.llm import sentencepiece_codec as codec
from weftmark.llm.registry import TOKENIZER


@pytest.fixture(scope="module")
def raw():
    return codec.read_model(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=TOKENIZER)


def test_same_ids_as_the_library(raw, library):
    mine, r = codec.Codec(raw), random.Random(5)
    texts = ["", " ", "  a  b ", "é日本\U0001f916", "a\0b", "x" * 3000 + "ab" * 900, "line\n\n two\t\r\nthree"]
    texts += ["".join(r.choice("abcdeh the\nn  in12.é日,") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, mine.encode_all(texts)):
        assert ids.tolist() == library.encode(text), text
        assert mine.decode(ids.tolist()) == text


def plain_bpe(model, text):
    """Ids by merging the whole text, best score first: what the library is known to give."""
    parts = list(text)
    while True:
        scored = [(-model.scores[model.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.ids]
        if not scored:
            break
        k = min(scored)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [i for p in parts for i in ([model.ids[p]] if p in model.ids else [model.byte_ids[b] for b in p.encode()])]


def test_same_ids_as_plain_merging(raw):
    mine, r = codec.Codec(raw), random.Random(8)
    texts = ["".join(r.choice("abcdeh the\nn  in12.é日,") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", "\n", "a" * 300]
    assert [x.tolist() for x in mine.encode_all(texts)] == [plain_bpe(mine.model, mine.normal(t)) for t in texts]


def test_all_characters_of_all_texts_go_through_the_search(raw, rows):
    mine = codec.Codec(raw)
    texts = [row[1] for row in rows] + ["x" * 100_000, "word " * 30_000, "日本" * 700]
    mine.encode_all(texts)
    assert mine.searched == sum(len(mine.normal(t)) for t in texts if t is not None)


@pytest.mark.parametrize("part,round_", ((1, 1), (3, 10), (17, 40), (50, 1 << 18)))
def test_parts_of_any_size_give_the_same_ids(raw, monkeypatch, part, round_):
    r = random.Random(part)
    texts = ["".join(r.choice("abc the\n▁  in12é日") for _ in range(r.randint(0, 300))) for _ in range(30)] + [None, "", "ab" * 200]
    whole = codec.Codec(raw).encode_all(texts)
    monkeypatch.setattr(codec, "PART_CHARS", part)
    monkeypatch.setattr(codec, "ROUND_CHARS", round_)
    cut = codec.Codec(raw).encode_all(texts)
    assert [x if x is None else x.tolist() for x in cut] == [x if x is None else x.tolist() for x in whole]


def test_stream_commits_early_and_keeps_a_bounded_window(raw):
    mine = codec.Codec(raw)
    stream, out, widest = codec.Stream(mine.start), [], 0
    text = codec.MARK + "abcdefgh0123" * 4000
    for i in range(0, len(text), 100):
        out += mine.feed([stream], [text[i : i + 100]], [i + 100 >= len(text)])[0].tolist()
        widest = max(widest, len(stream.tail))
    assert out == mine.encode(text.replace(codec.MARK, "", 1)).tolist()
    assert widest < 100 and not stream.tail


def unigram_model(pieces):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    import struct

    field = lambda n, body: varint(n << 3 | 2) + varint(len(body)) + body
    raw = field(1, field(1, b"<unk>") + b"\x18\x02")
    for piece, score in pieces:
        raw += field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score))
    return raw + field(2, b"\x18\x01") + field(3, b"\x20\x00")


def test_unigram_finds_the_best_path():
    pieces = [("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("aba", -4.5), ("▁ab", -5.0), ("ba", -3.5)]
    mine, scores, r = codec.Codec(unigram_model(pieces)), dict(pieces), random.Random(1)

    def best(text):
        value = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            value[end] = max(value[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores)
        return value[-1]

    for _ in range(300):
        text = "".join(r.choice("ab ") for _ in range(r.randint(1, 200)))
        ids = mine.encode(text).tolist()
        assert mine.decode(ids) == text
        got = sum(scores[mine.model.pieces[i]] for i in ids)
        assert got == pytest.approx(best(mine.normal(text)))


@pytest.mark.parametrize("part", (1, 5, 1 << 15))
def test_unigram_equals_the_library(monkeypatch, part):
    sp = pytest.importorskip("sentencepiece")
    r = random.Random(4)
    pieces = [("▁", -2.0), ("a", -3.25), ("b", -3.5), ("ab", -4.125), ("aba", -4.75), ("▁ab", -5.0), ("ba", -3.75), ("cab▁a", -6.5), ("bb", -7.5)]
    raw = unigram_model(pieces)
    library = sp.SentencePieceProcessor(model_proto=raw)
    monkeypatch.setattr(codec, "PART_CHARS", part)
    mine = codec.Codec(raw)
    texts = ["".join(r.choice("ababc x") for _ in range(r.randint(0, 80))) for _ in range(300)]
    assert [x.tolist() for x in mine.encode_all(texts)] == [library.encode(t) for t in texts]


def test_query_on_the_whole_table(spark, raw, library):
    from weftmark.llm.registry import documents, op3_sentencepiece

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    got = op3_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["same"] and r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"])


def test_spark_round_trip(docs, rows, empty, raw, library):
    got = codec.round_trip(docs, raw).collect()
    assert len(got) == len(rows) and all(r["same"] for r in got if r["ids"] is not None)
    by_text = sorted(len(library.encode(row[1])) for row in rows if row[1] is not None)
    assert sorted(r["n_ids"] for r in got if r["ids"] is not None) == by_text
    ids = codec.encode(docs, raw)
    texts = {r["doc_id"]: r["text"] for r in codec.decode(ids, raw).collect()}
    assert texts[3] is None and texts[4] == "" and texts[1] == rows[0][1]
    assert codec.round_trip(empty, raw).count() == codec.decode(codec.encode(empty, raw), raw).count() == 0
