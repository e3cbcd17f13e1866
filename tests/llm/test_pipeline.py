"""The pipeline stage by stage and as a whole, against plain versions."""

import hashlib
import math
import re
import unicodedata

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weftmark.llm import registry  # noqa: E402
from weftmark.plans.shared import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark, docs, empty):
    for start in (docs, empty):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = now.columns
            now = materialize(stage(spark, now, SF), f"test-{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == columns
        assert now.columns == ["doc_id", "ids", "n_ids", "same"]
        assert now.where("not same").count() == 0


def plain_quality(text, words):
    """Whether no rule of policy v1 fails, rule by rule."""
    ws, text = words(text), text or ""
    starts = {}
    for i in range(len(ws) - 2):
        starts.setdefault(tuple(ws[i : i + 3]), []).append(i)
    repeated = {i + j for at in starts.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    upper = [c for c in letters if unicodedata.category(c) == "Lu"]
    n, chars = len(ws), sum(map(len, ws))
    return not (
        n < 50 or 100 * len(repeated) > 50 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n
        or len(lines) >= 3 and 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
        or 2 * chars < 5 * n or chars > 15 * n or letters and 2 * len(upper) > len(letters)
    )


def plain_mix(rows, words):
    """Copies of (doc_id, text, source) by systematic sampling along size and doc_id."""
    size = {d: len(words(t)) for d, t, _ in rows}
    sources = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total = {s: sum(size[d] for d, _, of in rows if of == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(sources)
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    target |= {s: share * weight[s] for s in open_}
    copies = {}
    for s in sources:
        offset = int(hashlib.md5(f"17:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        ratio = target[s] / total[s] if total[s] else 0.0
        for rank, d in enumerate(sorted((d for d, _, of in rows if of == s), key=lambda d: (size[d], d)), 1):
            copies[d] = math.floor(rank * ratio + offset) - math.floor((rank - 1) * ratio + offset)
    return {d: c for d, c in copies.items() if c}


def test_run_equals_the_plain_version(spark):
    """Every stage by itself in plain Python; no operator of the pipeline is asked."""
    from tests.llm.conftest import WORD
    from tests.llm.test_contracts import brute_components

    words = lambda text: WORD.findall(text or "")
    texts, seen = [], set()
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        if plain_quality(r["text"], words) and normal not in seen:
            seen.add(normal)
            texts.append((r["doc_id"], r["text"], r["source"]))
    single = {d for d, _, c in brute_components(texts, words) if d == c}
    want = plain_mix([row for row in texts if row[0] in single], words)
    got: dict[int, int] = {}
    lengths = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        lengths[r["doc_id"]] = r["n_ids"]
        assert r["same"]
    assert got == want
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=registry.TOKENIZER)
    assert all(lengths[d] == len(sp.encode(t)) for d, t, _ in texts if d in got)
