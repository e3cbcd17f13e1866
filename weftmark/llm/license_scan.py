"""License scan with a positional rare-token index.

Templates are the notices and texts that licences ask to be kept, with key phrases that
must stand in them.  A first pass counts in how many documents each template word occurs;
the index then holds the postings (template, position) of every template's words with
the highest inverse document frequency.  The second pass looks each file's words up in
that index and turns every hit into a template start (file position minus template
position).  A start on which two rare words agree, however far apart they stand, is an
alignment; it is verified if all key phrases of the template stand there, each at its
place or up to SLACK words off, so that an inserted name or a lost word does not hide a
licence.  All of it is row-local SQL over the word array.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.license_templates import TEMPLATES, Template

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Words of a template in the index, rare words that make an alignment, and words a key phrase may be off its place.
RARE, AGREE, SLACK = 6, 2, 8


def words_of(text: Column) -> Column:
    """Lower-case (A-Z) words of letters, digits and everything beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lowered, BREAK), lambda w: w != "")


def template_words(template: Template) -> list[str]:
    return [w for w in re.split(BREAK, template.text.lower()) if w]


def _place(template: Template, phrase: str) -> int:
    """Where a key phrase begins in its template."""
    words, part = template_words(template), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, over all documents, and their number.

    The result has one row per word of the templates: its size does not grow with the input.
    """
    vocabulary = sorted({w for t in TEMPLATES for w in template_words(t)})
    known = F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(vocabulary)))
    found = df.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("w"))
    by_word = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    total = by_word.pop("", 0)
    return by_word, total


def build_index(frequencies: dict[str, int], total: int, rare: int = RARE) -> dict[str, list[tuple[int, int]]]:
    """word -> postings (template, position), for each template's ``rare`` words of highest IDF."""
    idf = lambda w: math.log((total + 1) / (frequencies.get(w, 0) + 1))
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(TEMPLATES):
        words = template_words(template)
        chosen = set(sorted(set(words), key=lambda w: (-idf(w), -len(w), w))[:rare])
        for place, word in enumerate(words):
            if word in chosen:
                index.setdefault(word, []).append((number, place))
    return index


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    held = F.get(words, at) == phrase[0]
    for j, word in enumerate(phrase[1:], 1):
        held = held & F.coalesce(F.get(words, at + j) == word, F.lit(False))
    return F.coalesce(held, F.lit(False))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def license_scan(df: DataFrame, text: str = "text", key: str = "doc_id", rare: int = RARE) -> DataFrame:
    """One row per document: ``key``, n_words, base (array of place, label), found, score.

    ``base`` lists every place where a base phrase stands; ``found`` lists verified
    template alignments (label, start, score), where score is the share of template
    words that stand exactly in place.  ``score`` is the best of these, 0.5 at least with a
    base place, else 0.  Null text counts as empty: no words, empty lists, score 0.
    Texts are read whole, however long, and every alignment in them is judged.
    Rows are scanned on their own, so repeated rows and null keys pass through;
    other columns are ignored whatever their names; an empty table gives an empty
    result.
    """
    frequencies, total = document_frequencies(df, text)
    index = build_index(frequencies, total, rare)
    heads = {p.split()[0] for p in PHRASES}
    probes = sorted(heads | set(index))

    rows = df.select(F.col(key).alias("k"), words_of(F.col(text)).alias("words"))
    places = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(probes), i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumn("places", places)
    words = F.col("words")
    rows = rows.withColumn("hits", F.transform("places", lambda i: F.struct(F.get(words, i).alias("w"), i.alias("i"))))

    def base_label(x: Column) -> Column:
        named = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            named = F.when(_stands(words, x["i"], phrase.split()), F.lit(name)).otherwise(named)
        return named

    base = F.filter(
        F.transform("hits", lambda x: F.struct(x["i"].cast("long").alias("place"), base_label(x).alias("label"))),
        lambda b: b["label"].isNotNull(),
    )

    # the index as two arrays: its words, and each word's postings
    names = sorted(index)
    lists = F.array(*[F.array(*[F.struct(F.lit(t).alias("template"), F.lit(p).alias("place")) for t, p in index[n]]) for n in names])

    def postings(x: Column) -> Column:
        of = F.get(lists, F.array_position(_strings(names), x["w"]).cast("int") - 1)
        return F.transform(of, lambda p: F.struct(p["template"].alias("template"), (x["i"] - p["place"]).alias("start")))

    rows = rows.withColumn("base", base)
    indexed = F.filter("hits", lambda x: x["w"].isin(names))
    # votes in order: a start is agreed where its run is as long as it must be
    rows = rows.withColumn("votes", F.sort_array(F.flatten(F.transform(indexed, postings))))
    agreed = F.filter(
        "votes",
        lambda c, i: F.coalesce(F.get(F.col("votes"), i + (AGREE - 1)) == c, F.lit(False))
        & ~F.coalesce(F.get(F.col("votes"), i - 1) == c, F.lit(False)),
    )
    rows = rows.withColumn("agreed", agreed)

    phrases = F.array(
        *[
            F.array(*[F.struct(F.lit(_place(t, p)).alias("place"), _strings(p.split()).alias("words")) for p in t.mandatory])
            for t in TEMPLATES
        ]
    )
    shifts = F.sequence(F.lit(-SLACK), F.lit(SLACK))

    def verified(c: Column) -> Column:
        return F.forall(
            F.get(phrases, c["template"]),
            lambda p: F.exists(
                shifts,
                lambda d: (c["start"] + p["place"] + d >= 0)
                & (F.slice(words, F.greatest(F.lit(1), c["start"] + p["place"] + d + 1), F.size(p["words"])) == p["words"]),
            ),
        )

    texts = F.array(*[_strings(template_words(t)) for t in TEMPLATES])
    labels = _strings([t.label for t in TEMPLATES])

    def share(c: Column) -> Column:
        whole = F.get(texts, c["template"])
        same = F.filter(F.transform(whole, lambda w, j: F.get(words, c["start"] + j) == w), lambda x: x)
        return F.size(same) / F.size(whole).cast("double")

    found = F.transform(
        F.filter("agreed", verified),
        lambda c: F.struct(F.get(labels, c["template"]).alias("label"), c["start"].cast("long").alias("start"), share(c).alias("score")),
    )
    rows = rows.withColumn("found", found)
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))
    return rows.select(
        F.col("k").alias(key),
        F.size("words").cast("long").alias("n_words"),
        "base",
        "found",
        F.greatest(best, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
