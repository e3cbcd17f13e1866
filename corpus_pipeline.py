"""From raw documents to token ids: the corpus pipeline as a list of stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and
returns a DataFrame that is written as Parquet and read again for the next one.  All but
the last return the columns of ``documents``, whatever else these are and whatever their
names.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmark.llm.exact_dedup import drop_exact_duplicates
from weftmark.llm.jaccard_join import drop_near_duplicates
from weftmark.llm.mixing import take_mix
from weftmark.llm.quality_rules import keep_quality
from weftmark.llm.registry import POLICY, TOKENIZER
from weftmark.llm.sentencepiece_codec import read_model, round_trip
from weftmark.plans.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current rule policy, with all their columns.

    A null or empty text has too few words and goes; nulls elsewhere stay.  Each row is
    judged by itself and whole, however long, so repeated rows share their fate.
    """
    return keep_quality(docs, POLICY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal normalised texts, that with the smallest doc_id.

    Null counts as empty, a null doc_id comes after all others, and of rows that repeat a
    doc_id one stays.  Very long texts are hashed whole.
    """
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of documents at Jaccard similarity 0.75 or more, the smallest doc_id.

    Texts without words link with nothing and stay.  Of rows that repeat a doc_id one
    stays.  Very long texts are compared by all their shingles.
    """
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    A null source is a source of its own; a document without words has size 0; ties are
    ordered by doc_id and then by hashes of the whole row.
    """
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, and whether decoding gives the text back; a row per copy of a document.

    Null text gives null ids.  Every character of a text, however long, is encoded.
    """
    return round_trip(docs, read_model(TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("mixing to target weights", mixture),
    ("sentencepiece encoding", tokens),
]

#: The last stage has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
