"""Text sources: universes of model references and ground-truth documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_reference(line: Column) -> Column:
    """A line without comment, blanks, trailing commas and quotes; null if nothing is left."""
    s = F.trim(F.substring_index(line, "#", 1))
    s = F.regexp_replace(s, "^,+|,+$", "")
    s = F.regexp_replace(F.regexp_replace(s, '^"+|"+$', ""), "^'+|'+$", "")
    return F.nullif(s, F.lit(""))


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """First occurrence of every value, with its place."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias(order))


def universe(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(ref, line_no) of a universe given as numbered lines."""
    return ordered_distinct(lines.select(clean_reference(F.col(line)).alias("ref"), order), "ref", order)


def universe_file(spark: SparkSession, path: str) -> DataFrame:
    """A universe file: lines, or a JSON list, or an object with ``models`` or ``universe``."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("doc"))
    entry = "struct<path:string,id:string,model_id:string>"
    as_json = whole.where(F.substring("doc", 1, 1).isin("{", "[")).select(
        F.when(F.substring("doc", 1, 1) == "[", F.concat(F.lit('{"models":'), F.col("doc"), F.lit("}"))).otherwise(F.col("doc")).alias("doc")
    )
    names = F.coalesce(F.from_json("doc", "models array<string>")["models"], F.from_json("doc", "universe array<string>")["universe"])
    listed = as_json.select(F.posexplode(names).alias("line_no", "item"))
    rich = F.from_json("item", entry)
    ref = F.when(F.substring("item", 1, 1) == "{", F.coalesce(rich["path"], rich["id"], rich["model_id"])).otherwise(F.col("item"))
    plain = whole.where(~F.substring("doc", 1, 1).isin("{", "[")).select(F.posexplode(F.split("doc", "\r?\n")).alias("line_no", "line"))
    return ordered_distinct(listed.select(ref.alias("ref"), "line_no").unionByName(plain.select(clean_reference(F.col("line")).alias("ref"), "line_no")), "ref", "line_no")


def ground_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """models, edges and pairs of a ground-truth JSON document; pairs with unknown ids go, absent pairs are made."""
    doc = spark.read.json(path, multiLine=True)
    models = doc.select(F.explode("models").alias("m")).select("m.*")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    ids = models.select("id")
    if "pairs" in doc.columns:
        pairs = doc.select(F.explode("pairs").alias("p")).select("p.*")
        pairs = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    else:
        a, b = models.select(F.col("id").alias("a"), F.col("family").alias("fa")), models.select(F.col("id").alias("b"), F.col("family").alias("fb"))
        pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("fa") == F.col("fb")).alias("related"))
    return {"models": models, "edges": edges, "pairs": pairs}


# Free-form relation words and what they stand for, in order of the substring search.
RELATIONS = {
    "sft": "sft", "ft": "sft", "finetune": "sft", "finetuned": "sft", "fine_tune": "sft", "fine-tuned": "sft", "instruct": "sft",
    "chat": "sft", "derived": "sft", "dpo": "sft", "rlhf": "sft", "lora": "lora", "peft": "lora", "adapter": "lora",
    "lora_merged": "lora", "qlora": "lora", "cpt": "cpt", "continued_pretraining": "cpt", "continued-pretraining": "cpt",
    "cont_pretrain": "cpt", "pretrain": "cpt", "domain_adapt": "cpt", "quant": "quant", "quantized": "quant", "quantised": "quant",
    "quantization": "quant", "int8": "quant", "int4": "quant", "gptq": "quant", "awq": "quant", "fp8": "quant", "prune": "prune",
    "pruned": "prune", "pruning": "prune", "sparsify": "prune", "magnitude_prune": "prune", "sparse": "prune", "vocab": "vocab",
    "vocab_extended": "vocab", "vocab_extension": "vocab", "vocab_expand": "vocab", "vocab_expanded": "vocab",
    "tokenizer_extended": "vocab", "merge": "merge", "merged": "merge", "slerp": "merge", "ties": "merge", "dare": "merge",
    "linear": "merge", "task_arithmetic": "merge", "distill": "distilled", "distilled": "distilled", "distillation": "distilled",
}
MERGE_METHODS = ("slerp", "ties", "dare", "linear", "task_arithmetic")


def normalize_relation(raw: Column) -> Column:
    """Canonical relation: an exact alias, else the first alias contained, else other."""
    key = F.translate(F.lower(F.trim(raw)), "- ", "__")
    table = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    out = F.when(raw.isNull() | (raw == ""), F.lit("other")).when(F.try_element_at(table, key).isNotNull(), F.try_element_at(table, key))
    for alias, name in RELATIONS.items():
        out = out.when(key.contains(alias), F.lit(name))
    return out.otherwise(F.lit("other"))


def merge_method(*candidates: Column) -> Column:
    """First known method contained in the first candidate that has one."""
    found = []
    for c in candidates:
        out = F.when(F.lit(False), F.lit(""))
        for m in MERGE_METHODS:
            out = out.when(F.lower(c).contains(m), F.lit(m))
        found.append(out)
    return F.coalesce(*found, F.lit("unknown"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place in a (small) ordered document."""
    return df.withColumn("line_no", F.row_number().over(Window.orderBy(*order)))
