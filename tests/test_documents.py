"""Documents and tables of text: whole graphs as lines, numbers as their values round."""

import json

import duckdb
from pyspark.sql import functions as F

from weftmark.functions.scalars import fixed, round_scaled
from weftmark.operators import export, metadata, rights


def test_documents_are_made_of_lines_that_no_row_holds_whole(spark):
    names = ['say "hi"', "a\\b", *[f"m{i:03d}" for i in range(300)]]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    rows = [(names[i // 2], names[i], "sft", 0.5 + i / 1000) for i in range(1, 302)]
    edges = spark.createDataFrame(rows, "parent string, child string, relation string, confidence double")
    lines = export.graph_json(nodes, edges).orderBy("part", "line_no").collect()
    assert max(len(r["line"]) for r in lines) < 100 and len(lines) == 302 + 301 + 1 + 4
    doc = json.loads("".join(r["line"] for r in lines))
    assert sorted(doc["nodes"]) == sorted(names) and doc["roots"] == ['say "hi"']
    assert sorted((e["parent"], e["child"], e["relation"], e["confidence"]) for e in doc["edges"]) == sorted(rows)
    facts = rights.facts(spark.createDataFrame([(n, "mit") for n in names], "model string, declared string"))
    none = rights.conflicts(facts, edges)
    lines = export.bom(names[0], facts, edges, none).orderBy("part", "line_no").collect()
    doc = json.loads("".join(r["line"] for r in lines))
    assert doc["target"] == names[0] and len(doc["components"]) == 302 and len(doc["relationships"]) == 301 and doc["conflicts"] == [] and doc["disclaimer"] == rights.DISCLAIMER


def test_decimals_are_those_of_the_value_not_of_its_text(spark):
    values = [0.695, 0.125, 0.5, 0.0, 2.43, 1e-9, 123456.789]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(fixed(F.col("v"), 2).alias("x")).collect()]
    assert got == ["0.69", "0.13", "0.50", "0.00", "2.43", "0.00", "123456.79"]
    con = duckdb.connect()
    many = [(i * 5 + 0.0) / 1000 for i in range(600)] + [1 + 2 * (i / 10000 + 0.0025) for i in range(2500)]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in many], "v double").select(fixed(F.col("v"), 2).alias("x")).collect()]
    assert got == [con.execute("select round((?::double)::decimal(38, 17), 2)::varchar", [v]).fetchone()[0] for v in many]


def test_confidences_are_rounded_as_in_sql(spark):
    halves = [(2 * i + 1) / 2000000 + 0.6 for i in range(3000)]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in halves], "v double").select(round_scaled(F.col("v"), 6).alias("x")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in halves]


def test_global_features_beyond_a_sketch_are_whole(spark):
    rows = [("m", "model.embed_tokens.weight", "BF16", [100, 4]), ("m", "model.layers.0.mlp.up_proj.weight", "BF16", [400, 4])]
    meta = metadata.model_meta(spark.createDataFrame(rows, "model string, tensor string, dtype string, shape array<long>"))
    whole = metadata.global_features(meta, F.lit(0.5), limit=None).collect()[0]["globals"]
    assert whole[6] == 12.5 and metadata.global_features(meta, F.lit(0.5)).collect()[0]["globals"][6] == 10.0
