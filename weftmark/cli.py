"""Command line: trace, sketch, direction, decompose and index over checkpoint folders.

    python -m weftmark.cli direction /models/a /models/b
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.operators import direction, export, graph, index, merge, phylogeny, rights, sketch
from weftmark.plans.session import local_session
from weftmark.plans.shared import materialize, shared_dir
from weftmark.sources import safetensors, texts


def model_rows(spark: SparkSession, refs: list[str], max_rows: int) -> DataFrame:
    """Sampled rows of checkpoints by their folder names, read once."""
    models = {os.path.basename(r.rstrip("/")): r for r in refs}
    return materialize(safetensors.scan(spark, models, max_rows=max_rows), "cli-rows")


def model_headers(spark: SparkSession, refs: list[str]) -> DataFrame:
    """Tensor headers of checkpoints by their folder names: model, tensor, dtype, shape."""
    models = {os.path.basename(r.rstrip("/")): r for r in refs}
    return materialize(safetensors.scan(spark, models, mode="metadata").select("model", "tensor", "dtype", "shape"), "cli-headers")


def _pair(spark: SparkSession, a: str, b: str) -> DataFrame:
    name = lambda r: os.path.basename(r.rstrip("/"))
    return spark.createDataFrame([(name(a), name(b))], "a string, b string")


def _show(df: DataFrame) -> None:
    """A small report, one JSON object a line."""
    for row in df.collect():
        sys.stdout.write(json.dumps(row.asDict(recursive=True)) + "\n")


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    name = lambda r: os.path.basename(r.rstrip("/"))
    if args.command == "direction":
        rows = model_rows(spark, [args.a, args.b], args.max_rows)
        evidence = direction.collect_evidence(rows, _pair(spark, args.a, args.b), model_headers(spark, [args.a, args.b]))
        found = direction.verdict(direction.features(evidence))
        _show(found.select("a", "b", "direction", "llr", "p", "confidence", direction.evidence_sentences().alias("evidence")))
    elif args.command == "sketch":
        _show(sketch.sketch(model_rows(spark, args.models, args.max_rows)))
    elif args.command == "index":
        universe = index.universe_of(spark, {name(r): r for r in args.models})
        made, failures = index.build(universe, args.cache or f"{shared_dir(spark)}/weftmark-index-cache", max_rows=args.max_rows)
        index.save(made, args.out)
        _show(failures.orderBy("model"))
    elif args.command == "decompose":
        refs = [args.child, *args.candidates, *([args.base] if args.base else [])]
        rows = model_rows(spark, refs, args.max_rows)
        found = merge.decompose(rows, name(args.child), [name(c) for c in args.candidates], name(args.base) if args.base else None)
        sys.stdout.write(json.dumps(found) + "\n")
    else:
        refs = [r["ref"] for r in texts.universe_file(spark, args.universe).orderBy("line_no").collect()]
        target = name(args.target)
        if target not in {name(r) for r in refs}:
            refs.append(args.target)
        found = phylogeny.build(model_rows(spark, refs, args.max_rows), headers=model_headers(spark, refs))
        edges = materialize(graph.trace(found.edges, target), "cli-edges")
        cards = [(name(r), _declared(r)) for r in refs]
        facts = rights.facts(spark.createDataFrame(cards, "model string, declared string"))
        report = rights.conflicts(facts, edges)
        nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).union(spark.createDataFrame([(target,)], "node string")).distinct()
        sys.stdout.write(export.mermaid(nodes, edges, report).collect()[0]["text"] + "\n")
        _show(rights.conflict_order(report))
        if args.bom:
            held = facts.join(nodes.withColumnRenamed("node", "model"), "model", "left_semi")
            lines = export.bom(target, held, edges, report).orderBy("part", "line_no")
            export.write_json(args.bom, json.loads("".join(r["line"] for r in lines.collect())))  # the lineage of one model
        sys.stdout.write(rights.DISCLAIMER + "\n")
    return 0


def _declared(ref: str) -> str | None:
    """License line of a model card, local or remote, if there is one."""
    inside = False
    for line in (safetensors.document(ref, "README.md") or "").splitlines():
        if line.strip() == "---":
            if inside:
                return None
            inside = True
        elif inside and line.startswith("license:"):
            return line.split(":", 1)[1].strip().strip("\"'") or None
    return None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftmark", description="Weight-provenance evidence; never a legal finding.")
    parser.add_argument("--max-rows", type=int, default=2048)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("trace")
    p.add_argument("target")
    p.add_argument("--universe", required=True)
    p.add_argument("--bom")
    p = sub.add_parser("direction")
    p.add_argument("a")
    p.add_argument("b")
    p = sub.add_parser("decompose")
    p.add_argument("child")
    p.add_argument("--candidates", nargs="+", required=True)
    p.add_argument("--base")
    for command in ("sketch", "index"):
        p = sub.add_parser(command)
        p.add_argument("models", nargs="+")
        if command == "index":
            p.add_argument("--out", required=True)
            p.add_argument("--cache", help="folder of headers and sketches that later runs take up")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    spark.sparkContext.setLogLevel("ERROR")
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
