"""Sinks: JSON, Mermaid, DOT, bill of materials and SPDX-shaped documents."""

from __future__ import annotations

import json
import os
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions.scalars import escape_label, fixed, human_bytes, sanitize_id, short_id
from weftmark.operators import graph, rights
from weftmark.operators.ordered import running_sums
from weftmark.plans.shared import materialize


def write_json(path: str, doc: object) -> None:
    """One document, written beside its place and renamed into it."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temp = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, sort_keys=True)
    os.replace(temp, path)


def node_ids(nodes: DataFrame) -> DataFrame:
    """(node, id): sanitised ids; the i-th node (by name) of a collision gets the suffix _i."""
    base = sanitize_id(F.col("node"))
    again = F.row_number().over(Window.partitionBy(base).orderBy("node")) - 1
    return nodes.select("node", F.when(again == 0, base).otherwise(F.concat(base, F.lit("_"), again.cast("string"))).alias("id"))


def edge_label(relation: Column, confidence: Column) -> Column:
    return F.format_string("%s %s", relation, fixed(confidence, 2))


def _lines(parts: list[DataFrame]) -> DataFrame:
    """Lines (section, key, line) in order as one text column."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("section", "key", "line")))
    # a rendered graph is one document: it is meant to be looked at whole
    return every.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def mermaid(nodes: DataFrame, edges: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """One row, the graph as Mermaid text; nodes with a conflict carry a star and their own class."""
    spark = nodes.sparkSession
    ids = node_ids(nodes)
    flagged = rights.touched(conflicts).select(F.col("model").alias("node"), F.lit(True).alias("flag")) if conflicts is not None else spark.createDataFrame([], "node string, flag boolean")
    marked = ids.join(flagged, "node", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    label = F.concat(escape_label(short_id(F.col("node"))), F.when(F.col("flag"), F.lit(" *")).otherwise(F.lit("")))
    head = spark.createDataFrame([(0, "", "graph TD")], "section int, key string, line string")
    body = marked.select(F.lit(1).alias("section"), F.col("node").alias("key"), F.format_string('    %s["%s"]', F.col("id"), label).alias("line"))
    p, c = ids.select(F.col("node").alias("parent"), F.col("id").alias("pid")), ids.select(F.col("node").alias("child"), F.col("id").alias("cid"))
    arrows = edges.join(p, "parent").join(c, "child").select(
        F.lit(2).alias("section"), F.concat_ws("\t", "parent", "child").alias("key"),
        F.format_string('    %s -->|"%s"| %s', F.col("pid"), escape_label(edge_label(F.col("relation"), F.col("confidence"))), F.col("cid")).alias("line"),
    )
    bad = marked.where("flag").select(F.lit(3).alias("section"), F.col("node").alias("key"), F.format_string("    class %s conflict;", F.col("id")).alias("line"))
    top = graph.roots(nodes, edges).join(marked.where("not flag"), "node").select(
        F.lit(4).alias("section"), F.col("node").alias("key"), F.format_string("    class %s root;", F.col("id")).alias("line")
    )
    return _lines([head, body, arrows, bad, top])


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, the graph as DOT text: pen width 1 + 2 * confidence, dashed below one half."""
    spark = nodes.sparkSession
    ids = node_ids(nodes)
    frame = spark.createDataFrame([(0, "", "digraph lineage {"), (0, "1", "  rankdir=TB;"), (9, "", "}")], "section int, key string, line string")
    body = ids.select(F.lit(1).alias("section"), F.col("node").alias("key"), F.format_string('  %s [label="%s"];', F.col("id"), escape_label(short_id(F.col("node")))).alias("line"))
    p, c = ids.select(F.col("node").alias("parent"), F.col("id").alias("pid")), ids.select(F.col("node").alias("child"), F.col("id").alias("cid"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    style = F.when(F.col("confidence") < 0.5, "dashed").otherwise("solid")
    arrows = edges.join(p, "parent").join(c, "child").select(
        F.lit(2).alias("section"), F.concat_ws("\t", "parent", "child").alias("key"),
        F.format_string(
            '  %s -> %s [label="%s", penwidth=%s, style=%s];', F.col("pid"), F.col("cid"),
            escape_label(edge_label(F.col("relation"), F.col("confidence"))), fixed(1 + 2 * conf, 2), style,
        ).alias("line"),
    )
    return _lines([frame, body, arrows])


def _json_lines(head: str, arrays: list[tuple[str, DataFrame]], tail: str) -> DataFrame:
    """(part, line_no, line): lines that make one JSON document, in this order.

    ``arrays`` names the arrays of the document with frames of their elements as JSON text,
    one ``line`` each.  An array is a part: line 0 opens it, its elements follow sorted by
    their text, a comma before all but the first.  Elements are sorted and numbered by
    ranges, so that no task or row holds an array whole.
    """
    spark = arrays[0][1].sparkSession
    opened = [head + f'"{arrays[0][0]}":[', *[f'],"{name}":[' for name, _ in arrays[1:]], "]" + tail]
    frame = spark.createDataFrame([(i, 0, x) for i, x in enumerate(opened)], "part int, line_no long, line string")
    every = reduce(DataFrame.unionAll, [rows.select(F.lit(i).alias("part"), "line", F.lit(1).alias("n")) for i, (_, rows) in enumerate(arrays)])
    placed = running_sums(every, ["part"], [F.col("line")], ["n"])
    line = F.when(F.col("n_upto") == 1, F.col("line")).otherwise(F.concat(F.lit(","), "line"))
    return frame.unionByName(placed.select("part", F.col("n_upto").alias("line_no"), line.alias("line")))


def elements(lines: DataFrame, part: int, kind: str) -> DataFrame:
    """The elements ``x`` of an array of :func:`bom` or :func:`graph_json`, read back line by line."""
    text = F.concat(F.lit("["), F.regexp_replace("line", "^,", ""), F.lit("]"))
    own = lines.where((F.col("part") == part) & (F.col("line_no") > 0))
    return own.select(F.get(F.from_json(text, f"array<{kind}>"), 0).alias("x"))


def _objects(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def _strings(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.regexp_replace(F.to_json(F.array(column)), r"^\[|\]$", "").alias("line"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line_no, line): the graph as the lines of a JSON document; parts 0 to 2 are nodes, edges and roots."""
    arrays = [("nodes", _strings(nodes, "node")), ("edges", _objects(edges, "parent", "child", "relation", "confidence")), ("roots", _strings(graph.roots(nodes, edges), "node"))]
    return _json_lines("{", arrays, "}")


def bom_components(facts: DataFrame, target: str) -> DataFrame:
    """Components of a bill of materials; every model but the target is inferred."""
    return facts.select("model", "license", "spdx", "commercial_use", (F.col("model") != target).alias("inferred"))


def bom(target: str, facts: DataFrame, edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(part, line_no, line): the bill of materials as the lines of a JSON document; parts 0 to 2 are components, relationships and conflicts."""
    arrays = [
        ("components", _objects(bom_components(facts, target), "model", "license", "spdx", "commercial_use", "inferred")),
        ("relationships", _objects(edges, "parent", "child", "relation", "confidence")),
        ("conflicts", _objects(conflicts, "descendant", "ancestor", "kind", "severity", "confidence")),
    ]
    return _json_lines(f'{{"target":{json.dumps(target)},', arrays, f',"disclaimer":{json.dumps(rights.DISCLAIMER)}}}')


def spdx_packages(facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """SPDX packages: nothing is concluded where a license is unknown or a conflict touches the model."""
    t = rights.touched(conflicts).withColumn("hit", F.lit(True))
    safe = F.regexp_replace(F.substring(F.regexp_replace("model", "[^A-Za-z0-9.-]+", "-"), 1, 60), "^-+|-+$", "")
    open_ = (F.col("license") == "unknown") | F.coalesce("hit", F.lit(False))
    own = facts.select("model", "license", "spdx", F.lit(0).alias("all"), F.lit(1).alias("n"))
    placed = running_sums(own, ["all"], [F.col("model")], ["n"])
    return placed.join(t, "model", "left").select(
        "model", F.concat(F.lit("SPDXRef-Package-"), (F.col("n_upto") - 1).cast("string"), F.lit("-"), safe).alias("spdx_id"),
        F.col("spdx").alias("license_declared"), F.when(open_, F.lit("NOASSERTION")).otherwise(F.col("spdx")).alias("license_concluded"),
    )


def spdx_relationships(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GENERATED_FROM for merges, DESCENDANT_OF otherwise, and DESCRIBES for roots."""
    kind = F.when(F.col("relation") == "merge", "GENERATED_FROM").otherwise("DESCENDANT_OF")
    own = edges.select(F.col("child").alias("element"), kind.alias("type"), F.col("parent").alias("related"))
    return own.unionByName(graph.roots(nodes, edges).select(F.lit("document").alias("element"), F.lit("DESCRIBES").alias("type"), F.col("node").alias("related")))


def ancestor_tree(edges: DataFrame, target: str, max_depth: int = 16) -> DataFrame:
    """(line_no, line): the ancestors of a model as an indented tree, most confident parents first.

    Level by level, the edges of a level's models meet them by join; a model that is its
    own ancestor is named but not followed, and no branch goes deeper than ``max_depth``.
    """
    by = Window.partitionBy("child")
    own = edges.select("parent", "child", *[F.col(c) if c in edges.columns else F.lit(None).alias(c) for c in ("relation", "confidence", "weight")])
    ranked = own.select(
        "*", F.row_number().over(by.orderBy(F.desc("confidence"), "parent")).alias("i"), F.count(F.lit(1)).over(by).alias("of")
    )
    note = F.concat(
        F.coalesce("relation", F.lit("derived")), F.format_string(" at %s", fixed(F.coalesce("confidence", F.lit(0.0)), 2)),
        F.when(F.col("weight").isNull(), "").otherwise(F.format_string(", weight %s", fixed(F.col("weight"), 2))),
    )
    ranked = materialize(ranked.select("parent", "child", "i", (F.col("i") == F.col("of")).alias("last"), note.alias("note")), "tree-edges")
    spark = edges.sparkSession
    kind = "node string, at array<int>, prefix string, path array<string>, line string, open boolean"
    levels = [materialize(spark.createDataFrame([(target, [], "", [target], None, True)], kind).withColumn("line", short_id(F.col("node"), 60)), "tree-level")]
    for _ in range(max_depth):
        up = levels[-1].where("open").withColumnRenamed("node", "child").drop("line", "open").join(ranked, "child")
        line = F.concat("prefix", F.when(F.col("last"), "`-- ").otherwise("|-- "), short_id(F.col("parent"), 48), F.lit(": "), "note")
        up = up.select(
            F.col("parent").alias("node"), F.array_append("at", F.col("i")).alias("at"), F.concat("prefix", F.when(F.col("last"), "    ").otherwise("|   ")).alias("prefix"),
            F.array_append("path", F.col("parent")).alias("path"), line.alias("line"), (~F.array_contains("path", F.col("parent"))).alias("open"),
        )
        up = materialize(up, "tree-level")
        if up.isEmpty():
            break
        levels.append(up)
    else:
        cut = levels[-1].where("open").join(ranked.select(F.col("child").alias("node")).distinct(), "node", "left_semi")
        levels.append(cut.select("node", F.array_append("at", F.lit(1)).alias("at"), "prefix", "path", F.concat("prefix", F.lit("`-- (earlier ancestors left out)")).alias("line"), F.lit(True).alias("open")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    loops = every.where("not open").select("node", F.array_append("at", F.lit(0)).alias("at"), "prefix", "path", F.concat("prefix", F.lit("    (named above, not followed)")).alias("line"), F.lit(True).alias("open"))
    lines = every.unionByName(loops)
    if len(levels) == 1:
        lines = lines.unionByName(lines.withColumns({"at": F.array(F.lit(1)), "line": F.lit("`-- (no parent found)")}))
    # a tree is one document: it is meant to be read from top to bottom
    return lines.select(F.row_number().over(Window.orderBy("at")).alias("line_no"), "line")


def _wrapped(text: Column, width: int, indent: str) -> Column:
    """Lines of at most ``width`` characters, words kept whole."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    longer = lambda acc, w: F.concat_ws(" ", F.nullif(acc["open"], F.lit("")), w)
    step = lambda acc, w: F.when(
        F.length(longer(acc, w)) <= width, F.struct(acc["done"].alias("done"), longer(acc, w).alias("open"))
    ).otherwise(F.struct(F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), w.alias("open")))
    full = F.aggregate(words, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.transform(F.filter(full, lambda x: x != ""), lambda x: F.concat(F.lit(indent), x))


def _report_order() -> Window:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    return Window.orderBy(rank, F.desc("confidence"), "descendant", "ancestor", "kind")


def conflict_lines(conflicts: DataFrame) -> DataFrame:
    """(line_no, line): conflicts as text, severity first: a heading, the wrapped message and the path; one line if there is none."""
    head = F.format_string("%s: %s at %s", F.upper("severity"), "kind", fixed(F.col("confidence"), 2))
    path = F.concat(F.lit("    along "), F.array_join(F.transform("path", lambda x: short_id(x, 28)), " -> "))
    block = F.concat(F.array(head), _wrapped(F.col("message"), 72, " " * 4), F.when(F.size("path") > 0, F.array(path)).otherwise(F.array().cast("array<string>")))
    placed = conflicts.select(F.row_number().over(_report_order()).alias("n"), block.alias("block"))
    lines = placed.select("n", F.posexplode("block").alias("i", "line"))
    none = conflicts.sparkSession.createDataFrame([(0, 0, "no conflict")], "n int, i int, line string")
    lines = lines.unionAll(none.join(conflicts.limit(1).agg(F.count(F.lit(1)).alias("c")).where("c = 0")).drop("c"))  # one row each
    return lines.select(F.row_number().over(Window.orderBy("n", "i")).alias("line_no"), "line")


def conflict_rows(conflicts: DataFrame) -> DataFrame:
    """(line_no, line): rows of a Markdown table severity, kind, confidence, detail."""
    detail = F.translate(F.col("message"), "|\n", "/ ")
    line = F.format_string("| **%s** | `%s` | %s | %s |", F.upper("severity"), "kind", fixed(F.col("confidence"), 2), detail)
    return conflicts.select(F.row_number().over(_report_order()).alias("line_no"), line.alias("line"))


def mixing_rows(edges: DataFrame) -> DataFrame:
    """(line_no, line): rows of a Markdown table child, parent, mixing weight, confidence; merges only."""
    line = F.format_string("| `%s` | `%s` | %s | %s |", short_id(F.col("child"), 40), short_id(F.col("parent"), 40), fixed(F.col("weight"), 3), fixed(F.col("confidence"), 2))
    return edges.where("weight is not null").select(F.row_number().over(Window.orderBy("child", F.desc("weight"), "parent")).alias("line_no"), line.alias("line"))


def transfer_line(seconds: Column, bytes_: Column, full_size: Column, requests: Column) -> Column:
    """What a scan read of how much, and how many times less; from the columns of a metered scan."""
    took = F.format_string(", %.1f s", seconds.cast("double"))
    asked = F.format_string(", %d requests", requests.cast("long"))
    less = F.format_string(" out of %s (a share of 1 in %.0f)", human_bytes(full_size), F.try_divide(full_size, F.greatest(bytes_, F.lit(1))).cast("double"))
    known = F.concat(F.lit("read "), human_bytes(bytes_), F.when(full_size > 0, less).otherwise(F.lit("")), took, asked)
    return F.when(bytes_ > 0, known).otherwise(F.concat(F.lit("bytes not counted"), took))


def report(target: str, edges: DataFrame, conflicts: DataFrame, transfer: DataFrame | None = None, universe: int = 0) -> DataFrame:
    """(line_no, line): a Markdown report of lineage, mixing weights, license warnings and transfer.

    ``transfer`` is a frame (bytes, requests, seconds, full_size) as ``metrics.transfer_totals`` sums it.
    """
    spark = edges.sparkSession
    fixed = lambda section, *lines: spark.createDataFrame([(section, i, x) for i, x in enumerate(lines)], "section int, line_no int, line string")
    part = lambda section, rows: rows.select(F.lit(section).alias("section"), "line_no", "line")
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    kept = nodes.agg(F.count(F.lit(1)).alias("n")).join(edges.agg(F.count(F.lit(1)).alias("e"))).select(  # one row each
        F.lit(9).alias("section"), F.lit(0).alias("line_no"), F.format_string(f"{universe} candidates, of which %d in the lineage, by %d edges", "n", "e").alias("line")
    )
    parts = [
        fixed(0, f"# {target}", "", "```"), part(1, ancestor_tree(edges, target)), fixed(2, "```", "", "| merge | part | weight | confidence |", "| --- | --- | ---: | ---: |"),
        part(3, mixing_rows(edges)), fixed(4, "", "## Terms to review", "", "| severity | kind | confidence | detail |", "| --- | --- | ---: | --- |"), part(5, conflict_rows(conflicts)),
        fixed(6, "", rights.DISCLAIMER, "", "## Read", ""), kept,
    ]
    if transfer is not None:
        parts.append(transfer.select(F.lit(8).alias("section"), F.lit(0).alias("line_no"), F.concat(F.lit("`"), transfer_line(F.col("seconds"), F.col("bytes"), F.col("full_size"), F.col("requests")), F.lit("`")).alias("line")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select(F.row_number().over(Window.orderBy("section", "line_no", "line")).alias("line_no"), "line")
