"""A lineage of model families made from ``part`` and ``lineitem``, for the graph and license operators.

Every part is a model; two dozen neighbouring parts are a family.  The lines of a part choose
its parents among the earlier models of its family, and their discounts the confidence of
the edges, so that every result depends on the tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.functions.scalars import round_scaled

FAMILY = 24
RELATIONS = ("sft", "lora", "quant", "prune", "vocab", "distilled")
DECLARED = ("apache-2.0", "mit", "llama2", "cc-by-sa-4.0", None, "cc-by-nc-4.0", "gpl-3.0", "apache-2.0")
#: A model with ancestors, for the operators that ask about one.
TARGET = "part-22"


def _name(key: Column) -> Column:
    return F.concat(F.lit("part-"), key.cast("string"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, place, base, quantity, lines, cents, size): a part with the sums of its lines."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pk"), F.col("p_size").alias("size"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("pk")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("lines"), F.sum(F.rint(F.col("l_discount") * 100).cast("long")).alias("cents")
    )
    place = F.col("pk") % FAMILY
    return part.join(lines, "pk", "left").select(
        "pk", place.alias("place"), (F.col("pk") - place).alias("base"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quantity", "lines", "cents")], "size"
    )


def nodes(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """(node); ``made`` is the table of :func:`models`, if it is written."""
    return (made or models(spark, sf_dir)).select(_name(F.col("pk")).alias("node"))


def _confidence(up: Column, down: Column) -> Column:
    mean = F.coalesce(F.try_divide(F.col("cents").cast("double"), F.col("lines").cast("double")), F.lit(0.0))
    return round_scaled(F.lit(0.45) + F.lit(0.05) * mean + ((up * 13 + down * 7) % 997) / F.lit(100000.0), 6)


def edges(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """(parent, child, relation, weight, confidence) without cycles: up to two parents each, weights for merges."""
    m = (made or models(spark, sf_dir)).where("place > 0")
    nth = F.greatest("place", F.lit(1))
    first, second = F.col("quantity") % nth, (F.col("lines") * 7 + F.col("pk")) % nth
    merge = (first != second) & (F.col("pk") % 4 == 0)
    relation = F.when(merge, "merge").otherwise(F.get(F.array(*[F.lit(r) for r in RELATIONS]), (F.col("pk") % 6).cast("int")))
    share = round_scaled(F.lit(0.55) + (F.col("quantity") % 40) / F.lit(100.0), 6)
    two = F.array(F.struct(first.alias("at"), share.alias("w")), F.struct(second.alias("at"), round_scaled(F.lit(1.0) - share, 6).alias("w")))
    one = F.slice(two, 1, 1)
    e = m.select("*", merge.alias("merge"), relation.alias("relation"), F.explode(F.when(first != second, two).otherwise(one)).alias("p"))
    up = F.col("base") + F.col("p.at")
    return e.select(_name(up).alias("parent"), _name(F.col("pk")).alias("child"), "relation", F.when(F.col("merge"), F.col("p.w")).alias("weight"), _confidence(up, F.col("pk")).alias("confidence"))


def back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child, confidence) against the lineage: every fifth child points at its first parent."""
    m = models(spark, sf_dir).where("place > 0 and pk % 5 = 0")
    up = F.col("base") + F.col("quantity") % F.greatest("place", F.lit(1))
    conf = round_scaled(F.lit(0.4) + (F.col("quantity") % 50) / F.lit(100.0) + F.col("pk") % 89 / F.lit(10000.0), 6)
    return m.select(_name(F.col("pk")).alias("parent"), _name(up).alias("child"), conf.alias("confidence"))


def family_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): the ordered pairs of every family, a before b by name."""
    m = models(spark, sf_dir).select("base", _name(F.col("pk")).alias("a"))
    return m.join(m.withColumnRenamed("a", "b"), "base").where("a < b").select("a", "b")


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, declared, gated): licenses by the size of a part."""
    names = F.array(*[F.lit(x) for x in DECLARED])
    return models(spark, sf_dir).select(_name(F.col("pk")).alias("model"), F.get(names, (F.col("size") % 8).cast("int")).alias("declared"), (F.col("size") % 25 == 3).alias("gated"))


def predicted(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """(parent, child) as a wrong reader might have it: some edges lost, some turned, some that skip or cross."""
    m = made or models(spark, sf_dir)
    first = F.col("base") + F.col("quantity") % F.greatest("place", F.lit(1))
    kept = edges(spark, sf_dir, made).where("confidence > 0.68").select("parent", "child")
    turned = m.where("place > 0 and pk % 10 = 1").select(_name(F.col("pk")).alias("parent"), _name(first).alias("child"))
    top = m.where("place > 2 and pk % 6 = 0").select(_name(F.col("base")).alias("parent"), _name(F.col("pk")).alias("child"))
    beside = m.where("place > 3 and pk % 7 = 0").select(_name(F.col("pk") - 1).alias("parent"), _name(F.col("pk")).alias("child"))
    across = m.where("place = 5").select(_name(F.col("base") + FAMILY).alias("parent"), _name(F.col("pk")).alias("child"))
    return kept.unionAll(turned).unionAll(top).unionAll(beside).unionAll(across).distinct()


#: The same tables in DuckDB: fm, nodes, edges, back, pairs, fx and pred.
SQL = f"""
ls as (select l_partkey as pk, sum(l_quantity::bigint)::bigint as quantity, count(*) as lines, sum(round_even(l_discount * 100, 0)::bigint)::bigint as cents from lineitem group by l_partkey),
fm as materialized (
  select p_partkey as pk, p_partkey % {FAMILY} as place, p_partkey - p_partkey % {FAMILY} as base, coalesce(quantity, 0) as quantity, coalesce(lines, 0) as lines,
         coalesce(cents, 0) as cents, p_size as size
  from part left join ls on ls.pk = p_partkey
),
nodes as materialized (select 'part-' || pk as node from fm),
f2 as (select *, quantity % greatest(place, 1) as p1, (lines * 7 + pk) % greatest(place, 1) as p2, round(0.55::double + (quantity % 40) / 100::double, 6) as share from fm where place > 0),
f3 as (select pk, base, lines, cents, p1 <> p2 and pk % 4 = 0 as merge, p1 as spot, share as w from f2
       union all select pk, base, lines, cents, pk % 4 = 0, p2, round(1::double - share, 6) from f2 where p1 <> p2),
edges as materialized (
  select 'part-' || (base + spot) as parent, 'part-' || pk as child, case when merge then 'merge' else (['{"', '".join(RELATIONS)}'])[pk % 6 + 1] end as relation,
         case when merge then w end as weight,
         round(0.45::double + 0.05::double * (case when lines = 0 then 0 else cents::double / lines::double end) + (((base + spot) * 13 + pk * 7) % 997) / 100000::double, 6) as confidence
  from f3
),
back as (select 'part-' || pk as parent, 'part-' || (base + quantity % greatest(place, 1)) as child,
                round(0.4::double + (quantity % 50) / 100::double + (pk % 89) / 10000::double, 6) as confidence from fm where place > 0 and pk % 5 = 0),
pairs as (select 'part-' || x.pk as a, 'part-' || y.pk as b from fm x join fm y using (base) where 'part-' || x.pk < 'part-' || y.pk),
fx as (select 'part-' || pk as model, ([{", ".join("null" if d is None else f"'{d}'" for d in DECLARED)}])[size % 8 + 1] as declared, size % 25 = 3 as gated from fm),
pred as materialized (
  select parent, child from edges where confidence > 0.68
  union select 'part-' || pk, 'part-' || (base + quantity % greatest(place, 1)) from fm where place > 0 and pk % 10 = 1
  union select 'part-' || base, 'part-' || pk from fm where place > 2 and pk % 6 = 0
  union select 'part-' || (pk - 1), 'part-' || pk from fm where place > 3 and pk % 7 = 0
  union select 'part-' || (base + {FAMILY}), 'part-' || pk from fm where place = 5
)
"""
#: (ancestor, descendant, depth) of ``edges``, every pair once.
CLOSURE = """
walk(ancestor, descendant, depth) as (
  select distinct parent, child, 1 from edges union select w.ancestor, e.child, w.depth + 1 from walk w join edges e on e.parent = w.descendant
),
up as materialized (select ancestor, descendant, min(depth) as depth from walk group by 1, 2)
"""
