"""Queries over the derived lineage: geometry, direction, merges, simulation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.operators import baselines, blocks, direction, graph, merge, metrics, pairs, selection, simulate, sketch, stats
from weftmark.plans.catalog import register
from weftmark.plans.shared import materialize, shared_dir
from weftmark.sources import lineage, safetensors

L = lineage.ORACLE


def r6(c) -> F.Column:
    """Six decimals without a negative zero, so that sums in any order agree."""
    return F.round(c, 6) + F.lit(0.0)


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tensor_rows(spark, sf_dir)


def all_models(spark: SparkSession, name: str = "model") -> DataFrame:
    return spark.createDataFrame([(m,) for m in lineage.MODELS], f"{name} string").coalesce(1)


def model_pairs(spark: SparkSession) -> DataFrame:
    return pairs.unordered_pairs(all_models(spark))


def ordered_models(spark: SparkSession) -> DataFrame:
    return pairs.ordered_pairs(all_models(spark))


def model_triples(spark: SparkSession, third: str) -> DataFrame:
    """All pairs a < b with every other model."""
    p = model_pairs(spark)
    return p.join(all_models(spark, third), (F.col(third) != F.col("a")) & (F.col(third) != F.col("b")))


_MODELS_SQL = f"(select unnest({list(lineage.MODELS)}) as m)"
_ORDERED_SQL = f"p as (select x.m as a, y.m as b from {_MODELS_SQL} x join {_MODELS_SQL} y on x.m <> y.m)"
_PAIR_SQL = f"p as (select x.m as a, y.m as b from {_MODELS_SQL} x join {_MODELS_SQL} y on x.m < y.m)"
_TRIPLE_SQL = f"t as (select x.m as a, y.m as b, z.m as r from {_MODELS_SQL} x join {_MODELS_SQL} y on x.m < y.m join {_MODELS_SQL} z on z.m <> x.m and z.m <> y.m)"

PAIRS_SQL = f"""
pairs as (select a.m as a, b.m as b from (select unnest({list(lineage.MODELS)}) as m) a join (select unnest({list(lineage.MODELS)}) as m) b on a.m < b.m),
st as materialized (
  select p.a, p.b, x.tensor, sum(x.x * y.x) as ab, sum(x.x * x.x) as aa, sum(y.x * y.x) as bb, sum((x.x - y.x) * (x.x - y.x)) as dd,
         count(*) as n, bool_and(x.x = y.x) as same
  from pairs p join cells x on x.model = p.a join cells y on y.model = p.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c
  group by all
)"""


@register("j03_a01_pair_tensor_stats", f"""
with {L}, {PAIRS_SQL}
select a, b, tensor, round(ab, 6) + 0 as dot, round(sqrt(aa), 6) + 0 as norm_a, round(sqrt(bb), 6) + 0 as norm_b,
       round(dd, 6) + 0 as squared_difference, n as cells, same as identical from st
""")
def pair_tensor_stats(spark, sf_dir):
    s = pairs.pair_tensor_stats(rows_of(spark, sf_dir), model_pairs(spark))
    return s.select(
        "a", "b", "tensor", r6("ab").alias("dot"), r6(F.sqrt("aa")).alias("norm_a"), r6(F.sqrt("bb")).alias("norm_b"),
        r6("dd").alias("squared_difference"), F.col("cells").cast("long"), "identical",
    )


@register("c15_c24_k14_pair_distances", f"""
with {L}, {PAIRS_SQL}, s as (select a, b, sum(ab) as ab, sum(aa) as aa, sum(bb) as bb, sum(dd) as dd from st group by all)
select a, b, round(ab / sqrt(aa * bb), 6) + 0 as cosine, round((1 + ab / sqrt(aa * bb)) / 2, 6) + 0 as cosine_score,
       round(sqrt(dd) / sqrt(bb), 6) + 0 as relative_delta, round(sqrt(dd) / ((sqrt(aa) + sqrt(bb)) / 2), 6) + 0 as scaled_distance from s
""")
def pair_distances(spark, sf_dir):
    p = pairs.pooled(pairs.pair_tensor_stats(rows_of(spark, sf_dir), model_pairs(spark)))
    return p.select(
        "a", "b", r6("cosine").alias("cosine"), r6((1 + F.col("cosine")) / 2).alias("cosine_score"),
        r6("relative_delta").alias("relative_delta"), r6("scaled_distance").alias("scaled_distance"),
    )


@register("c07_relatedness", f"""
with {L}, {PAIRS_SQL}, s as (select a, b, sum(ab) as ab, sum(aa) as aa, sum(bb) as bb, sum(dd) as dd, avg(same::int) as same from st group by all),
v as (select model, tensor, c, avg(x) as x from cells group by all),
k as (select x.model as a, y.model as b, greatest(0, least(2, 1 - sum(x.x * y.x) / sqrt(sum(x.x * x.x) * sum(y.x * y.x)))) as d from v x join v y on y.tensor = x.tensor and y.c = x.c group by all)
select a, b, round(0.30::double * greatest(0, least(1, 1 - d / 2)) + 0.55::double * (0.5::double * greatest(0, least(1, ab / sqrt(aa * bb)))
       + 0.5::double * greatest(0, least(1, 1 - sqrt(dd) / ((sqrt(aa) + sqrt(bb)) / 2) / sqrt(2)))) + 0.15::double * same, 6) + 0 as relatedness from s join k using (a, b)
""")
def relatedness(spark, sf_dir):
    """With the similarity of the models' mean vectors, which SQL can repeat; c28_phylogeny takes the sketches."""
    rows = rows_of(spark, sf_dir)
    index = materialize(sketch.mean_vectors(rows), "query-means")
    near = sketch.search(index, index, len(lineage.MODELS)).select(F.col("query").alias("a"), F.col("hit").alias("b"), "distance")
    p = pairs.pooled(pairs.pair_tensor_stats(rows, model_pairs(spark))).join(near, ["a", "b"])
    return pairs.relatedness(p, sketch.sketch_similarity(F.col("distance"))).select("a", "b", r6("relatedness").alias("relatedness"))


@register("j01_j02_p26_shared_tensors", f"""
with {L}, t as (select model, tensor, count(distinct r) as n_rows, count(distinct c) as n_cols from cells
  where not (model = 'int8' and tensor = 'lm_head.weight') group by all),
{_PAIR_SQL}
select p.a, p.b, coalesce(x.tensor, y.tensor) as tensor, case when y.tensor is null then 'only a' when x.tensor is null then 'only b' else 'shared' end as held,
       case when x.tensor is not null and y.tensor is not null then least(x.n_rows, y.n_rows) else 0 end as n_rows
from p join (select distinct tensor from t) n on true left join t x on x.model = p.a and x.tensor = n.tensor left join t y on y.model = p.b and y.tensor = n.tensor
where x.tensor is not null or y.tensor is not null
""")
def shared_tensors(spark, sf_dir):
    rows = rows_of(spark, sf_dir).where("not (model = 'int8' and tensor = 'lm_head.weight')")
    t = pairs.tensors_of(rows)
    p = model_pairs(spark)
    both = pairs.shared_tensors(t, p).select("a", "b", "tensor", F.lit("shared").alias("held"), "n_rows")
    one = pairs.only_in_one(t, p).select("a", "b", "tensor", F.concat(F.lit("only "), "side").alias("held"), F.lit(0).cast("long").alias("n_rows"))
    return both.unionByName(one)


@register("j05_common_tensors", f"""
with {L}, t as (select model, tensor, count(*) as numel from cells where not (model = 'int8' and tensor = 'lm_head.weight') group by all)
select tensor, max(numel) as numel from t group by tensor having count(*) = 8
""")
def common_tensors(spark, sf_dir):
    rows = rows_of(spark, sf_dir).where("not (model = 'int8' and tensor = 'lm_head.weight')")
    return selection.common_tensors(pairs.tensors_of(rows), 16)


@register("c17_reconstruction", f"""
with {L}, {_ORDERED_SQL}
select p.a, p.b, round(sqrt(sum(case when y.x <> 0 then (x.x - y.x) * (x.x - y.x) else 0 end)) / sqrt(sum(case when y.x <> 0 then y.x * y.x else 0 end)), 6) + 0 as residual
from p join cells x on x.model = p.a join cells y on y.model = p.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c group by all
""")
def reconstruction(spark, sf_dir):
    return pairs.reconstruction_residual(rows_of(spark, sf_dir), ordered_models(spark)).select("a", "b", r6("residual").alias("residual"))


@register("c18_j04_cousin_score", f"""
with {L}, {_TRIPLE_SQL}
select t.a, t.b, t.r, round(sum((x.x - z.x) * (y.x - z.x)) / sqrt(sum((x.x - z.x) * (x.x - z.x)) * sum((y.x - z.x) * (y.x - z.x))), 6) + 0 as cousin
from t join cells x on x.model = t.a join cells y on y.model = t.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c
join cells z on z.model = t.r and z.tensor = x.tensor and z.r = x.r and z.c = x.c group by all
""")
def cousin(spark, sf_dir):
    return pairs.cousin_scores(rows_of(spark, sf_dir), model_triples(spark, "r")).select("a", "b", "r", r6("cousin").alias("cousin"))


_DELTA_SQL = f"""{PAIRS_SQL}, s as (select a, b, sum(aa) as aa, sum(bb) as bb, sum(dd) as dd from st group by all),
d as materialized (select a, b, sqrt(dd) / sqrt(bb) as delta from s union all select b, a, sqrt(dd) / sqrt(aa) from s)"""


def all_deltas(spark, sf_dir):
    every = ordered_models(spark)
    return materialize(
        pairs.pooled(pairs.pair_tensor_stats(rows_of(spark, sf_dir), every)).select("a", "b", F.col("relative_delta").alias("delta")), "query-deltas"
    )


@register("j09_plausible_ancestors", f"""
with {L}, {_DELTA_SQL}
select x.a, x.b, y.b as r from d x join d y on y.a = x.a join d z on z.a = x.b and z.b = y.b
where x.a < x.b and y.b <> x.a and y.b <> x.b and y.delta < x.delta and z.delta < x.delta
""")
def plausible(spark, sf_dir):
    return pairs.plausible_ancestors(all_deltas(spark, sf_dir))


@register("c16_proximity_gate", f"""
with {L}, {_DELTA_SQL}, b as (select a, min(delta) as best from d group by a)
select a as child, b as candidate, round(delta, 6) + 0 as delta from d join b using (a) where delta <= greatest(best * 2, 1e-12)
""")
def proximity(spark, sf_dir):
    d = all_deltas(spark, sf_dir).select(F.col("a").alias("child"), F.col("b").alias("candidate"), "delta")
    return pairs.proximity_gate(d, 2.0).select("child", "candidate", r6("delta").alias("delta"))


@register("c19_cousin_veto", f"""
with {L}, {_DELTA_SQL}, p as (select a, b from pairs),
res as (
  select least(q.a, q.b) as a, greatest(q.a, q.b) as b, min(q.v) as v from (
    select u.a, u.b, sqrt(sum(case when y.x <> 0 then (x.x - y.x) * (x.x - y.x) else 0 end)) / sqrt(sum(case when y.x <> 0 then y.x * y.x else 0 end)) as v
    from (select a, b from d) u join cells x on x.model = u.a join cells y on y.model = u.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c group by u.a, u.b
  ) q group by 1, 2
),
tri as (
  select x.a, x.b, y.b as r from d x join d y on y.a = x.a join d z on z.a = x.b and z.b = y.b join res on res.a = x.a and res.b = x.b
  where x.a < x.b and y.b <> x.a and y.b <> x.b and y.delta < x.delta and z.delta < x.delta and res.v > 1e-5
),
sc as (
  select t.a, t.b, t.r, sum((x.x - z.x) * (y.x - z.x)) / sqrt(sum((x.x - z.x) * (x.x - z.x)) * sum((y.x - z.x) * (y.x - z.x))) as v
  from tri t join cells x on x.model = t.a join cells y on y.model = t.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c
  join cells z on z.model = t.r and z.tensor = x.tensor and z.r = x.r and z.c = x.c group by all
)
select p.a, p.b, count(sc.r) > 0 as vetoed from p left join sc on sc.a = p.a and sc.b = p.b and sc.v < 0.15 group by all
""")
def veto(spark, sf_dir):
    return pairs.cousin_veto(rows_of(spark, sf_dir), all_deltas(spark, sf_dir), model_pairs(spark)).select("a", "b", "vetoed")


@register("c14_outgroup", f"""
with {L}, {_TRIPLE_SQL},
g as (
  select t.a, t.b, t.r as c, x.tensor, sqrt(sum((x.x - z.x) * (x.x - z.x)) / sum(z.x * z.x)) as ac, sqrt(sum((y.x - z.x) * (y.x - z.x)) / sum(z.x * z.x)) as bc
  from t join cells x on x.model = t.a join cells y on y.model = t.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c
  join cells z on z.model = t.r and z.tensor = x.tensor and z.r = x.r and z.c = x.c group by all
),
m as (select a, b, greatest(-1, least(1, avg((bc - ac) / (ac + bc)))) as gap from g group by all)
select a, b, round(gap, 6) + 0 as gap, round(greatest(-3, least(3, gap / (3 - 2 * sqrt(2)))), 6) + 0 as outgroup from m
""")
def outgroup(spark, sf_dir):
    o = pairs.outgroup_statistic(rows_of(spark, sf_dir), model_triples(spark, "c"))
    return o.select("a", "b", r6("gap").alias("gap"), r6("outgroup").alias("outgroup"))


@register("c20_pick_outgroups", f"""
with {L}, {_DELTA_SQL}
select p.a, p.b, x.a as c, row_number() over (partition by p.a, p.b order by x.delta + y.delta, x.a)::int as rank
from pairs p join d x on x.b = p.a join d y on y.b = p.b and y.a = x.a where x.a <> p.a and x.a <> p.b
qualify row_number() over (partition by p.a, p.b order by x.delta + y.delta, x.a) <= 2
""")
def outgroup_pick(spark, sf_dir):
    return pairs.pick_outgroups(all_deltas(spark, sf_dir), model_pairs(spark), 2).select("a", "b", "c", "rank")


@register("k08_c25_cka", f"""
with {L}, {_PAIR_SQL},
f as materialized (
  select model, tensor, r, c, x - avg(x) over (partition by model, tensor, c) as x from cells
),
g as (
  select u.model as a, v.model as b, u.tensor, u.c as i, v.c as j, sum(u.x * v.x) as xy
  from f u join f v on v.tensor = u.tensor and v.r = u.r and v.model >= u.model group by all
),
n as materialized (select a, b, tensor, sum(xy * xy) as xy from g group by all)
select n.a, n.b, n.tensor, round(n.xy / (sqrt(x.xy) * sqrt(y.xy)), 6) + 0 as cka from n join n x on x.a = n.a and x.b = n.a and x.tensor = n.tensor
join n y on y.a = n.b and y.b = n.b and y.tensor = n.tensor where n.a < n.b
""")
def cka(spark, sf_dir):
    return blocks.cka(rows_of(spark, sf_dir), model_pairs(spark)).select("a", "b", "tensor", r6("cka").alias("cka"))


@register("c25_cka_score", f"""
with {L}, {_PAIR_SQL},
f as materialized (
  select model, tensor, r, c, x - avg(x) over (partition by model, tensor, c) as x from cells
),
z as (select tensor, count(*) as cells from cells where model = 'root' group by tensor),
g as (
  select u.model as a, v.model as b, u.tensor, u.c as i, v.c as j, sum(u.x * v.x) as xy
  from f u join f v on v.tensor = u.tensor and v.r = u.r and v.model >= u.model group by all
),
n as materialized (select a, b, tensor, sum(xy * xy) as xy from g group by all)
select n.a, n.b, round(sum(z.cells * n.xy / (sqrt(x.xy) * sqrt(y.xy))) / sum(z.cells), 6) + 0 as score from n join n x on x.a = n.a and x.b = n.a and x.tensor = n.tensor
join n y on y.a = n.b and y.b = n.b and y.tensor = n.tensor join z on z.tensor = n.tensor where n.a < n.b group by n.a, n.b
""")
def cka_score(spark, sf_dir):
    return baselines.cka(rows_of(spark, sf_dir), model_pairs(spark)).select("a", "b", r6("score").alias("score"))


@register("k09_c26_adjacent_products", f"""
with {L}, {_PAIR_SQL}, of(role, tensor) as (values ('q', 'model.layers.0.self_attn.q_proj.weight'), ('k', 'model.layers.0.self_attn.k_proj.weight'),
  ('in', 'model.layers.0.mlp.gate_proj.weight'), ('out', 'model.layers.0.mlp.down_proj.weight')),
w as materialized (select model, role, r, c, x from cells join of using (tensor)),
prod as materialized (
  select 'attn' as block, q.model, q.r as i, k.r as j, sum(q.x * k.x) as x from w q join w k on k.model = q.model and k.c = q.c where q.role = 'q' and k.role = 'k' group by all
  union all select 'mlp', o.model, o.r, n.c, sum(o.x * n.x) from w o join w n on n.model = o.model and n.r = o.c where o.role = 'out' and n.role = 'in' group by all),
s as (select p.a, p.b, x.block, sum(x.x * y.x) / sqrt(sum(x.x * x.x) * sum(y.x * y.x)) as cosine
  from p join prod x on x.model = p.a join prod y on y.model = p.b and y.block = x.block and y.i = x.i and y.j = x.j group by all)
select a, b, round((1 + avg(cosine)) / 2, 6) + 0 as score from s group by a, b
""")
def huref(spark, sf_dir):
    """Attention and MLP products of the layers that all models have; the second has no key matrix."""
    return baselines.huref(rows_of(spark, sf_dir), model_pairs(spark)).select("a", "b", r6("score").alias("score"))


@register("a02_a06_tensor_stats", f"""
with {L}, n as materialized (select model, tensor, r, sqrt(sum(x * x)) as norm, count(*) filter (where x = 0) as z, count(*) as k, sum(x * x) as s from cells group by all),
m as (select model, tensor, quantile_cont(norm, 0.5) as med from n group by all)
select model, tensor, round(sqrt(sum(s)), 6) + 0 as norm, round(sum(z) / sum(k), 6) + 0 as zero_frac, count(*) as n_rows,
       round(avg((norm <= greatest(1e-6, med * 1e-3))::int), 6) + 0 as dead_frac, round(avg((med > 0 and norm > 8 * med)::int), 6) + 0 as outlier_frac,
       round(coalesce(avg(norm) filter (where med > 0 and norm > 8 * med) / max(med), 0), 6) + 0 as sharpness
from n join m using (model, tensor) group by all
""")
def tensor_stats(spark, sf_dir):
    s = stats.tensor_stats(rows_of(spark, sf_dir))
    return s.select("model", "tensor", "n_rows", *[r6(c).alias(c) for c in ("norm", "zero_frac", "dead_frac", "outlier_frac", "sharpness")])


@register("a07_zero_containment", f"""
with {L}, {_PAIR_SQL},
g as (select p.a, p.b, x.tensor, count(*) as n, count(*) filter (where x.x = 0) as za, count(*) filter (where y.x = 0) as zb, count(*) filter (where x.x = 0 and y.x = 0) as zz
  from p join cells x on x.model = p.a join cells y on y.model = p.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c group by all)
select a, b, tensor, n as cells, round(za / n, 6) + 0 as zero_a, round(zb / n, 6) + 0 as zero_b,
       round(case when za = 0 then 1 else zz / za end, 6) + 0 as h_ab, round(case when zb = 0 then 1 else zz / zb end, 6) + 0 as h_ba from g
""")
def zero_containment(spark, sf_dir):
    z = stats.zero_containment(pairs.pair_tensor_stats(rows_of(spark, sf_dir), model_pairs(spark)))
    return z.select("a", "b", "tensor", F.col("cells").cast("long"), *[r6(c).alias(c) for c in ("zero_a", "zero_b", "h_ab", "h_ba")])


@register("a14_a15_a16_row_profile", f"""
with {L}, p as materialized (select model, tensor, r, 64 * sum(x * x * x * x) / (sum(x * x) * sum(x * x)) as p from cells group by all),
k as (select *, row_number() over (partition by model, tensor order by p) as i from p)
select model, tensor, round(2 * sum(i * p) / (count(*) * sum(p)) - (count(*) + 1) / count(*), 6) + 0 as gini, round(quantile_cont(p, 0.05) / avg(p), 6) + 0 as q0, round(quantile_cont(p, 0.1785714285714286) / avg(p), 6) + 0 as q1, round(quantile_cont(p, 0.30714285714285716) / avg(p), 6) + 0 as q2, round(quantile_cont(p, 0.4357142857142857) / avg(p), 6) + 0 as q3, round(quantile_cont(p, 0.5642857142857144) / avg(p), 6) + 0 as q4, round(quantile_cont(p, 0.692857142857143) / avg(p), 6) + 0 as q5, round(quantile_cont(p, 0.8214285714285715) / avg(p), 6) + 0 as q6, round(quantile_cont(p, 0.9500000000000001) / avg(p), 6) + 0 as q7, round(kurtosis_pop(p), 4) + 0 as kurtosis,
       round((avg(p * p * p) - 3 * avg(p) * avg(p * p) + 2 * pow(avg(p), 3)) / pow(stddev_pop(p), 3), 4) + 0 as skewness
from k group by all
""")
def row_profile(spark, sf_dir):
    two = stats.total("v", lambda x: x * x)
    rows = rows_of(spark, sf_dir).select("model", "tensor", (F.size("v") * stats.total("v", lambda x: x * x * x * x) / (two * two)).alias("p"))
    found = stats.profile(rows, ["model", "tensor"], "p")
    return found.select(
        "model", "tensor", r6("gini").alias("gini"), *[r6(f"q{i}").alias(f"q{i}") for i in range(8)],
        (F.round("kurtosis", 4) + 0.0).alias("kurtosis"), (F.round("skewness", 4) + 0.0).alias("skewness"),
    )


LATTICE_SQL = """
lr as (select model, tensor, r, list(x order by c) filter (where x <> 0) as v from cells group by all),
lu as (select *, list_sort(list_distinct(list_transform(v, lambda x: abs(x)))) as u from lr where len(v) >= 8),
lg as (select *, u[len(u)] as amax, list_sort(list_filter(list_transform(range(2, len(u) + 1), lambda i: u[i] - u[i - 1]), lambda x: x > 0)) as g from lu),
ls as (select *, list_distinct(list_transform(list_filter(
    [u[1], g[1]] || list_transform([0.05::double, 0.25::double, 0.5::double], lambda q: g[1 + floor((len(g) - 1) * q)::int]
      + (g[1 + ceil((len(g) - 1) * q)::int] - g[1 + floor((len(g) - 1) * q)::int]) * ((len(g) - 1) * q - floor((len(g) - 1) * q))),
    lambda s: s is not null and s >= amax / 4096 and s <= amax / 3), lambda s: round(s, 18))) as s from lg),
lf as (select *, case when len(u) < 3 then null when len(s) = 0 then 0 else
    list_max(list_transform(s, lambda st: len(list_filter(v, lambda x: abs(x / st - round_even(x / st, 0)) <= 1e-3)) / len(v))) end as f from ls),
lattice as materialized (select t.model, t.tensor, coalesce(avg(f), 0) as lattice_frac, coalesce(avg(len(u) / len(v)), 0) as distinct_ratio
  from (select distinct model, tensor from cells) t left join lf using (model, tensor) group by all)
"""


@register("a19_lattice_fit", f"""
with {L}, {LATTICE_SQL} select model, tensor, round(lattice_frac, 6) + 0 as lattice_frac, round(distinct_ratio, 6) + 0 as distinct_ratio from lattice
""")
def lattice(spark, sf_dir):
    f = stats.lattice_fit(rows_of(spark, sf_dir))
    return f.select("model", "tensor", r6("lattice_frac").alias("lattice_frac"), r6("distinct_ratio").alias("distinct_ratio"))


@register("a17_ks_two_sample", f"""
with {L}, n as (select model, tensor, r, sqrt(sum(x * x)) as norm, r % 3 = 0 as own from cells group by all),
s as (select model, tensor, norm, sum(own::int) as c1, sum((not own)::int) as c0 from n group by all),
w as (select model, tensor, sum(c1) over (partition by model, tensor order by norm) / sum(c1) over (partition by model, tensor) as f1,
  sum(c0) over (partition by model, tensor order by norm) / sum(c0) over (partition by model, tensor) as f0 from s)
select model, tensor, round(max(abs(f1 - f0)), 6) + 0 as ks from w group by all
""")
def ks(spark, sf_dir):
    n = stats.row_norms(rows_of(spark, sf_dir)).withColumn("own", F.col("row_idx") % 3 == 0)
    return stats.ks_2samp(n, ["model", "tensor"], "norm", "own").select("model", "tensor", r6("ks").alias("ks"))


@register("a18_orphan_stats", f"""
with {L}, o as (select model, tensor, r, list(x order by c) as v, sqrt(sum(x * x)) as norm, r < 12 as own from cells group by all),
m as (select model, tensor, quantile_cont(norm, 0.5) as med from o where own group by all),
s as (select model, tensor, norm, sum(own::int) as c1, sum((not own)::int) as c0 from o group by all),
w as (select model, tensor, sum(c1) over (partition by model, tensor order by norm) / sum(c1) over (partition by model, tensor) as f1,
  sum(c0) over (partition by model, tensor order by norm) / sum(c0) over (partition by model, tensor) as f0 from s),
k as (select model, tensor, max(abs(f1 - f0)) as ks from w group by all),
x as (select model, tensor, count(*) as n_rows, avg((norm <= 1e-6)::int) as zero_frac, (count(*) - count(distinct v)) / count(*) as dup_frac, stddev_pop(norm) / avg(norm) as cv,
  avg((abs(norm - med) <= 3 * med / sqrt(128) or norm <= 1e-6)::int) as untrained from o join m using (model, tensor) where own group by all)
select model, tensor, n_rows, round(cv, 6) + 0 as cv, round(untrained, 6) + 0 as untrained_frac, round(ks, 6) + 0 as ks,
       round(least(1, greatest(0.5 * untrained + 0.5 * ks, zero_frac, dup_frac)), 6) + 0 as score from x join k using (model, tensor)
""")
def orphans(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    o = stats.orphan_stats(rows.where("row_idx < 12"), stats.row_norms(rows.where("row_idx >= 12")))
    return o.select("model", "tensor", "n_rows", *[r6(c).alias(c) for c in ("cv", "untrained_frac", "ks", "score")])


VERDICT_SQL = f"""
z as (
  select p.a, p.b, x.tensor, count(*) as n, count(*) filter (where x.x = 0) as za, count(*) filter (where y.x = 0) as zb,
         count(*) filter (where x.x = 0 and y.x = 0) as zz, bool_and(x.x = y.x) as same
  from pairs p join cells x on x.model = p.a join cells y on y.model = p.b and y.tensor = x.tensor and y.r = x.r and y.c = x.c group by all
),
ev as (
  select z.a, z.b, sum(za) / sum(n) as zero_a, sum(zb) / sum(n) as zero_b, sum(n * case when za = 0 then 1 else zz / za end) / sum(n) as h_ab,
         sum(n * case when zb = 0 then 1 else zz / zb end) / sum(n) as h_ba, sum(n * la.lattice_frac) / sum(n) as lat_a, sum(n * lb.lattice_frac) / sum(n) as lat_b
  from z join lattice la on la.model = z.a and la.tensor = z.tensor join lattice lb on lb.model = z.b and lb.tensor = z.tensor group by z.a, z.b
),
ft as (
  select a, b, greatest(-1, least(1, lat_b - lat_a)) as lattice_asym, greatest(-1, least(1, zero_b - zero_a)) as zero_asym,
         greatest(-1, least(1, least(1, greatest(zero_a, zero_b) / 0.01::double) * (h_ab - h_ba))) as zero_subset_asym from ev
),
vd as (select *, 3 * lattice_asym + 1.5::double * zero_asym + 2.5::double * zero_subset_asym as llr from ft)
"""


def verdicts(spark, sf_dir):
    ev = direction.value_evidence(rows_of(spark, sf_dir), model_pairs(spark))  # the terms of VERDICT_SQL
    return direction.verdict(direction.features(ev))


@register("c13_direction_verdict", f"""
with {L}, pairs as (select a.m as a, b.m as b from (select unnest({list(lineage.MODELS)}) as m) a join (select unnest({list(lineage.MODELS)}) as m) b on a.m < b.m),
{LATTICE_SQL}, {VERDICT_SQL}
select a, b, round(lattice_asym, 6) + 0 as lattice_asym, round(zero_asym, 6) + 0 as zero_asym, round(zero_subset_asym, 6) + 0 as zero_subset_asym,
       round(llr, 6) + 0 as llr, round(1 / (1 + exp(-llr)), 6) + 0 as p, round(abs(2 / (1 + exp(-llr)) - 1), 6) + 0 as confidence,
       case when llr > 0.5 then 'a->b' when llr < -0.5 then 'b->a' else 'unknown' end as direction from vd
""")
def direction_verdict(spark, sf_dir):
    """Features, signed log likelihood ratio and verdict of every pair; no derived row is dead or an outlier."""
    v = verdicts(spark, sf_dir)
    return v.select("a", "b", *[r6(c).alias(c) for c in ("lattice_asym", "zero_asym", "zero_subset_asym", "llr", "p", "confidence")], "direction")


@register("c08_c13_full_verdict")
def full_verdict(spark, sf_dir):
    """All thirteen features, with spectra and headers (int8 is stored in 8 bits), and the verdict of every pair."""
    rows = rows_of(spark, sf_dir)
    h = direction.headers_of(rows).withColumn("dtype", F.when(F.col("model") == "int8", "I8").otherwise("F32"))
    v = direction.verdict(direction.features(direction.collect_evidence(rows, model_pairs(spark), h)))
    v = v.withColumn("relation", direction.relation(F.col("direction")))
    return v.select("a", "b", *[r6(c).alias(c) for c in (*schema.DIRECTION_WEIGHTS, "llr", "p", "confidence")], "direction", "relation")


_ZEROS_SQL = ", ".join(f"('{n}')" for n in schema.DIRECTION_WEIGHTS if n not in ("lattice_asym", "zero_asym", "zero_subset_asym"))


@register("p22_w14_relation_and_contributions", f"""
with {L}, pairs as (select a.m as a, b.m as b from (select unnest({list(lineage.MODELS)}) as m) a join (select unnest({list(lineage.MODELS)}) as m) b on a.m < b.m),
{LATTICE_SQL}, {VERDICT_SQL}, o as (select *, case when llr < -0.5 then -1 else 1 end as s from vd),
rel as (select a, b, case when llr between -0.5 and 0.5 then 'derived' when lattice_asym * s >= 0.15 then 'quantized'
         when zero_subset_asym * s >= 0.15 or zero_asym * s >= 0.20 then 'pruned' else 'derived' end as relation from o),
c as (select a, b, 'lattice_asym' as feature, round(3 * lattice_asym, 6) + 0 as contribution from o union all select a, b, 'zero_asym', round(1.5 * zero_asym, 6) + 0 from o
      union all select a, b, 'zero_subset_asym', round(2.5 * zero_subset_asym, 6) + 0 from o union all select a, b, z.f, 0 from o, (values {_ZEROS_SQL}) z(f)),
k as (select *, row_number() over (partition by a, b order by abs(contribution) desc, feature) as rank from c)
select a, b, relation, feature, contribution, rank::int as rank from k join rel using (a, b) where rank <= 8
""")
def relation_and_contributions(spark, sf_dir):
    """The eight largest terms of every verdict; spectra are not in VERDICT_SQL, c08_c13_full_verdict has every term."""
    v = verdicts(spark, sf_dir).withColumn("relation", direction.relation(F.col("direction")))
    told_apart = F.transform_values("contributions", lambda k, x: r6(x))
    top = direction.top_contributions(v.withColumn("contributions", told_apart), 8)
    return v.select("a", "b", "relation").join(top, ["a", "b"]).select("a", "b", "relation", "feature", "contribution", "rank")


@register("c22_two_parent_weight", f"""
with {L}, g as (
  select sum(y.x * y.x) as yy, sum(a.x * a.x) as aa, sum(b.x * b.x) as bb, sum(y.x * a.x) as ya, sum(y.x * b.x) as yb, sum(a.x * b.x) as ab
  from cells y join cells a on a.model = 'sft' and a.tensor = y.tensor and a.r = y.r and a.c = y.c
  join cells b on b.model = 'cpt' and b.tensor = y.tensor and b.r = y.r and b.c = y.c where y.model = 'merge2'
)
select round(greatest(0, least(1, (ya - ab - yb + bb) / (aa - 2 * ab + bb))), 4) + 0 as weight_a from g
""")
def two_parent(spark, sf_dir):
    w = merge.two_parent_weight(rows_of(spark, sf_dir), "merge2", "sft", "cpt")
    return w.select((F.round("weight_a", 4) + 0.0).alias("weight_a"))


@register("c21_k12_merge_decomposition", f"""
with {L}, t as (
  select y.x - z.x as y, a.x - z.x as a, b.x - z.x as b from cells y join cells z on z.model = 'root' and z.tensor = y.tensor and z.r = y.r and z.c = y.c
  join cells a on a.model = 'sft' and a.tensor = y.tensor and a.r = y.r and a.c = y.c join cells b on b.model = 'cpt' and b.tensor = y.tensor and b.r = y.r and b.c = y.c
  where y.model = 'merge2'
),
w as (select greatest(0, least(1, sum((y - b) * (a - b)) / sum((a - b) * (a - b)))) as w from t),
left_over as (select w, sqrt(sum((y - w * a - (1 - w) * b) * (y - w * a - (1 - w) * b)) / sum(y * y)) as e from t, w group by w)
select candidate, round(weight, 4) + 0 as weight, weight > 0.05 as selected, round(e, 4) + 0 as residual, round(1 - e * e, 4) + 0 as r2
from left_over, (values ('cpt', 1), ('lora', 2), ('sft', 3), ('unrelated', 4)) c(candidate, i), lateral (select case i when 1 then 1 - w when 3 then w else 0 end as weight)
""")
def decomposition(spark, sf_dir):
    """Four candidates of which two are live: on them the simplex problem has a closed form, and no residual is left for the others."""
    claims = spark.createDataFrame([("merge2", c) for c in ("sft", "cpt", "lora", "unrelated")], "child string, candidate string")
    found = merge.decompose_all(rows_of(spark, sf_dir), claims, "root")
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return found.select("candidate", r4("weight"), "selected", r4("residual"), r4("r2"))


@register("e06_merge_axis", f"""
with {L}, t as (
  select y.x - z.x as y, a.x - z.x as a, b.x - z.x as b from cells y join cells z on z.model = 'root' and z.tensor = y.tensor and z.r = y.r and z.c = y.c
  join cells a on a.model = 'sft' and a.tensor = y.tensor and a.r = y.r and a.c = y.c join cells b on b.model = 'cpt' and b.tensor = y.tensor and b.r = y.r and b.c = y.c
  where y.model = 'merge2'
),
w as (select greatest(0, least(1, sum((y - b) * (a - b)) / sum((a - b) * (a - b)))) as w from t),
g as (select w, abs(w - 0.6) + abs(1 - w - 0.4) as gap, (w > 0.05)::int + (1 - w > 0.05)::int as found from w)
select 'merge2' as child, 'linear' as method, 2 as n_parents, round(gap / 4, 4) + 0 as mae, round(gap / 2, 4) + 0 as mae_true_parents, 1.0::double as precision,
  found / 2 as recall, round(2 * (found / 2) / (1 + found / 2), 6) + 0 as f1 from g
""")
def merge_axis(spark, sf_dir):
    """The merge with two decoys among its candidates; on its two live parents the simplex problem has a closed form."""
    edges = lineage.edges(spark)
    truth = edges.where("relation = 'merge'").select("parent", "child", "weight", F.lit("linear").alias("method"))
    models = spark.createDataFrame([(m,) for m in lineage.MODELS], "model string")
    base = truth.select("child", F.lit("root").alias("base")).distinct()
    claims = metrics.merge_decoys(truth, models, graph.closure(edges), base, 2)
    cases = metrics.merge_cases(truth, merge.decompose_all(rows_of(spark, sf_dir), claims, "root"))
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return cases.select("child", "method", "n_parents", r4("mae"), r4("mae_true_parents"), "precision", "recall", r6("f1").alias("f1"))


@register("e05_outgroup_rerun")
def outgroup_rerun(spark, sf_dir):
    """The edges without a trace in the child, judged alone and with a sibling as outgroup."""
    rows, edges = rows_of(spark, sf_dir), lineage.edges(spark)
    chosen = materialize(metrics.sibling_outgroups(edges, graph.closure(edges)), "query-siblings")
    asked = chosen.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.col("outgroup").alias("c"))
    evidence = materialize(direction.features(direction.collect_evidence(rows, asked.select("a", "b"))), "query-evidence")
    statistic = pairs.outgroup_statistic(rows, asked).select("a", "b", "outgroup")
    relation = edges.select(F.col("parent").alias("a"), F.col("child").alias("b"), "relation", F.lit("a->b").alias("truth"))
    judged = lambda v: v.select("a", "b", F.col("direction").alias("predicted"), "llr").join(relation, ["a", "b"])
    before = judged(direction.verdict(evidence))
    after = judged(direction.verdict(evidence.join(statistic, ["a", "b"], "left"), outgroup="outgroup"))
    return metrics.outgroup_rerun(materialize(before, "query-before"), materialize(after, "query-after"))


@register("c01_k03_sketch")
def sketches(spark, sf_dir):
    return sketch.sketch(rows_of(spark, sf_dir))


@register("k04_k07_spectral_pairs")
def spectral(spark, sf_dir):
    s = sketch.spectral_pairs(rows_of(spark, sf_dir), model_pairs(spark))
    return s.select("a", "b", "tensor", "energy_a", "energy_b", "rank_a", "rank_b", "mass_a", "mass_b")


_NEAREST_SQL = """
with q as (select vec_id, embedding as e from embeddings where vec_id % 50 = 0),
d as (select q.vec_id as query, i.vec_id as hit,
  greatest(0, least(2, 1 - list_inner_product(q.e::double[], i.embedding::double[]) / sqrt(list_inner_product(q.e::double[], q.e::double[]) * list_inner_product(i.embedding::double[], i.embedding::double[])))) as distance
  from q join embeddings i on true),
r as (select *, row_number() over (partition by query order by round(distance, 9), hit) as rank from d)
select query, hit, round(distance, 6) + 0 as distance, rank::int as rank from r where rank <= 10
"""


def _checkpoints(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The derived models as checkpoint files, written once a session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _written:
        _written[name] = safetensors.write_models(rows_of(spark, sf_dir), f"{shared_dir(spark)}/checkpoints-{uuid.uuid4().hex}")
    return _written[name]


_written: dict[tuple[str, str], dict[str, str]] = {}


@register("l01_l03_headers", f"""
with {L}, t as (select model, tensor, count(distinct r) as n, count(distinct c) as w from cells group by all)
select model, tensor, 'F64' as dtype, n::bigint as n_rows, w::bigint as n_cols, (n * w * 8)::bigint as bytes from t
""")
def checkpoint_headers(spark, sf_dir):
    """Headers of all models, written as checkpoints and read back by the tasks."""
    h = safetensors.scan(spark, _checkpoints(spark, sf_dir), mode="metadata")
    return h.select("model", "tensor", "dtype", F.get("shape", 0).alias("n_rows"), F.get("shape", 1).alias("n_cols"), (F.col("end") - F.col("begin")).alias("bytes"))


@register("l04_l07_row_scan", f"""
with {L}, t as (select model, tensor, max(r) + 1 as n from cells group by all),
p as (select distinct model, tensor, unnest(list_transform(range(0, 16), lambda i: round_even(i * (n - 1) / 15.0::double, 0)::bigint)) as r from t where n > 16
  union select model, tensor, unnest(range(0, n)) from t where n <= 16)
select model, tensor, r as row_idx, round(sum(x), 9) + 0 as total, round(sum(x * (c + 1)), 9) + 0 as by_column from cells join p using (model, tensor, r) group by all
""")
def row_scan(spark, sf_dir):
    """Sixteen rows of every tensor of all models, by merged byte ranges."""
    rows = safetensors.scan(spark, _checkpoints(spark, sf_dir), max_rows=16)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    weighed = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("model", "tensor", "row_idx", (F.round(total, 9) + 0.0).alias("total"), (F.round(weighed, 9) + 0.0).alias("by_column"))


@register("e07_l08_metered_scan", f"""
with {L} select model, count(distinct (tensor, r))::bigint as rows, (count(*) * 8)::bigint as bytes, count(distinct tensor)::bigint as requests, (count(*) * 8)::bigint as full_size, 1.0::double as reduction
from cells group by model
""")
def metered_scan(spark, sf_dir):
    """What a scan of all rows read: every tensor is a shard of its own and one request."""
    models = _checkpoints(spark, sf_dir)
    cost = materialize(safetensors.transfer(safetensors.scan(spark, models, metered="true"), safetensors.scan(spark, models, mode="metadata")), "query-cost")
    totals = metrics.transfer_totals(cost, ["model"]).select("model", "bytes", "requests", "full_size", r6("reduction").alias("reduction"))
    return totals.join(cost.select("model", "rows"), "model")


@register("c05_w01_index_search", _NEAREST_SQL)
def index_search(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("model"), F.col("embedding").alias("vector"))
    found = sketch.search(e.where("model % 50 = 0"), e, 10)
    return found.select("query", "hit", r6("distance").alias("distance"), "rank")


@register("c05_j06_pruned_search", _NEAREST_SQL)
def pruned_search(spark, sf_dir):
    """The same hits by inverted lists and bounds."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("model"), F.col("embedding").alias("vector"))
    found = sketch.pruned_search(e.where("model % 50 = 0"), e, 10)
    return found.select("query", "hit", r6("distance").alias("distance"), "rank")


@register("c06_j07_candidate_pairs", f"""
with {L}, v as (select model, tensor, c, avg(x) as x from cells group by all),
d as (select a.model as a, b.model as b, greatest(0, least(2, 1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)))) as d
  from v a join v b on b.tensor = a.tensor and b.c = a.c group by all),
r as (select *, row_number() over (partition by a order by d, b) as k from d),
f as (select * from r where k <= 8 and a <> b and d <= 0.35),
g as (select *, row_number() over (partition by a order by d, b) as k2 from f)
select least(a, b) as a, greatest(a, b) as b, round(min(d), 6) + 0 as distance from g where k2 <= 7 group by 1, 2
""")
def candidate_pairs(spark, sf_dir):
    index = materialize(sketch.mean_vectors(rows_of(spark, sf_dir)), "query-means")
    found = sketch.pair_candidates(sketch.candidate_parents(index, index, 7))
    return found.select("a", "b", r6("distance").alias("distance"))


def _summary(rows: DataFrame) -> DataFrame:
    cells = rows.select("tensor", "row_idx", F.posexplode("v").alias("c", "x"))
    return cells.groupBy("tensor").agg(
        F.count(F.lit(1)).alias("cells"), F.sum((F.col("x") == 0).cast("long")).alias("zeros"), r6(F.sum("x")).alias("total"),
        r6(F.sum(F.col("x") * (F.col("c") + 1))).alias("by_column"), r6(F.sum(F.col("x") * F.pmod("row_idx", F.lit(7)))).alias("by_row"),
    )


_SUMMARY_SQL = """select tensor, count(*) as cells, count(*) filter (where x = 0) as zeros, round(sum(x), 6) + 0 as total,
  round(sum(x * (c + 1)), 6) + 0 as by_column, round(sum(x * (r % 7)), 6) + 0 as by_row from y group by tensor"""


def _root(spark, sf_dir, model="root"):
    return rows_of(spark, sf_dir).where(F.col("model") == model).drop("model")


@register("f01_int8_round_trip", f"with {L}, y as (select * from cells where model = 'int8') {_SUMMARY_SQL}")
def f01(spark, sf_dir):
    return _summary(simulate.int8_round_trip(_root(spark, sf_dir)))


@register("f02_int4_groupwise", f"""
with {L}, g as (select *, max(abs(x)) over (partition by tensor, r, c // 16) / 7 as s from cells where model = 'sft'),
y as (select tensor, r, c, case when s > 0 then greatest(-7, least(7, round_even(x / s, 0))) * s else x end as x from g) {_SUMMARY_SQL}
""")
def f02(spark, sf_dir):
    return _summary(simulate.int4_groupwise(_root(spark, sf_dir, "sft"), 16))


@register("f03_magnitude_prune", f"""
with {L}, y as (select tensor, r, c, case when abs(x) >= (select quantile_cont(abs(x), 0.4) from cells where model = 'root') then x else 0 end as x
  from cells where model = 'root') {_SUMMARY_SQL}
""")
def f03(spark, sf_dir):
    return _summary(simulate.magnitude_prune(_root(spark, sf_dir), 0.4, ()))


@register("f04_structured_prune", f"""
with {L}, root as (select * from cells where model = 'root'), s as (
  select r, sum(x * x) as s from root where tensor in ('model.layers.0.mlp.gate_proj.weight', 'model.layers.0.mlp.up_proj.weight') group by r),
k as (select r, row_number() over (order by s, r) as pos, count(*) over () as n from s), dead as (select r from k where pos <= round(0.25 * n)),
y as (
  select tensor, r, c, case when r in (select r from dead) then 0 else x end as x from root where tensor in ('model.layers.0.mlp.gate_proj.weight', 'model.layers.0.mlp.up_proj.weight')
  union all select tensor, r, c, case when c in (select r from dead) then 0 else x end from root where tensor = 'model.layers.0.mlp.down_proj.weight'
) {_SUMMARY_SQL}
""")
def f04(spark, sf_dir):
    root = _root(spark, sf_dir)
    of = lambda t: root.where(F.col("tensor") == f"model.layers.0.mlp.{t}_proj.weight")
    g, u, d = simulate.structured_prune(of("gate"), of("up"), of("down"), 0.25)
    return _summary(g.unionByName(u).unionByName(d))


@register("f05_extend_vocab", f"""
with {L}, m as (select max(r) as last from cells where model = 'root' and tensor = 'lm_head.weight'),
y as (
  select tensor, r, c, x from cells where model = 'root' and tensor = 'lm_head.weight'
  union all select 'lm_head.weight', last + i, j, 0.02::double * sin(i * 12.9898::double + j * 78.233::double) from m, range(1, 17) a(i), range(0, 64) b(j)
) {_SUMMARY_SQL}
""")
def f05(spark, sf_dir):
    root = _root(spark, sf_dir).where("tensor = 'lm_head.weight'")
    return _summary(simulate.extend_vocab(root, "lm_head.weight", 16))


@register("f06_halve_depth", f"""
with {L}, t as (select distinct tensor, nullif(regexp_extract(tensor, '\\.layers\\.(\\d+)\\.', 1), '')::int as l from cells)
select case when l is null then tensor else regexp_replace(tensor, '\\.layers\\.\\d+\\.', '.layers.' || (l // 2) || '.') end as tensor from t where l is null or l % 2 = 0
""")
def f06(spark, sf_dir):
    return simulate.halve_depth(_root(spark, sf_dir).select("tensor").distinct())


_DELTA2 = """t as (select b.tensor, b.r, b.c, b.x as b, a.x - b.x as t0, d.x - b.x as t1 from cells b
  join cells a on a.model = 'sft' and a.tensor = b.tensor and a.r = b.r and a.c = b.c join cells d on d.model = 'lora' and d.tensor = b.tensor and d.r = b.r and d.c = b.c
  where b.model = 'root')"""


@register("f07_slerp", f"""
with {L}, {_DELTA2}, g as (select tensor, greatest(-1, least(1, sum(t0 * t1) / sqrt(sum(t0 * t0) * sum(t1 * t1)))) as cs from t group by tensor),
w as (select tensor, case when abs(cs) > 1 - 5e-4 then 0.3 else sin(0.3 * acos(cs)) / sin(acos(cs)) end as wa,
  case when abs(cs) > 1 - 5e-4 then 0.7 else sin(0.7 * acos(cs)) / sin(acos(cs)) end as wb from g),
y as (select tensor, r, c, b + (wa * t0 + wb * t1) as x from t join w using (tensor)) {_SUMMARY_SQL}
""")
def f07(spark, sf_dir):
    return _summary(simulate.merge_slerp(_root(spark, sf_dir), _root(spark, sf_dir, "sft"), _root(spark, sf_dir, "lora"), 0.7))


@register("f08_ties", f"""
with {L}, {_DELTA2}, q as (select tensor, quantile_cont(abs(t0), 0.8) as q0, quantile_cont(abs(t1), 0.8) as q1 from t group by tensor),
k as (select tensor, r, c, b, case when abs(t0) >= q0 then t0 * 0.6::double else 0 end as k0, case when abs(t1) >= q1 then t1 * 0.4::double else 0 end as k1 from t join q using (tensor)),
s as (select *, sign(k0 + k1) as s from k),
y as (select tensor, r, c, b + case when (sign(k0) = s and k0 <> 0)::int + (sign(k1) = s and k1 <> 0)::int > 0 then
    (case when sign(k0) = s and k0 <> 0 then k0 else 0 end + case when sign(k1) = s and k1 <> 0 then k1 else 0 end) / ((sign(k0) = s and k0 <> 0)::int + (sign(k1) = s and k1 <> 0)::int)
    else 0 end as x from s) {_SUMMARY_SQL}
""")
def f08(spark, sf_dir):
    made = simulate.merge_ties(_root(spark, sf_dir), [_root(spark, sf_dir, "sft"), _root(spark, sf_dir, "lora")], [0.6, 0.4])
    return _summary(made)


@register("f09_dare")
def f09(spark, sf_dir):
    return _summary(simulate.merge_dare(_root(spark, sf_dir), _root(spark, sf_dir, "sft"), _root(spark, sf_dir, "lora"), 0.5, 0.5))


@register("f10_linear_merge", f"with {L}, {_DELTA2}, y as (select tensor, r, c, b + (0.7::double * t0 + 0.3::double * t1) as x from t) {_SUMMARY_SQL}")
def f10(spark, sf_dir):
    return _summary(simulate.merge_linear(_root(spark, sf_dir), _root(spark, sf_dir, "sft"), _root(spark, sf_dir, "lora"), 0.7, 0.3))


@register("f11_lineage_rows", f"with {L} select model, tensor, count(*) as cells, round(sum(x * (c + 1)), 6) + 0 as total from cells group by all")
def f11(spark, sf_dir):
    cells = rows_of(spark, sf_dir).select("model", "tensor", F.posexplode("v").alias("c", "x"))
    return cells.groupBy("model", "tensor").agg(F.count(F.lit(1)).alias("cells"), r6(F.sum(F.col("x") * (F.col("c") + 1))).alias("total"))


@register("f11_low_rank_delta", f"""
with {L}, w as (select tensor, r, c, x, list_sum(list_transform(range(1, 9), lambda k: sin((r + 1) * 12.9898::double * k) * cos((c + 1) * 78.233::double * k))) as d from c_root),
s as (select tensor, case when count(distinct r) >= 2 then 0.03::double * sqrt(sum(x * x)) / sqrt(sum(d * d)) else 0 end as s from w group by tensor),
y as (select tensor, r, c, x + s * d as x from w join s using (tensor)) {_SUMMARY_SQL}
""")
def low_rank(spark, sf_dir):
    return _summary(simulate.low_rank_delta(_root(spark, sf_dir)))


@register("l05_row_sample", f"""
with {L}, t as (select tensor, count(distinct r)::bigint as n from cells where model = 'root' group by tensor),
s as (select tensor, n, unnest(list_transform(range(0, 16), lambda i: round_even(i * (n - 1) / 15.0::double, 0)::bigint)) as st from t where n > 24),
p as (select distinct tensor, st as row_idx from s)
select tensor, row_idx from p union all select tensor, unnest(range(0, n)) from t where n <= 24
""")
def row_sample(spark, sf_dir):
    t = pairs.tensors_of(rows_of(spark, sf_dir).where("model = 'root'")).select("tensor", "n_rows")
    return selection.select_rows(t, 24).select("tensor", "row_idx")


@register("a26_w06_w09_tensor_picks", f"""
with {L}, t as (select tensor, count(*) as numel from cells where model = 'root' group by tensor),
z as (select *, case when tensor like '%embed%' then 'embed' when tensor like '%lm_head%' then 'lm_head' when tensor like '%q_proj%' then 'attn_q' when tensor like '%k_proj%' then 'attn_k'
  when tensor like '%v_proj%' then 'attn_v' when tensor like '%o_proj%' then 'attn_o' when tensor like '%down%' then 'mlp_out' else 'mlp_in' end as role from t),
k as (select *, row_number() over (partition by role order by numel desc, tensor) as turn from z),
c as (select *, row_number() over (order by (turn > 2)::int, (tensor <> 'model.embed_tokens.weight')::int, numel desc, tensor) as pos from k)
select 'capped' as pick, tensor from c where pos <= 6
union all select 'largest', tensor from (select tensor from z order by numel desc, tensor limit 4)
union all select 'by name', tensor from (select tensor from z order by tensor limit 8)
union all select 'round robin', tensor from (select tensor from k order by turn, role limit 8)
""")
def picks(spark, sf_dir):
    from weftmark.functions import names

    t = pairs.tensors_of(rows_of(spark, sf_dir).where("model = 'root'")).select("tensor", "numel").withColumn("role", names.role(F.col("tensor")))
    t = t.withColumn("numel", F.col("numel").cast("long"))
    parts = {
        "capped": selection.capped_pick(t, 6, "model.embed_tokens.weight"), "largest": selection.largest(t, 4),
        "by name": selection.first_by_name(t, 8), "round robin": selection.round_robin(t, 8),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("pick"), "tensor")
        out = part if out is None else out.unionByName(part)
    return out


@register("a26_sketch_slots", f"""
with {L}, t as (select distinct model, tensor from cells),
z as (select *, case when tensor like '%embed%' then 0 when tensor like '%q_proj%' then 1 when tensor like '%k_proj%' then 2 when tensor like '%v_proj%' then 3
  when tensor like '%o_proj%' then 4 when tensor like '%down%' then 6 when tensor like '%lm_head%' then 7 else 5 end as role,
  nullif(regexp_extract(tensor, 'layers\\.(\\d+)\\.', 1), '')::int as l from t),
b as (select *, case when role = 7 then 4 when l is null then 0 when l = 0 then 0 else 4 end as bucket from z),
n as (select model, tensor, count(*) as numel from cells group by all),
k as (select b.*, row_number() over (partition by b.model, role, bucket order by numel desc, b.tensor) as pos from b join n using (model, tensor))
select model, tensor, role * 5 + bucket as slot from k where pos = 1
""")
def slots(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return selection.sketch_tensors(pairs.tensors_of(rows)).select("model", "tensor", "slot")


@register("c28_phylogeny")
def phylogeny(spark, sf_dir):
    from weftmark.operators.phylogeny import build

    return build(rows_of(spark, sf_dir), outgroups=1).edges.select("parent", "child", "relation", "weight", r6("confidence").alias("confidence"))


assert schema.SKETCH_DIM == 1456
