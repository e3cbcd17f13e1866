"""Which of two related models is the parent: features, signed log likelihood ratio, verdict.

All mirrored statistics are computed by one expression per side and subtracted, so
swapping the models flips every feature exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.functions.scalars import antisym, clip, finite, odd_tanh, sigmoid
from weftmark.operators import metadata, sketch, stats
from weftmark.operators import pairs as geometry
from weftmark.plans.shared import materialize

#: Side statistics of the evidence and pair statistics in both directions, with their neutral values.
SIDE = ("vocab_rows", "bits", "zero_frac", "dead_frac", "outlier_frac", "sharpness", "lattice_frac", "log_norm",
        "subspace_energy", "delta_rank", "top_mass", "orphan_score", "extra")
NEUTRAL = {"bits": 32.0}
PAIR = ("zero_h", "dead_h", "outlier_h")


def features(evidence: DataFrame) -> DataFrame:
    """Add the features to evidence with columns <side>_a, <side>_b, <pair>_ab, <pair>_ba and identical_frac.

    Missing columns count as neutral.  A feature is positive when b looks like the child.
    """
    have = set(evidence.columns)
    side = lambda n, s: F.coalesce(F.col(f"{n}_{s}").cast("double"), F.lit(NEUTRAL.get(n, 0.0))) if f"{n}_{s}" in have else F.lit(NEUTRAL.get(n, 0.0))
    pair = lambda n, d: F.coalesce(F.col(f"{n}_{d}"), F.lit(1.0)) if f"{n}_{d}" in have else F.lit(1.0)
    child = lambda n: side(n, "b") - side(n, "a")
    child_norm = lambda n: antisym(side(n, "b"), side(n, "a"), normalise=True)
    parent = lambda n: pair(n, "ab") - pair(n, "ba")
    gate = lambda n, width: F.least(F.lit(1.0), F.greatest(side(n, "a"), side(n, "b")) / F.lit(width))
    same = F.coalesce(F.col("identical_frac"), F.lit(0.0)) if "identical_frac" in have else F.lit(0.0)
    made = {
        "vocab_delta": odd_tanh(child("vocab_rows") / 128),
        "orphan_asym": child("orphan_score"),
        "lattice_asym": child("lattice_frac"),
        "zero_asym": child("zero_frac"),
        "zero_subset_asym": gate("zero_frac", schema.ZERO_GATE) * parent("zero_h"),
        "dtype_precision_asym": (side("bits", "a") - side("bits", "b")) / 32,
        "subspace_energy_asym": child_norm("subspace_energy"),
        "delta_rank_asym": child_norm("delta_rank"),
        "spectral_growth_asym": child_norm("top_mass"),
        "norm_growth_asym": odd_tanh(10 * child("log_norm")),
        "dead_fossil_asym": gate("dead_frac", schema.DEAD_GATE) * parent("dead_h"),
        "outlier_fossil_asym": 0.5 * gate("outlier_frac", schema.OUTLIER_GATE) * parent("outlier_h") + 0.5 * child_norm("sharpness"),
        "exact_tie_asym": (0.5 + 0.5 * same) * child("extra"),
    }
    return evidence.select("*", *[clip(finite(made[n]), -1.0, 1.0).alias(n) for n in schema.DIRECTION_WEIGHTS])


def default_weights(df: DataFrame) -> DataFrame:
    """The default weights as a table (feature, weight)."""
    return df.sparkSession.createDataFrame([*schema.DIRECTION_WEIGHTS.items()], "feature string, weight double")


def verdict(
    scored: DataFrame, weights: dict[str, float] | None = None, abstain: float = schema.ABSTAIN, outgroup: str | None = None
) -> DataFrame:
    """Add contributions, llr, p, direction and confidence to rows with the features."""
    w = {n: (weights or schema.DIRECTION_WEIGHTS).get(n, 0.0) for n in schema.DIRECTION_WEIGHTS}
    terms: list[tuple[str, Column]] = [(n, F.col(n) * F.lit(float(x))) for n, x in w.items()]
    if outgroup:
        terms.append(("outgroup", F.coalesce(F.col(outgroup), F.lit(0.0)) * schema.OUTGROUP_WEIGHT))
    llr = sum((t for _, t in terms[1:]), terms[0][1])
    out = scored.withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(n) for n, _ in terms]), F.array(*[t for _, t in terms])))
    out = out.withColumn("llr", llr)
    side = F.when(F.col("llr") > abstain, F.lit("a->b")).when(F.col("llr") < -abstain, F.lit("b->a")).otherwise(F.lit("unknown"))
    out = out.withColumn("direction", side).withColumn("p", sigmoid(F.col("llr")))
    return out.withColumn("confidence", F.abs(2 * F.col("p") - 1))


def relation(direction: Column) -> Column:
    """Relation named by the features once they are oriented towards the child."""
    sign = F.when(direction == "b->a", F.lit(-1.0)).otherwise(F.lit(1.0))
    out = F.when(~direction.isin("a->b", "b->a"), F.lit("derived"))
    for name, rules in schema.RELATION_RULES:
        hit = F.lit(False)
        for feature, least in rules:
            hit = hit | (F.col(feature) * sign >= least)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("derived"))


def top_contributions(verdicts: DataFrame, n: int = 8) -> DataFrame:
    """(a, b, feature, contribution, rank) by size."""
    from pyspark.sql.window import Window

    long = verdicts.select("a", "b", F.explode("contributions").alias("feature", "contribution"))
    order = Window.partitionBy("a", "b").orderBy(F.desc(F.abs("contribution")), "feature")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def evidence_sentences() -> Column:
    """Conditional sentences about oriented features, as an array of strings."""
    side = lambda f: F.when(F.col(f) > 0, F.col("b")).otherwise(F.col("a"))
    say = lambda f, least, text: F.when(F.abs(f) >= least, F.format_string(text, side(f), F.abs(f)))
    made = F.array(
        say("lattice_asym", 0.15, "%s sits on a value lattice that the other does not (gap %.3f)"),
        say("zero_subset_asym", 0.15, "zeros of the other model persist in %s (containment gap %.3f)"),
        say("zero_asym", 0.20, "%s holds more exact zeros (gap %.3f)"),
        say("vocab_delta", 0.05, "%s has a larger vocabulary (score %.3f)"),
        say("dtype_precision_asym", 0.15, "%s is stored at lower precision (score %.3f)"),
        F.when(F.col("direction") == "unknown", F.format_string("evidence is too weak to orient %s and %s", F.col("a"), F.col("b"))),
    )
    return F.filter(made, lambda s: s.isNotNull())


def collect_evidence(rows: DataFrame, pairs: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All evidence per (a, b), one row for every pair: values, headers, rows beyond the shared ones, spectra.

    ``headers`` is (model, tensor, dtype, shape).  Without it shapes come from the rows
    and precision, which rows do not show, counts as equal.
    """
    wanted = pairs.select("a", "b").distinct()
    h = headers_of(rows) if headers is None else headers.select("model", "tensor", "dtype", "shape")
    out = wanted
    for part in (value_evidence(rows, wanted), header_evidence(h, wanted), orphan_evidence(rows, wanted, h), spectral_evidence(rows, wanted)):
        out = out.join(part, ["a", "b"], "left")
    return out


def headers_of(rows: DataFrame) -> DataFrame:
    """(model, tensor, dtype, shape) as far as rows show them: the type is null, a single row is a vector."""
    n, width = F.max("row_idx") + 1, F.max(F.size("v")).cast("long")
    shape = F.when(n > 1, F.array(n, width)).otherwise(F.array(width))
    return rows.groupBy("model", "tensor").agg(shape.alias("shape")).select("model", "tensor", F.lit(None).cast("string").alias("dtype"), "shape")


def header_evidence(headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored precision, vocabulary rows and the score of tensors that only one side has, per (a, b)."""
    totals = headers.groupBy("model").agg(F.count(F.lit(1)).alias("n_tensors"))
    known = totals.join(metadata.precision(headers), "model", "left").join(metadata.vocab_rows(headers), "model", "left")
    side = lambda s: known.select(F.col("model").alias(s), F.col("mean_bits").alias(f"bits_{s}"), F.col("vocab_rows").alias(f"vocab_rows_{s}"))
    extra = metadata.extra_tensor_score(geometry.only_in_one(headers, pairs), totals)
    of = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("extra"))), F.lit(0.0)).alias(f"extra_{s}")
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").join(extra.groupBy("a", "b").agg(of("a"), of("b")), ["a", "b"], "left")


def orphan_evidence(rows: DataFrame, pairs: DataFrame, headers: DataFrame) -> DataFrame:
    """How untrained the embedding rows look that only the side with the larger vocabulary has, per (a, b)."""
    t = metadata.with_roles(headers).where("role = 'embed' and size(shape) = 2")
    largest = F.min_by(F.struct("tensor", F.get("shape", 0).alias("n"), F.get("shape", 1).alias("d")), F.struct(-F.col("numel"), F.col("tensor")))
    embed = t.groupBy("model").agg(largest.alias("e"))
    met = pairs.join(embed.select(F.col("model").alias("a"), F.col("e").alias("ea")), "a").join(embed.select(F.col("model").alias("b"), F.col("e").alias("eb")), "b")
    first = F.col("ea.n") > F.col("eb.n")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    wide = met.where("ea.d = eb.d and ea.n != eb.n").select(
        "a", "b", pick(F.lit("a"), F.lit("b")).alias("side"), pick(F.col("a"), F.col("b")).alias("model"),
        pick(F.col("ea.tensor"), F.col("eb.tensor")).alias("tensor"), F.least("ea.n", "eb.n").alias("n_shared"),
    )
    held = rows.join(wide.select("model", "tensor").distinct(), ["model", "tensor"], "left_semi")
    keys = ["a", "b", "side"]
    orphans = held.join(wide, ["model", "tensor"]).where("row_idx >= n_shared").select(*keys, "v")
    shared = stats.row_norms(held).join(wide, ["model", "tensor"]).where("row_idx < n_shared").select(*keys, "norm")
    found = stats.orphan_stats(orphans, shared, keys)
    of = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("score"))), F.lit(0.0)).alias(f"orphan_score_{s}")
    return found.groupBy("a", "b").agg(of("a"), of("b"))


def spectral_evidence(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cell-weighted spectra over shared matrices per (a, b), added in order of names so that swapping sides flips exactly."""
    s = sketch.spectral_pairs(rows, pairs).where("n_rows >= 2 and n_cols >= 2")
    names = ["energy_a", "energy_b", "erank_a", "erank_b", "erank_d", "top_a", "top_b"]
    cells = (F.col("n_rows") * F.col("n_cols")).cast("double").alias("cells")
    s = s.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("tensor", cells, *names))).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda x, t: x + t["cells"])
    mean = lambda c: F.aggregate("t", F.lit(0.0), lambda x, t: x + t["cells"] * t[c]) / total
    s = s.select("a", "b", *[mean(c).alias(c) for c in names])
    rank = lambda c: (F.col("erank_d") / F.greatest(F.col(f"erank_{c}"), F.lit(1e-12))).alias(f"delta_rank_{c}")
    return s.select(
        "a", "b", *[F.col(f"energy_{c}").alias(f"subspace_energy_{c}") for c in "ab"], rank("a"), rank("b"),
        *[F.col(f"top_{c}").alias(f"top_mass_{c}") for c in "ab"],
    )


def value_evidence(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Evidence per (a, b) from the values of shared tensors alone: parameter-weighted side and pair statistics."""
    norms = materialize(geometry.pair_tensor_stats(rows, pairs), "evidence-sums")
    zero = stats.zero_containment(norms)
    lattice = stats.lattice_fit(rows)
    side = stats.tensor_stats(rows)
    one = side.join(lattice, ["model", "tensor"]).select(
        "model", "tensor", "dead_frac", "outlier_frac", "sharpness", "lattice_frac", F.log(F.col("norm") + 1e-12).alias("log_norm")
    )
    cols = ["dead_frac", "outlier_frac", "sharpness", "lattice_frac", "log_norm"]
    a = one.select(F.col("model").alias("a"), "tensor", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = one.select(F.col("model").alias("b"), "tensor", *[F.col(c).alias(f"{c}_b") for c in cols])
    flags = stats.fossils(stats.row_norms(rows)).select("model", "tensor", "row_idx", "dead", "outlier")
    fa = flags.select(F.col("model").alias("a"), "tensor", "row_idx", F.col("dead").alias("da"), F.col("outlier").alias("oa"))
    fb = flags.select(F.col("model").alias("b"), "tensor", "row_idx", F.col("dead").alias("db"), F.col("outlier").alias("ob"))
    both = pairs.select("a", "b").join(fa, "a").join(fb, ["b", "tensor", "row_idx"])
    n = lambda c: F.sum(c.cast("int"))
    held = lambda x, y: F.coalesce(F.try_divide(n(F.col(x) & F.col(y)), n(F.col(x))), F.lit(1.0))
    fossil = both.groupBy("a", "b", "tensor").agg(
        held("da", "db").alias("dead_h_ab"), held("db", "da").alias("dead_h_ba"),
        held("oa", "ob").alias("outlier_h_ab"), held("ob", "oa").alias("outlier_h_ba"),
    )
    keys = ["a", "b", "tensor"]
    wide = zero.join(norms.select(*keys, "identical"), keys).join(fossil, keys).join(a, ["a", "tensor"]).join(b, ["b", "tensor"])
    wide = wide.withColumnsRenamed({"zero_a": "zero_frac_a", "zero_b": "zero_frac_b", "h_ab": "zero_h_ab", "h_ba": "zero_h_ba"})
    weighted = lambda c: (F.sum(F.col("cells") * F.col(c)) / F.sum("cells")).alias(c)
    means = [f"{c}_{s}" for c in ["zero_frac", *cols] for s in "ab"] + [f"{c}_{d}" for c in PAIR for d in ("ab", "ba")]
    return wide.groupBy("a", "b").agg(*[weighted(c) for c in means], F.avg(F.col("identical").cast("double")).alias("identical_frac"))
