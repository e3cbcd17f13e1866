"""Evaluation metrics as window and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.operators import ordered
from weftmark.plans.shared import dealt

def roc_curve(scores: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by, threshold, tpr, fpr, and how far the point before was): one point per distinct score, ties together; the origin is implied.

    Scores are counted by value and then summed in order by ranges of them, so that one
    method with any number of scores uses all tasks.
    """
    per = scores.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n")
    )
    run = ordered.with_totals(ordered.running_sums(per, by, [F.desc("threshold")], ["p", "n"]), by, ["p", "n"])
    rate = lambda c, of: F.try_divide(c, f"{of}_total")
    return run.select(
        *by, "threshold", rate("p_upto", "p").alias("tpr"), rate("n_upto", "n").alias("fpr"),
        rate("p", "p").alias("tpr_step"), rate("n", "n").alias("fpr_step"),
    )


def roc_auc(curve: DataFrame, by: list[str]) -> DataFrame:
    """Area by trapezoids: each point has its distance from the one before."""
    area = F.col("fpr_step") * (2 * F.col("tpr") - F.col("tpr_step")) / 2
    return curve.groupBy(*by).agg(F.sum(area).alias("auc"))


def average_precision(scores: DataFrame, by: list[str], score: str = "score", label: str = "label", order: str = "pair_no") -> DataFrame:
    """Mean precision at the hits; ties keep the order of ``order``."""
    flat = scores.select(*by, F.col(score).alias("s"), F.col(order).alias("o"), F.col(label).cast("long").alias("l"), F.lit(1).cast("long").alias("one"))
    ranked = ordered.running_sums(flat, by, [F.desc("s"), F.col("o")], ["l", "one"])
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("l") * F.col("l_upto") / F.col("one_upto")), F.sum("l")).alias("ap"))


def fpr_at_tpr(curve: DataFrame, by: list[str], tpr: float = 0.95) -> DataFrame:
    """Least false positive rate among points that reach ``tpr``, with the highest threshold that has it."""
    best = F.min(F.struct("fpr", (-F.col("threshold")).alias("t")))
    return curve.where(F.col("tpr") >= tpr).groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.fpr").alias("fpr"), (-F.col("b.t")).alias("threshold"))


def class_means(scores: DataFrame, by: list[str], threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Share of scores at or above a threshold and mean score, for positives and negatives."""
    at = (F.col(score) >= threshold).cast("double")
    pos = F.col(label).cast("boolean")
    return scores.groupBy(*by).agg(
        F.avg(F.when(pos, at)).alias("tpr"), F.avg(F.when(~pos, at)).alias("fpr"),
        F.avg(F.when(pos, F.col(score))).alias("mean_pos"), F.avg(F.when(~pos, F.col(score))).alias("mean_neg"),
    )


def relatedness_axis(scores: DataFrame, by: list[str], tpr: float = 0.95) -> DataFrame:
    """One row per method of scored pairs (by, pair_no, label, hard, score).

    Area, average precision, the operating point that reaches ``tpr``, and the false positive rates
    of hard controls and of the other negatives at its threshold.  Rates of nothing are null.
    """
    curve = roc_curve(scores, by)
    point = fpr_at_tpr(curve, by, tpr)
    summary = roc_auc(curve, by).join(average_precision(scores, by), by, "left").join(point, by, "left")
    positive = F.col("label").cast("boolean")
    hard = ~positive & F.coalesce(F.col("hard"), F.lit(False))
    over = (F.col("score") >= F.col("threshold")).cast("double")
    rates = scores.join(point.select(*by, "threshold"), by, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(positive).alias("n_positive"), F.count_if(hard).alias("n_hard"),
        F.avg(F.when(hard, over)).alias("hard_fpr"), F.avg(F.when(~positive & ~hard, over)).alias("easy_fpr"),
        F.avg(F.when(positive, F.col("score"))).alias("mean_pos"), F.avg(F.when(hard, F.col("score"))).alias("mean_hard"),
    )
    return rates.join(summary, by, "left")


#: Relations that leave no lossy trace in the child.
SCAR_FREE = ("sft", "lora", "cpt")


def sibling_outgroups(edges: DataFrame, descendants: DataFrame) -> DataFrame:
    """(parent, child, outgroup) of true edges (parent, child, relation) without a trace in the child.

    The outgroup is the first sibling by name that does not descend from the child, by a closure
    (ancestor, descendant); edges without one are left out.
    """
    ours = edges.where(F.lower("relation").isin(*SCAR_FREE)).select("parent", "child").distinct()
    siblings = edges.select("parent", F.col("child").alias("outgroup")).distinct()
    below = descendants.select(F.col("ancestor").alias("child"), F.col("descendant").alias("outgroup"))
    met = ours.join(siblings, "parent").where("outgroup != child").join(below, ["child", "outgroup"], "left_anti")
    return met.groupBy("parent", "child").agg(F.min("outgroup").alias("outgroup"))


def outgroup_rerun(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores per relation and over all of the pairs in both runs (a, b, relation, truth, predicted, llr).

    ``run`` says without or with the outgroup; ``llr_changed`` counts pairs whose ratio moved.
    """
    moved = before.join(after.select("a", "b", F.col("llr").alias("new")), ["a", "b"])
    moved = moved.withColumn("moved", (F.abs(F.col("new") - F.col("llr")) > 1e-9).cast("int"))
    changed = moved.rollup("relation").agg(F.sum("moved").alias("llr_changed"))
    kept = before.join(after.select("a", "b"), ["a", "b"], "left_semi")
    runs = None
    for name, part in (("without", kept), ("with", after)):
        part = direction_scores(part).withColumn("run", F.lit(name))
        runs = part if runs is None else runs.unionByName(part)
    same = runs["relation"].eqNullSafe(changed["relation"])
    return runs.join(changed, same).select("run", runs["relation"], "n", "correct", "abstained", "accuracy", "accuracy_answered", "mean_abs_llr", "llr_changed")


def merge_cases(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row per merged child: parent sets and weights found among candidates against the true ones.

    ``truth`` is (child, parent, weight, method), a weight of null meaning equal shares; ``found`` is
    (child, candidate, weight, selected, residual, r2).
    """
    shares = Window.partitionBy("child")
    known = truth.withColumn("t", F.coalesce("weight", 1 / F.count(F.lit(1)).over(shares))).select("child", F.col("parent").alias("candidate"), "t", "method")
    met = known.join(found.select("child", "candidate", "weight", "selected", "residual", "r2"), ["child", "candidate"], "full_outer")
    gap = F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0)))
    sets = met.groupBy("child").agg(
        F.max("method").alias("method"), F.count("t").cast("int").alias("n_parents"), F.avg(gap).alias("mae"), F.avg(F.when(F.col("t").isNotNull(), gap)).alias("mae_true_parents"),
        F.collect_list(F.when(F.col("t").isNotNull(), F.col("candidate"))).alias("truth"), F.collect_list(F.when(F.col("selected"), F.col("candidate"))).alias("found"),
        F.max("residual").alias("residual"), F.max("r2").alias("r2"),
    )
    return parent_set_prf(sets.where("n_parents > 0"))


def merge_decoys(truth: DataFrame, models: DataFrame, descendants: DataFrame, bases: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(child, candidate): the true parents of every child and ``n`` decoys in the order of a hash.

    No decoy is the child, its parent, its descendant or its base (child, base).  Models stand on a
    circle in the order of a hash; a child looks at as many of them, from a place of its own, as it
    has forbidden models and ``n`` more.
    """
    parents = truth.select("child", F.col("parent").alias("candidate"))
    banned = (
        parents.unionByName(truth.select("child", F.col("child").alias("candidate")))
        .unionByName(descendants.select(F.col("ancestor").alias("child"), F.col("descendant").alias("candidate")))
        .unionByName(bases.select("child", F.col("base").alias("candidate")))
        .distinct()
    )
    drawn = F.sha2(F.concat_ws("|", F.lit(str(seed)), "candidate"), 256)
    circle = models.select(F.col("model").alias("candidate")).distinct()
    circle = circle.withColumn("place", F.row_number().over(Window.orderBy(drawn, "candidate")) - 1)  # names only
    size = circle.agg(F.count(F.lit(1)).alias("size"))
    children = truth.select("child").distinct().join(banned.groupBy("child").agg(F.count(F.lit(1)).alias("held")), "child")
    start = F.pmod(F.xxhash64(F.lit(seed), "child"), F.col("size"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.col("held") + n) - 1)
    asked = children.join(F.broadcast(size)).where("size > 0").select("child", "size", start.alias("start"), F.explode(steps).alias("step"))  # one row
    met = asked.select("child", "step", ((F.col("start") + F.col("step")) % F.col("size")).cast("int").alias("place")).join(circle, "place")
    turn = F.row_number().over(Window.partitionBy("child").orderBy("step"))
    decoys = met.join(banned, ["child", "candidate"], "left_anti").withColumn("turn", turn).where(F.col("turn") <= n)
    return parents.distinct().unionByName(decoys.select("child", "candidate"))


def cost_by_method(costs: DataFrame) -> DataFrame:
    """Count, median, mean and total bytes, seconds and the reduction against full downloads per method."""
    return costs.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.median("bytes").alias("median_bytes"), F.avg("bytes").alias("mean_bytes"), F.sum("bytes").alias("total_bytes"),
        F.median("seconds").alias("median_seconds"), F.try_divide(F.max("full_size"), F.median("bytes")).alias("reduction"),
    )


def transfer_totals(stats: DataFrame, by: list[str]) -> DataFrame:
    """Sums of transfers with the largest full size; reduction is infinite where nothing was read."""
    out = stats.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.sum("requests").alias("requests"), F.sum("seconds").alias("seconds"), F.max("full_size").alias("full_size"))
    return out.withColumn("reduction", F.coalesce(F.try_divide("full_size", "bytes"), F.lit(float("inf"))))


def direction_scores(verdicts: DataFrame) -> DataFrame:
    """Per relation and over all (relation null): counts, accuracy with abstentions wrong, accuracy on answered."""
    answered, right = F.col("predicted") != "unknown", F.col("predicted") == F.col("truth")
    return verdicts.rollup("relation").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right.cast("int")).alias("correct"), F.sum((~answered).cast("int")).alias("abstained"),
        F.avg(right.cast("double")).alias("accuracy"), F.avg(F.when(answered, right.cast("double"))).alias("accuracy_answered"),
        F.avg(F.abs("llr")).alias("mean_abs_llr"),
    )


def merge_scores(cases: DataFrame) -> DataFrame:
    """Means of mae, f1 and residual by method, by number of parents, and over all, as grouping sets."""
    import uuid

    name = f"wm_cases_{uuid.uuid4().hex[:12]}"
    cases.createOrReplaceTempView(name)
    out = cases.sparkSession.sql(
        f"select method, n_parents, count(*) as n, avg(mae) as mae, avg(f1) as f1, avg(residual) as residual "
        f"from {name} group by grouping sets ((method), (n_parents), ())"
    )
    out.schema
    cases.sparkSession.catalog.dropTempView(name)
    return out


def mixing_mae(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute error of weights over the union of keys; a missing weight is 0, weights of a repeated key are summed.

    Both sides are dealt once, to as many tasks as keep their rows bounded, and summed together
    there.  As in a join, null keys meet nothing on the other side.
    """
    keys = [*by, "key"]
    none = F.lit(None).cast("double")
    sided = lambda frame, side, t, f: frame.select(*keys, t.alias("t"), f.alias("f"), F.lit(side).alias("side"))
    weight = F.col("weight").cast("double")
    both = sided(truth, 0, weight, none).unionByName(sided(found, 1, none, weight))
    lone = F.when(F.greatest(*[F.col(c).isNull() for c in keys]), F.col("side"))
    sums = dealt(both.withColumn("side", lone), *keys, "side", rows=1 << 19).groupBy(*keys, "side").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    gap = F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("f", F.lit(0.0)))
    return sums.groupBy(*by).agg(F.avg(gap).alias("mae"))


def parent_set_prf(cases: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """Precision, recall, F1 of two array columns; both empty scores 1."""
    tp = F.size(F.array_intersect(truth, found))
    none = (F.size(truth) == 0) & (F.size(found) == 0)
    ratio = lambda n: F.when(none, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(tp, n), F.lit(0.0)))
    out = cases.withColumn("precision", ratio(F.size(found))).withColumn("recall", ratio(F.size(truth)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def shape_signature(tensors: DataFrame) -> DataFrame:
    """(model, signature): a digest of the sorted names and shapes."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "tensor", F.col("n_rows").cast("string"), F.col("n_cols").cast("string"))))
    return tensors.groupBy("model").agg(F.sha2(F.array_join(parts, "|"), 256).alias("signature"))


#: Labels of pairs that were made as hard controls.
CONTROL_RELATIONS = ("same_shape_diff_init", "same-shape-diff-init", "diff_init", "different_init", "reinit", "control", "hard_negative", "hard-negative", "independent_init", "same_arch_diff_init", "sibling_init", "shuffled")


def signature_classes(signatures: DataFrame) -> DataFrame:
    """(model, signature, class_size): models with one signature; two of them that are unrelated are a hard control."""
    sizes = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("class_size"))
    return signatures.join(sizes, "signature").select("model", "signature", "class_size")


def hard_controls(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Mark unrelated pairs whose relation label, if pairs have one, names a control or whose models have the same shapes."""
    a = signatures.select(F.col("model").alias("a"), F.col("signature").alias("sa"))
    b = signatures.select(F.col("model").alias("b"), F.col("signature").alias("sb"))
    met = pairs.join(a, "a", "left").join(b, "b", "left")
    return marked_controls(met, F.coalesce(F.col("sa") == F.col("sb"), F.lit(False))).drop("sa", "sb")


def marked_controls(pairs: DataFrame, same: Column) -> DataFrame:
    """The rules of :func:`hard_controls`, where it is known which pairs have the same shapes."""
    named = F.coalesce(F.col("relation").isin(*CONTROL_RELATIONS), F.lit(False)) if "relation" in pairs.columns else F.lit(False)
    return pairs.withColumn("hard", ~F.col("related") & (named | same))


def balanced_subsample(pairs: DataFrame, quotas: dict[str, int], by: str = "class", seed: int = 0) -> DataFrame:
    """Up to a quota of each class, in the order of a hash of (seed, a, b)."""
    order = Window.partitionBy(by).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "a", "b"), 256), "a", "b")
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    # the fixed bound lets each task drop, before the shuffle, what is beyond the largest quota among its own rows
    ranked = pairs.where(F.col(by).isin(*quotas)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(quotas.values(), default=0))
    return ranked.where(F.col("rank") <= F.coalesce(F.try_element_at(quota, F.col(by)), F.lit(0)))
