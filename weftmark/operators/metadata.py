"""Model metadata from tensor headers (model, tensor, dtype, shape, numel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.functions import names
from weftmark.functions.scalars import finite, sanitize

# Config keys that name the number of layers, in order.
LAYER_KEYS = ("num_hidden_layers", "n_layer", "n_layers", "num_layers", "num_blocks")


def dtype_bits(dtype: Column, default: int = 16) -> Column:
    table = F.create_map(*[F.lit(x) for pair in schema.DTYPE_BITS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, dtype), F.lit(default))


def with_roles(tensors: DataFrame) -> DataFrame:
    name = F.col("tensor")
    return tensors.withColumn("role", names.role(name)).withColumn("layer", names.layer_index(name)).withColumn(
        "numel", F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    )


def layer_counts(tensors: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Layers per model: largest index + 1, else a config key (model, map of strings), else 1."""
    found = with_roles(tensors).groupBy("model").agg((F.max("layer") + 1).alias("n"))
    if config is None:
        return found.select("model", F.coalesce("n", F.lit(1)).cast("int").alias("n_layers"))
    keys = [F.try_element_at(F.col("config"), F.lit(k)).cast("int") for k in LAYER_KEYS]
    return found.join(config, "model", "left").select("model", F.coalesce("n", *keys, F.lit(1)).cast("int").alias("n_layers"))


def precision(tensors: DataFrame) -> DataFrame:
    """Stored bits per parameter, over tensors of two dimensions or more."""
    t = with_roles(tensors).where("size(shape) >= 2").withColumn("bits", dtype_bits(F.col("dtype")))
    return t.groupBy("model").agg((F.sum(F.col("numel") * F.col("bits")) / F.sum("numel")).alias("mean_bits"))


def vocab_rows(tensors: DataFrame) -> DataFrame:
    t = with_roles(tensors)
    rows = F.when((F.size("shape") == 2) & F.col("role").isin("embed", "lm_head"), F.get("shape", 0))
    return t.groupBy("model").agg(F.coalesce(F.max(rows), F.lit(0).cast("long")).alias("vocab_rows"))


def extra_tensor_score(only: DataFrame, totals: DataFrame) -> DataFrame:
    """Per (a, b, side): auxiliary tensors count twice, over the side's tensors, at most 1."""
    hint = F.lower("tensor").rlike("|".join(schema.QUANT_HINTS))
    n = only.groupBy("a", "b", "side").agg(F.sum(F.when(hint, 2).otherwise(1)).alias("n"))
    model = F.when(F.col("side") == "a", F.col("a")).otherwise(F.col("b"))
    n = n.withColumn("model", model).join(totals, "model")
    return n.select("a", "b", "side", F.least(F.lit(1.0), F.col("n") / F.greatest("n_tensors", F.lit(1))).alias("extra"))


def model_meta(tensors: DataFrame) -> DataFrame:
    """One row per model: counts, dtypes, shapes by role, and the flags fused, tied."""
    t = with_roles(tensors).withColumn("bits", dtype_bits(F.col("dtype")))
    of = lambda role, value: F.when(F.col("role") == role, value)
    first = lambda role: F.min_by(of(role, F.col("shape")), of(role, F.col("tensor")))
    largest = lambda role: F.max_by(of(role, F.col("shape")), of(role, F.struct("numel", "tensor")))
    return t.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_tensors"),
        F.sum("numel").alias("n_params"),
        F.sum((F.size("shape") == 1).cast("int")).alias("n_vectors"),
        F.avg(F.col("bits").cast("double")).alias("mean_bits"),
        F.count_distinct("dtype").alias("n_dtypes"),
        F.bool_or(F.col("tensor").rlike(r"c_attn|query_key_value|qkv")).alias("fused"),
        (F.coalesce(F.bool_or(F.col("role") == "embed"), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("role") == "lm_head"), F.lit(False))).alias("tied"),
        first("attn_q").alias("q_shape"), first("attn_k").alias("k_shape"),
        largest("embed").alias("embed_shape"), largest("mlp_in").alias("mlp_shape"),
        F.max(F.coalesce(F.col("layer") + 1, F.lit(1))).alias("n_layers"),
    )


def global_features(meta: DataFrame, present: Column, architectures: Column | None = None, limit: float | None = 10.0) -> DataFrame:
    """The 16 global features of a sketch from :func:`model_meta` and the mean of its presence mask.

    A sketch keeps each within ``limit`` of zero; without one they are whole.
    """
    col, one = F.col, F.lit(1.0)
    hidden = F.coalesce(F.get("embed_shape", 1), F.lit(0)).cast("double")
    vocab = F.coalesce(F.get("embed_shape", 0), F.lit(0)).cast("double")
    wide = F.coalesce(F.get("mlp_shape", 0), F.lit(0)).cast("double")
    least = lambda s: F.coalesce(F.array_min(s), F.lit(0)).cast("double")
    log = lambda x: F.log10(one + x)
    features = [
        log(col("n_params")) / 10, col("n_layers") / 64, log(hidden) / 5, log(vocab) / 5, col("n_tensors") / 512, present,
        F.coalesce(F.try_divide(wide, hidden), F.lit(0.0)) / 8, least("k_shape") / F.greatest(least("q_shape"), one),
        col("fused").cast("double"), col("mean_bits") / 32, col("n_dtypes") / 8, col("tied").cast("double"),
        F.coalesce(F.try_divide(vocab, hidden), F.lit(0.0)) / 100, F.try_divide("n_vectors", "n_tensors"),
        log(F.try_divide(col("n_params"), col("n_tensors"))) / 10, F.coalesce(architectures if architectures is not None else F.lit(1), F.lit(1)) / 4,
    ]
    kept = (lambda x: finite(x)) if limit is None else (lambda x: sanitize(x, limit))
    return meta.select("model", F.array(*[kept(f.cast("double")) for f in features]).alias("globals"))
