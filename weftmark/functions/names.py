"""Tensor names to roles, layers, depth buckets and sketch slots, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmark import schema

# Patterns of ignored names, and of roles and layers in order of precedence.
IGNORED = r"(rotary|inv_freq|masked_bias|attn\.bias|position_ids|wpe)"
ROLE_PATTERNS = (
    ("embed", r"(embed_tokens|\bwte\b|word_embeddings|tok_embeddings|embeddings\.word)"),
    ("lm_head", r"(lm_head|\boutput\.weight$|score\.weight$|embed_out)"),
    ("attn_q", r"(q_proj|query|\bwq\b|attn\.c_attn|query_key_value|\bWq\b)"),
    ("attn_k", r"(k_proj|\bkey\b|\bwk\b)"),
    ("attn_v", r"(v_proj|\bvalue\b|\bwv\b)"),
    ("attn_o", r"(o_proj|out_proj|\bwo\b|attn\.c_proj|dense\.weight)"),
    ("mlp_in", r"(gate_proj|up_proj|\bw1\b|\bw3\b|mlp\.c_fc|fc_in|intermediate\.dense)"),
    ("mlp_out", r"(down_proj|\bw2\b|mlp\.c_proj|fc_out|output\.dense)"),
    ("norm", r"(?i)(layernorm|layer_norm|\bln_\d*\b|\bln_f\b|rmsnorm|\bnorm\.weight$)"),
)
LAYER_PATTERNS = (
    r"\.layers?\.(\d+)\.",
    r"\.h\.(\d+)\.",
    r"\.blocks?\.(\d+)\.",
    r"\.layer\.(\d+)\.",
    r"\btransformer\.(\d+)\.",
)


def role(name: Column) -> Column:
    """Role of a tensor, null for biases, caches and everything unknown; the first pattern that matches wins."""
    out = F.when(name.endswith(".bias") | name.rlike(IGNORED), F.lit(None).cast("string"))
    for value, pattern in ROLE_PATTERNS:
        out = out.when(name.rlike(pattern), F.lit(value))
    return out


def layer_index(name: Column) -> Column:
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in LAYER_PATTERNS]
    return F.coalesce(*found).cast("int")


def relative_depth(index: Column, n_layers: Column) -> Column:
    ratio = index.cast("double") / F.greatest(n_layers - 1, F.lit(1))
    return F.when(n_layers <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def depth_bucket(depth: Column) -> Column:
    """Nearest bucket, the lower one on ties."""
    b = schema.DEPTH_BUCKETS
    out = F.when(depth <= (b[0] + b[1]) / 2, F.lit(0))
    for i in range(1, len(b) - 1):
        out = out.when(depth <= (b[i] + b[i + 1]) / 2, F.lit(i))
    return out.otherwise(F.lit(len(b) - 1))


def layerless_bucket(role_of: Column) -> Column:
    return F.when(role_of.isin("lm_head", "norm"), F.lit(len(schema.DEPTH_BUCKETS) - 1)).otherwise(F.lit(0))


def slot(role_of: Column, bucket: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(r) for r in schema.ROLES]), role_of)
    return ((place - 1) * len(schema.DEPTH_BUCKETS) + bucket).cast("int")
