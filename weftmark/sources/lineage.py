"""A universe of related models derived from the ``embeddings`` table by plain arithmetic.

The label of a vector names its tensor, its rank within the label is the row, the
array position the column.  Children are made from the root as SQL can repeat it, so
that every lineage operator has data with a known answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.operators import simulate
from weftmark.plans.shared import materialize

#: Tensor names by label.
TENSORS = (
    "model.embed_tokens.weight",
    "model.layers.0.self_attn.q_proj.weight",
    "model.layers.0.self_attn.k_proj.weight",
    "model.layers.0.self_attn.v_proj.weight",
    "model.layers.0.self_attn.o_proj.weight",
    "model.layers.0.mlp.gate_proj.weight",
    "model.layers.0.mlp.up_proj.weight",
    "model.layers.0.mlp.down_proj.weight",
    "model.layers.1.self_attn.q_proj.weight",
    "lm_head.weight",
)
#: True edges (parent, child, relation, weight) of the derived universe.
EDGES = (
    ("root", "sft", "sft", None),
    ("root", "lora", "lora", None),
    ("sft", "cpt", "cpt", None),
    ("root", "int8", "quant", None),
    ("root", "prune30", "prune", None),
    ("sft", "merge2", "merge", 0.6),
    ("cpt", "merge2", "merge", 0.4),
)
MODELS = ("root", "sft", "lora", "cpt", "int8", "prune30", "merge2", "unrelated")
_made: dict[tuple[str, str], DataFrame] = {}


def root_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tensor, row_idx, n_rows, v) of the root model."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    names = F.array(*[F.lit(t) for t in TENSORS])
    by = Window.partitionBy("label")
    return e.select(
        F.get(names, F.col("label").cast("int")).alias("tensor"),
        (F.row_number().over(by.orderBy("vec_id")) - 1).cast("long").alias("row_idx"),
        F.count(F.lit(1)).over(by).alias("n_rows"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )


def derive(root: DataFrame) -> DataFrame:
    """(model, tensor, row_idx, v) of all models derived from the root's rows."""
    plus = lambda a, b, w: F.zip_with(a, b, lambda x, y: x + F.lit(w) * y)

    def shifted(by: int) -> DataFrame:
        """Each row with the row ``by`` places further of the same tensor, around the end."""
        far = root.select("tensor", F.pmod(F.col("row_idx") - by, F.col("n_rows")).alias("row_idx"), F.col("v").alias("w"))
        return root.join(far, ["tensor", "row_idx"])

    sft = shifted(7).select("tensor", "row_idx", "n_rows", plus("v", "w", 0.03).alias("v"))
    lora = shifted(13).select("tensor", "row_idx", plus("v", "w", 0.03).alias("v"))
    far = root.select("tensor", F.pmod(F.col("row_idx") - 29, F.col("n_rows")).alias("row_idx"), F.col("v").alias("w"))
    cpt = sft.join(far, ["tensor", "row_idx"]).select("tensor", "row_idx", F.col("v").alias("s"), plus("v", "w", 0.03).alias("v"))
    merge2 = cpt.select(
        "tensor", "row_idx", F.zip_with("s", "v", lambda a, b: F.lit(0.6) * a + F.lit(0.4) * b).alias("v")
    )
    unrelated = shifted(11).select("tensor", "row_idx", F.reverse("w").alias("v"))
    int8 = simulate.int8_round_trip(root)
    prune = simulate.magnitude_prune(root, 0.3)
    out = None
    for name, rows in (
        ("root", root), ("sft", sft), ("lora", lora), ("cpt", cpt), ("int8", int8), ("prune30", prune),
        ("merge2", merge2), ("unrelated", unrelated),
    ):
        rows = rows.select(F.lit(name).alias("model"), "tensor", "row_idx", "v")
        out = rows if out is None else out.unionByName(rows)
    return out


def tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived universe as a written table, partitioned by model, made once a session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _made:
        root = materialize(root_rows(spark, sf_dir), "lineage-root")
        _made[name] = materialize(derive(root), "lineage-rows", "model")
    return _made[name]


def edges(spark: SparkSession) -> DataFrame:
    """True edges: parent, child, relation, weight."""
    return spark.createDataFrame([*EDGES], "parent string, child string, relation string, weight double")


_NAMES = ", ".join(f"'{t}'" for t in TENSORS)
#: DuckDB views of the same universe: ``tr`` (model, tensor, r, v) and ``cells`` (model, tensor, r, c, x).
ORACLE = f"""
e as materialized (
  select ([{_NAMES}])[label + 1] as tensor, row_number() over (partition by label order by vec_id) - 1 as r,
         count(*) over (partition by label) as n, embedding
  from embeddings
),
c_root as materialized (
  select tensor, r, n, unnest(range(64))::int as c, unnest(embedding)::double as x from e
),
c_sft as materialized (
  select a.tensor, a.r, a.n, a.c, a.x + 0.03::double * b.x as x from c_root a
  join c_root b on b.tensor = a.tensor and b.r = (a.r + 7) % a.n and b.c = a.c
),
c_cpt as materialized (
  select a.tensor, a.r, a.n, a.c, a.x + 0.03::double * b.x as x from c_sft a
  join c_root b on b.tensor = a.tensor and b.r = (a.r + 29) % a.n and b.c = a.c
),
absmax as (select tensor, r, max(abs(x)) / 127::double as s from c_root group by all),
cut as (select tensor, quantile_cont(abs(x), 0.3) as q from c_root group by all),
cells as materialized (
  select 'root' as model, tensor, r, c, x from c_root
  union all select 'sft', tensor, r, c, x from c_sft
  union all select 'lora', a.tensor, a.r, a.c, a.x + 0.03::double * b.x from c_root a
    join c_root b on b.tensor = a.tensor and b.r = (a.r + 13) % a.n and b.c = a.c
  union all select 'cpt', tensor, r, c, x from c_cpt
  union all select 'int8', tensor, r, c, round_even(x / s, 0) * s from c_root join absmax using (tensor, r)
  union all select 'prune30', tensor, r, c, case when abs(x) >= q then x else 0 end from c_root join cut using (tensor)
  union all select 'merge2', a.tensor, a.r, a.c, 0.6::double * a.x + 0.4::double * b.x from c_sft a
    join c_cpt b using (tensor, r, c)
  union all select 'unrelated', a.tensor, a.r, a.c, b.x from c_root a
    join c_root b on b.tensor = a.tensor and b.r = (a.r + 11) % a.n and b.c = 63 - a.c
)
"""
