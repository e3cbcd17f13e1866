"""Fixed coordinates of the sketch and direction spaces, and small dimension tables.

Fixed values: orders, widths and thresholds are part of the data format.
"""

ROLES = ("embed", "attn_q", "attn_k", "attn_v", "attn_o", "mlp_in", "mlp_out", "lm_head", "norm")
DEPTH_BUCKETS = (0.0, 0.25, 0.5, 0.75, 1.0)
SLOT_FEATURES, GLOBAL_FEATURES = 32, 16
SKETCH_DIM = len(ROLES) * len(DEPTH_BUCKETS) * SLOT_FEATURES + GLOBAL_FEATURES
SKETCH_VERSION, INDEX_VERSION, DIRECTION_VERSION = 1, 1, 1

#: Direction features in order, with the default weights.
DIRECTION_WEIGHTS = {
    "vocab_delta": 2.0,
    "orphan_asym": 3.0,
    "lattice_asym": 3.0,
    "zero_asym": 1.5,
    "zero_subset_asym": 2.5,
    "dtype_precision_asym": 3.0,
    "subspace_energy_asym": 0.25,
    "delta_rank_asym": 0.20,
    "spectral_growth_asym": 0.20,
    "norm_growth_asym": 0.0,
    "dead_fossil_asym": 1.0,
    "outlier_fossil_asym": 0.5,
    "exact_tie_asym": 0.5,
}
OUTGROUP_WEIGHT = 2.0
ABSTAIN = 0.5

#: Least oriented value of a feature that names a relation, in order of precedence.
RELATION_RULES = (
    ("quantized", (("lattice_asym", 0.15), ("dtype_precision_asym", 0.15))),
    ("pruned", (("zero_subset_asym", 0.15), ("zero_asym", 0.20))),
    ("vocab_extended", (("vocab_delta", 0.05), ("orphan_asym", 0.15))),
    (
        "finetuned",
        (
            ("subspace_energy_asym", 0.05),
            ("norm_growth_asym", 0.05),
            ("delta_rank_asym", 0.10),
            ("spectral_growth_asym", 0.05),
        ),
    ),
)

DTYPE_BITS = {
    "F64": 64, "F32": 32, "F16": 16, "BF16": 16,
    "F8_E4M3": 8, "F8_E4M3FN": 8, "F8_E4M3FNUZ": 8, "F8_E5M2": 8, "F8_E5M2FNUZ": 8,
    "I64": 64, "U64": 64, "I32": 32, "U32": 32, "I16": 16, "U16": 16, "I8": 8, "U8": 8, "BOOL": 1,
}
QUANT_HINTS = ("scale", "zero_point", "qzeros", "qweight", "absmax", "g_idx", "quant", "zeros")

DEAD_ABS, DEAD_REL, OUTLIER_MULT = 1e-6, 1e-3, 8.0
ZERO_GATE, DEAD_GATE, OUTLIER_GATE = 0.01, 0.002, 0.005
LATTICE_TOLERANCE, LATTICE_LEVELS = 1e-3, (3, 4096)
MIN_ORPHAN_ROWS = 8
OUTGROUP_CANONICAL = 3.0 - 2.0 * 2.0**0.5
MAX_DISTANCE, MIN_RELATEDNESS, COUSIN_FLOOR, RECONSTRUCTED = 0.35, 0.6, 0.15, 1e-5
CONFIDENT_EDGE = 0.8
COALESCE_GAP = 64 * 1024
SAMPLE_BLOCKS = 16
