"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one failure bit per rule; policies are versioned masks applied to the ledger
later, and ablations come from one bitwise aggregation over distinct masks.  All
of it is row-local SQL: nothing is shuffled but the (at most 2**rules) mask counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named test; ``fails`` maps the measurement columns to a boolean."""

    name: str
    fails: str


#: Bit i of a ledger's mask belongs to rule i.  Append only: stored masks outlive a version.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_share", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("shouting", "n_letters > 0 and 2 * n_upper > n_letters"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)

#: Policy version -> the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": (
        "too_few_words",
        "repeated_words",
        "symbol_share",
        "duplicate_lines",
        "short_words",
        "long_words",
        "shouting",
    ),
    "strict": tuple(rule.name for rule in RULES),
}


def policy_mask(version: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(name) for name in POLICIES[version])


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(text: Column) -> dict[str, Column]:
    """Measurements over one text column, the word list first (needs two projections)."""
    return {
        "words": F.filter(F.split(text, SPACE + "+"), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n"), lambda line: _strip(line, _BLANKS) != ""),
        "n_symbols": (F.length(text) - F.length(_strip(text, _SYMBOLS))).cast("long"),
        "word_chars": F.length(_strip(text, _BLANKS)).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
    }


def _windows(words: Column, width: int = 3) -> Column:
    """A 64-bit hash of every window of ``width`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def _sorted_twins(windows: Column) -> Column:
    """(hash, place) of all windows by hash, or nothing where no two are equal."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered).otherwise(none)


def _twin_starts(ordered: Column) -> Column:
    """Places, in order, of the windows that stand next to an equal one in ``ordered``."""
    near = lambda x, i: F.get(ordered, i)["h"].eqNullSafe(x["h"])
    twins = F.filter(ordered, lambda x, i: ((i > 0) & near(x, i - 1)) | near(x, i + 1))
    return F.sort_array(F.transform(twins, lambda x: x["i"]))


def _covered(starts: Column, width: int = 3) -> Column:
    """Words under the windows at ``starts``: each start adds up to ``width`` new ones."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which no filter is pushed.

    A filter that moves below the measurements would copy their expressions into itself
    and into their lambdas, and evaluate an array for each of its elements.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def ledger(df: DataFrame, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """One row per document: ``key``, the measurements and ``failed_mask``.

    ``carry`` adds the input row as the struct column ``r``.  Null text counts as
    empty: no words, every count 0, and it fails ``too_few_words``.  A null or
    repeated key is carried through unchanged; each row is judged on its own, so
    ties do not matter.  Other columns are ignored whatever their names.  An empty
    table gives an empty ledger.
    """
    whole = [F.struct(*[F.col(c) for c in df.columns]).alias("r")] if carry else []
    carried = ["r"] if carry else []
    base = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *whole)
    made = measure(F.col("t"))
    base = base.select("k", *carried, *[c.alias(n) for n, c in made.items()])
    # each array is a column before a lambda looks into it, so that it is built once a row
    base = base.withColumn("windows", _windows(F.col("words")))
    base = base.withColumn("ordered", _sorted_twins(F.col("windows")))
    measured = base.select(
        "k",
        *carried,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(_twin_starts(F.col("ordered"))).alias("n_repeat_words"),
        "n_letters",
        "n_upper",
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(RULES)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return fenced(measured).withColumn("failed_mask", mask).withColumnRenamed("k", key)


def apply_policy(rows: DataFrame, version: str = "v1", mask: str = "failed_mask") -> DataFrame:
    """Add ``kept``: no rule of the policy failed.  The ledger is not evaluated again."""
    return rows.withColumn("kept", F.col(mask).bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(rows: DataFrame, version: str = "v1", mask: str = "failed_mask") -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, rows kept without it.

    Distinct masks are counted first (at most 2**len(RULES) of them), and every
    ablated policy is then a bitwise test on those counts.
    """
    policy = policy_mask(version)
    counts = rows.select(F.col(mask).bitwiseAND(F.lit(policy)).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("c"))
    names = [r.name for r in RULES]
    sums = []
    for name in POLICIES[version]:
        bit = 1 << names.index(name)
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.sum(F.when(F.col("m").bitwiseAND(F.lit(bit)) != 0, F.col("c")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(F.col("m") == bit, F.col("c")).otherwise(0)).alias("n_failed_alone"),
                F.sum(F.when(F.col("m").bitwiseAND(F.lit(policy & ~bit)) == 0, F.col("c")).otherwise(0)).alias("n_kept_without"),
            )
        )
    return counts.agg(F.array(*sums).alias("a")).select(F.inline("a"))


def keep_quality(df: DataFrame, version: str = "v1", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The input rows, unchanged, that pass the policy."""
    return apply_policy(ledger(df, text, key, carry=True), version).where("kept").select("r.*")
