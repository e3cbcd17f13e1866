"""License facts along a lineage: lookup, propagation, conflicts, bill of materials.

Conflicts are judged on declared facts; effective facts are carried beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.functions.scalars import clip, fixed
from weftmark.operators import graph

#: What a license asks of derived models, in words of this library.
_RULES = {
    "patents": "patent grants end for those who sue over them",
    "changes": "say which files were changed",
    "names": "do not advertise with the names of the authors",
    "uses": "some uses are excluded, for derived models as well",
    "pass on": "recipients must get the same terms",
    "users": "services with very many users need a license of their own",
    "label": "names of derived models have to show where they come from",
    "no sale": "commercial use is excluded",
    "same": "derived works stay under this license",
    "network": "offering a service counts as handing out a copy",
    "open": "no recognised license is on record",
}


def _rules(*keys: str) -> tuple[str, ...]:
    return tuple(_RULES[k] for k in keys)


# Id -> (name, SPDX id, commercial use or None for unknown, share alike, attribution, restrictions).
LICENSES = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0", True, False, True, _rules("patents", "changes")),
    "mit": ("MIT License", "MIT", True, False, True, ()),
    "bsd-3-clause": ("BSD 3-Clause License", "BSD-3-Clause", True, False, True, _rules("names")),
    "llama2": ("Llama 2 Community License", "LicenseRef-Llama-2-Community", True, False, True, _rules("uses", "users", "pass on")),
    "llama3": ("Llama 3 Community License", "LicenseRef-Llama-3-Community", True, False, True, _rules("uses", "users", "label")),
    "llama3.1": ("Llama 3.1 Community License", "LicenseRef-Llama-3.1-Community", True, False, True, _rules("uses", "users", "label")),
    "llama3.2": ("Llama 3.2 Community License", "LicenseRef-Llama-3.2-Community", True, False, True, _rules("uses", "users", "label")),
    "gemma": ("Gemma Terms of Use", "LicenseRef-Gemma-Terms", True, False, True, _rules("uses", "pass on")),
    "tongyi-qianwen": ("Tongyi Qianwen (Qwen) License", "LicenseRef-Tongyi-Qianwen", True, False, True, _rules("users", "pass on")),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0", "CC-BY-NC-4.0", False, False, True, _rules("no sale")),
    "cc-by-nc-sa-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC-BY-NC-SA-4.0", False, True, True, _rules("no sale", "same")),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0", True, True, True, _rules("same")),
    "cc-by-4.0": ("Creative Commons Attribution 4.0", "CC-BY-4.0", True, False, True, ()),
    "cc0-1.0": ("Creative Commons Zero v1.0 Universal", "CC0-1.0", True, False, False, ()),
    "openrail": ("OpenRAIL", "LicenseRef-OpenRAIL", True, True, True, _rules("uses", "pass on")),
    "bigscience-openrail-m": ("BigScience OpenRAIL-M", "LicenseRef-BigScience-OpenRAIL-M", True, True, True, _rules("uses", "pass on")),
    "creativeml-openrail-m": ("CreativeML OpenRAIL-M", "LicenseRef-CreativeML-OpenRAIL-M", True, True, True, _rules("uses", "pass on")),
    "gpl-3.0": ("GNU General Public License v3.0", "GPL-3.0-only", True, True, True, _rules("same")),
    "agpl-3.0": ("GNU Affero General Public License v3.0", "AGPL-3.0-only", True, True, True, _rules("same", "network")),
    "unknown": ("Unknown / undeclared", "NOASSERTION", None, False, False, _rules("open")),
}
# Spellings and the ids they stand for.
ALIASES = {
    "apache2": "apache-2.0", "apache-2": "apache-2.0", "apache": "apache-2.0", "apache-license-2.0": "apache-2.0",
    "mit-license": "mit", "bsd-3": "bsd-3-clause", "bsd3": "bsd-3-clause", "bsd": "bsd-3-clause",
    "llama-2": "llama2", "llama2-community": "llama2", "llama-2-community": "llama2", "llama-3": "llama3",
    "llama-3.1": "llama3.1", "llama31": "llama3.1", "llama-3.2": "llama3.2", "llama32": "llama3.2",
    "gemma-terms-of-use": "gemma", "google-gemma": "gemma", "qwen": "tongyi-qianwen", "qwen-license": "tongyi-qianwen",
    "cc-by-nc": "cc-by-nc-4.0", "cc-by-nc-sa": "cc-by-nc-sa-4.0", "cc-by-sa": "cc-by-sa-4.0", "cc-by": "cc-by-4.0",
    "cc0": "cc0-1.0", "openrail-m": "openrail", "bigscience-bloom-rail-1.0": "bigscience-openrail-m",
    "gpl3": "gpl-3.0", "gplv3": "gpl-3.0", "gpl-3.0-only": "gpl-3.0", "agpl3": "agpl-3.0", "agpl-3.0-only": "agpl-3.0",
    "other": "unknown", "unlicensed": "unknown", "none": "unknown",
}

DISCLAIMER = (
    "Findings are statistical evidence for human review. They do not establish that any license was breached."
)


def normalize_license(raw: Column) -> Column:
    """Canonical license id; unknown spellings are kept in lower case, null and blank are ``unknown``."""
    s = F.translate(F.lower(F.trim(raw)), "_ ", "--")
    s = F.regexp_replace(s, "^license[:-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(raw.isNull() | (s == ""), F.lit("unknown")).otherwise(F.coalesce(F.try_element_at(table, s), s))


def license_table(spark: SparkSession) -> DataFrame:
    rows = [(k, n, s, c, sa, at, list(r)) for k, (n, s, c, sa, at, r) in LICENSES.items()]
    return spark.createDataFrame(
        rows, "license string, license_name string, spdx string, commercial_use boolean, share_alike boolean, attribution_required boolean, restrictions array<string>"
    )


def facts(models: DataFrame) -> DataFrame:
    """License facts of (model, declared[, gated]): a left join to the small license table; unknown ids forbid nothing."""
    gated = F.coalesce("gated", F.lit(False)) if "gated" in models.columns else F.lit(False)
    m = models.select("model", normalize_license(F.col("declared")).alias("license"), gated.alias("gated"))
    joined = m.join(F.broadcast(license_table(models.sparkSession)), "license", "left")  # 20 rows
    no = F.lit(False)
    return joined.select(
        "model", "license", F.coalesce("license_name", "license").alias("license_name"), spdx(F.col("license"), F.col("spdx")).alias("spdx"),
        "commercial_use", F.coalesce("share_alike", no).alias("share_alike"), F.coalesce("attribution_required", no).alias("attribution_required"), "gated",
        F.coalesce("restrictions", F.array(F.lit(_RULES["open"]))).alias("restrictions"),
    )


def spdx(license_id: Column, known: Column) -> Column:
    own = F.regexp_replace(F.regexp_replace(license_id, "[^A-Za-z0-9.-]+", "-"), "^-+|-+$", "")
    return F.coalesce(known, F.concat(F.lit("LicenseRef-"), own))


def strictest(value: Column) -> Column:
    """Aggregate of a three-valued flag: any false, else any null, else true."""
    return F.when(F.bool_or(~value), F.lit(False)).when(F.bool_or(value.isNull()), F.lit(None).cast("boolean")).otherwise(F.lit(True))


def propagate(facts_: DataFrame, edges: DataFrame) -> DataFrame:
    """Effective facts: the strictest over a model and all its ancestors; inherited restrictions name their source."""
    up = graph.closure(edges.join(facts_.select(F.col("model").alias("parent")), "parent", "left_semi"))
    flags = ["commercial_use", "share_alike", "attribution_required", "gated", "restrictions"]
    own = facts_.select(F.col("model").alias("node"), *flags, F.lit(None).cast("string").alias("source"), F.lit(0).alias("depth"))
    theirs = facts_.select(F.col("model").alias("ancestor"), *flags)
    inherited = up.join(theirs, "ancestor").select(F.col("descendant").alias("node"), *flags, F.col("ancestor").alias("source"), "depth")
    every = own.unionByName(inherited)
    text = F.when(F.col("source").isNull(), F.col("restrictions")).otherwise(
        F.transform("restrictions", lambda r: F.concat(F.lit("inherited from "), F.col("source"), F.lit(": "), r))
    )
    listed = F.array_sort(F.collect_list(F.struct("depth", "source", text.alias("rs"))))
    out = every.groupBy("node").agg(
        strictest(F.col("commercial_use")).alias("commercial_use"), F.bool_or("share_alike").alias("share_alike"),
        F.bool_or("attribution_required").alias("attribution_required"), F.bool_or("gated").alias("gated"),
        F.array_distinct(F.flatten(F.transform(listed, lambda x: x["rs"]))).alias("restrictions"),
    )
    known = facts_.select(F.col("model").alias("node")).distinct()
    return out.join(known, "node", "left_semi").withColumnRenamed("node", "model")


def conflicts(facts_: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of inconsistent terms: descendant, ancestor, kind, severity, confidence, path, message."""
    paths = graph.best_paths(edges)
    d = facts_.select(F.col("model").alias("descendant"), F.col("license").alias("dl"), F.col("commercial_use").alias("dc"), F.col("share_alike").alias("ds"))
    a = facts_.select(F.col("model").alias("ancestor"), F.col("license").alias("al"), F.col("commercial_use").alias("ac"), F.col("share_alike").alias("asa"), F.col("gated").alias("ag"))
    met = paths.join(d, "descendant", "left").join(a, "ancestor", "left")
    dl, al, no = F.coalesce("dl", F.lit("unknown")), F.coalesce("al", F.lit("unknown")), F.lit(False)
    sure = F.col("least") > schema.CONFIDENT_EDGE
    strong, weak = F.when(sure, "high").otherwise("warning"), F.when(sure, "warning").otherwise("info")
    rule = lambda test, kind, severity: F.when(F.coalesce(test, no), F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    found = F.array(
        rule(~F.col("ac") & F.col("dc"), "noncommercial_ancestor", strong),
        rule(F.coalesce("asa", no) & ~F.coalesce("ds", no) & (dl != "unknown"), "share_alike_broken", strong),
        rule((al == "unknown") | F.col("ac").isNull(), "unknown_ancestor", weak),
        rule(F.coalesce("ag", no), "gated_ancestor", weak),
    )
    flat = met.select("descendant", "ancestor", "path", clip(F.col("product"), 0.0, 1.0).alias("confidence"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    shown = F.format_string(
        "Weight-level evidence suggests %s may descend from %s (path %s; confidence %s). Their recorded terms may not fit (%s). Human review required.",
        "descendant", "ancestor", F.array_join("path", " -> "), fixed(F.col("confidence"), 2), F.col("f.kind"),
    )
    return flat.select("descendant", "ancestor", "f.kind", "f.severity", "confidence", "path", shown.alias("message"))


#: Stems that accuse, and the words every message of a finding ends with.
ACCUSING, REVIEW = ("violat", "infring", "illegal", "unlawful"), "Human review required."


def wording(messages: DataFrame) -> DataFrame:
    """The rows of ``message`` with ``accusing`` (a stem of ACCUSING outside of model names) and ``hedged`` (asks for a review)."""
    said = F.lower("message")
    for c in ("descendant", "ancestor"):
        if c in messages.columns:
            name = F.replace(F.lower(c), F.lit("\\E"), F.lit(""))
            whole = F.concat(F.lit(r"(?<![\w./-])\Q"), name, F.lit(r"\E(?![\w/-])"))
            said = F.regexp_replace(said, whole, F.lit(" "))
    accusing = F.lit(False)
    for stem in ACCUSING:
        accusing = accusing | said.contains(stem)
    return messages.withColumns({"accusing": F.coalesce(accusing, F.lit(False)), "hedged": F.coalesce(F.col("message").endswith(REVIEW), F.lit(False))})


def conflict_order(found: DataFrame) -> DataFrame:
    """Conflicts in report order: severity, confidence, names."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(rank, F.desc("confidence"), "descendant", "ancestor", "kind")


def touched(found: DataFrame) -> DataFrame:
    """Models named by a conflict."""
    return found.select(F.col("descendant").alias("model")).union(found.select("ancestor")).distinct()


def front_matter_license(text: Column) -> Column:
    """The license line of a leading ``---`` block of a model card."""
    block = F.regexp_extract(text, r"(?s)^\s*---\s*\n(.*?)\n---", 1)
    line = F.regexp_extract(block, r"(?m)^license:[ \t]*[\"']?([^\"'\n#]+)", 1)
    return F.nullif(F.trim(line), F.lit(""))
