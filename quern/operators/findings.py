"""Findings as tables: identity, duplicates, suppression, baseline, ranking, counts.

A findings table has rule, severity, confidence, tier, context, file, line, function and flow (a struct or null), as
far as an operator needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import CONFIDENCE_WEIGHT, SEVERITY_WEIGHT, mapped

DIRECTIVE, REASON_CHARS, TOP = "quern-ignore:", 120, 10
CONTEXTS, SEVERITIES = ("production", "test", "fixture", "detector_definition"), ("critical", "high", "medium", "low")
EXPOSURE = 100


def fingerprint() -> Column:
    return F.concat_ws(":", "rule", "file", F.col("line").cast("string"))


def first_of_each(findings: DataFrame, *order: str) -> DataFrame:
    """The first finding of each rule, file and line, by order."""
    w = Window.partitionBy("rule", "file", "line").orderBy(*(order or ("line",)))
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_stable_ids(findings: DataFrame, *order: str) -> DataFrame:
    """Findings with stable_id: rule, file, function and the ordinal among those, so that moved lines keep their ids."""
    w = Window.partitionBy("rule", "file", F.coalesce("function", F.lit("-"))).orderBy("line", *order)
    return findings.withColumn("stable_id", F.concat_ws(":", "rule", "file", F.coalesce("function", F.lit("-")), F.row_number().over(w).cast("string")))


def with_baseline(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Findings with baselined: whether ids (stable_id) holds theirs."""
    known = ids.select("stable_id").distinct().withColumn("_known", F.lit(True))
    return findings.join(known, "stable_id", "left").withColumn("baselined", F.coalesce("_known", F.lit(False))).drop("_known")


def without_taint_twins(structural: DataFrame, taint: DataFrame, *keys: str) -> DataFrame:
    """Both kinds together, without structural findings that a taint finding on the same line and category covers."""
    return structural.join(taint.select(*keys).distinct(), list(keys), "left_anti").unionByName(taint, allowMissingColumns=True)


def directives(lines: DataFrame, marker: str = DIRECTIVE) -> DataFrame:
    """file, line_no, id and reason of suppression directives with a reason, in lines (file, line_no, line)."""
    at = lines.filter(F.col("line").contains(marker))
    at = at.withColumn("rest", F.ltrim(F.expr(f"substring(line, locate('{marker}', line) + {len(marker)})")))
    at = at.withColumn("id", F.regexp_extract("rest", r"^(\S+)\s", 1))
    reason = F.rtrim(F.regexp_replace(F.trim(F.regexp_extract("rest", r"^\S+\s+(.*)$", 1)), r"(\*/)+$", ""))
    at = at.withColumn("reason", F.substring(reason, 1, REASON_CHARS))
    return at.filter("id != '' and reason != ''").select("file", "line_no", "id", "reason")


def removed(findings: DataFrame) -> DataFrame:
    """findings and removed: how many there are, and how many of them first_of_each leaves out."""
    return findings.agg(F.count("rule").alias("findings"), (F.count("rule") - F.countDistinct(F.struct("rule", "file", "line"))).alias("removed"))


def with_suppression(findings: DataFrame, found: DataFrame, legacy: dict[str, str] | None = None) -> DataFrame:
    """Findings with reason: of a directive (file, line_no, id, reason) on their line or else the line above, or null.

    Directives are dealt to the two lines that they speak for, and to the rules that had their id before (legacy: rule
    to old id), so the join is on equality.
    """
    olds: dict[str, list[str]] = {}
    for rule, old in (legacy or {}).items():
        olds.setdefault(old, []).append(rule)
    if olds:
        table = F.create_map(*[x for old, rules in olds.items() for x in (F.lit(old), F.array(*[F.lit(r) for r in rules]))])
        ids = F.explode(F.concat(F.array("id"), F.coalesce(F.element_at(table, F.col("id")), F.array().cast("array<string>"))))
        found = found.select("file", "line_no", ids.alias("id"), "reason")
    near = found.select("file", F.explode(F.array(F.struct(F.col("line_no").alias("line"), F.lit(0).alias("away")), F.struct((F.col("line_no") + 1).alias("line"), F.lit(1).alias("away")))).alias("t"), "id", "reason")
    near = near.select("file", F.col("t.line").alias("line"), F.col("id").alias("rule"), F.col("t.away").alias("away"), "reason")
    best = near.groupBy("file", "line", "rule").agg(F.min_by("reason", F.struct("away", "reason")).alias("reason"))
    return findings.join(best, ["file", "line", "rule"], "left")


def matrix(findings: DataFrame) -> DataFrame:
    """Counts by context and severity, a row for each of the contexts; without patterns and baselined findings."""
    counted = findings.filter("tier != 'pattern' and not baselined").groupBy("context").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    every = findings.sparkSession.createDataFrame([(c,) for c in CONTEXTS], "context string")
    return every.join(counted, "context", "left").na.fill(0)


def ranked_functions(findings: DataFrame, k: int = TOP) -> DataFrame:
    """The k functions with the highest score: weights of severity times confidence, and a bonus if input reaches one."""
    weight = mapped(F.col("severity"), SEVERITY_WEIGHT) * mapped(F.col("confidence"), CONFIDENCE_WEIGHT)
    own = findings.filter("context = 'production' and not baselined and function is not null")
    by = own.groupBy("file", "function").agg(F.sum(weight).alias("base"), F.count("rule").alias("findings"), F.max(F.col("flow").isNotNull()).alias("exposed"))
    score = F.col("base") + F.when(F.col("exposed"), EXPOSURE).otherwise(0)
    return by.select("file", "function", score.alias("score"), "findings", "exposed").orderBy(F.desc("score"), "file", "function").limit(k)


def baselined_by_rule(findings: DataFrame) -> DataFrame:
    """rule, n and baselined: findings of each rule, and how many of them the baseline holds."""
    return findings.groupBy("rule").agg(F.count("file").alias("n"), F.count_if("baselined").alias("baselined"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("file").alias("findings")).orderBy("rule")


#: Lines of a bucket in joins of lines with ranges.
BUCKET = 256


def _dealt(ranges: DataFrame) -> DataFrame:
    """ranges with _bucket: a row for each bucket of lines that a range (start_line, end_line) reaches into."""
    return ranges.select("*", F.explode(F.expr(f"sequence(start_line div {BUCKET}, greatest(start_line, end_line) div {BUCKET})")).alias("_bucket"))


def reclassified(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Production findings within a test range (file, start_line, end_line) become test findings."""
    near = findings.select("file", "line", F.expr(f"line div {BUCKET}").alias("_bucket")).distinct().join(_dealt(ranges), ["file", "_bucket"])
    hit = near.filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("file", "line").distinct().withColumn("_in", F.lit(True))
    out = findings.join(hit, ["file", "line"], "left")
    return out.withColumn("context", F.when(F.col("_in") & (F.col("context") == "production"), "test").otherwise(F.col("context"))).drop("_in")


def enclosing(points: DataFrame, ranges: DataFrame, *keys: str) -> DataFrame:
    """points with name and within: of the innermost range (keys, name, start_line, end_line) around their line, and its first line, or null.

    Lines and ranges meet by keys and bucket of lines, so a line meets only the ranges near it, and a large file is
    dealt to as many tasks as it has buckets.
    """
    lines = points.select(*keys, "line", F.expr(f"line div {BUCKET}").alias("_bucket")).distinct()
    inner = lines.join(_dealt(ranges), [*keys, "_bucket"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = inner.groupBy(*keys, "line").agg(F.max_by("name", F.struct("start_line", "name")).alias("name"), F.max("start_line").alias("within"))
    return points.join(best, [*keys, "line"], "left")
