"""Operators over lines: continued lines, comment runs, lint marks and rules, infrastructure and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import redact
from quern.sources.files import infra_target, is_config, lines

# Markers of unfinished work, in order, and substrings by language with message and rule.
MARKERS = ("TODO", "FIXME", "HACK")
LINT: tuple[tuple[str, str, str, str], ...] = (
    ("javascript", "console.log(", "console.log() detected", "no-console"),
    ("javascript", "debugger;", "debugger statement detected", "no-debugger"),
    ("typescript", "console.log(", "console.log() detected", "no-console"),
    ("typescript", "debugger;", "debugger statement detected", "no-debugger"),
    ("tsx", "console.log(", "console.log() detected", "no-console"),
    ("tsx", "debugger;", "debugger statement detected", "no-debugger"),
    ("python", "print(", "print() detected", "no-print"),
    ("python", "import *", "wildcard import detected", "import-star"),
    ("java", "System.out.println(", "System.out.println() detected", "no-system-out"),
    ("rust", "unwrap()", ".unwrap() detected", "no-unwrap"),
    ("rust", "dbg!(", "debug print detected", "no-debug-print"),
    ("rust", "println!(", "debug print detected", "no-debug-print"),
)
SLASHES = ("rust", "javascript", "typescript", "tsx", "java", "c", "csharp")

# Rules of infrastructure files: id, weakness, category, severity, targets, pattern.
INFRA: tuple[tuple[str, str, str, str, tuple[str, ...], str], ...] = (
    ("docker-root-user", "CWE-250", "container_hardening", "medium", ("dockerfile",), r"(?i)^\s*USER\s+(root|0)(\s|:|$)"),
    ("docker-remote-add", "CWE-829", "supply_chain", "medium", ("dockerfile",), r"(?i)^\s*ADD\s+(--\S+\s+)*https?://"),
    ("any-download-pipe-to-shell", "CWE-494", "supply_chain", "high", ("dockerfile", "yaml", "shell"), r"\b(curl|wget)\b[^|\n]*\|\s*(sudo\s+)?(sh|bash|zsh|ash|dash)\b"),
    ("docker-secret-in-env", "CWE-798", "hardcoded_secret", "high", ("dockerfile",), r"(?i)^\s*(ENV\s+\w*(PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY|PRIVATE_KEY|ACCESS_KEY)\w*(\s*=\s*|\s+)\S|ARG\s+\w*(PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY|PRIVATE_KEY|ACCESS_KEY)\w*)"),
    ("docker-ssh-port-exposed", "CWE-284", "container_hardening", "low", ("dockerfile",), r"(?i)^\s*EXPOSE\s+(.*\s)?22(/tcp)?(\s|$)"),
    ("docker-unpinned-base-image", "CWE-829", "supply_chain", "low", ("dockerfile",), r"(?i)^\s*FROM\s+(--\S+\s+)*([^\s@]+?)(:[^\s/@]+)?(\s|$)"),
    ("yaml-privileged-container", "CWE-250", "container_hardening", "high", ("yaml",), r"^\s*privileged\s*:\s*true\b"),
    ("spring-actuator-endpoints-exposed", "CWE-200", "exposure", "medium", ("properties", "yaml"), r"""(management\.endpoints\.web\.exposure\.include\s*[=:]\s*["']?\*|^\s*include\s*:\s*["']\*["'])"""),
    ("spring-ssl-disabled", "CWE-319", "transport_security", "medium", ("properties", "yaml"), r"server\.ssl\.enabled\s*[=:]\s*false\b"),
)


def islands(lines_: DataFrame, member: Column, *keys: str) -> DataFrame:
    """start, end and text of each run of neighbouring lines for which member holds."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines_.filter(member).withColumn("_island", F.col("line_no") - F.row_number().over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy(*keys, "_island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), text.alias("text")).drop("_island")


def logical(lines_: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no (of the start) and line: comment lines dropped, lines that end in a backslash joined with the next."""
    kept = lines_.filter(~F.ltrim("line").startswith("#")).withColumn("_open", F.rtrim("line").endswith("\\"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    kept = kept.withColumn("_n", F.coalesce(F.sum(F.when(F.col("_open"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = F.concat(F.regexp_replace(F.rtrim("line"), r"\\+$", ""), F.when(F.col("_open"), " ").otherwise(""))
    kept = kept.withColumn("_part", part)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_part"))), lambda x: x["_part"]), "")
    return kept.groupBy(*keys, "_n").agg(F.min("line_no").alias("line_no"), joined.alias("line")).drop("_n")


_QUOTES = r"""'(?:\\.|[^'\\])*+(?:'|$)|"(?:\\.|[^"\\])*+(?:"|$)"""
#: What is no code in a line, by the sign that opens a comment: quoted text, comments, a sign at the end that takes on the next line.
_HIDDEN = {"hash": _QUOTES + r"|#.*", "slashes": _QUOTES + r"|//.*|\\$", "none": _QUOTES}


def masked(line: Column | str, language: Column | str) -> Column:
    """A line with quoted text and what follows a comment sign blanked."""
    line, language = (F.col(x) if isinstance(x, str) else x for x in (line, language))

    def blanked(pattern: str) -> Column:
        each = F.lit(f"({pattern})|[^'\"#/\\\\]+|(?s:.)")
        return F.array_join(F.zip_with(F.regexp_extract_all(line, each, F.lit(0)), F.regexp_extract_all(line, each, F.lit(1)), lambda x, hidden: F.when(hidden != "", F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "")

    return F.when(language == "python", blanked(_HIDDEN["hash"])).when(language.isin(*SLASHES), blanked(_HIDDEN["slashes"])).otherwise(blanked(_HIDDEN["none"]))


def first_marker(line: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The first of the markers, in their order, that a line holds, or null."""
    return F.coalesce(*[F.when(line.contains(m), F.lit(m)) for m in markers])


def lint(files: DataFrame) -> DataFrame:
    """rel_path, line_no, col, severity, message, rule_id of marks and rules, in order; files has rel_path, language, content."""
    each = lines(files, "content", "rel_path", "language")
    marks = each.withColumn("m", first_marker(F.col("line"))).filter("m is not null").select("rel_path", "line_no", F.lit(1).alias("col"), F.lit("info").alias("severity"), F.concat("m", F.lit(" found in comment or code")).alias("message"), F.lower("m").alias("rule_id"))
    rules = files.sparkSession.createDataFrame(list(LINT), "language string, pattern string, message string, rule_id string")
    hits = each.withColumn("scan", masked("line", "language")).join(F.broadcast(rules), "language").withColumn("col", F.expr("locate(pattern, scan)")).filter("col > 0")
    return marks.unionByName(hits.select("rel_path", "line_no", "col", F.lit("warning").alias("severity"), "message", "rule_id")).orderBy("rel_path", "line_no", "col", "rule_id")


def lint_within(found: DataFrame, start: int, end: int, most: int) -> DataFrame:
    w = Window.partitionBy("rel_path").orderBy("line_no", "col", "rule_id")
    return found.filter(F.col("line_no").between(start, end)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def infra(files: DataFrame) -> DataFrame:
    """file, line, rule, cwe, category and severity of the findings in infrastructure files (rel_path, content).

    Configuration is redacted first. An image counts as unpinned if it is no stage of its file, not scratch, holds no
    variable, and has no tag or the tag latest.
    """
    at = files.withColumn("target", infra_target(F.col("rel_path"))).filter("target is not null")
    at = at.withColumn("content", F.when(is_config(F.col("rel_path")), redact.config_text(F.col("content"))).otherwise(F.col("content")))
    each = lines(at, "content", "rel_path", "target")
    docker = logical(each.filter("target = 'dockerfile'"), "rel_path", "target")
    every = docker.unionByName(each.filter("target != 'dockerfile' and not startswith(ltrim(line), '#')").select("rel_path", "target", "line_no", "line"))
    stage = F.lower(F.regexp_extract("line", r"(?i)^\s*FROM\s+.*\s+AS\s+(\S+)", 1))
    every = every.withColumn("stages", F.collect_set(F.nullif(stage, F.lit(""))).over(Window.partitionBy("rel_path")))
    hits = []
    for rule, cwe, category, severity, targets, pattern in INFRA:
        hit = F.col("target").isin(*targets) & F.regexp_like("line", F.lit(pattern))
        if rule == "docker-unpinned-base-image":
            image, tag = (F.lower(F.regexp_extract("line", pattern, k)) for k in (2, 3))
            hit = hit & (image != "scratch") & ~F.array_contains("stages", image) & ~image.contains("$") & tag.isin("", ":latest")
        named = ((rule, "rule"), (cwe, "cwe"), (category, "category"), (severity, "severity"))
        hits.append(F.when(hit, F.struct(*[F.lit(v).alias(n) for v, n in named])))
    found = every.select(F.col("rel_path").alias("file"), F.col("line_no").alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("r"))
    return found.select("file", "line", "r.*").orderBy("file", "line", "rule")


def secret_findings(files: DataFrame) -> DataFrame:
    """file, line, rule, label: every secret in the text as it is, at its line; values aren't kept."""
    each = lines(files, "content", "rel_path")
    hit = each.select("rel_path", "line_no", F.explode(redact.detected(F.col("line"))).alias("s"))
    return hit.select(F.col("rel_path").alias("file"), F.col("line_no").alias("line"), F.lit("any-hardcoded-secret").alias("rule"), F.col("s.label").alias("label"))


def sql_text(files: DataFrame, languages: tuple[str, ...] = ("c", "css", "scss", "html")) -> DataFrame:
    """file, line, rule: lines that put SQL together, in languages without flow rules for it."""
    each = lines(files.filter(F.col("language").isin(*languages)), "content", "rel_path")
    low = F.lower("line")
    verb = low.contains("select ") | low.contains("insert ") | low.contains("delete ")
    glue = F.col("line").contains("+") | F.col("line").contains("format!") | F.col("line").contains("concat")
    return each.filter(verb & glue).select(F.col("rel_path").alias("file"), F.col("line_no").alias("line"), F.lit("any-sql-injection-heuristic").alias("rule"))
