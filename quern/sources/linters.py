"""Outputs of other checkers as one table: path, line, col, severity, message, rule_id, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = ("path", "line", "col", "severity", "message", "rule_id", "source")


def _severity(word: Column) -> Column:
    return F.when(F.lower(word).isin("error", "fatal", "err"), "error").when(F.lower(word).isin("warning", "warn"), "warning").otherwise("info")


def _shaped(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    kinds = {"line": "int", "col": "int"}
    cols = {"rule_id": F.lit(None).cast("string"), "col": F.lit(1), **cols, "source": F.lit(source)}
    return df.select(*[cols[c].cast(kinds.get(c, "string")).alias(c) for c in OUT])


def clippy(lines: DataFrame) -> DataFrame:
    """Lines (value) of cargo's JSON: the first primary span of each compiler message."""
    schema = "reason string, message struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,is_primary:boolean,line_start:int,column_start:int>>>"
    m = lines.filter(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("j")).filter("j.reason = 'compiler-message'")
    m = m.withColumn("span", F.get(F.filter("j.message.spans", lambda s: s["is_primary"]), F.lit(0))).filter("span is not null")
    return _shaped(m, "clippy", path=F.col("span.file_name"), line=F.col("span.line_start"), col=F.col("span.column_start"), severity=_severity(F.col("j.message.level")), message=F.col("j.message.message"), rule_id=F.col("j.message.code.code"))


def eslint(reports: DataFrame) -> DataFrame:
    """Whole JSON reports (value)."""
    schema = "array<struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,message:string,ruleId:string>>>>"
    m = reports.select(F.explode(F.from_json("value", schema)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    return _shaped(m, "eslint", path=F.col("filePath"), line=F.coalesce("m.line", F.lit(1)), col=F.coalesce("m.column", F.lit(1)), severity=F.when(F.col("m.severity") == 2, "error").when(F.col("m.severity") == 1, "warning").otherwise("info"), message=F.col("m.message"), rule_id=F.col("m.ruleId"))


#: Patterns of lines: path, line, column, severity, message, rule (0 where there is none).
_TEXT = {
    "mypy": (r"^([^:\n]+):(\d+)(?::(\d+))?: (error|warning|note): (.*?)(?:\s+\[([\w-]+)\])?$", (1, 2, 3, 4, 5, 6)),
    "javac": (r"^([^:\n]+\.java):(\d+): (?:(error|warning): )?(?:\[([\w-]+)\] )?(.*)$", (1, 2, 0, 3, 5, 4)),
    "ktlint": (r"^([^:\n]+\.kts?):(\d+):(\d+): (.*?)(?: \(([\w:-]+)\))?$", (1, 2, 3, 0, 4, 5)),
    "kotlinc": (r"^([^:\n]+\.kts?):(\d+):(\d+): (error|warning|info): (.*)$", (1, 2, 3, 4, 5, 0)),
    "cppcheck": (r"^([^:\n]+):(\d+):(?:(\d+):)? (error|warning|style|performance|portability|information): (.*?)(?: \[([\w-]+)\])?$", (1, 2, 3, 4, 5, 6)),
    "dotnet": (r"^\s*([^(\n]+)\((\d+),(\d+)\): (error|warning|info) ([A-Z]+\d+): (.*?)(?: \[[^\]]*\])?$", (1, 2, 3, 4, 6, 5)),
}


def text_report(lines: DataFrame, tool: str) -> DataFrame:
    """Lines (value) of mypy, javac, ktlint, kotlinc, cppcheck or dotnet."""
    pattern, at = _TEXT[tool]
    g = [F.nullif(F.regexp_extract("value", pattern, k), F.lit("")) if k else F.lit(None).cast("string") for k in at]
    hit = lines.filter(F.regexp_like("value", F.lit(pattern)))
    if tool == "ktlint":
        hit = hit.filter(~F.regexp_like("value", F.lit(_TEXT["kotlinc"][0])))
    severity = F.lit("warning") if not at[3] else F.when(g[3].isNull(), "error").otherwise(_severity(g[3]))
    return _shaped(hit, tool, path=g[0], line=g[1], col=F.coalesce(g[2], F.lit("1")), severity=severity, message=g[4], rule_id=g[5])


def of_file(found: DataFrame, rel_path: str) -> DataFrame:
    """The rows of one file, whose path may be absolute or begin with a dot, in order."""
    p = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    return found.filter((p == rel_path) | p.endswith("/" + rel_path)).orderBy("line", "col", "source")


def merged(*found: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of several checkers together, by line, column and source; at most so many of each file, if most is given."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if most is not None:
        w = Window.partitionBy("path").orderBy("line", "col", "source", "rule_id", "message")
        out = out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return out.orderBy("path", "line", "col", "source")
