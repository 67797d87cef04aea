"""Reports: assembly of findings, and their renderings as JSON, SARIF, Markdown and baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import redact
from quern.functions.text import SARIF_LEVEL, SARIF_SCORE, context_of, mapped
from quern.operators import findings as fd
from quern.operators import lines as ln
from quern.plans import catalogue
from quern.sources.files import lines

FINDING = "rule string, cwe string, category string, tier string, severity string, confidence string, context string, file string, line int, function string, description string, flow struct<source_line:int,sink_line:int>"
SCHEMA_VERSION = "3"


def text_findings(files: DataFrame) -> DataFrame:
    """The findings of the text rules in files (rel_path, language, content), in the columns of FINDING."""
    context = context_of(F.col("file"))
    nothing = {"function": F.lit(None).cast("string"), "flow": F.lit(None).cast("struct<source_line:int,sink_line:int>")}
    secret = ln.secret_findings(files).withColumns({"cwe": F.lit("CWE-798"), "category": F.lit("hardcoded_secret"), "severity": F.lit("critical"), "confidence": F.lit("medium"), "description": F.concat(F.lit("secret of type "), "label")})
    heuristic = ln.sql_text(files).withColumns({"cwe": F.lit("CWE-89"), "category": F.lit("sql_injection"), "severity": F.lit("high"), "confidence": F.lit("medium"), "description": F.lit("statement put together from text")})
    infra = ln.infra(files).withColumns({"confidence": F.lit("high"), "description": F.col("rule")})
    out = None
    for f in (secret, heuristic, infra):
        f = f.withColumns({**nothing, "tier": F.lit("text"), "context": context, "line": F.col("line").cast("int")})
        f = f.select(*[x.strip().split(" ")[0] for x in "rule,cwe,category,tier,severity,confidence,context,file,line,function,description,flow".split(",")])
        out = f if out is None else out.unionByName(f)
    return out


def assembled(found: DataFrame, directives: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and suppressed findings: deduplicated, with stable ids and baseline marks."""
    marked = fd.with_suppression(found, directives, catalogue.LEGACY)
    kept = fd.with_baseline(fd.with_stable_ids(fd.first_of_each(marked.filter("reason is null").drop("reason"), "description"), "rule"), ids)
    silent = fd.with_stable_ids(fd.first_of_each(marked.filter("reason is not null"), "description"), "rule")
    return kept, silent


ORDER = ("file", "line", "rule", "stable_id")


def _section(rows: DataFrame, text: Column, listed: bool = True) -> DataFrame:
    """Rows as lines of a document, in ORDER; as elements of a list each but the first begins with a comma."""
    keyed = rows.select(*[F.col(c) for c in ORDER], text.alias("text"))
    if not listed:
        return keyed
    first = keyed.agg(F.min(F.struct(*ORDER)).alias("k")).first()["k"]  # one row
    if first is None:
        return keyed
    same = F.lit(True)
    for c in ORDER:
        same = same & F.col(c).eqNullSafe(F.lit(first[c]))
    return keyed.withColumn("text", F.when(same, F.col("text")).otherwise(F.concat(F.lit(","), F.col("text"))))


def _line(df: DataFrame, text: Column) -> DataFrame:
    """The one row of df as a line of a document."""
    return df.select(F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("rule"), F.lit("").alias("stable_id"), text.alias("text"))


def _document(spark: SparkSession, *parts: DataFrame | str) -> DataFrame:
    """section, ORDER and text: the lines of a document, part by part. Executors make the lines; nothing of a report's size is collected."""
    one, out = spark.range(1), None
    for n, part in enumerate(parts):
        rows = _line(one, F.lit(part)) if isinstance(part, str) else part
        rows = rows.select(F.lit(n).alias("section"), F.col("file"), F.col("line").cast("int").alias("line"), F.col("rule"), F.col("stable_id"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def written(document: DataFrame, path: str) -> None:
    """A document as text files under path, dealt by ranges: one after the other, by name, they are the document."""
    keys = ["section", *ORDER]
    document.repartitionByRange(*keys).sortWithinPartitions(*keys).select("text").write.mode("errorifexists").text(path)


def text_of(document: DataFrame) -> str:
    """A document of a size to be held at once, as text."""
    return "\n".join(r["text"] for r in document.orderBy("section", *ORDER).collect()) + "\n"


def _whole(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in rows.columns]))


def summary(kept: DataFrame, silent: DataFrame, files_scanned: int) -> DataFrame:
    """The JSON summary, as a document: totals, counts by context, risks in production, patterns, top functions, suppressed findings."""
    spark = kept.sparkSession
    n = kept.agg(F.count(F.lit(1)).alias("findings_total"), F.count_if("baselined").alias("baselined_total"))
    totals = F.concat(F.lit('{"schema_version":"' + SCHEMA_VERSION + f'","files_scanned":{files_scanned},"findings_total":'), F.col("findings_total").cast("string"), F.lit(',"baselined_total":'), F.col("baselined_total").cast("string"), F.lit(f',"suppressed_total":{silent.count()}'))
    by = fd.matrix(kept).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", F.struct(*fd.SEVERITIES))))).alias("m"))  # a row for each context
    top = fd.ranked_functions(kept).withColumn("score", F.col("score") / 10)
    top = top.select(F.col("file"), F.lit(0).alias("line"), F.format_string("%020d", (F.lit(10**9) - F.col("score") * 10).cast("long")).alias("rule"), F.col("function").alias("stable_id"), _whole(top).alias("text"))
    top = top.withColumn("file", F.concat("rule", F.lit(" "), "file"))  # by falling score
    gate = kept.filter("context = 'production' and not baselined")
    risk, patterns = gate.filter("tier != 'pattern'"), gate.filter("tier = 'pattern'")
    return _document(
        spark, _line(n, totals), _line(by, F.concat(F.lit(',"by_context":'), F.to_json("m"))), ',"production_risk":[', _section(risk, _whole(risk)), '],"risk_patterns":[', _section(patterns, _whole(patterns)),
        '],"top_risk_functions":[', _section(top, F.col("text")), '],"suppressed":[', _section(silent, _whole(silent)), "]}",
    )


def sarif(kept: DataFrame, silent: DataFrame, tool: str = "quern") -> DataFrame:
    """SARIF 2.1.0, as a document: rules by sorted id, results that point at them, flows as code flows, suppressions by kind."""
    both = kept.withColumns({"kind": F.when(F.col("baselined"), "external"), "reason": F.lit(None).cast("string")}).unionByName(silent.withColumn("kind", F.lit("inSource")), allowMissingColumns=True)
    both = both.withColumns({"level": mapped(F.col("severity"), SARIF_LEVEL), "score": mapped(F.col("severity"), SARIF_SCORE)})
    rules = both.groupBy("rule").agg(F.max("score").alias("score"), F.min("cwe").alias("cwe"), F.min("category").alias("category"))
    rules = rules.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rule")) - 1)  # a row for each rule that fired
    tags = F.filter(F.array("cwe", "category"), lambda x: x.isNotNull())
    told = F.struct(F.col("rule").alias("id"), F.struct(F.col("score").alias("security-severity"), tags.alias("tags")).alias("properties"))
    listed = rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("told")))), lambda x: x["told"]).alias("rules"))
    driver = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), F.to_json(F.struct(F.lit(tool).alias("name"), "rules")), F.lit('},"results":['))

    def place(line: Column) -> Column:
        return F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))

    steps = F.array(*[F.struct(place(F.col("flow")[k]).alias("location")) for k in ("source_line", "sink_line")])
    flows = F.when(F.col("flow").isNotNull(), F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("place").alias("ruleIndex"), "level", F.struct(F.col("description").alias("text")).alias("message"), F.array(place(F.col("line"))).alias("locations"), F.create_map(F.lit("stableId/v1"), F.col("stable_id")).alias("partialFingerprints"),
        F.struct("context").alias("properties"), flows.alias("codeFlows"), F.when(F.col("kind").isNotNull(), F.array(F.struct("kind", F.col("reason").alias("justification")))).alias("suppressions"),
    )
    found = both.join(F.broadcast(rules.select("rule", "place")), "rule")  # the catalogue's rules at most, and one's own
    return _document(kept.sparkSession, _line(listed, driver), _section(found, F.to_json(result)), "]}]}")


def baseline(kept: DataFrame, tool: str = "quern") -> DataFrame:
    """The baseline that accepts all that was kept, as a document."""
    ids = kept.select("stable_id").distinct().select(F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("rule"), "stable_id")
    text = F.expr("substring(to_json(array(stable_id)), 2, length(to_json(array(stable_id))) - 2)")
    return _document(kept.sparkSession, '{"version": 1, "generated_by": "' + tool + '", "findings": [', _section(ids, text), "]}")


def markdown(kept: DataFrame, silent: DataFrame) -> DataFrame:
    """The report for people, as a document: the table of counts, risks in production, the riskiest functions, suppressed findings."""
    at = F.concat(F.lit("- `"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("` "))
    by = fd.matrix(kept)
    row = F.concat(F.lit("| "), F.col("context"), *[F.concat(F.lit(" | "), F.col(c).cast("string")) for c in fd.SEVERITIES], F.lit(" |"))
    by = by.select(mapped(F.col("context"), {c: str(k) for k, c in enumerate(fd.CONTEXTS)}).alias("file"), F.lit(0).alias("line"), F.lit("").alias("rule"), F.lit("").alias("stable_id"), row.alias("text"))
    risk = kept.filter("context = 'production' and tier != 'pattern' and not baselined")
    top = fd.ranked_functions(kept)
    told = F.concat(F.lit("- `"), "function", F.lit("` in `"), "file", F.lit("`: "), (F.col("score") / 10).cast("string"), F.when(F.col("exposed"), F.lit(" (exposed)")).otherwise(F.lit("")))
    top = top.select(F.concat(F.format_string("%020d", F.lit(10**9) - F.col("score")), F.lit(" "), "file").alias("file"), F.lit(0).alias("line"), F.lit("").alias("rule"), F.col("function").alias("stable_id"), told.alias("text"))
    quiet = F.concat(at, "rule", F.lit(": "), F.coalesce("reason", F.lit("None")))
    return _document(
        kept.sparkSession, "# Audit\n\n| Context | Critical | High | Medium | Low |\n|---|---|---|---|---|", by, "\n## Production risk\n", _section(risk, F.concat(at, "severity", F.lit(" "), "rule", F.lit(": "), "description"), False),
        "\n## Riskiest functions\n", top, "\n## Suppressed\n", _section(silent, quiet, False),
    )


def text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by context and severity of the text rules over documents (as configuration) and pages (as HTML)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("conf/d"), F.col("doc_id").cast("string"), F.lit(".properties")).alias("rel_path"), F.lit(None).cast("string").alias("language"), F.col("text").alias("content"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("web/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    found = text_findings(docs.unionByName(pages))
    config = lines(docs, "content", "rel_path").filter(redact.config_line(F.col("line")) != F.col("line"))
    values = {"rule": F.lit("any-hardcoded-secret"), "tier": F.lit("text"), "severity": F.lit("critical"), "context": context_of(F.col("rel_path")), "file": F.col("rel_path"), "line": F.col("line_no").cast("int"), "description": F.lit("sensitive value in configuration")}
    found = found.unionByName(config.select(*[v.alias(k) for k, v in values.items()]), allowMissingColumns=True)
    kept = fd.first_of_each(found, "description").withColumn("baselined", F.lit(False))
    return fd.matrix(kept)
