"""The library's own queries over the driver's tables, and the SQL that gives the same rows.

Text that the documents lack is built by the same expression on both sides (carriers).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import redact
from quern.functions.text import backoff_ms, context_of, escalated, namespace, normal_path
from quern.operators import findings as fd
from quern.operators import graph, lines, markov, markup
from quern.plans import insight, report, rules, treequeries
from quern.sources.files import lines as explode_lines
from quern.sources.files import in_scope, restriction
from quern.sources.store import spread
from quern.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def s(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


LINES = "(SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, source, string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') AS l FROM documents WHERE length(text) > 0))"
CARRIER = "concat('db.password = ', c_name, chr(10), 'host=10.0.', c_nationkey, '.7', chr(10), 'url: https://api', c_custkey, '.internal/v1', chr(10), 'auth_token = ', chr(34), 'abcdefgh', c_custkey, chr(34))"


def carrier(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat('db.password = ', c_name, chr(10), 'host=10.0.', c_nationkey, '.7', chr(10), 'url: https://api', c_custkey, '.internal/v1', chr(10), 'auth_token = ', chr(34), 'abcdefgh', c_custkey, chr(34))")
    return spread(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey").select("c_custkey", text.alias("text"))


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return explode_lines(t(spark, d, "documents"), "text", "doc_id", "source")


_SECRETS = redact.SECRETS


def _rewrite(col: str) -> str:
    for _, p in _SECRETS:
        col = f"regexp_replace({col}, {s(p)}, '{redact.MARK}', 'g')"
    return col


def _config_value(col: str) -> str:
    v = _rewrite(col)
    v = rf"regexp_replace(regexp_replace({v}, '\b127\.0\.0\.1\b', chr(1), 'g'), '\b0\.0\.0\.0\b', chr(2), 'g')"
    v = f"regexp_replace({v}, {s(redact.CONFIG_IPV4)}, '{redact.MARK}', 'g')"
    return f"replace(replace({v}, chr(1), '127.0.0.1'), chr(2), '0.0.0.0')"


_L = s(redact.CONFIG_LINE)
_G = [f"regexp_extract(line, {_L}, {k})" for k in range(5)]
_CONFIG = f"""CASE WHEN trim(line) = '' OR left(ltrim(line), 1) IN ('#', '!') THEN line
 WHEN NOT regexp_matches(line, {_L}) THEN {_config_value('line')} WHEN trim({_G[4]}) = '' THEN line
 WHEN regexp_matches({_G[2]}, {s(redact.CONFIG_KEY)}) THEN {_G[1]} || {_G[2]} || {_G[3]} || '{redact.MARK}'
 ELSE {_G[1]} || {_G[2]} || {_G[3]} || {_config_value(_G[4])} END"""


@q(f"SELECT doc_id, line_no, {_CONFIG} AS redacted FROM {LINES} WHERE {_CONFIG} <> line")
def config_redact_lines(spark, d):
    out = _doc_lines(spark, d).withColumn("redacted", redact.config_line(F.col("line")))
    return out.filter("redacted != line").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "redacted")


@q(f"SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE {_CONFIG} <> line) AS n_redacted FROM {LINES} GROUP BY source")
def config_redact_by_source(spark, d):
    out = _doc_lines(spark, d).withColumn("hit", redact.config_line(F.col("line")) != F.col("line"))
    return out.groupBy("source").agg(F.count("line").alias("n_lines"), F.count_if("hit").alias("n_redacted"))


@q(f"SELECT c_custkey, {_rewrite('text')} AS redacted FROM (SELECT c_custkey, {CARRIER} AS text FROM customer)")
def secret_rewrite(spark, d):
    return carrier(spark, d).select("c_custkey", redact.redacted(F.col("text")).alias("redacted"))


@q("SELECT label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {s(k)} AS label, unnest(regexp_extract_all({CARRIER}, {s(p)})) AS v FROM customer" for k, p in _SECRETS) + ") GROUP BY label")
def secret_detection(spark, d):
    return carrier(spark, d).select(F.explode(redact.detected(F.col("text"))).alias("x")).groupBy(F.col("x.label").alias("label")).agg(F.count("x").alias("n"))


@q("SELECT c_custkey, 3 AS fired, 4 AS detected FROM customer")  # an address, two assigned secrets and a host name, of three kinds
def redact_sequence_vs_detect(spark, d):
    text = F.col("text")
    return carrier(spark, d).select("c_custkey", F.size(redact.fired(text)).alias("fired"), F.size(redact.detected(text)).alias("detected"))


@q(f"SELECT doc_id, line_no, array_to_string(list_filter(regexp_extract_all(line, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}'), lambda x: x NOT IN ('127.0.0.1', '0.0.0.0')), ',') AS addresses FROM {LINES} WHERE len(list_filter(regexp_extract_all(line, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}'), lambda x: x NOT IN ('127.0.0.1', '0.0.0.0'))) > 0")
def public_ip_lines(spark, d):
    out = _doc_lines(spark, d).withColumn("found", redact.addresses(F.col("line"))).filter("size(found) > 0")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("found", ",").alias("addresses"))


def _stages() -> str:
    at, out = "text", []
    for k, p in _SECRETS:
        out.append(f"CASE WHEN regexp_matches({at}, {s(p)}) THEN {s(k)} END")
        at = f"regexp_replace({at}, {s(p)}, '{redact.MARK}', 'g')"
    return ", ".join(out)


@q(f"SELECT label, count(*) AS n FROM (SELECT unnest([{_stages()}]) AS label FROM (SELECT {CARRIER} AS text FROM customer)) WHERE label IS NOT NULL GROUP BY label")
def secret_rewrite_labels(spark, d):
    return carrier(spark, d).select(F.explode(redact.fired(F.col("text"))).alias("label")).groupBy("label").agg(F.count("label").alias("n"))


@q(f"SELECT s_suppkey, regexp_replace(concat('int x; // salary of ', s_name, ' is 5', chr(10), 'y // fine'), {s(redact.REMARK)}, '{redact.REMARK_TEXT}', 'g') AS text FROM supplier")
def sensitive_remarks(spark, d):
    text = F.expr("concat('int x; // salary of ', s_name, ' is 5', chr(10), 'y // fine')")
    return t(spark, d, "supplier").select("s_suppkey", redact.without_remarks(text).alias("text"))


@q("SELECT event_id, CASE WHEN event_type = 'click' THEN '[REDACTED]' ELSE props END AS props FROM events")
def json_props_redact(spark, d):
    m = F.create_map(F.when(F.col("event_type") == "click", F.lit("Token")).otherwise(F.lit("props")), F.col("props"))
    return t(spark, d, "events").select("event_id", F.element_at(F.map_values(redact.redacted_map(m)), 1).alias("props"))


@q(f"SELECT doc_id, line_no, marker FROM (SELECT doc_id, line_no, CASE WHEN contains(line, 'License') THEN 'License' WHEN contains(line, 'token') THEN 'token' WHEN contains(line, '|') THEN '|' END AS marker FROM {LINES}) WHERE marker IS NOT NULL")
def first_marker_lines(spark, d):
    marker = lines.first_marker(F.col("line"), ("License", "token", "|"))
    return _doc_lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), marker.alias("marker")).filter("marker is not null")


_TAGS = r"""<([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[^\s=<>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*)\s*/?>"""
_BARE = r"regexp_replace(html, '(?s)<!--.*?-->|(<script\b[^>]*>).*?</script>|(<style\b[^>]*>).*?</style>', '\1\2', 'g')"


@q(f"SELECT tag_name, count(*) AS n, count(*) FILTER (WHERE has_class) AS n_class FROM (SELECT regexp_extract(tag, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1) AS tag_name, regexp_matches(tag, '\\sclass\\s*=') AS has_class FROM (SELECT unnest(regexp_extract_all({_BARE}, {s(_TAGS)})) AS tag FROM pages)) GROUP BY tag_name")
def html_tag_histogram(spark, d):
    e = markup.elements(t(spark, d, "pages"), "html", "page_id")
    return e.groupBy("tag_name").agg(F.count("pos").alias("n"), F.count_if(F.size("class_names") > 0).alias("n_class"))


@q(f"SELECT page_id, pos, tag_name FROM (SELECT page_id, unnest(range(len(x))) AS pos, regexp_extract(unnest(x), '^<([a-zA-Z][a-zA-Z0-9-]*)', 1) AS tag_name FROM (SELECT page_id, regexp_extract_all({_BARE}, {s(_TAGS)}) AS x FROM pages))")
def html_elements(spark, d):
    return markup.elements(t(spark, d, "pages"), "html", "page_id").select("page_id", F.col("pos").cast("long").alias("pos"), "tag_name")


@q("SELECT DISTINCT unnest(string_split(regexp_extract(x, '\"(.*)\"', 1), ' ')) AS class_name FROM (SELECT unnest(regexp_extract_all(html, 'class=\"[^\"]*\"')) AS x FROM pages)")
def html_classes_distinct(spark, d):
    return markup.elements(t(spark, d, "pages"), "html").select(F.explode("class_names").alias("class_name")).distinct()


@q("SELECT page_id, trim(regexp_extract(r, '^([^{]+)\\{', 1)) AS selector, trim(regexp_extract(r, '\\{([^:]*):', 1)) AS property FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<style\\b[^>]*>(.*?)</style>', 1), '[^{}]+\\{[^{}]*\\}')) AS r FROM pages)")
def html_inline_css_rules(spark, d):
    return markup.inline_css(t(spark, d, "pages"), "html", "page_id").select("page_id", "selector", F.explode("properties").alias("property"))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").withColumn("path", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""))


@q(f"SELECT prefix, count(*) AS files FROM (SELECT unnest([array_to_string(p[1:k], '/') for k in range(1, len(p))]) AS prefix FROM (SELECT string_split({_PATH}, '/') AS p FROM pages)) GROUP BY prefix")
def url_tree_rollup(spark, d):
    return insight.folder_counts(_paths(spark, d), "path")


_RESTRICT = ["# languages", "fr", "/m.ththth.example.net", "*2?"]


@q(f"SELECT page_id, regexp_full_match({_PATH}, {s(restriction(_RESTRICT) or '')}) AS restricted FROM pages")
def url_glob_restrict(spark, d):
    return _paths(spark, d).select("page_id", F.regexp_like("path", F.lit(restriction(_RESTRICT))).alias("restricted"))


@q(f"SELECT page_id, len(string_split({_PATH}, '/')) AS depth FROM pages WHERE contains({_PATH}, '/en/') ORDER BY depth, {_PATH}, page_id LIMIT 20 OFFSET 10")
def scope_filter_page(spark, d):
    p = _paths(spark, d).filter(in_scope(F.col("path"), "/en/")).select("page_id", F.concat("path", F.lit("#"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("rel_path"))
    return insight.page(p, 10, 20).select("page_id", F.col("depth").cast("long").alias("depth"))


@q(f"SELECT page_id, split_part({_PATH}, '/', 1) AS host FROM pages")
def path_normal(spark, d):
    odd = F.concat(F.lit("a/./b/../"), F.regexp_extract("path", "^([^/]*)", 1))
    got = normal_path(odd)
    return _paths(spark, d).select("page_id", F.regexp_extract(got, "^a/(.*)$", 1).alias("host"))


@q(f"SELECT regexp_extract({_PATH}, '^[^./:]+') AS ns, count(*) AS n FROM pages GROUP BY ns")
def external_namespaces(spark, d):
    return _paths(spark, d).groupBy(namespace(F.col("path")).alias("ns")).agg(F.count("page_id").alias("n"))


# Findings made of events: the type is the rule, the user the file, the value the line.
_FINDINGS = """(SELECT event_id, event_type AS rule, 'src/u' || user_id AS file, CAST(floor(value) AS INTEGER) % 20 AS line, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'f' || (event_id % 5) END AS function,
 CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
 CASE event_id % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'fixture' ELSE 'production' END AS context, CASE WHEN event_id % 11 = 0 THEN 'pattern' ELSE 'structural' END AS tier, event_id % 13 = 0 AS baselined FROM events)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr(
        "event_id", "event_type AS rule", "'src/u' || user_id AS file", "CAST(floor(value) AS INT) % 20 AS line", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'f' || (event_id % 5) END AS function",
        "CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity", "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence",
        "CASE event_id % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'fixture' ELSE 'production' END AS context", "CASE WHEN event_id % 11 = 0 THEN 'pattern' ELSE 'structural' END AS tier", "event_id % 13 = 0 AS baselined", "IF(event_id % 17 = 0, named_struct('source_line', 1, 'sink_line', 2), NULL) AS flow",
    )


@q(f"SELECT event_id, rule, file, line FROM {_FINDINGS} QUALIFY row_number() OVER (PARTITION BY rule, file, line ORDER BY event_id) = 1")
def findings_dedup(spark, d):
    return fd.first_of_each(_findings(spark, d), "event_id").select("event_id", "rule", "file", "line")


@q(f"SELECT event_id, rule || ':' || file || ':' || coalesce(function, '-') || ':' || row_number() OVER (PARTITION BY rule, file, coalesce(function, '-') ORDER BY line, event_id) AS stable_id FROM {_FINDINGS}")
def findings_stable_id(spark, d):
    return fd.with_stable_ids(_findings(spark, d), "event_id").select("event_id", "stable_id")


@q(f"SELECT rule, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS baselined FROM {_FINDINGS} GROUP BY rule")
def findings_baseline_split(spark, d):
    f = fd.with_stable_ids(_findings(spark, d).drop("baselined"), "event_id")
    out = fd.with_baseline(f, f.filter("event_id % 2 = 0").select("stable_id"))
    return fd.baselined_by_rule(out)


@q("""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS category FROM lineitem WHERE l_quantity > 10), b AS (SELECT l_orderkey, l_linenumber, l_returnflag AS category FROM lineitem WHERE l_discount > 0.05)
SELECT 'structural' AS tier, category, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.category = a.category) GROUP BY category
UNION ALL SELECT 'taint', category, count(*) FROM b GROUP BY category""")
def findings_structural_suppressed_by_taint(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("category"), "l_quantity", "l_discount")
    a = li.filter("l_quantity > 10").drop("l_quantity", "l_discount").withColumn("tier", F.lit("structural"))
    b = li.filter("l_discount > 0.05").drop("l_quantity", "l_discount").withColumn("tier", F.lit("taint"))
    return fd.without_taint_twins(a, b, "l_orderkey", "l_linenumber", "category").groupBy("tier", "category").agg(F.count("l_orderkey").alias("n"))


@q(f"""SELECT c.context, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low
FROM (VALUES ('production'), ('test'), ('fixture'), ('detector_definition')) c(context) LEFT JOIN (SELECT * FROM {_FINDINGS} WHERE tier <> 'pattern' AND NOT baselined) f ON f.context = c.context GROUP BY c.context""")
def severity_context_matrix(spark, d):
    return fd.matrix(_findings(spark, d))


@q(f"""SELECT file, function, score, findings, exposed FROM (SELECT file, function, CAST(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END * CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 6 ELSE 3 END) + CASE WHEN bool_or(event_id % 17 = 0) THEN 100 ELSE 0 END AS BIGINT) AS score, count(*) AS findings, bool_or(event_id % 17 = 0) AS exposed
FROM {_FINDINGS} WHERE context = 'production' AND NOT baselined AND function IS NOT NULL GROUP BY file, function) ORDER BY score DESC, file, function LIMIT 10""")
def function_risk_topk(spark, d):
    return fd.ranked_functions(_findings(spark, d))


@q(f"SELECT rule, count(*) AS findings FROM {_FINDINGS} GROUP BY rule")
def findings_by_rule(spark, d):
    return fd.by_rule(_findings(spark, d))


_DIRECTIVES = f"(SELECT DISTINCT file, line AS line_no, rule AS id, 'accepted ' || line AS reason FROM {_FINDINGS} WHERE event_id % 5 = 0)"


@q(f"SELECT f.event_id, coalesce(a.reason, b.reason) AS reason FROM {_FINDINGS} f LEFT JOIN {_DIRECTIVES} a ON a.file = f.file AND a.id = f.rule AND a.line_no = f.line LEFT JOIN {_DIRECTIVES} b ON b.file = f.file AND b.id = f.rule AND b.line_no = f.line - 1")
def suppression_band_join(spark, d):
    f = _findings(spark, d)
    text = f.filter("event_id % 5 = 0").select("file", F.col("line").alias("line_no"), F.expr(f"'x /* {fd.DIRECTIVE} ' || rule || ' accepted ' || line || ' */'").alias("line")).distinct()
    return fd.with_suppression(f, fd.directives(text)).select("event_id", "reason")


@q("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 40 AS a, o_orderkey % 40 + o_orderkey % 25 AS b FROM orders), p AS (SELECT DISTINCT o_custkey, o_orderkey % 50 AS line FROM orders)
SELECT p.o_custkey, p.line, max_by('o' || r.o_orderkey, (r.a, 'o' || r.o_orderkey)) AS name FROM p LEFT JOIN r ON r.o_custkey = p.o_custkey AND p.line BETWEEN r.a AND r.b GROUP BY p.o_custkey, p.line""")
def enclosing_range_join(spark, d):
    o = t(spark, d, "orders")
    r = o.selectExpr("o_custkey", "'o' || o_orderkey AS name", "o_orderkey % 40 AS start_line", "o_orderkey % 40 + o_orderkey % 25 AS end_line")
    return fd.enclosing(o.selectExpr("o_custkey", "o_orderkey % 50 AS line").distinct(), r, "o_custkey").drop("within")


_EDGES = "(SELECT DISTINCT 'p' || (l_partkey % 300) AS src, 's' || (l_suppkey % 40) AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' ELSE 'restricted' END AS kind FROM lineitem)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").selectExpr("'p' || (l_partkey % 300) AS src", "'s' || (l_suppkey % 40) AS dst", "CASE l_linenumber % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' ELSE 'restricted' END AS kind").distinct()


@q(f"SELECT name, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS name, 1 AS o, 0 AS i FROM {_EDGES} UNION ALL SELECT dst, 0, 1 FROM {_EDGES}) GROUP BY name")
def dep_edges_fan(spark, d):
    return graph.fan(_edges(spark, d))


@q(f"SELECT kind, count(*) AS n FROM (SELECT src, dst, kind FROM {_EDGES} UNION ALL SELECT dst, src, 'dependent' FROM {_EDGES} WHERE kind <> 'external') GROUP BY kind")
def dep_reverse_merge(spark, d):
    return graph.merged(_edges(spark, d)).groupBy("kind").agg(F.count("src").alias("n"))


_CHAIN = "(SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'n' || ((r_regionkey * 7) % 25) FROM region)"


@q(f"WITH RECURSIVE b AS (SELECT 'c1' AS name, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN {_CHAIN} e ON e.src = b.name WHERE b.depth < 4) SELECT name, min(depth) AS depth FROM b GROUP BY name")
def dep_bfs_depth(spark, d):
    c = t(spark, d, "customer").selectExpr("'c' || c_custkey AS src", "'n' || c_nationkey AS dst")
    n = t(spark, d, "nation").selectExpr("'n' || n_nationkey AS src", "'r' || n_regionkey AS dst")
    r = t(spark, d, "region").selectExpr("'r' || r_regionkey AS src", "'n' || ((r_regionkey * 7) % 25) AS dst")
    return graph.within(c.union(n).union(r), spark.createDataFrame([("c1",)], "name string"), 4)


_RING = "(SELECT DISTINCT n_nationkey % 12 AS src, (n_nationkey * 5 + n_regionkey) % 12 AS dst FROM nation)"


@q(f"WITH RECURSIVE r AS (SELECT src, dst FROM {_RING} UNION SELECT r.src, e.dst FROM r JOIN {_RING} e ON e.src = r.dst) SELECT DISTINCT array_to_string(list_sort(m), ',') AS members FROM (SELECT a.src, list(DISTINCT a.dst) AS m FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) WHERE list_contains(m, src)")
def dep_cycles(spark, d):
    e = t(spark, d, "nation").selectExpr("n_nationkey % 12 AS src", "(n_nationkey * 5 + n_regionkey) % 12 AS dst").distinct()
    return graph.cycles(e).select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


_IMPORTS = "(SELECT l_orderkey AS src, 'm' || l_partkey AS dst, CASE l_linenumber % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' ELSE 'unresolved' END AS kind FROM lineitem)"


@q(f"SELECT count(*) AS imports_total, count(*) FILTER (WHERE kind IN ('internal', 'restricted')) AS resolved, count(*) FILTER (WHERE kind = 'unresolved') AS unresolved, count(DISTINCT CASE WHEN kind = 'external' THEN dst END) AS libraries, count(*) FILTER (WHERE kind IN ('internal', 'restricted'))::DOUBLE / count(*) FILTER (WHERE kind <> 'external') AS coverage FROM {_IMPORTS}")
def dep_coverage(spark, d):
    i = t(spark, d, "lineitem").selectExpr("l_orderkey AS src", "'m' || l_partkey AS dst", "CASE l_linenumber % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' ELSE 'unresolved' END AS kind")
    return graph.coverage(i)


@q(f"SELECT src, dst, kind FROM {_EDGES} QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, kind) <= 3")
def per_node_edge_cap(spark, d):
    return graph.capped(_edges(spark, d), 3)


@q(f"SELECT name, fan_out, fan_in FROM (SELECT name, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS name, 1 AS o, 0 AS i FROM {_EDGES} UNION ALL SELECT dst, 0, 1 FROM {_EDGES}) GROUP BY name) ORDER BY fan_in DESC, fan_out DESC, name LIMIT 15")
def dep_hotspots(spark, d):
    return graph.hotspots(_edges(spark, d), 15, "fan_in")


@q("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 25000")
def byte_budget_trim(spark, d):
    return graph.within_budget(t(spark, d, "documents").select("source", "doc_id", "n_chars"), "n_chars", 25_000, "doc_id", by=("source",)).select("source", "doc_id", "used")


@q("""SELECT p.p_partkey AS src, CASE WHEN a.k IS NOT NULL THEN 'x' || p.p_size || a.ext END AS dst, CASE WHEN a.k IS NULL THEN 'unresolved' WHEN a.restricted THEN 'restricted' ELSE 'internal' END AS kind
FROM part p LEFT JOIN (SELECT k, ext, restricted FROM (VALUES (0, '.ts', true), (1, '.ts', false), (1, '.py', false), (2, '.java', true)) v(k, ext, restricted) QUALIFY row_number() OVER (PARTITION BY k ORDER BY restricted, CASE ext WHEN '.ts' THEN 2 WHEN '.py' THEN 5 ELSE 6 END) = 1) a ON a.k = p.p_size % 4""")
def import_resolution_priority(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey AS src", "'x' || p_size AS path", "'x' || p_size AS candidate", "p_size")
    v = spark.createDataFrame([(0, ".ts", True), (1, ".ts", False), (1, ".py", False), (2, ".java", True)], "k int, ext string, restricted boolean")
    files = p.select("p_size").distinct().join(F.broadcast(v), F.expr("p_size % 4 = k")).selectExpr("'x' || p_size || ext AS rel_path", "restricted")
    return graph.resolved_imports(p.drop("p_size"), files).select("src", "dst", "kind")


_PREFIX = ("CASE " + " ".join(f"WHEN starts_with(p_name, '{x}') THEN '{x}'" for x in ("part", "p", "a", "s")) + " END")


@q(f"SELECT prefix, count(*) AS n FROM (SELECT {_PREFIX} AS prefix FROM part) WHERE prefix IS NOT NULL GROUP BY prefix HAVING count(*) >= 2")
def verb_prefix_groups(spark, d):
    prefixes = ("part", "p", "a", "s")
    got = insight.verb_groups(t(spark, d, "part"), "p_name", prefixes, "p_partkey")
    return got.select(F.element_at(F.array(*map(F.lit, prefixes)), F.col("place") + 1).alias("prefix"), F.size("names").cast("long").alias("n"))


@q("WITH x AS (SELECT lag(event_type, 2) OVER w AS parent, lag(event_type) OVER w AS current, event_type AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT parent, current, next, count(*) AS cnt FROM x WHERE parent IS NOT NULL GROUP BY ALL")
def markov_transitions(spark, d):
    return markov.transitions(t(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type")


@q("WITH x AS (SELECT lag(event_type, 2) OVER w AS parent, lag(event_type) OVER w AS current, event_type AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT parent, current, next, count(*) AS cnt FROM x WHERE parent IS NOT NULL GROUP BY ALL) SELECT parent, current, next, cnt / sum(cnt) OVER (PARTITION BY parent, current) AS prob FROM c QUALIFY prob >= 0.2")
def markov_predict(spark, d):
    return markov.predictions(markov.transitions(t(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type"), 0.2)


@q("""WITH x AS (SELECT lag(event_type, 2) OVER w AS parent, lag(event_type) OVER w AS current, event_type AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT parent, current, next, count(*) AS cnt FROM x WHERE parent IS NOT NULL GROUP BY ALL)
SELECT parent, current, CAST(sum(cnt) AS BIGINT) AS total, sum(cnt) >= 3 AND coalesce(sum(cnt) FILTER (WHERE next = 'purchase'), 0) / sum(cnt) < 0.2 AS prune FROM c GROUP BY parent, current""")
def markov_prune_flags(spark, d):
    c = markov.transitions(t(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type")
    return markov.prunable(c, c.withColumnRenamed("next", "node"), ("purchase",), 0.2)


@q(f"SELECT doc_id, island, count(*) AS n, CAST(min(line_no) AS BIGINT) AS start_line FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM {LINES} WHERE length(line) > 60) GROUP BY doc_id, island")
def comment_run_islands(spark, d):
    runs = lines.islands(_doc_lines(spark, d), F.length("line") > 60, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    n = (F.col("end_line") - F.col("start_line") + 1).cast("long")
    return runs.withColumn("n", n).withColumn("island", F.col("start_line") - 1 - F.coalesce(F.sum("n").over(w), F.lit(0))).select("doc_id", "island", "n", F.col("start_line").cast("long").alias("start_line"))


_SLASHED = f"(SELECT doc_id, line_no, CASE WHEN length(line) % 3 = 0 THEN line || ' \\' ELSE line END AS line FROM {LINES})"


@q(f"""SELECT doc_id, CAST(min(line_no) AS BIGINT) AS line_no, string_agg(regexp_replace(regexp_replace(line, ' +$', ''), '\\\\+$', '') || CASE WHEN open THEN ' ' ELSE '' END, '' ORDER BY line_no) AS line
FROM (SELECT *, coalesce(sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (SELECT *, ends_with(rtrim(line), '\\') AS open FROM {_SLASHED} WHERE NOT starts_with(ltrim(line), '#'))) GROUP BY doc_id, g""")
def logical_line_join(spark, d):
    each = _doc_lines(spark, d).select("doc_id", "line_no", F.when(F.length("line") % 3 == 0, F.concat("line", F.lit(" \\"))).otherwise(F.col("line")).alias("line"))
    return lines.logical(each, "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@q("SELECT c_custkey, u.n_name FROM customer JOIN (SELECT n_nationkey % 20 AS k, min(n_name) AS n_name FROM nation GROUP BY n_nationkey % 20 HAVING count(*) = 1) u ON u.k = c_nationkey")
def unique_name_only_join(spark, d):
    n = rules.unambiguous(t(spark, d, "nation").select(F.expr("n_nationkey % 20").alias("k"), "n_name"), "k")
    return t(spark, d, "customer").join(n, F.expr("c_nationkey = k")).select("c_custkey", "n_name")


@q("SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY event_type")
def tool_counts(spark, d):
    return insight.tool_counts(t(spark, d, "events"), "event_type")


@q(r"""SELECT event_id, CASE WHEN k = 'refresh' OR (k = 'modify' AND event_id % 10 = 0) THEN 'refresh' WHEN k = 'modify' THEN 'invalidate' ELSE 'ignore' END AS action FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'modify' WHEN 1 THEN 'refresh' WHEN 2 THEN 'refresh' WHEN 3 THEN 'refresh' ELSE 'access' END AS k FROM events)""")
def event_actions(spark, d):
    e = t(spark, d, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN 'modify' WHEN 1 THEN 'create' WHEN 2 THEN 'remove' WHEN 3 THEN 'rename' ELSE 'access' END AS kind", f"IF(event_id % 10 = 0, 'a/{watch.RESTRICTIONS}', 'a/b.py') AS path")
    return e.select("event_id", watch.action(F.col("kind"), F.col("path")).alias("action"))


@q("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts::TIMESTAMP) // 1000 AS ms FROM events),
arm AS (SELECT user_id, min(ms) AS first_ms FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(e.ms) FROM arm JOIN e ON e.user_id = arm.user_id AND e.ms >= arm.first_ms + 3600000 GROUP BY e.user_id)
SELECT arm.user_id, arm.first_ms, count(*) AS events FROM arm JOIN e ON e.user_id = arm.user_id AND e.ms >= arm.first_ms AND e.ms < arm.first_ms + 3600000 GROUP BY arm.user_id, arm.first_ms""")
def event_debounce(spark, d):
    e = t(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return watch.debounced(e, "user_id", "ms", 3_600_000)


def event_debounce_stream(spark, d):
    """The same over a stream of files, in four batches, whose state closes a refresh by a timer; a last event lets all time pass."""
    import uuid

    at = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/events-{uuid.uuid4().hex}"
    e = t(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    low, high = e.agg(F.min("ms"), F.max("ms")).first()
    step = ((high or 0) - (low or 0)) // 4 + 1
    for k in range(4):  # files come in the order of their time
        e.filter(F.expr(f"(ms - {low or 0}) div {step} = {k}")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    spark.createDataFrame([(-1, (high or 0) + 10 * 3_600_000)], "user_id long, ms long").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run = watch.debounced_stream(stream, "user_id", "ms", 3_600_000).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
    run.awaitTermination()
    return spark.read.schema("user_id long, first_ms long, events long").parquet(f"{at}/out").filter("user_id >= 0")


QUERIES["event_debounce_stream"], SQL["event_debounce_stream"] = event_debounce_stream, SQL["event_debounce"]


@q("SELECT event_id, CASE WHEN event_id % 9 < 3 THEN 0 ELSE CAST(least(2000, 250 * 2 ** least(4, event_id % 9 - 3)) AS INTEGER) END AS delay FROM events")
def rate_limit_backoff(spark, d):
    return t(spark, d, "events").select("event_id", backoff_ms(F.col("event_id") % 9).cast("int").alias("delay"))


@q(f"SELECT event_id, CASE severity WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END AS severity FROM {_FINDINGS}")
def severity_escalation(spark, d):
    return _findings(spark, d).select("event_id", escalated(F.col("severity")).alias("severity"))


@q("""SELECT context, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'fixture' WHEN page_id % 5 = 1 THEN 'detector_definition' WHEN page_id % 5 IN (2, 3) THEN 'test' ELSE 'production' END AS context FROM pages) GROUP BY context""")
def path_contexts(spark, d):
    path = F.expr("CASE page_id % 5 WHEN 0 THEN 'x/tests/fixtures/a.md' WHEN 1 THEN 'tests/readme.md' WHEN 2 THEN 'tests/a.py' WHEN 3 THEN 'src/a_test.go' ELSE 'src/' || page_id || '.py' END")
    return t(spark, d, "pages").groupBy(context_of(path).alias("context")).agg(F.count("page_id").alias("n"))


# Reports over the findings of events: some are suppressed, some accepted before.
def _reported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = _findings(spark, d).withColumns({"cwe": F.concat(F.lit("CWE-"), F.length("rule").cast("string")), "category": F.col("rule"), "description": F.concat(F.lit('said "so" of '), "rule")})
    once = fd.with_stable_ids(fd.first_of_each(found, "event_id"), "event_id")
    silent = once.filter("event_id % 19 = 0").drop("baselined").withColumn("reason", F.lit("known"))
    return once.filter("event_id % 19 != 0"), silent


_ONCE = f"(SELECT * FROM {_FINDINGS} QUALIFY row_number() OVER (PARTITION BY rule, file, line ORDER BY event_id) = 1)"


def _read_back(document: DataFrame, schema: str) -> DataFrame:
    """The elements of lists of a report that was written, parsed again."""
    import uuid

    spark = document.sparkSession
    at = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/report-{uuid.uuid4().hex}"
    report.written(document, at)
    return spark.read.text(at).select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r")).filter("r is not null").select("r.*")


@q(f"""SELECT rule, dense_rank() OVER (ORDER BY rule) - 1 AS place, level, suppression, flow, n FROM (SELECT rule, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
CASE WHEN event_id % 19 = 0 THEN 'inSource' WHEN baselined THEN 'external' END AS suppression, event_id % 17 = 0 AS flow, count(*) AS n FROM {_ONCE} GROUP BY ALL)""")
def sarif_of_events(spark, d):
    """A SARIF report that executors wrote, read again: its results by rule, level and suppression."""
    r = _read_back(report.sarif(*_reported(spark, d)), "ruleId string, ruleIndex long, level string, suppressions array<struct<kind:string>>, codeFlows array<struct<threadFlows:array<struct<locations:array<string>>>>>").filter("ruleId is not null")
    return r.groupBy(F.col("ruleId").alias("rule"), F.col("ruleIndex").alias("place"), "level", F.get("suppressions", F.lit(0))["kind"].alias("suppression"), F.col("codeFlows").isNotNull().alias("flow")).agg(F.count(F.lit(1)).alias("n"))


@q(f"SELECT event_id, file, line, rule, CASE WHEN event_id % 19 = 0 THEN 'suppressed' WHEN tier = 'pattern' THEN 'pattern' ELSE 'risk' END AS part FROM {_ONCE} WHERE event_id % 19 = 0 OR context = 'production' AND NOT baselined")
def summary_of_events(spark, d):
    """A JSON summary that executors wrote, read again: the findings that it lists."""
    r = _read_back(report.summary(*_reported(spark, d), 7), "event_id long, file string, line int, rule string, tier string, reason string").filter("event_id is not null")
    return r.select("event_id", "file", "line", "rule", F.when(F.col("reason").isNotNull(), "suppressed").when(F.col("tier") == "pattern", "pattern").otherwise("risk").alias("part"))


QUERIES.update(treequeries.QUERIES)
SQL.update(treequeries.SQL)
