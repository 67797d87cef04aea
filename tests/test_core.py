"""The library's operators on small tables, and its queries against SQL."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quern.functions import redact, text
from quern.operators import findings as fd
from quern.operators import graph, lines, markov, markup, source
from quern.plans import insight, queries, report
from quern.sources import files, linters
from quern.streaming import watch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = c.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    flat = lambda df: sorted(map(tuple, df[cols].astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))
    assert flat(got) == flat(want)


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_redaction(spark):
    key = "sk-" + "a" * 32
    got = one(spark, redact.redacted(F.col("t")), t=f"k={key} host 10.0.0.1 db.internal postgres://u:p@h/d gho_abcdefgh12")
    assert got.count(redact.MARK) == 5 and key not in got and "10.0.0.1" not in got
    assert one(spark, redact.redacted(F.lit(got)), t="") == got
    assert one(spark, redact.config_text(F.col("t")), t="# token = a\ndb.password = x y\nhost: 8.8.8.8 127.0.0.1\nempty =\n") == f"# token = a\ndb.password = {redact.MARK}\nhost: {redact.MARK} 127.0.0.1\nempty ="
    assert one(spark, redact.without_remarks(F.col("t")), t="x // salary of me") == "x // [REDACTED COMMENT] of me"
    assert redact.secrets(["(", "ab+"])[-1] == ("CUSTOM_PATTERN:ab+", "ab+") and len(redact.secrets(["("])) == 9


def test_scalars(spark):
    assert one(spark, text.normal_path(F.col("p")), p="a/./b/../c//d") == "a/c/d"
    assert one(spark, text.normal_path(F.col("p")), p="../../x") == "../../x"
    assert one(spark, text.internal_reference(F.col("p")), p="crate::a::b") == "a/b"
    assert one(spark, text.one_line(F.col("p")), p="  a \n b ") == "a b" and one(spark, text.one_line(F.col("p")), p=" ") is None
    assert one(spark, text.first_line(F.col("p")), p="///\n/// Says it.\n/// More") == "Says it."
    assert one(spark, text.sorted_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), p="") == '{"a":2,"b":1}'


def test_globs_and_languages(spark):
    rules = ["# c", "", "/build", "*.key", "docs"]
    for path, want in (("build/x.py", True), ("src/build/x.py", False), ("a/b.key", True), ("x/docs/y", True), ("docs", True), ("docsy", False)):
        assert one(spark, files.restricted(F.col("p"), rules).cast("string"), p=path) == str(want).lower()
    assert one(spark, files.language_of(F.col("p")), p="a/b.tsx") == "tsx" and one(spark, files.language_of(F.col("p")), p="a/b.PY") is None
    assert one(spark, files.infra_target(F.col("p")), p="x/Dockerfile.dev") == "dockerfile"
    assert one(spark, files.is_config(F.col("p")).cast("string"), p="x/.env.local") == "true"


def test_scan_and_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\r\ny = 2\n")
    (tmp_path / "target/b.py").write_text("no")
    (tmp_path / "k.pem").write_text("s")
    got = {r["rel_path"]: r for r in files.scan(spark, str(tmp_path), restrict=["*.pem"]).collect()}
    assert set(got) == {"src/a.py", "k.pem"} and got["k.pem"]["restricted"] and got["src/a.py"]["language"] == "python" and got["src/a.py"]["depth"] == 1
    rows = files.lines(files.scan(spark, str(tmp_path)).filter("language = 'python'"), "content", "rel_path").orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(1, "x = 1"), (2, "y = 2")]


def test_baseline_states(spark):
    assert files.baseline(spark, None)[0] == "absent" and files.baseline(spark, "{")[0] == "invalid" and files.baseline(spark, '{"findings": [1]}')[0] == "invalid"
    state, ids = files.baseline(spark, '{"findings": ["a"]}')
    assert state == "loaded" and ids.count() == 1


def test_aliases(spark):
    df = spark.createDataFrame([("web/tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@a/*": ["src/*", "lib/*"]}}}')], "rel_path string, content string")
    assert [(r["config_dir"], r["pattern"], r["target"]) for r in files.aliases(df).collect()] == [("web", "@a/*", "src/*"), ("web", "@a/*", "lib/*")]


FOUND = [("r1", "CWE-1", "c", "structural", "high", "high", "production", "a.py", 3, "f", "d", None), ("r1", "CWE-1", "c", "structural", "high", "high", "production", "a.py", 3, "f", "d", None), ("r1", "CWE-1", "c", "structural", "high", "high", "production", "a.py", 9, "f", "d", (1, 9)), ("r2", "CWE-2", "c", "pattern", "low", "low", "production", "a.py", 4, None, "d", None), ("r3", "CWE-3", "c", "taint", "critical", "high", "test", "t.py", 1, None, "d", None)]


def test_report(spark):
    found = spark.createDataFrame(FOUND, report.FINDING)
    text = spark.createDataFrame([("t.py", 1, f"x // {fd.DIRECTIVE} r3 known */"), ("a.py", 2, f"{fd.DIRECTIVE} r1")], "file string, line_no int, line string")
    ids = spark.createDataFrame([("r1:a.py:f:1",)], "stable_id string")
    kept, silent = report.assembled(found, fd.directives(text), ids)
    rows = {r["stable_id"]: r["baselined"] for r in kept.collect()}
    assert rows == {"r1:a.py:f:1": True, "r1:a.py:f:2": False, "r2:a.py:-:1": False} and silent.first()["reason"] == "known"
    s = json.loads(report.text_of(report.summary(kept, silent, 2)))
    assert s["by_context"]["production"] == {"critical": 0, "high": 1, "medium": 0, "low": 0} and s["suppressed_total"] == 1 and s["baselined_total"] == 1
    assert s["top_risk_functions"] == [{"file": "a.py", "function": "f", "score": 16.0, "findings": 1, "exposed": True}]
    run = json.loads(report.text_of(report.sarif(kept, silent)))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2", "r3"] and len(run["results"]) == 4
    assert {r["suppressions"][0]["kind"] for r in run["results"] if "suppressions" in r} == {"external", "inSource"} and sum("codeFlows" in r for r in run["results"]) == 1
    assert json.loads(report.text_of(report.baseline(kept)))["findings"] == ["r1:a.py:f:1", "r1:a.py:f:2", "r2:a.py:-:1"] and "| production | 0 | 1 | 0 | 0 |" in report.text_of(report.markdown(kept, silent))


def test_stable_ids_outlive_moved_lines(spark):
    found = spark.createDataFrame(FOUND, report.FINDING).dropDuplicates(["rule", "file", "line"])
    a = {r["stable_id"] for r in fd.with_stable_ids(found).collect()}
    assert a == {r["stable_id"] for r in fd.with_stable_ids(found.withColumn("line", F.col("line") + 7)).collect()}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", "internal"), ("b", "a", "internal"), ("b", "c", "internal"), ("c", "d", "internal"), ("e", "e", "internal"), ("a", "x", "external")], "src string, dst string, kind string")
    assert {tuple(r["members"]) for r in graph.cycles(e).collect()} == {("a", "b"), ("e",)}
    got = {r["name"]: r["depth"] for r in graph.within(e, spark.createDataFrame([("a",)], "name string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "x": 1, "c": 2}


def test_lines(spark):
    rows = [("d", k + 1, x) for k, x in enumerate(["FROM a \\", "# note", "  AS b", "RUN x"])]
    got = lines.logical(spark.createDataFrame(rows, "f string, line_no int, line string"), "f").orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "FROM a    AS b"), (4, "RUN x")]
    docker = spark.createDataFrame([("Dockerfile", "FROM node AS base\nFROM base\nUSER root\nENV API_KEY=1\nRUN curl x | sh\nEXPOSE 22\nADD https://x y\n"), ("c.yaml", "privileged: true\n")], "rel_path string, content string")
    assert {r["rule"] for r in lines.infra(docker).collect()} == {x[0] for x in lines.INFRA} - {"spring-actuator-endpoints-exposed", "spring-ssl-disabled"}
    code = spark.createDataFrame([("a.py", "python", "print('print(')  # print(\n# TODO x\ns = 'print('\n")], "rel_path string, language string, content string")
    assert [(r["line_no"], r["col"], r["rule_id"]) for r in lines.lint(code).collect()] == [(1, 1, "no-print"), (2, 1, "todo")]
    assert lines.lint_within(lines.lint(code), 1, 1, 5).count() == 1


def test_markup(spark):
    page = "<style>p{margin:0} @media (x){ a { b: c; d: e } }</style><app-x [v]=\"1\" [class.on]=\"y\" (click)=\"f()\" class=\"a b\"></app-x><!-- <i> --><font-face/>"
    df = spark.createDataFrame([(page,)], "html string")
    got = {r["tag_name"]: r for r in markup.elements(df, "html").collect()}
    assert set(got) == {"style", "app-x", "font-face"} and got["app-x"]["class_names"] == ["a", "b", "on"] and got["app-x"]["inputs"] == ["v"] and got["app-x"]["outputs"] == ["click"] and got["app-x"]["is_component"] and not got["font-face"]["is_component"]
    css = {(r["selector"], tuple(r["properties"]), r["media_query"]) for r in markup.inline_css(df, "html").collect()}
    assert css == {("p", ("margin",), None), ("a", ("b", "d"), "(x)")}


def test_trees(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 0, "m"), (1, 2, 1, 0, "f"), (1, 3, 1, 1, "g"), (1, 4, 2, 0, "x")], "tree int, id int, parent_id int, pos int, kind string")
    trans, desc = markov.tree_counts(nodes)
    assert {(r["parent"], r["current"], r["next"], r["cnt"]) for r in trans.collect()} == {("", "m", "f", 1), ("", "m", "g", 1), ("m", "f", "x", 1), ("m", "f", "g", 1)}
    assert {(r["current"], r["node"]) for r in desc.collect()} == {("m", "m"), ("m", "f"), ("m", "g"), ("m", "x"), ("f", "f"), ("f", "x"), ("g", "g"), ("x", "x")}


def test_debounce(spark):
    rows = [("p", t) for t in (0, 100, 499, 500, 1200)]
    df = spark.createDataFrame(rows, "project string, ms long")
    assert [(r["first_ms"], r["events"]) for r in watch.debounced(df, "project", "ms").orderBy("first_ms").collect()] == [(0, 3), (500, 1), (1200, 1)]
    done, armed, count = watch._walk([0, 100, 499], None, 500)
    assert done == [] and (armed, count) == (0, 3)
    assert watch._walk([500, 1200], armed, 500) == ([(0, 0), (500, 1)], 1200, 1)


CODE = [
    ("src/repo.py", "python", "import argparse\nclass UserFactory:\n    pass\ndef find_user(a):\n    return a\ndef find_all():\n    pass\ndef save(x):\n    pass\ndef delete(x):\n    pass\ndef main():\n    pass\n"),
    ("src/b.rs", "rust", "pub fn with_a() {}\npub fn with_b() {}\npub fn build() {}\npub fn instance() {}\n"),
]


def test_insight(spark):
    found = source.analysis(spark.createDataFrame(CODE, "rel_path string, language string, content string")).persist()
    assert {(r["pattern"], r["file"]) for r in insight.patterns(found).collect()} == {("Factory", "src/repo.py"), ("Repository", "src/repo.py"), ("Builder", "src/b.rs"), ("Singleton", "src/b.rs")}
    assert {(r["kind"], r["symbol"]) for r in insight.entrypoints(found).collect()} == {("main_function", "main"), ("cli_framework:argparse", None)}
    assert [(r["title"], r["functions"]) for r in insight.use_cases(found).collect()] == [("Finding data", ["find_user", "find_all"])]
    assert "## Entry points" in insight.documents(found) and "Puntos de entrada" in insight.documents(found, "es")
    assert [r["name"] for r in insight.outline(found, "src/b.rs").collect()] == ["with_a", "with_b", "build", "instance"]
    assert source.symbols(source.exploded(found, "functions"), "build").count() == 1
    assert [r["text"] for r in insight.query(found, '(function_definition name: (identifier) @n) @f').limit(1).collect()] == ["with_a"] and insight.query(found, '(function_item) @f (#match? @f "^with_")').count() == 2
    with pytest.raises(ValueError):
        insight.query(found, "(nothing")
    tree = {r["folder"]: r["files"] for r in insight.structure(found.withColumn("restricted", F.lit(False))).collect()}
    assert tree == {"": 2, "src": 2} and insight.page(found.select("rel_path"), 0, 1).first()["has_next"]


def test_components(spark):
    df = spark.createDataFrame([("app/x/a.ts", "@Component({ selector: 'app-a', templateUrl: './a.html', styleUrls: ['../s.css', './a.css'] })")], "rel_path string, content string")
    r = insight.component_triads(df).first()
    assert (r["selector"], r["template_file"], r["style_files"]) == ("app-a", "app/x/a.html", ["app/s.css", "app/x/a.css"])


def test_linter_outputs(spark):
    row = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    got = linters.clippy(row('{"reason":"compiler-message","message":{"level":"warning","message":"m","code":{"code":"c"},"spans":[{"file_name":"a.rs","is_primary":true,"line_start":3,"column_start":2}]}}', "x")).first()
    assert (got["path"], got["line"], got["severity"], got["rule_id"]) == ("a.rs", 3, "warning", "c")
    assert linters.eslint(row('[{"filePath":"/r/a.js","messages":[{"line":1,"column":2,"severity":2,"message":"m","ruleId":"r"}]}]')).first()["severity"] == "error"
    for tool, line, want in (("mypy", "a.py:3: error: Bad  [arg-type]", ("a.py", 3, 1, "error", "Bad", "arg-type")), ("javac", "A.java:5: warning: [unchecked] call", ("A.java", 5, 1, "warning", "call", "unchecked")), ("ktlint", "a.kt:1:2: No (std:x)", ("a.kt", 1, 2, "warning", "No", "std:x")), ("kotlinc", "a.kt:1:2: error: No", ("a.kt", 1, 2, "error", "No", None)), ("cppcheck", "a.c:4:7: style: S [id]", ("a.c", 4, 7, "info", "S", "id")), ("dotnet", "A.cs(3,4): error CS1: M [p]", ("A.cs", 3, 4, "error", "M", "CS1"))):
        r = linters.text_report(row(line, "other"), tool).collect()
        assert len(r) == 1 and tuple(r[0][:6]) == want
    assert linters.of_file(linters.text_report(row("./a.py:3: error: Bad"), "mypy"), "a.py").count() == 1
