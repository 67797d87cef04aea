"""Plans that hold at any size: texts are parsed by many tasks, and joins of what was parsed broadcast no side of unknown size."""

from quern.operators import graph, nodes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_resolved_imports_broadcast_nothing(spark):
    imports = spark.range(50).selectExpr("id AS src", "concat('x', id % 7) AS path", "concat('x', id % 7) AS candidate")
    files = spark.range(5).selectExpr("concat('x', id, '.ts') AS rel_path", "id = 1 AS restricted")
    got = graph.resolved_imports(imports, files)
    assert "Broadcast" not in _plan(got)
    assert {r["dst"] for r in got.collect()} == {"x0.ts", "x1.ts", "x2.ts", "x3.ts", "x4.ts", None}


def test_contained_broadcasts_nothing(spark):
    outer = spark.createDataFrame([("a", 0, 9), ("a", 2, 5), ("b", 0, 1 << 30), ("b", 7, 7)], "rel_path string, pre int, post int")
    inner = spark.createDataFrame([("a", 3), ("a", 8), ("b", 1 << 29), ("c", 1)], "rel_path string, in_pre int")
    got = nodes.contained(outer, inner, "rel_path")
    assert "Broadcast" not in _plan(got)
    assert sorted(map(tuple, got.select("rel_path", "pre", "in_pre").collect())) == [("a", 0, 3), ("a", 0, 8), ("a", 2, 3), ("b", 0, 1 << 29)]
    for how, left in (("left_semi", [("a", 0), ("a", 2), ("b", 0)]), ("left_anti", [("b", 7)])):
        got = nodes.contained(outer, inner, "rel_path", how=how)
        assert "Broadcast" not in _plan(got)
        assert sorted(map(tuple, got.select("rel_path", "pre").collect())) == left


def test_every_part_of_a_tree_is_parsed_by_many_tasks(spark):
    from quern.operators import dataflow, source

    files = spark.range(8).selectExpr("concat('a', id, '.py') AS rel_path", "'python' AS language", "'f(x)' AS content").coalesce(1)
    for parsed in (source.analysis, dataflow.sites, nodes.code_nodes):
        assert "hashpartitioning(rel_path" in _plan(parsed(files))


def test_json_is_redacted_in_its_row(spark):
    from quern.functions import redact

    rows = [('{"token": [{"a": 1}, "x"], "list": ["10.0.0.1", {"Secret": 2}], "n": {"password": "p"}}',), ('{"a": 1, "a": 2}',), (None,)]
    got = redact.redacted_json(spark.createDataFrame(rows, "v string").coalesce(1), "v")
    assert "Exchange" not in _plan(got) and "Window" not in _plan(got)
    assert [r["v"] for r in got.collect()] == ['{"token":"[REDACTED]","list":["[REDACTED]",{"Secret":"[REDACTED]"}],"n":{"password":"[REDACTED]"}}', None, None]


def test_each_pattern_replaces_once(spark):
    from quern.functions import redact

    rows = spark.createDataFrame([("password = abcdefgh at 10.0.0.1",), (None,)], "v string")
    got = rows.select(redact.fired(rows["v"]).alias("v"))
    assert _plan(got).count("regexp_replace") <= len(redact.SECRETS)
    assert [r["v"] for r in got.collect()] == [["PRIVATE_IP", "GENERIC_SECRET"], []]


def test_texts_of_one_small_split_are_searched_by_many_tasks(spark, tmp_path):
    from quern.plans import queries

    spark.sql("SELECT 1L AS c_custkey, 'a' AS c_name, 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert "hashpartitioning(c_custkey" in _plan(queries.carrier(spark, str(tmp_path)))


def test_only_asked_tables_are_worked_out(spark, tmp_path):
    from quern.operators import source
    from quern.plans import treequeries

    text = "import a.b\n# weigh\ndef f(x):\n    g(x, 'y')\n"
    for table in source.TABLES:
        found = source.analysed(text, "python", tables=(table,))
        assert getattr(found, table) == getattr(source.analysed(text, "python"), table)
        assert {t for t in source.TABLES if t != table and getattr(found, t)} <= ({"functions", "types", "calls"} if table in ("calls", "assigns", "functions", "types") else set())
    spark.sql("SELECT 1L AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    for query in ("imports", "comments", "calls"):
        plan = _plan(treequeries.QUERIES[f"{query}_over_parts"](spark, str(tmp_path)))
        assert not [t for t in source.TABLES if t != query and f"{t}#" in plan]


def test_a_stream_calls_groups_of_keys_not_each_key(spark, tmp_path):
    from quern.streaming import watch

    keys = 2 * watch.BUCKETS
    events = spark.range(2 * keys).selectExpr(f"nullif(id % {keys}, 7) AS k", f"1000 + id div {keys} * 400 + id % 3 AS ms")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, 20_000)], "k long, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = watch.debounced_stream(stream, "k", "ms", 500).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= watch.BUCKETS
    got = spark.read.schema("k long, first_ms long, events long").parquet(f"{tmp_path}/out").filter("k is null or k >= 0")
    want = watch.debounced(events, "k", "ms", 500)
    assert got.count() == keys and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_only_words_of_the_index_become_rows(spark):
    from quern.operators import source
    from quern.plans import rules

    files = spark.createDataFrame([("a.py", "python", "weigh(crate)\n")], "rel_path string, language string, content string")
    facts = rules.facts(files, source.analysis(files))
    plan = _plan(rules.candidates(facts))
    assert "filter(regexp_extract_all(" in plan


def test_parsing_tasks_are_not_put_together_by_bytes(spark):
    from quern.operators import dataflow, source

    files = spark.range(8).selectExpr("concat('a', id, '.py') AS rel_path", "'python' AS language", "'f(x)' AS content").coalesce(1)
    for parsed in (source.analysis, dataflow.sites, nodes.code_nodes):
        assert "REPARTITION_BY_NUM" in _plan(parsed(files))


def test_inputs_of_all_files_do_not_share_a_key(spark):
    from quern.plans import flows

    text = "def v():\n    return open(request.args['f'])\ndef w(q):\n    q = request.args['q']\n    c.execute(q)\n"
    e = flows.Edges(spark.range(20).selectExpr("concat('a', id, '.py') AS rel_path", "'python' AS language", f"'{text.replace(chr(39), chr(34))}' AS content"))
    by_key = [r["count"] for r in e.edges.groupBy("rel_path", "scope", "name", "epoch").count().collect()]
    assert len(by_key) >= 40 and max(by_key) <= 3
    _, arrivals = e.seeds()
    held = arrivals.filter("s_kind = 'def'")
    assert held.count() == 20 == flows._arrived(held).count()  # a row for all kinds
    e.edges.unpersist()


def test_a_round_moves_its_new_facts_only(spark):
    from quern.plans import flows

    e = flows.Edges(spark.createDataFrame([("a.py", "python", "def v():\n    q = request.args['q']\n    c.execute(q)\n")], "rel_path string, language string, content string"))
    assert e.edges.count() == 2  # the input that q holds, and q in the call
    names = spark.createDataFrame([("a.py", 1, "q", 1)], "rel_path string, scope int, name string, epoch int")
    found = names.hint("merge").join(e.edges, names.columns)
    assert _plan(found).split("InMemoryRelation")[0].count("Exchange hashpartitioning") == 1 and found.count() == 1
    e.edges.unpersist()


def test_names_of_many_calls_and_calls_by_keyword_lead_into_their_function(spark):
    from quern.plans import rules

    lib = [("lib.py", "python", "import os\ndef launch(a, cmd):\n    os.system(cmd)\ndef same(x):\n    return x\n")]
    apps = [(f"app{k}.py", "python", f"def view{k}():\n    q = same(request.args['q'])\n    launch(1, cmd=q)\n    launch(q, 2)\n") for k in range(30)]
    got = rules.taint(spark.createDataFrame(lib + apps, "rel_path string, language string, content string")).select("file", "line").collect()
    assert sorted(map(tuple, got)) == sorted((p, 3) for p, _, _ in apps)


def test_rules_keep_nothing_of_the_files(spark, tmp_path):
    from pathlib import Path

    from quern.plans import treequeries

    n = 3 * len(treequeries.STATEMENTS)
    spark.range(n).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("*"))
    got = treequeries.QUERIES["rules_over_orders"](spark, str(tmp_path))
    plan = _plan(got)
    assert set(shared.rglob("*")) == before  # neither facts nor analyses are written
    assert plan.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(o_orderkey" in plan and "SortMergeJoin" not in plan  # keys are dealt, no text moves
    want = {(k, treequeries.STATEMENTS[k % len(treequeries.STATEMENTS)][0]) for k in range(n)}
    assert set(map(tuple, got.collect())) == {(k, rule) for k, rule in want if rule}
