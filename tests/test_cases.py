"""The library's queries over inline trees and tables, against the rows written by hand."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.plans import catalogue, rules, samples
from tests import cases


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(r[k] for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, name):
    got = cases.QUERIES[name](spark, "")
    want = duckdb.sql(cases.SQL[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_samples_cover_every_rule():
    assert {r[0] for r in samples.FRAGMENTS} == {r[0] for r in catalogue.RULES}
    assert {r[0] for r in samples.FLOWS} == {f"{a}-{rules.KEY_NAMES[k]}" for a in rules.CALLS for k in rules.SINKS if (a, k) not in rules.LACKING}
    assert all(bad and fine for _, _, bad, fine in samples.FRAGMENTS) and all(len(set(r[2:])) == 3 for r in samples.FLOWS)


def test_every_sample_is_reported_as_it_should_be(spark):
    for cases_, found in ((samples.statement_cases(), rules.structural), (samples.flow_cases(), rules.taint)):
        ids = spark.range(len(cases_)).withColumnRenamed("id", "k")
        got = found(samples.dealt(ids, "k", cases_)).select(samples.key_of(F.col("file")).alias("k"), "rule").distinct().collect()
        assert Counter(map(tuple, got)) == Counter((n, c[0]) for n, c in enumerate(cases_) if c[0])


def test_fixed_lists():
    assert catalogue.SECURITY_NAMES[:4] == ("token", "secret", "password", "passwd") and {"apikey", "api_key", "uuid", "guid", "captcha"} <= set(catalogue.SECURITY_NAMES) and not {"iv", "key"} & set(catalogue.SECURITY_NAMES)
    assert {"acl", "grant"} <= set(catalogue.AUTH_NAMES) and "external-general-entities" in catalogue.HARDENING


def test_scan_of_a_tree_on_disk(spark, tmp_path):
    from quern.sources import files, settings

    for path, text in {"a.py": "x = 1\n", "b.log": "b", "build/c.py": "c", "src/keep.log": "k\n", "target/x.rs": "x", "src/d.rs": "fn f() { }\n", "secret/e.py": "e", "big.py": "x" * (files.MAX_BYTES + 1), "old/f.py": "f"}.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    own = spark.createDataFrame([(".gitignore", "*.log\nbuild/\n"), ("src/.ignore", "!keep.log\n")], "rel_path string, content string")
    got = {r["rel_path"]: r for r in files.scan(spark, f"file://{tmp_path}", restrict=["/secret"], ignore=["/old"], ignore_files=own).collect()}
    assert set(got) == {"a.py", "src/keep.log", "src/d.rs", "secret/e.py", "big.py"}
    assert got["secret/e.py"]["restricted"] and not got["a.py"]["restricted"] and got["big.py"]["content"] is None and got["src/d.rs"]["language"] == "rust" and got["src/d.rs"]["depth"] == 1
    log = settings.chained(spark.createDataFrame([("x", 1, 10, "start", "{}"), ("x", 2, 11, "stop", "{}")], "log string, seq long, timestamp long, event string, details string"))
    settings.append(log, f"file://{tmp_path}/log")
    assert settings.broken(spark.read.schema(settings.LOG).json(f"file://{tmp_path}/log")).count() == 0


def test_analysis_is_linear_in_the_file():
    import time

    from quern.operators import source

    def took(n):
        text = "".join(f"def f{k}(a):\n    b = a + {k}\n    return g(b)\n\n" for k in range(n))
        began = time.process_time()
        source.analysed(text, "python")
        return time.process_time() - began

    took(200)
    assert took(4000) < 25 * max(took(500), 0.01)
