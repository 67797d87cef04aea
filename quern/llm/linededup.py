"""Line dedup: lines that many documents share stay in one of them; levelled sorted runs know the lines seen so far.

A line's key is the line without white space at its ends and with A-Z in lower case; what counts are keys of at least
LENGTH characters, known by a 128-bit hash. Documents come in batches, highest doc_ids first (a batch is a range of
ids, so each reads its part of a narrow table of hashes, not the texts again).

A batch adds up its own hashes (partial sums first, so a line of a third of all documents is no hot key) and writes
them as a run: a table of hash and count, in buckets by hash, sorted within. The hashes that no earlier run holds are
found by merge anti-joins of the new run with the earlier ones, bucket by bucket without a shuffle; for these the
batch's highest doc_id is the one that keeps the line. When a level has FANOUT runs, they are merged into one of the
next level, so that later batches meet few runs: about FANOUT a level, and a level more for FANOUT times the batches.

At the end the runs give the hashes of DOCUMENTS documents or more. They meet the documents' hashes in a join that
deals a frequent hash to several tasks, and the documents get the set of hashes that they lose, by doc_id and a hash
of the text. That set is no larger than the document itself. Lines are then dropped in one pass over each text.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id are documents of their own, and if it
is the largest that holds a line, all its rows keep it; so do all lines of a key in the document that keeps it; a null
doc_id counts as a document below all others; rows that repeat doc_id and text lose the same lines; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_rows, shared_dir, split_join, written

LENGTH, DOCUMENTS, BATCHES, FANOUT = 40, 5, 6, 3
_SPACE, _UPPER, _LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Runs:
    """Levelled sorted runs of line hashes: tables of h and n, in buckets by h, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.name = spark, fanout, f"quern_runs_{uuid.uuid4().hex}"
        self.buckets, self.levels, self.count = int(spark.conf.get("spark.sql.shuffle.partitions")), [], 0

    def _run(self, rows: DataFrame) -> str:
        self.count += 1
        name = f"{self.name}_{self.count}"
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", self._at(name)).saveAsTable(name)
        return name

    def _at(self, name: str) -> str:
        return f"{shared_dir(self.spark).rstrip('/')}/{name}"

    def read(self, names: list[str]) -> DataFrame:
        """The rows of several runs. Their files are read without their buckets, as a union of tables in buckets may be taken for one."""
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*map(self._at, names))

    def add(self, rows: DataFrame) -> str:
        """The name of a run with h and top (its largest doc_id) of the hashes in rows (h, doc_id) that no run holds yet; rows become a run."""
        own = self.spark.table(table := self._run(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))))
        for run in [r for level in self.levels for r in level]:
            own = own.join(self.spark.table(run).select("h").hint("merge"), "h", "left_anti")
        fresh = self._run(own.select("h", "top"))
        self.levels = self.levels or [[]]
        self.levels[0].append(table)
        self._compact()
        return fresh

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._run(self.merged(level)))
            self.levels[k] = []

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """h and n over all runs, or those given."""
        runs = [r for level in self.levels for r in level] if runs is None else runs
        return self.read(runs).select("h", "n").groupBy("h").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        """Takes the runs' names out of the catalogue; their files lie in the shared folder like those of other steps."""
        for k in range(1, self.count + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")


def hashes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, doc (a hash of the text) and h: the distinct hashes of each row's lines that count."""
    line = lambda x: F.translate(F.btrim(x, F.lit(_SPACE)), _UPPER, _LOWER)
    long = F.filter(F.transform(F.split("text", "\n", -1), line), lambda k: F.char_length(k) >= length)
    found = F.array_distinct(F.transform(long, lambda k: F.unhex(F.md5(k))))
    return docs.select("doc_id", F.xxhash64("text").alias("doc"), F.explode(found).alias("h"))


def repeated(facts: DataFrame, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """h, n and top of the hashes that documents rows of facts (doc_id, h) hold at least: their number and largest doc_id."""
    runs = Runs(facts.sparkSession, fanout)
    cuts = facts.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5]).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []), reverse=True) if batches > 1 else []
    tops = []
    for k in range(len(cuts) + 1):
        these = F.col("doc_id") > cuts[k] if k < len(cuts) else F.lit(True)
        if k == len(cuts) and cuts:
            these = (F.col("doc_id") <= cuts[-1]) | F.col("doc_id").isNull()
        elif k:
            these = these & (F.col("doc_id") <= cuts[k - 1])
        tops.append(runs.add(facts.filter(these).select("h", "doc_id")))
    often = runs.merged().filter(F.col("n") >= documents)
    out = written(often.join(runs.read(tops), "h"), "repeated-lines")  # each hash is in one of tops
    runs.drop()
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text (what is kept), n_lines (before) and n_dropped of each document."""
    docs = docs.select("doc_id", "text")
    facts = written(hashes(docs, length), "line-hashes")
    often = repeated(facts, documents, batches, fanout)
    lost = split_join(facts, often, "h", [F.col("doc_id"), F.col("doc")], counts=often).filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    lost = lost.groupBy("doc_id", "doc").agg(F.collect_set("h").alias("lost")).select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "lost")
    both = docs.join(lost.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(lost["_id"]) & (F.xxhash64("text") == lost["_doc"]), "left")

    def run(part: pa.RecordBatch) -> dict:
        texts, lines, dropped = [], [], []
        for text, out in zip(part.column("text").to_pylist(), part.column("lost").to_pylist()):
            text = text or ""
            before = text.count("\n") + 1
            if out:
                out = set(out)
                kept = [x for x in text.encode().split(b"\n") if hashlib.md5(x.strip(_SPACE.encode()).lower()).digest() not in out]
                dropped.append(before - len(kept))
                text = b"\n".join(kept).decode()
            else:
                dropped.append(0)
            texts.append(text)
            lines.append(before)
        return {"doc_id": part.column("doc_id"), "text": texts, "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}

    return map_rows(both.select("doc_id", "text", "lost"), run, "doc_id long, text string, n_lines long, n_dropped long", "text")


#: The digests of deduplicated() in DuckDB.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
    FROM (SELECT row, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
o AS (SELECT k, max(doc_id) AS top FROM (SELECT DISTINCT row, doc_id, k FROM l WHERE length(k) >= {LENGTH}) GROUP BY k HAVING count(*) >= {DOCUMENTS}),
x AS (SELECT row, l.doc_id, i, line, o.k IS NOT NULL AND l.doc_id IS DISTINCT FROM o.top AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY row, doc_id
"""
