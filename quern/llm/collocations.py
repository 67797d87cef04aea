"""Phrase collocation mining: word sequences, per language, that occur far more often than their parts would suggest.

1. Texts are cut into pieces at punctuation and line ends, pieces into words; all contiguous sequences of 1 to MAX_WORDS
   words become rows of language, phrase and count, added up within a slice of text first and then by Spark's hash
   aggregation, which adds up within a task before it shuffles. So a word of a third of all rows is no hot key.
2. Most sequences of two words or more occur once or twice, and their rows would be several times the text. A first
   pass therefore counts the hashes of all of them in a table of fixed size, summed over the tasks; a sequence whose
   cell stays below the minimum cannot reach it, and makes no row. Cells are shared, so this never loses a sequence: the
   second pass counts the others exactly, by their words, and all single words. The size of the table changes the number of rows only, not the result; it rises
   with the number of documents up to MOST_CELLS, whose bits (2 MB) are all that is broadcast.
3. Each way to cut a candidate into a first part and a rest is a row; joins give the counts of both (they occur at
   least as often as the candidate, so they are in the table). Scores are exact in Decimal.
4. Candidates that lie in a longer one with the same count: if there is one, then there is one that is longer by one
   word, as counts fall from part to whole; an anti-join with all candidates less their first or their last word.
5. Ranks: each of many parts of a language gives its best rows, from which a window takes the best of the language.

Defined cases: a null or empty text, or one without words, gives no phrases; a null language is `und` (with documents
whose language is of that name); ties at the same score and count are in the order of the phrases' UTF-8 bytes; rows
that repeat a doc_id count each, as doc_id is not read; neither are other columns; texts are read whole, a slice has
one text at least; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow, mix64, returned, slices, split_join, word_hashes, written

MIN_COUNT, MAX_WORDS, TOP, SCALE = 100, 5, 2000, 1000
#: Cells of the table of hashed counts: at least, at most, and for each document in between; cells that travel in one row.
LEAST_CELLS, MOST_CELLS, CELLS_A_DOCUMENT, CHUNK = 1 << 20, 1 << 26, 64, 1 << 16
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[9] = 32
_MAP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10


class Words:
    """The words of a slice of texts: in order, their hashes, the language of each, and how far its piece goes on."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        raw = [(t or "").encode() for t in texts]
        buf = _MAP[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
        self.hashes, solid = word_hashes(buf, lower=False), (buf != 32) & (buf != 10)
        starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
        piece = np.searchsorted(np.flatnonzero(buf == 10), starts)
        ends = np.searchsorted(piece, piece, side="right")
        self.left = ends - np.arange(len(starts))  # words from here to the end of the piece
        self.names, at = np.unique(np.array(langs, dtype=object), return_inverse=True)
        begins = np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]])
        self.lang = at[np.searchsorted(begins, starts, side="right") - 1] if len(starts) else np.zeros(0, np.int64)
        self.bytes = buf

    def sequences(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n from 2 to most: n, where sequences of n words begin, and their hashes (with the language)."""
        seed = np.array([zlib.crc32(n.encode()) for n in self.names], dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = mix64(self.hashes ^ (seed[self.lang] * np.uint64(0x9E3779B97F4A7C15)))
            at = np.arange(len(h))
            for n in range(2, most + 1):
                on = self.left[at] >= n
                at, h = at[on], h[on]
                h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + n - 1])
                yield n, at, h

    def strings(self) -> pa.Array:
        return pa.array(self.bytes.tobytes().split(), pa.binary()).cast(pa.string())


def _texts(part: pa.RecordBatch) -> Words:
    return Words(part.column("text").to_pylist(), part.column("lang").to_pylist())


def frequent_cells(docs: DataFrame, least: int, most: int, cells: int) -> np.ndarray:
    """Which cells (by the leading bits of a hash) hold sequences that may occur least times: a bit for each cell, packed."""
    shift = np.uint64(64 - (cells.bit_length() - 1))
    kind = np.dtype("<u1" if least < 1 << 8 else "<u2" if least < 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(cells, dtype=kind)
        for part in slices(batches, "text"):
            for _, _, h in _texts(part).sequences(most):
                cell, n = np.unique(h >> shift, return_counts=True)
                full[cell] = np.minimum(full[cell] + n, least)  # more than least is as good as least
        for at in range(0, cells, CHUNK):
            if full[at : at + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([at // CHUNK], pa.int32()), "counts": [zlib.compress(full[at : at + CHUNK].tobytes(), 1)]})
        returned()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(min(CHUNK, cells), dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([held], pa.int32()), "bits": [np.packbits(total >= least).tobytes()]})

        for part in batches:
            for chunk, counts in zip(part.column("chunk").to_pylist(), part.column("counts").to_pylist()):
                if chunk != held:
                    if held is not None:
                        yield out()
                    held, total = chunk, np.zeros(min(CHUNK, cells), dtype=np.int64)
                total += np.frombuffer(zlib.decompress(counts), dtype=kind)
        if held is not None:
            yield out()

    parts = arrow(docs, count, "chunk int, counts binary")
    bits = np.zeros(max(1, cells // 8), dtype=np.uint8)
    for r in arrow(parts.repartition("chunk").sortWithinPartitions("chunk"), add, "chunk int, bits binary").collect():  # MOST_CELLS bits at most
        at = r["chunk"] * (CHUNK // 8)
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def counted(docs: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS, cells: int | None = None) -> DataFrame:
    """lang, words, phrase and f of all single words, and of all sequences of 2 to most words that occur least times in a language."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    if cells is None:
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_A_DOCUMENT * docs.count()).bit_length()))
    shift = np.uint64(64 - (cells.bit_length() - 1))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, least, most, cells))

    def rows(words: Words, n: int, lang: np.ndarray, phrase: pa.Array) -> Iterator[pa.RecordBatch]:
        found = pa.table({"lang": pa.array(lang), "phrase": phrase}).group_by(["lang", "phrase"]).aggregate([([], "count_all")]).combine_chunks()
        for part in found.to_batches(max_chunksize=50_000):
            names = pa.array(list(words.names), pa.string()).take(part.column("lang"))
            yield pa.RecordBatch.from_pydict({"lang": names, "words": pa.array(np.full(part.num_rows, n), pa.int32()), "phrase": part.column("phrase"), "c": part.column("count_all")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = _texts(part)
            strings = words.strings()
            may = np.ones(len(strings), dtype=bool)
            yield from rows(words, 1, words.lang, strings)
            for n, at, h in words.sequences(most):
                cell = h >> shift
                fine = (shared.value[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
                fine &= may[at] & may[at + 1]  # so must be the sequences without the last and without the first word
                on, may = at[fine], np.zeros(len(strings), dtype=bool)
                may[on] = True
                if len(on):
                    phrase = pc.binary_join_element_wise(*(strings.take(pa.array(on + k)) for k in range(n)), " ")
                    yield from rows(words, n, words.lang[on], phrase)
        returned()

    found = arrow(docs, run, "lang string, words int, phrase string, c long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 1))


def collocations(docs: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP, percent: int = 100, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    A candidate goes if a longer one holds its words and has at least percent of its count.
    """
    whole = written(counted(docs, least, most, cells), "sequences")
    key = F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("phrase"))
    known = whole.filter(F.col("f") >= least).withColumn("key", key)
    size = whole.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))  # a row for each language
    phrases = known.filter("words > 1")
    part = F.split("phrase", " ")

    def of(words: Column) -> Column:
        return F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.array_join(words, " "))

    shorter = phrases.filter("words > 2").select(F.explode(F.array(of(F.slice(part, 1, F.col("words") - 1)), of(F.slice(part, F.lit(2), F.col("words") - 1)))).alias("key"), "f")
    held = shorter.groupBy("key").agg(F.max("f").alias("longer"))
    left = phrases.join(held, "key", "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("f"))).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", of(F.slice(part, F.lit(1), F.col("k")))).withColumn("rest", of(F.slice(part, F.col("k") + 1, F.col("words") - F.col("k"))))
    by = [F.col("phrase"), F.col("k")]
    cuts = split_join(cuts, known.select(F.col("key").alias("first"), F.col("f").alias("l")), "first", by)
    cuts = split_join(cuts, known.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest", by)
    cuts = split_join(cuts, size, "lang", by)
    big = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.withColumn("x", F.lit(SCALE).cast("decimal(10,0)") * (big("a") * big("n")).cast("decimal(28,0)")).withColumn("y", (big("l") * big("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("x div y"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("_no", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_no") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP) -> str:
    """The same in DuckDB, from all sequences."""
    return f"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, w FROM (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents))),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k AS words, w[i : i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {most} + 1)) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, words, array_to_string(w, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
h AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:-2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM f WHERE words > 2) GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.f AS a, words, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN h ON h.lang = f.lang AND h.phrase = f.phrase WHERE words > 1 AND (h.f IS NULL OR 100 * h.f < 100 * f.f)),
k AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS first, array_to_string(w[i + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS i FROM c)),
s AS (SELECT k.lang, k.phrase, a, i, x.f AS l, y.f AS r, t.n, ({SCALE} * a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest JOIN t ON t.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS pick FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE pick = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r WHERE rank <= {top}
"""
