"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Each component x becomes floor(1024 x). The Gram matrix of all vectors (a sum of partial sums, as wide as a vector)
gives a rotation whose leading axes hold most of the length. Rows are numbered by length, longest first, and packed
into blocks of ROWS by their numbers, whatever the partitions were; a block keeps integers, rotated coordinates, and
lengths of all but the leading ones.

First the queries meet the leading block, which gives each a lower bound of its k-th score. As blocks are in order of
length, the further blocks whose longest vector could still reach a bound of a query block are a prefix of them, read
off a small table without vectors; a query block meets these and no others. There the partial sum over the leading
axes plus the product of the two remaining lengths bounds a score from above; only pairs above the query's bound are
scored, exactly, in integers. The best k of each block are merged in a last step by query row. All bounds have a
margin far above the rounding of the rotation, so the result is exact.

The queries are a stated set; they meet all rows in blocks. A candidate block and the query blocks that it meets come
together by a shuffle on its number and a salt, so that no task has more than MEETINGS query blocks. A query row is
known by its number: it is no candidate of its own, while another row with the same vec_id is.

Defined cases: vectors that are null or hold null or non-finite components take no part, as rows with a null vec_id;
an empty vector is a zero one, and shorter vectors count as if filled up with zeros; a query with fewer than k
candidates has all of them; ties go to the smaller vec_id; rows that repeat a vec_id are rows of their own, each with
its k results if it is a query; integers beyond 2**62 count as 2**62, and scores beyond a long as the nearest long; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow, cut, map_rows

K, SCALE, ROWS, QUERIES, LEAD = 10, 1024, 2048, 1024, 16
#: Query blocks that one task compares with a candidate block; entries of the table of lengths on the driver.
MEETINGS, LENGTHS = 64, 65_536
_MOST = 2.0**62


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of all rows, where each row begins (and the last one ends), and which rows take part."""
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    values = flat.to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False))))
    offsets -= offsets[0]
    return values, offsets, (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, x (integers as bytes), dim and norm of the vectors that take part."""

    def run(part: pa.RecordBatch) -> dict:
        values, at, fine = _vectors(part.column("embedding"))
        keep = np.flatnonzero(fine & ~part.column("vec_id").is_null().to_numpy(zero_copy_only=False))
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.clip(np.floor(SCALE * values), -_MOST, _MOST)
            v = np.where(np.isnan(v), 0, v).astype("<i8")
        x = [v[a:b] for a, b in zip(at[keep].tolist(), at[keep + 1].tolist())]
        return {"vec_id": part.column("vec_id").take(pa.array(keep)), "x": [r.tobytes() for r in x], "dim": pa.array(list(map(len, x)), pa.int32()), "norm": pa.array([float(np.sqrt((r.astype(float) ** 2).sum())) for r in x], pa.float64())}

    return map_rows(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), run, "vec_id long, x binary, dim int, norm double")


def _matrix(column: list[bytes], dim: int) -> np.ndarray:
    if all(len(b) == 8 * dim for b in column):
        return np.frombuffer(b"".join(column), dtype="<i8").reshape(-1, dim)
    out = np.zeros((len(column), dim), dtype=np.int64)
    for k, b in enumerate(column):
        out[k, : len(b) // 8] = np.frombuffer(b, dtype="<i8")
    return out


def rotation(vecs: DataFrame, dim: int) -> np.ndarray:
    """The orthogonal matrix whose leading columns hold most of the vectors' length, from sums of partial Gram matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for part in batches:
            x = _matrix(part.column("x").to_pylist(), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId() % 8], pa.int32()), "gram": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim)
        for part in batches:
            for g in part.column("gram").to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_pydict({"gram": [total.tobytes()]})

    parts = arrow(vecs.select("x"), run, "k int, gram binary")
    gram = np.zeros(dim * dim)
    for r in arrow(parts.repartition(8, "k"), add, "gram binary").toLocalIterator():  # a matrix as wide as a vector at a time
        gram += np.frombuffer(r["gram"])
    _, axes = np.linalg.eigh(gram.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1])


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with no: their number in that order, from 0. Partitions are ranges; a small table of their sizes gives the rest."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_seq", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"))
    counts = dealt.groupBy("_part").agg(F.count("_seq").alias("c"))  # a row for each partition at most
    base = counts.select("_part", F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(base), "_part").withColumn("no", F.col("_base") + F.col("_seq")).drop("_base", "_part", "_seq")


BLOCK = "no long, n int, longest double, ids binary, rows binary, ints binary, turned binary, rest binary"


def packed(rows: DataFrame, axes: np.ndarray, size: int) -> DataFrame:
    """Blocks of size rows (no, row, vec_id, x) by their numbers no."""
    dim = len(axes)
    turn = rows.sparkSession.sparkContext.broadcast(axes)
    dealt = rows.select(F.expr(f"no div {size}").alias("block"), "no", "row", "vec_id", "x").repartition("block").sortWithinPartitions("block", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x = _matrix([h[3] for h in held], dim)
            y = x.astype(np.float64) @ turn.value
            norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            wide = np.abs(x).max(initial=0) >= 2**31
            one = {"n": pa.array([len(held)], pa.int32()), "longest": [float(norms.max(initial=0))], "ids": [np.array([h[2] for h in held], "<i8").tobytes()], "rows": [np.array([h[1] for h in held], "<i8").tobytes()]}
            return pa.RecordBatch.from_pydict({"no": pa.array([held[0][0]], pa.int64()), **one, "ints": [x.astype("<i8" if wide else "<i4").tobytes()], "turned": [y[:, :LEAD].astype("<f8").tobytes()], "rest": [np.sqrt((y[:, LEAD:] ** 2).sum(axis=1)).astype("<f8").tobytes()]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "row", "vec_id", "x"))):
                if held and held[0][0] != row[0]:
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return arrow(dealt, run, BLOCK)


def _ints(block: dict, dim: int) -> np.ndarray:
    wide = len(block["ints"]) == 8 * dim * (len(block["ids"]) // 8)
    return np.frombuffer(block["ints"], dtype="<i8" if wide and dim else "<i4").reshape(-1, dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of the rows of q and c, as longs; those beyond a long are the nearest one."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = q.astype(object) @ c.astype(object).T
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in row] for row in exact], dtype=np.int64).reshape(len(q), len(c))


def best_of(q: dict, c: dict, dim: int, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, score) of the best k candidates of each query in the block, among those at its bound or above."""
    qi, ci = _ints(q, dim), _ints(c, dim)
    qt, ct = (np.frombuffer(x["turned"], dtype="<f8").reshape(-1, min(LEAD, dim)) for x in (q, c))
    qr, cr = (np.frombuffer(x["rest"], dtype="<f8") for x in (q, c))
    q_rows, c_rows = (np.frombuffer(x["rows"], dtype="<i8") for x in (q, c))
    c_ids = np.frombuffer(c["ids"], dtype="<i8")
    slack = 1e-9 * np.sqrt((qi.astype(float) ** 2).sum(axis=1)) * c["longest"] + 1e-6
    bounds = np.maximum(bounds, -np.inf)
    place, vec, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(c_ids), 256):  # in descending length, so that bounds rise early
        to = slice(at, at + 256)
        may = (qt @ ct[to].T + qr[:, None] * cr[None, to] + slack[:, None] >= bounds[:, None]) & (q_rows[:, None] != c_rows[None, to])
        i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(i):
            continue
        got = _products(qi[i], ci[to][j])
        a, b = np.nonzero(may[np.ix_(i, j)] & (got >= bounds[i][:, None] - slack[i][:, None]))
        place, vec, score = np.concatenate((place, i[a])), np.concatenate((vec, c_ids[to][j[b]])), np.concatenate((score, got[a, b]))
        order = np.lexsort((vec, ~score, place))  # ~ falls as the score rises, for every long
        place, vec, score = place[order], vec[order], score[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        best = rank < k
        full = place[rank == k - 1]
        bounds[full] = np.maximum(bounds[full], score[rank == k - 1])
        place, vec, score = place[best], vec[best], score[best]
    return place, vec, score


def _met(blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score, q_row of the best of each candidate block and each query block that meets it.

    blocks has c_no, salt, tag (0 for the candidates, which come first, 1 for queries), bounds and the columns of BLOCK.
    """
    dealt = blocks.repartition("c_no", "salt").sortWithinPartitions("c_no", "salt", "tag", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                if not row["tag"]:
                    c = row
                elif c and (c["c_no"], c["salt"]) == (row["c_no"], row["salt"]):
                    bounds = np.frombuffer(row["bounds"], dtype="<f8") if row["bounds"] else np.full(row["n"], -np.inf)
                    place, vec, score = best_of(row, c, dim, k, bounds)
                    if len(place):
                        yield pa.RecordBatch.from_pydict({"query_id": np.frombuffer(row["ids"], dtype="<i8")[place], "vec_id": vec, "score": score, "q_row": np.frombuffer(row["rows"], dtype="<i8")[place], "q_no": pa.array([row["no"]] * len(place), pa.int64()), "place": place})

    return arrow(dealt, run, "query_id long, vec_id long, score long, q_row long, q_no long, place long")


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest scores of each row for which is_query (of vec_id) holds."""
    vecs = cut(scaled(vectors))
    dim = vecs.agg(F.max("dim")).first()[0] or 1
    axes = rotation(vecs, dim)
    rows = cut(numbered(vecs, F.desc("norm"), F.asc("vec_id")).withColumn("row", F.col("no")))
    cand = cut(packed(rows, axes, ROWS))
    quer = cut(packed(numbered(rows.filter(is_query).drop("no"), F.asc("row")), axes, QUERIES))
    count, queries = cand.count(), quer.count()
    salts = max(1, -(-queries // MEETINGS))
    salt, none = F.pmod("no", F.lit(salts)), F.lit(None).cast("binary")
    names = ["c_no", "salt", "tag", "bounds", *cand.columns]

    def candidates(these: DataFrame) -> DataFrame:
        return these.select("*", F.col("no").alias("c_no"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("tag"), none.alias("bounds")).select(names)

    head = quer.select("*", F.lit(0).cast("long").alias("c_no"), salt.alias("salt"), F.lit(1).alias("tag"), none.alias("bounds")).select(names)
    first = cut(_met(candidates(cand.filter("no = 0")).unionByName(head), dim, k))
    scores = F.sort_array(F.collect_list("score"), asc=False)  # k scores of a query at most
    kth = first.groupBy("q_no", "place").agg(scores.alias("s")).select("q_no", "place", F.when(F.size("s") >= k, F.element_at("s", k)).alias("bound"))
    lists = kth.groupBy("q_no").agg(F.collect_list(F.struct("place", "bound")).alias("at"))  # QUERIES entries at most
    step = -(-count // LENGTHS) or 1
    longest = [r["l"] for r in cand.groupBy(F.expr(f"no div {step}").alias("g")).agg(F.max("longest").alias("l")).orderBy("g").collect()]  # LENGTHS at most

    def bounded(part: pa.RecordBatch) -> dict:
        out, last = [], []
        for n, at, ints, ids in zip(*(part.column(c).to_pylist() for c in ("n", "at", "ints", "ids"))):
            b = np.full(n, -np.inf, dtype="<f8")
            for x in at or []:
                if x["bound"] is not None:
                    b[x["place"]] = x["bound"]
            length = np.sqrt((_ints({"ints": ints, "ids": ids}, dim).astype(float) ** 2).sum(axis=1))
            out.append(b.tobytes())
            reach = float(np.min(np.where(length > 0, b / np.where(length > 0, length, 1), np.where(b > 0, np.inf, -np.inf)), initial=np.inf))
            groups = sum(l * (1 + 1e-9) + 1e-6 >= reach for l in longest)  # lengths fall from block to block
            last.append(min(count, groups * step) - 1)
        return {"no": part.column("no"), "bounds": out, "last": last}

    known = cut(map_rows(quer.join(lists.withColumnRenamed("q_no", "_n"), F.col("no") == F.col("_n"), "left").select("no", "n", "at", "ints", "ids"), bounded, "no long, bounds binary, last long"))
    most = known.agg(F.max("last")).first()[0] or 0
    found = first
    if most > 0:
        every = quer.join(known.filter("last > 0").hint("merge"), "no").select("*", salt.alias("salt"), F.lit(1).alias("tag"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("c_no")).select(names)
        found = first.unionByName(_met(candidates(cand.filter(f"no between 1 and {most}")).unionByName(every), dim, k))
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.select("query_id", "vec_id", "score", "q_row").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB, every query row against every other row.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
