"""Vector code compression: product codes from codebooks of integers, trained by Lloyd rounds over kd-trees.

Each component x becomes floor(SCALE x); a vector is cut into PARTS equal consecutive parts, each with a codebook of
its own. A codebook begins as that part of the vectors with the smallest ids. In each round the codebooks, a kd-tree
each, are broadcast (their size is entries times components, whatever the number of vectors); tasks find the nearest
entry of each part and add up the members of each entry in integers, and Spark sums what the tasks give. The driver
gets one row for each entry and component, and takes floors of means.

The search goes down a tree for many parts at once: the child whose box is nearer comes first, and a node is left out
only if its box is farther than the best entry so far. A node at the very same distance is visited, so of entries at
equal distance the one with the lower index is found, as if all had been compared. All distances are whole numbers:
floats while they are exact, then 64-bit integers, then Python's.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as if
filled up with zeros, and all are filled up to a multiple of PARTS (an empty one is a zero one); rows with a null
vec_id are coded but never begin a codebook; of rows that repeat a vec_id each is coded, and those that begin a
codebook come in the order of their components; with fewer vectors than ENTRIES a codebook has that many entries;
integers beyond 2**62 count as 2**62, and errors beyond a long as the largest long; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, cut, map_rows, split_join
from quern.llm.topk import _vectors

SCALE, PARTS, ENTRIES, ROUNDS, LEAF = 1024, 4, 256, 4, 32
_MOST, _LONG = 2.0**62, (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (the components as integers, little-endian longs) and dim of the vectors that take part."""

    def run(part: pa.RecordBatch) -> dict:
        values, at, fine = _vectors(part.column("embedding"))
        keep = np.flatnonzero(fine)
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.clip(np.floor(SCALE * values), -_MOST, _MOST)
            v = np.where(np.isnan(v), 0, v).astype("<i8")
        x = [v[a:b].tobytes() for a, b in zip(at[keep].tolist(), at[keep + 1].tolist())]
        return {"vec_id": part.column("vec_id").take(pa.array(keep)), "label": part.column("label").take(pa.array(keep)), "x": x, "dim": pa.array(at[keep + 1] - at[keep], pa.int32())}

    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return map_rows(rows, run, f"vec_id long, label {label}, x binary, dim int")


def matrix(column: list[bytes], width: int) -> np.ndarray:
    """The parts of the vectors: rows x PARTS x width, filled up with zeros."""
    out = np.zeros((len(column), PARTS * width), dtype=np.int64)
    for k, b in enumerate(column):
        out[k, : len(b) // 8] = np.frombuffer(b, dtype="<i8")
    return out.reshape(len(column), PARTS, width)


@dataclass
class Node:
    """A node of a kd-tree: the box of its entries, and two nodes, or the entries (ascending) of a leaf."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    sides: tuple["Node", "Node"] | None = None


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: entries are halved along the component in which they spread most."""
    entries = np.arange(len(book)) if entries is None else entries
    low, high = book[entries].min(axis=0), book[entries].max(axis=0)
    node = Node(low, high, entries)
    spread = [int(h) - int(l) for l, h in zip(low, high)]
    if len(entries) > LEAF and max(spread) > 0:
        order = entries[np.argsort(book[entries, spread.index(max(spread))], kind="stable")]
        half = len(order) // 2
        node.sides = (tree(book, np.sort(order[:half])), tree(book, np.sort(order[half:])))
    return node


def _exact(parts: np.ndarray, book: np.ndarray) -> type:
    """A type in which squared distances of the two are exact."""
    most = max([abs(int(v)) for a in (parts, book) for v in (a.min(initial=0), a.max(initial=0))])
    bound = 4 * most * most * max(1, book.shape[1])
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def nearest(parts: np.ndarray, book: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of parts, the lower index of equal ones, and its squared distance."""
    kind = _exact(parts, book)
    q, c = parts.astype(kind), book.astype(kind)
    best = np.full(len(q), np.inf if kind is np.float64 else _LONG if kind is np.int64 else 1 << 200, dtype=kind)
    index = np.full(len(q), len(book), dtype=np.int64)
    squares = ((q**2).sum(axis=1), (c**2).sum(axis=1))
    stack = [(root, np.arange(len(q)), np.zeros(len(q), dtype=kind))]
    while stack:
        node, rows, bound = stack.pop()
        rows = rows[bound <= best[rows]]  # a node at the distance of the best one may hold a lower index
        if not len(rows):
            continue
        if node.sides is None:
            if kind is np.float64:  # by products, whose terms are whole numbers below 2**53
                away = squares[0][rows][:, None] - 2 * (q[rows] @ c[node.entries].T) + squares[1][node.entries]
            else:
                away = ((q[rows][:, None, :] - c[node.entries][None, :, :]) ** 2).sum(axis=2)
            at = away.argmin(axis=1)  # the first of equal ones
            d, e = away[np.arange(len(rows)), at], node.entries[at]
            better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], e[better]
            continue
        x = q[rows]
        away = [(np.maximum(np.maximum(n.low.astype(kind) - x, x - n.high.astype(kind)), 0) ** 2).sum(axis=1) for n in node.sides]
        left = away[0] <= away[1]
        for first, those in ((0, left), (1, ~left)):
            for side in (1 - first, first):  # what is pushed last is visited first
                stack.append((node.sides[side], rows[those], away[side][those]))
    return index, best


def _summed(vecs: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, pos, total and n: sums of the members' components of each entry that has members."""
    width = books.shape[2]
    shared = vecs.sparkSession.sparkContext.broadcast([(b, tree(b)) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, held = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64), 0

        def out() -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            flat = pa.array(sums[part, entry].reshape(-1), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), flat)
            return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": counts[part, entry], "sums": lists})

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                parts = matrix(batch.column("x").slice(at, 1024).to_pylist(), width)
                step = 1 if (most := max(abs(int(parts.min())), abs(int(parts.max())))) * len(parts) >= 2**62 else len(parts)
                found = [nearest(parts[:, p], *shared.value[p])[0] for p in range(PARTS)]
                for k in range(0, len(parts), step):
                    if held + most * step >= 2**62 and held:  # sums stay within a long
                        yield out()
                        sums[:], counts[:], held = 0, 0, 0
                    held += most * step
                    for p in range(PARTS):
                        np.add.at(sums[p], found[p][k : k + step], parts[k : k + step, p])
                        np.add.at(counts[p], found[p][k : k + step], 1)
        if counts.any():
            yield out()

    rows = arrow(vecs.select("x"), run, "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode("sums").alias("pos", "v"))
    return rows.groupBy("part", "entry", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def trained(vecs: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (PARTS x entries x components) of the rows of integers()."""
    width = max(1, -(-(vecs.agg(F.max("dim")).first()[0] or 0) // PARTS))
    seeds = vecs.filter("vec_id is not null").orderBy("vec_id", "x").limit(entries).select("x").collect()
    books = np.ascontiguousarray(matrix([r["x"] for r in seeds], width).transpose(1, 0, 2))
    for _ in range(rounds if len(seeds) else 0):
        books = books.copy()
        for r in _summed(vecs, books).toLocalIterator():  # a row for each entry and component at most
            books[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all entries' components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(vecs: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (an index for each part, as bytes or 16-bit integers), and error of the rows of integers()."""
    shared = vecs.sparkSession.sparkContext.broadcast([(b, tree(b)) for b in books])
    width, kind = books.shape[2], np.uint8 if books.shape[1] <= 256 else np.dtype("<u2")

    def run(part: pa.RecordBatch) -> dict:
        parts = matrix(part.column("x").to_pylist(), width)
        found = [nearest(parts[:, p], *shared.value[p]) for p in range(PARTS)]
        codes = np.stack([f[0] for f in found], axis=1).astype(kind)
        error = [min(_LONG, sum(int(f[1][k]) for f in found)) for k in range(len(parts))]
        return {"vec_id": part.column("vec_id"), "label": part.column("label"), "codes": [c.tobytes() for c in codes], "error": pa.array(error, pa.int64())}

    return map_rows(vecs.select("vec_id", "label", "x"), run, f"vec_id long, label {vecs.schema['label'].dataType.simpleString()}, codes binary, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with vector: the components that the codes stand for, divided by SCALE again (filled up to a multiple of PARTS)."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    kind = np.uint8 if books.shape[1] <= 256 else np.dtype("<u2")

    def run(part: pa.RecordBatch) -> dict:
        at = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=kind).reshape(-1, PARTS)
        whole = (shared.value[np.arange(PARTS), at] / SCALE).reshape(len(at), -1)
        return {"vec_id": part.column("vec_id"), "codes": part.column("codes"), "vector": list(whole)}

    return map_rows(codes.select("vec_id", "codes"), run, "vec_id long, codes binary, vector array<double>")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error (errors summed over equal labels) and codebooks_sha256."""
    vecs = cut(integers(vectors))
    books = trained(vecs)
    if not books.shape[1]:  # no vector, or none with an id
        return vecs.filter("vec_id is not null").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = cut(coded(vecs, books).withColumn("_of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    sums = codes.groupBy("_of").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("label_error", F.least("total", F.lit(_LONG).cast("decimal(38,0)")).cast("long"))
    both = split_join(codes, sums.select("_of", "label_error"), "_of", [F.col("vec_id"), F.col("codes")], counts=sums)
    return both.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: every part against every entry, in each round."""
    nearest_of = "SELECT row, part, min({{'d': d, 'e': entry}}) AS best FROM (SELECT row, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM p JOIN {book} USING (part, pos) GROUP BY ALL) GROUP BY ALL"
    steps, book = [], "b0"
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest_of.format(book=book)})")
        steps.append(f"m{k} AS MATERIALIZED (SELECT part, best.e AS entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN p USING (row, part) GROUP BY ALL)")
        steps.append(f"b{k} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN s IS NULL THEN c ELSE ((s - ((s % n + n) % n)) // n)::BIGINT END AS c FROM {book} LEFT JOIN m{k} USING (part, entry, pos))")
        book = f"b{k}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, ((i - 1) // (len(x) // {parts}))::INTEGER AS part, ((i - 1) % (len(x) // {parts}))::INTEGER AS pos, x[i] AS x FROM (SELECT row, x, unnest(range(1, len(x) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, (row - 1)::INTEGER AS entry, pos, x AS c FROM p WHERE row <= {entries}),
{", ".join(steps)},
f AS MATERIALIZED ({nearest_of.format(book=book)}),
e AS (SELECT row, sum(best.d)::BIGINT AS error, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code FROM f GROUP BY row),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM {book})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (row), h
"""
