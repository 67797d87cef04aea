"""Near duplicates by SetSketch registers: band, estimate jointly by likelihood, then verify on full shingle sets.

A document's set holds its distinct word shingles. Register i of its sketch is floor(-log_b(x_i)) for the least x_i
of independent exponential values of the shingles: exponentially spaced truncated minima, one byte each, which merge
by taking the larger byte. Two registers agree with a probability close to the Jaccard similarity.

1. Documents with equal sets (by a 128-bit fingerprint) form a class; its smallest doc_id stands for it from here on.
2. Groups of ROWS registers are band values. Sets at the threshold that share no band among BANDS are about 3 in a
   million. Members of a bucket are paired with its smallest member only, never with each other.
3. A pair goes on if the likelihood of its registers (how many are larger, smaller, equal), given both set sizes, has
   its maximum within MARGIN of the threshold; MARGIN is over 4 standard deviations.
4. The full sets of what is left are read again from the texts and compared exactly.
5. Links join classes to components (alternating large-star and small-star steps).
6. Buckets that now hold more than one component are looked at whole, in cells of about BLOCK x BLOCK rows, so a bucket
   of any size is covered exactly and no task gets all of it. In a first round a document tries its most likely
   partners in each other component; after components are formed again, a second round tries every likely pair that is
   still across components, on the full sets within the cell, and gives at most one link for a document and a
   component. So each pair that shares a band is either in one component or has been tested, and no step gives more
   rows than documents times bands.

Defined cases: null or empty text, or text of white space only, has an empty set, is linked with nothing and kept;
a text with fewer words than a shingle has its whole sequence as its one shingle; rows that repeat a doc_id count as
one document; a null doc_id is linked with nothing, has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, cut, map_rows, mix64, released, slices, split_join, word_hashes, written

BANDS, ROWS, BASE, MARGIN = 40, 6, 1.09, 0.12
#: Rows and shingles of a side of a cell; pairs of a document and a component that are tried first.
BLOCK, BLOCK_SIZE, FIRST = 512, 1_000_000, 2
M = BANDS * ROWS
_OFFSET = 30  # registers of x up to e**2.6 stay above 0
#: Documents whose ids may be broadcast to fetch their texts (8 bytes each); above it the join shuffles.
SMALL_IDS = 1_000_000

_I = np.arange(1, M + 1, dtype=np.uint64)
_XOR, _MUL = mix64(_I * np.uint64(0x632BE59BD9B4E019)), mix64(_I * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(data: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of width words in UTF-8 bytes, A-Z in lower case."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    s = np.full(n, min(width, len(w)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(w))):
            s = mix64(s * np.uint64(0x9FB21C651E98DF25) + w[k : k + n])
    return np.unique(s)


def registers(h: np.ndarray) -> bytes:
    """The sketch of a set of 64-bit hashes: M bytes."""
    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 256):
            np.minimum(least, ((h[at : at + 256, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    x = -np.log1p(-((least.astype(np.float64) + 0.5) / 2.0**64).clip(0, 1 - 1e-16))
    return np.clip(np.floor(-np.log(x) / np.log(BASE)) + _OFFSET, 0, 255).astype(np.uint8).tobytes()


def estimate(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarities with the largest likelihood, for M registers of which greater and less are so in a against b."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = M - greater - less
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * scale) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        more, fewer = p((u - v * j).clip(1e-12)), p((v - u * j).clip(1e-12))
        return greater * np.log(more) + less * np.log(fewer) + equal * np.log((1 - more - fewer).clip(1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = fit(a) > fit(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (128 bits of the set) and regs of every row with doc_id and text."""

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": part.column("doc_id"), "n_shingles": [], "fp1": [], "fp2": [], "regs": []}
        for text in part.column("text").cast(pa.binary()).to_pylist():
            h = shingles(text or b"", width)
            with np.errstate(over="ignore"):
                a, b = mix64(h).sum(dtype=np.uint64), mix64(h ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
            out["n_shingles"].append(len(h))
            out["fp1"].append(int(a.astype(np.int64)))
            out["fp2"].append(int(b.astype(np.int64)))
            out["regs"].append(registers(h) if len(h) else None)
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_shingles long, fp1 long, fp2 long, regs binary", text="text")


def _bands(classes: DataFrame) -> DataFrame:
    """key, rep: a row for each band of each class."""
    mul = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    def run(part: pa.RecordBatch) -> dict:
        r = _bytes(part.column("regs"), M).reshape(-1, BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64((r * mul).sum(axis=2, dtype=np.uint64) ^ salt)
        return {"key": key.ravel().astype(np.int64), "rep": np.repeat(part.column("rep").to_numpy(), BANDS)}

    return map_rows(classes.select("rep", "regs"), run, "key long, rep long")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs a, b whose registers make the threshold likely enough."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))

    def run(part: pa.RecordBatch) -> dict:
        a, b = _bytes(part.column("r_a"), M), _bytes(part.column("r_b"), M)
        n_a, n_b = part.column("n_a").to_numpy().astype(float), part.column("n_b").to_numpy().astype(float)
        keep = _passes((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b, threshold)
        return {"a": part.column("a").to_numpy()[keep], "b": part.column("b").to_numpy()[keep]}

    near = split_join(pairs, side("a"), "a", [F.col("b")]).filter("n_a > 0").join(side("b"), "b").filter(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))
    return map_rows(near.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a long, b long")


def _passes(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    return estimate(greater.astype(float), less.astype(float), n_a, n_b) >= threshold - MARGIN


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, set: the whole sorted shingle set of each of the ids, from the texts."""
    small = ids.count() <= SMALL_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("id"))

    def run(part: pa.RecordBatch) -> dict:
        return {"id": part.column("id"), "set": [shingles(t or b"", width).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]}

    return map_rows(texts.select("id", "text"), run, "id long, set binary", text="text")


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs a, b with 100 * intersection >= percent * union of their full sets."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = written(_sets(docs, ids, width), "shingle-sets")

    def run(part: pa.RecordBatch) -> dict:
        sets_a, sets_b = ([np.frombuffer(x, dtype=np.uint64) for x in part.column(c).to_pylist()] for c in ("set_a", "set_b"))
        keep = [_confirmed(x, y, percent) for x, y in zip(sets_a, sets_b)]
        keep = np.array(keep, dtype=bool)
        return {"a": part.column("a").to_numpy()[keep], "b": part.column("b").to_numpy()[keep]}

    both = split_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a", [F.col("b")]).join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return map_rows(both.select("a", "b", "set_a", "set_b"), run, "a long, b long", text="set_a").distinct()


def _no_stars(e: DataFrame) -> bool:
    """Whether a node of the edges u, v (u > v) has two smaller ones near it, or both a smaller and a larger one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return bool(ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in the edges a, b, itself if it is the smallest.

    Large-star links all larger neighbours of a node to the smallest node near it, small-star the smaller ones; both
    keep components, and together they end in stars after a number of steps that grows with the logarithm of the size.
    Steps stop as soon as all is stars. Shuffles are kept few: each takes a thread of the driver for a minute.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while _no_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")  # no more rows than e
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        del both, least, large, near, small
        released(e.sparkSession)
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (key) of rep, hub, label and main, which together hold every pair across components that shares a bucket.

    Of buckets of three or more with several components, the smallest one is the main one. Documents outside it meet
    all its members that share a bucket with others, in one group for each main component, whatever the number of
    buckets that they share; what is outside the main component of a bucket meets in a group of its own.
    """
    m = members.filter("cnt > 2").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    m = m.withColumn("label", F.coalesce("component", "rep")).select("key", "rep", "hub", "label")
    label = (F.min("label").alias("main"), F.max("label").alias("other"), F.count("rep").alias("n"))
    mixed = cut(m.groupBy("key").agg(*label).filter("main != other"))
    m = cut(split_join(m, mixed.select("key", "main"), "key", [F.col("rep")], counts=mixed))
    whole = m.select(F.xxhash64(F.lit(1), "main").alias("key"), "rep", F.lit(None).cast("long").alias("hub"), "label", "main").distinct()
    odd = m.filter("label != main").drop("main")
    again = cut(odd.groupBy("key").agg(*label).filter("main != other"))
    return whole.unionByName(split_join(odd, again.select("key", "main"), "key", [F.col("rep")], counts=again).select("key", "rep", "hub", "label", "main"))


def _cells(m: DataFrame, classes: DataFrame, sets: DataFrame | None) -> DataFrame:
    """The rows of m in cells (key, rb, cb) of bounded rows and set sizes.

    A cell tests some rows of a bucket against some of those outside its main component (col); together the cells of a
    bucket cover every pair across components.
    """
    m = cut(m.join(classes.select("rep", F.col("n").alias("size"), "regs"), "rep"))
    odd = F.col("label") != F.col("main")
    sums = cut(m.groupBy("key").agg(F.count("rep").alias("n"), F.sum("size").alias("s"), F.count(F.when(odd, 1)).alias("on"), F.sum(F.when(odd, F.col("size")).otherwise(0)).alias("os")))
    blocks = lambda n, s: F.greatest(F.expr(f"({n} - 1) div {BLOCK} + 1"), F.expr(f"{s} div {BLOCK_SIZE} + 1"))
    m = split_join(m, sums.select("key", blocks("n", "s").alias("rbs"), blocks("on", "os").alias("cbs")), "key", [F.col("rep")], counts=sums)
    if sets is not None:
        m = m.join(sets.select(F.col("id").alias("rep"), "set"), "rep")
    cols = [c for c in m.columns if c not in ("key", "rbs", "cbs")]
    zero = F.lit(0).cast("long")
    rows = m.select("key", F.pmod(F.xxhash64("rep"), F.col("rbs")).alias("rb"), F.explode(F.sequence(zero, F.col("cbs") - 1)).alias("cb"), F.lit(False).alias("col"), *cols)
    odds = m.filter("label != main").select("key", F.explode(F.sequence(zero, F.col("rbs") - 1)).alias("rb"), F.pmod(F.xxhash64("rep"), F.col("cbs")).alias("cb"), F.lit(True).alias("col"), *cols)
    return rows.unionByName(odds).repartition("key", "rb", "cb").sortWithinPartitions("key", "rb", "cb")


def _tested(cells: DataFrame, threshold: float, percent: int | None) -> DataFrame:
    """Pairs a, b across components; pairs with a bucket's hub were tested before.

    Without percent: of each col and other component, the FIRST pairs with the highest estimates, if likely. With
    percent: of each col and other component, a pair that the full sets confirm; all likely ones are tried until then.
    """

    def run(batches):
        def done(held: list[dict]) -> pa.RecordBatch | None:
            r, c = [x for x in held if not x["col"]], [x for x in held if x["col"]]
            if not r or not c:
                return None
            regs = np.frombuffer(b"".join(x["regs"] for x in r), dtype=np.uint8).reshape(-1, M)
            rep, label, size = (np.array([x[k] for x in r]) for k in ("rep", "label", "size"))
            odd = np.array([x["label"] != x["main"] for x in r])
            hub, a, b = held[0]["hub"], [], []
            for x in c:
                if hub is not None and x["rep"] == hub:
                    continue
                ok = (label != x["label"]) & (~odd | (rep < x["rep"])) & (np.minimum(size, x["size"]) >= (threshold - 1e-9) * np.maximum(size, x["size"]))
                if hub is not None:
                    ok &= rep != hub
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                mine = np.frombuffer(x["regs"], dtype=np.uint8)
                greater, less = (mine > regs[at]).sum(axis=1), (mine < regs[at]).sum(axis=1)
                j = estimate(greater.astype(float), less.astype(float), np.full(len(at), float(x["size"])), size[at].astype(float))
                likely = j >= threshold - MARGIN
                at, j = at[likely], j[likely]
                had: dict[int, int] = {}
                own = np.frombuffer(x["set"], dtype=np.uint64) if percent is not None else None
                for k in at[np.argsort(-j, kind="stable")].tolist():
                    if had.get(label[k], 0) >= (FIRST if own is None else 1):
                        continue
                    if own is None or _confirmed(own, np.frombuffer(r[k]["set"], dtype=np.uint64), percent):
                        had[label[k]] = had.get(label[k], 0) + 1
                        a.append(min(x["rep"], int(rep[k])))
                        b.append(max(x["rep"], int(rep[k])))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) if a else None

        held, last = [], None
        for batch in batches:
            for part in slices([batch], None):
                for row in part.to_pylist():
                    now = (row["key"], row["rb"], row["cb"])
                    if now != last and held:
                        if (out := done(held)) is not None:
                            yield out
                        held = []
                    last = now
                    held.append(row)
        if held and (out := done(held)) is not None:
            yield out

    return arrow(cells, run, "a long, b long").distinct()


def _confirmed(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets, of which one at least isn't empty."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _stars(labels: DataFrame) -> DataFrame:
    """Edges a, b that have the components of labels: what was joined before is not worked out again."""
    return labels.filter("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (which has doc_id and text)."""
    threshold = percent / 100
    signed = written(signatures(docs, width), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(filled.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")))
    one = classes.groupBy("rep").agg(F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("n").alias("k"))
    if classes.select("rep").distinct().count() == classes.count():
        one = classes
    bands = _bands(one)
    buckets = cut(bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("rep").alias("cnt")).filter("cnt > 1"))
    members = cut(split_join(bands, buckets, "key", [F.col("rep")], counts=buckets.withColumnRenamed("cnt", "n")))
    hubs = members.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_linked(cut(_likely(hubs, one, threshold)), docs, width, percent))
    released(docs.sparkSession)
    labels = components(links)
    rest = cut(_across(members, labels))
    if rest.limit(1).count():  # first the most likely pairs, which join most of what belongs together
        more = _linked(cut(_tested(_cells(rest, one, None), threshold, None)), docs, width, percent)
        labels = components(_stars(labels).unionByName(more))
        rest = cut(_across(members, labels))
        released(docs.sparkSession)
    if rest.limit(1).count():  # then every likely pair that is still across components
        sets = written(_sets(docs, cut(rest.select(F.col("rep").alias("id")).distinct()), width), "shingle-sets")
        more = cut(_tested(_cells(rest, one, sets), threshold, percent))
        if more.limit(1).count():
            labels = components(_stars(labels).unionByName(more))
    named = signed.join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2"], "left").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", linked.alias("component_id"), F.coalesce(linked == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps; of rows that repeat a kept doc_id, one. Rows with a null doc_id all stay."""
    kept = cut(near_duplicates(docs, width, percent).filter("kept and doc_id is not null").select("doc_id").distinct())
    named = docs.filter("doc_id is not null")
    out = named.join(kept, named["doc_id"] == kept["doc_id"], "left_semi")
    if named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter("doc_id is null"))
