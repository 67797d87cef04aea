"""Helpers shared by the corpus operators: shared folders, Arrow mapping, hashing of words."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one slice that a mapping function sees at once, and about how many bytes of text; bytes of an Arrow batch.
SLICE_ROWS, SLICE_BYTES, BATCH_BYTES = 2048, 4 << 20, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name under sf_dir; read by Spark alone, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/quern-shared-{os.getpid()}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through the shared folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of results that nothing refers to any more, as after a cut lineage.

    Without it they stay until the driver happens to collect its garbage, so many small steps would pile them up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, written and read again."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(at)
    return spark.read.parquet(at)


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of BATCH_BYTES at most (and one row at least), so that neither side holds more of long texts.

    The bound is a setting of the session; it is lowered where it is higher.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?[0-9]+)[bB]?", conf.get(name))
    if now and not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


#: Rows of one value from which a join deals them to several tasks; most values that are dealt so.
SPLIT, HOT = 512, 100_000


def split_join(many: DataFrame, one: DataFrame, on: str, by: list[Column], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with one (a row for each value of on) on equality; a value of many rows is dealt to several tasks.

    Values with more than SPLIT rows, and how many tasks each gets, make a small table that is broadcast: there are no
    more than HOT of them, else the limit rises. Their rows get a salt from by, and the row of one a copy for each
    salt. counts (on, n) has the rows of each value, if that is known.
    """
    counts = many.groupBy(on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(on, "n")
    most, hot = SPLIT, cut(counts.filter((F.col("n") > SPLIT) & F.col(on).isNotNull()))
    while (found := hot.count()) > HOT:
        most *= 2
        hot = hot.filter(F.col("n") > most)
    if not found:
        return many.join(one, on, how)
    hot = F.broadcast(hot.select(on, F.expr(f"(n - 1) div {most} + 1").alias("_salts")))
    zero = F.lit(0).cast("long")
    dealt = many.join(hot, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), zero).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts")))).drop("_salts")
    copies = one.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(zero, F.coalesce("_salts", F.lit(1)).cast("long") - 1))).drop("_salts")
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows, and of bounded bytes of the column text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if text is None:
            for at in range(0, n, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.float64))
        ends, at = np.cumsum(sizes), 0
        while at < n:
            before = ends[at - 1] if at else 0.0
            to = min(n, at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def returned() -> None:
    """Gives memory that Python and Arrow hold but do not use back to the machine: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, text: str | None = None, done: Callable[[], None] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices; fn gives a dict of columns, in the order of schema; done is called when a task's rows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, most):
            out = fn(part)
            if out:
                yield pa.RecordBatch.from_pydict(out)
        if done is not None:
            done()
            returned()

    return arrow(df, run, schema)


def map_whole(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> DataFrame:
    """mapInArrow over bounded slices of whole rows: fn gives a batch with the columns of df, by place; names may repeat."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield fn(part)
        returned()

    return arrow(df, run, schema)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection whose output bits all depend on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _S33)
        x = x * _M1
        x = x ^ (x >> _S33)
        x = x * _M2
        return x ^ (x >> _S33)


_R = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = []
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes whose prefix sums are taken at once.
_SPAN = 1 << 20


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        inverse = pow(_R, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for base in (_R, inverse):
                p = np.full(_SPAN + 1, base, dtype=np.uint64)
                p[0] = 1
                _POW.append(np.multiply.accumulate(p))
    return _POW[0], _POW[1]


def word_hashes(data: bytes | np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, in order; A-Z count as a-z if lower.

    A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64 and then finalised, so the
    cost is a few vector operations per byte. Equal words have equal hashes on every machine.
    """
    buf = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
    if not len(buf):
        return np.zeros(0, dtype=np.uint64)
    solid = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False).astype(np.int8))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    codes = _BYTE_LOWER if lower else _BYTE
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = starts[first]
            last = int(np.searchsorted(ends, base + _SPAN, side="right"))
            if last <= first:  # one word longer than the span
                out[first] = _long_word(codes[buf[base : ends[first]]])
                first += 1
                continue
            n = ends[last - 1] - base
            sums = np.empty(n + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(codes[buf[base : base + n]] * up[:n], out=sums[1:])
            a, b = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (sums[b] - sums[a]) * down[a]
            first = last
    return mix64(out)


def _long_word(codes: np.ndarray) -> np.uint64:
    up, _ = _powers()
    total, scale = 0, 1
    for at in range(0, len(codes), _SPAN):
        part = codes[at : at + _SPAN]
        total += int(np.sum(part * up[: len(part)], dtype=np.uint64)) * scale
        scale = scale * pow(_R, len(part), 1 << 64) & (1 << 64) - 1
    return np.uint64(total & (1 << 64) - 1)
