"""Running sums and lags over keys of any size, in two phases.

Rows are dealt by ranges of key and order, so a key of a third of all rows lies in many tasks. First each range works
on its own rows. What a range must know of the ones before it is, for a key that goes on from them, a sum or the last
few values: a row for each range and such key, of which there are at most two for each range. These rows are scanned,
and carried into the ranges by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.store import kept


def ranged(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows in ranges of by and order, with _range: the number of the range."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    return kept(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))


def _edges(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The keys that lie in more than one range."""
    return rows.select(*by, "_range").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(c).alias(f"_w_{c}") for c in by])


def _alike(by: tuple[str, ...], prefix: str, first: Column | None = None) -> Column:
    """Whether the keys of two sides are the same, null or not."""
    out = first
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        out = same if out is None else out & same
    return out


def running(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their key up to them, in order (which must tell rows of a key apart)."""
    dealt = ranged(rows, by, order)
    own = dealt.withColumn(name, F.sum(value).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = dealt.groupBy("_range", *by).agg(F.sum(value).alias("_s"))
    if by:
        sums = sums.join(_edges(dealt, by), _alike(by, "_w_"), "left_semi")
    before = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_carry", F.sum("_s").over(before)).filter("_carry is not null").select(F.col("_range").alias("_to"), *[F.col(c).alias(f"_b_{c}") for c in by], "_carry")
    out = own.join(F.broadcast(carry), _alike(by, "_b_", F.col("_range") == F.col("_to")), "left")  # two rows for each range at most
    return out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).select(*rows.columns, name)


def lagged(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, names: tuple[str, ...]) -> DataFrame:
    """rows with the values of the rows before them of their key: the first of names is one row before, the next two, and so on."""
    n = len(names)
    dealt = ranged(rows, by, order)
    w = Window.partitionBy("_range", *by).orderBy(*order)
    own = dealt.withColumn("_i", F.row_number().over(w)).withColumns({x: F.lag(F.struct(value), k + 1).over(w) for k, x in enumerate(names)})
    last = dealt.withColumn("_j", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_j") <= n)
    tails = last.groupBy("_range", *by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", F.col(value).alias("v")))), lambda x: F.struct(x["v"].alias(value))).alias("_t"))  # the last ones first
    tails = tails.join(_edges(dealt, by), _alike(by, "_w_"), "left_semi")
    before = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(1, n)  # each of the n ranges before has a row at least
    carry = tails.withColumn("_carry", F.flatten(F.collect_list("_t").over(before))).filter("size(_carry) > 0").select(F.col("_range").alias("_to"), *[F.col(c).alias(f"_b_{c}") for c in by], "_carry")
    out = own.join(F.broadcast(carry), _alike(by, "_b_", F.col("_range") == F.col("_to")), "left")
    late = {x: F.when(F.col("_i") > k + 1, F.col(x)).otherwise(F.get("_carry", F.lit(k + 1) - F.col("_i"))) for k, x in enumerate(names)}
    return out.withColumns(late).withColumns({x: F.col(x)[value] for x in names}).select(*rows.columns, *names)
