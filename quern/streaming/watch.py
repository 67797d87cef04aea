"""File events as a stream: classification, and refreshes put together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY_MS, RESTRICTIONS = 500, ".quernignore"
#: Groups that the keys of a stream are dealt to.
BUCKETS = 2048


def action(kind: Column, path: Column, restrictions: str = RESTRICTIONS) -> Column:
    """refresh for files that come, go or change their name, and for the restriction file; invalidate for other changes; else ignore."""
    own = F.regexp_extract(path, r"([^/]*)$", 1) == restrictions
    return F.when(kind.isin("create", "remove", "rename"), "refresh").when((kind == "modify") & own, "refresh").when(kind == "modify", "invalidate").otherwise("ignore")


def invalidated(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """The cache entries (root, tool, args: canonical JSON) that changes (root, path) touch: args hold the path, absolute or below the root.

    Strings in args are pulled out once and meet the paths on equality.
    """
    held = F.regexp_extract_all("args", F.lit(r'"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))
    strings = cache.select("root", "tool", "args", F.explode(F.array_distinct(held)).alias("string"))
    both = F.array(F.col("path"), F.when(F.col("path").startswith(F.concat("root", F.lit("/"))), F.expr("substring(path, length(root) + 2)")))
    paths = changes.select("root", F.explode(F.array_compact(both)).alias("string")).distinct()
    return strings.join(paths, ["root", "string"], "left_semi").select("root", "tool", "args").distinct()


def _walk(times: list[int], armed: int | None, delay: int) -> tuple[list[tuple[int, int]], int | None, int]:
    """(first, number) of the refreshes that end within times, and the one still open: its first time and number."""
    out, count = [], 0
    for t in times:
        if armed is None or t >= armed + delay:
            if armed is not None:
                out.append((armed, count))
            armed, count = t, 1
        else:
            count += 1
    return out, armed, count


def debounced(events: DataFrame, key: str, time_ms: str, delay: int = DELAY_MS) -> DataFrame:
    """key, first_ms and events: the first event arms a timer, those within delay of it join it (batch).

    A fold over the sorted rows of a partition, which holds one open refresh however many events a key has.
    """
    dealt = events.select(F.col(key), F.col(time_ms).cast("long").alias(time_ms)).filter(F.col(time_ms).isNotNull()).repartition(key).sortWithinPartitions(key, time_ms)
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, armed, count, begun = None, None, 0, False
        for batch in batches:
            done: list[tuple] = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if begun and (name != at or t >= armed + delay):
                    done.append((at, armed, count))
                    armed, count = t, 1
                elif begun:
                    count += 1
                else:
                    armed, count = t, 1
                at, begun = name, True
            yield rows(done, batch.schema.field(0).type)
        if begun:
            yield rows([(at, armed, count)], batch.schema.field(0).type)

    def rows(done: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({key: pa.array([d[0] for d in done], type_), "first_ms": pa.array([d[1] for d in done], pa.int64()), "events": pa.array([d[2] for d in done], pa.int64())})

    return dealt.mapInArrow(run, f"{key} {kind}, first_ms long, events long")


def debounced_stream(events: DataFrame, key: str, time_ms: str, delay: int = DELAY_MS, late: str = "0 seconds") -> DataFrame:
    """The same on a stream, by the events' own time: the state is the open refresh, and a timer closes it when the watermark has passed its end.

    Events of a key that come in one batch may be in any order; those behind the watermark (late behind the latest event) are dropped.
    Keys (numbers, texts, dates) are dealt to BUCKETS groups, each of which is called once a batch and holds the open
    refreshes of its keys: a call costs more than the few events that a key has in a batch.
    """
    name = F.col(key).cast("string")
    own = events.select(name.alias(key), F.col(time_ms).cast("long").alias(time_ms), F.timestamp_millis(F.col(time_ms)).alias("_at"), F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("_bucket"))
    own = own.filter(F.col(time_ms).isNotNull()).withWatermark("_at", late)

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (a, n) for k, a, n in zip(*state.get)} if state.exists else {}
        times: dict[str | None, list[int]] = {}
        if not state.hasTimedOut:
            for p in parts:
                for k, t in zip(p[key].tolist(), p[time_ms].tolist()):
                    times.setdefault(k, []).append(int(t))
        done: list[tuple[str | None, int, int]] = []
        for k, at in times.items():
            armed, count = held.get(k, (None, 0))
            ended, now, n = _walk(sorted(at), armed, delay)
            if ended and armed is not None:
                ended[0] = (ended[0][0], ended[0][1] + count)
            elif armed is not None:
                n += count
            done += [(k, *e) for e in ended]
            held[k] = (now, n)
        over = state.getCurrentWatermarkMs() - delay
        done += [(k, a, n) for k, (a, n) in held.items() if a <= over]
        held = {k: x for k, x in held.items() if x[0] > over}
        if held:
            state.update((list(held), [a for a, _ in held.values()], [n for _, n in held.values()]))
            state.setTimeoutTimestamp(min(a for a, _ in held.values()) + delay)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({key: pd.Series([d[0] for d in done], dtype=object), "first_ms": [d[1] for d in done], "events": [d[2] for d in done]})

    out = own.groupBy("_bucket").applyInPandasWithState(run, f"{key} string, first_ms long, events long", "keys array<string>, armed array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(key, F.col(key).cast(events.schema[key].dataType))
