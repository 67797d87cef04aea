"""Security settings, and the log of events that is chained by hashes."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The names of the settings in the environment; the file of settings comes before all others.
PREFIX = "QUERN_"
FIELDS = ("AUTH_TOKEN", "ALLOWED_TOOLS", "AUDIT_LOG_PATH", "CUSTOM_REDACTION_PATTERNS", "CUSTOM_STRIP_PLACEHOLDER")
#: The hash before the first entry of a log.
FIRST = "0" * 64


@dataclass(frozen=True)
class Settings:
    token_digest: str | None = None
    allowed_tools: tuple[str, ...] | None = None
    audit_log_path: str | None = None
    custom_redaction_patterns: tuple[str, ...] = ()
    custom_strip_placeholder: str | None = None

    def allows(self, tool: str, token: str | None = None) -> bool:
        """Whether a tool may be called with a token: it is on the list, if there is one, and the token fits, if one is asked for."""
        if self.token_digest is not None and _digest(token or "") != self.token_digest:
            return False
        return self.allowed_tools is None or tool in self.allowed_tools


def _digest(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def _parts(value: object) -> tuple[str, ...]:
    each = value.split(",") if isinstance(value, str) else value or ()
    return tuple(x for x in (str(v).strip() for v in each) if x)


def settings(text: str | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """The settings in JSON text, or where that is not there or broken, in the environment."""
    raw: dict = {}
    try:
        found = json.loads(text) if text is not None else None
        raw = found if isinstance(found, dict) else {}
    except ValueError:
        raw = {}
    if not raw:
        raw = {name.lower(): env.get(PREFIX + name) for name in FIELDS}
    tools, token = raw.get("allowed_tools"), raw.get("auth_token")
    return Settings(_digest(token) if token is not None else None, _parts(tools) if tools is not None else None, raw.get("audit_log_path"), _parts(raw.get("custom_redaction_patterns")), (raw.get("custom_strip_placeholder") or "").strip() or None)


LOG = "log string, seq long, timestamp long, event string, details string, prev_hash string, hash string"


def entry_hash(prev: str, timestamp: int, event: str, details: str) -> str:
    return hashlib.sha256(f"{prev}\n{timestamp}\n{event}\n{details}".encode()).hexdigest()


def chained(events: DataFrame) -> DataFrame:
    """events (log, seq, timestamp, event, details as JSON) with prev_hash and hash: each entry's hash covers the one before it.

    A chain is a fold by nature; it runs over the sorted rows of a partition and holds one hash, whatever a log's length.
    """
    rows = events.select("log", F.col("seq").cast("long"), F.col("timestamp").cast("long"), "event", "details").repartition("log").sortWithinPartitions("log", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prev = None, FIRST
        for batch in batches:
            before, after = [], []
            for log, stamp, event, details in zip(*(batch.column(c).to_pylist() for c in ("log", "timestamp", "event", "details"))):
                if log != at:
                    at, prev = log, FIRST
                before.append(prev)
                prev = entry_hash(prev, stamp, event, details)
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "prev_hash", "hash"])

    return rows.mapInArrow(run, LOG)


def broken(log: DataFrame) -> DataFrame:
    """log and seq of the entries whose hash, or whose link to the entry before, does not hold."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("log").orderBy("seq")), F.lit(FIRST))
    own = F.sha2(F.concat_ws("\n", "prev_hash", F.col("timestamp").cast("string"), "event", "details"), 256)
    return log.withColumn("before", before).filter((F.col("prev_hash") != F.col("before")) | (F.col("hash") != own)).select("log", "seq")


def append(log: DataFrame, path: str) -> None:
    """Adds entries to a log of JSON lines."""
    log.write.mode("append").json(path)
