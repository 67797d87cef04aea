"""Intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(files: DataFrame, key: str = "rel_path") -> DataFrame:
    """files (rel_path, ..) dealt to tasks by path, or other rows by their key, before their texts are parsed or searched.

    The rows that texts are built from, or a listing, may lie in one small split, and parsing takes long for its bytes.
    """
    return files.repartition(tasks(files.sparkSession), key)


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that take long for their bytes: some for each core. Without a number they would be put together by their bytes."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))


def kept(df: DataFrame) -> DataFrame:
    """df worked out once, for several that read it: a checkpoint in the folder of spark.checkpoint.dir, which cuts its lineage.

    Where no such folder is set, its rows are kept by the executors instead, and worked out again where they are lost.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None:
            return df.persist()
        sc.setCheckpointDir(at)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df worked out once, as a table in the folder of spark.checkpoint.dir, for several that each read a few of its columns."""
    at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if at is None:
        return kept(df)
    at = f"{at.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
