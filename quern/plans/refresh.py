"""Analyses that follow a tree: only files whose content changed are worked on again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.store import kept


def manifest(files: DataFrame) -> DataFrame:
    """rel_path and digest of files (rel_path, content): what a later listing is compared with."""
    return files.select("rel_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def changes(files: DataFrame, before: DataFrame) -> DataFrame:
    """rel_path and change (added, changed, removed or same) of every file that is, or was, in the tree."""
    now = manifest(files).withColumnRenamed("digest", "_now")
    both = now.join(before.withColumnRenamed("digest", "_before"), "rel_path", "full")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("_before"), "same").otherwise("changed")
    return both.select("rel_path", change.alias("change"))


def refreshed(files: DataFrame, before: DataFrame, results: DataFrame, work: Callable[[DataFrame], DataFrame], path: str = "rel_path") -> tuple[DataFrame, DataFrame]:
    """results brought up to date with files, and the paths that were worked on.

    before is the manifest of the files that results came of, and work gives the results of files, whose path is in the
    column of that name. It must look at each file by itself. Files that are as they were keep their results; those of
    changed and removed ones go. A manifest has a row for each path.
    """
    change = kept(changes(files, before))
    again = change.filter(F.col("change").isin("added", "changed")).select("rel_path")
    gone = change.filter("change != 'same'").select(F.col("rel_path").alias(path))
    fresh = work(files.join(again, "rel_path", "left_semi"))
    return results.join(gone, path, "left_anti").unionByName(fresh.select(*results.columns)), again
