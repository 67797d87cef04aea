"""The corpus pipeline: stages in order, each over all that the one before it kept.

Language identification drops what it rejects; of each group of near duplicates one document stays; personal data is
masked; sources are mixed to their target weights (a row for each copy that the mix takes); the texts are encoded.
Every stage but the last gives the columns of documents, and further columns stay as they are.

Defined cases, in every stage: an empty table gives no rows. A null, empty or letterless text is rejected by the first
stage; the second keeps such rows (they are linked with nothing), the third leaves them as they are, the fourth takes
no words of them and so drops them, the last gives them no ids. Rows that repeat a doc_id are judged one by one by the
first stage, are one document for the second, and documents of their own for the others; rows with a null doc_id all
pass the second. Texts of any length are read whole. Ties do not matter: no stage depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import langid, mixing, neardup, pieces, pii
from quern.llm.common import written


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is identified; the model learns from labelled rows that are not held out."""
    return langid.accepted(docs, langid.fitted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    return neardup.one_of_each(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked in their texts."""
    return pii.without_personal(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources to their target weights: a row for each copy of a document that the mix takes."""
    return mixing.mixed_texts(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, with merge dropout of its own, checked by decoding them again.

    The dropout is keyed by doc_id, text and, for rows with a doc_id, the number of the copy among those alike.
    """
    text, copy = _free(docs, "text_hash"), _free(docs, "copy")
    same = Window.partitionBy("doc_id", text).orderBy("doc_id")
    docs = docs.withColumn(text, F.xxhash64("text"))
    named = docs.filter("doc_id is not null").withColumn(copy, F.row_number().over(same))
    every = named.unionByName(docs.filter("doc_id is null").withColumn(copy, F.lit(1)))
    return pieces.encoded(every, F.struct("doc_id", text, copy)).drop(text, copy)


def _free(docs: DataFrame, name: str) -> str:
    """A name like that one which no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express trained models; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
