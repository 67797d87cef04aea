"""The queries of the corpus operators, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import collocations, htmltext, langid, linededup, media, mixing, neardup, pieces, pii, secrets, tokenfile, topk, vectorcodes
from quern.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.fitted(docs))
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.stored_tokens(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoded(docs, F.col("doc_id"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_langid": op1_langid, "op2_htmltext": op2_htmltext, "op3_pii": op3_pii, "op4_mixing": op4_mixing, "op5_topk": op5_topk, "op6_media": op6_media, "op7_tokens": op7_tokens, "op8_sentencepiece": op8_sentencepiece, "op9_secrets": op9_secrets, "op10_neardup": op10_neardup, "op11_vectorcodes": op11_vectorcodes, "op12_linededup": op12_linededup, "op13_collocations": op13_collocations}
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.oracle(), "op5_topk": topk.ORACLE, "op11_vectorcodes": vectorcodes.oracle(), "op12_linededup": linededup.ORACLE, "op13_collocations": collocations.oracle()}
