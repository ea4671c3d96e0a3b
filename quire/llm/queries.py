"""The operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, htmltext, langid, licenses, lm, merkle, packing, simhash, tokens, trie, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where("vec_id % 100 = 0"), vectors)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.union(spark.createDataFrame(chat.HOSTILE, "conv_id long, turn long, role string, text string")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), host=F.col("source"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(_table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digests(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(_table(spark, sf_dir, "documents"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID of pages' main texts with all evidence: declared language, address suffix, host."""
    pages = _table(spark, sf_dir, "pages")
    marked = pages.select("page_id", "html", F.to_json(F.struct("url", F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"))).alias("url"))
    texts = htmltext.main_texts(marked, htmltext.fitted(pages))
    model = langid.fit(_table(spark, sf_dir, "documents"))
    host = urlfilter.host_of(F.get_json_object("url", "$.url"))
    return langid.identify(texts, "page_id", host, F.get_json_object("url", "$.declared"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_packing, op3_url_filter, op4_nearest_neighbours, op5_decontamination, op6_chat_format, op7_language_id, op8_main_text, op9_license_scan, op10_lm_score, op11_prefix_trie, op12_merkle_manifest, op13_token_counts, page_language)
}

ORACLE_SQL = {"op3_url_filter": urlfilter.ORACLE_SQL, "op6_chat_format": chat.ORACLE_SQL, "op11_prefix_trie": trie.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
