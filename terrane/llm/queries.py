"""The queries of this subpackage and, where SQL can express them, the SQL for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import sql
from terrane.llm.common import table
from terrane.llm.decontaminate import contamination
from terrane.llm.jaccard_join import near_duplicates
from terrane.llm.quality_classifier import grade_documents, grade_of
from terrane.llm.sentencepiece_sampling import load_vocabulary
from terrane.llm.sentencepiece_sampling import round_trip as piece_round_trip
from terrane.llm.substring_dedup import dedup_substrings
from terrane.llm.suffix_dedup import dedup_bytes
from terrane.llm.topk_search import exact_topk
from terrane.llm.toxicity import toxicity
from terrane.llm.url_reputation import Rule, judge_urls
from terrane.llm.warc import round_trip

#: The vocabulary of op3, read on the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & F.forall("embedding", real))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))
    return exact_topk(vectors, F.col("vec_id") % 100 == 0, k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"), load_vocabulary(PIECES))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_bytes(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return grade_documents(table(spark, sf_dir, "documents"), ratings)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (op1_topk_search, op2_toxicity, op3_sentencepiece, op4_warc, op5_url_filter, op6_substring_dedup, op7_suffix_dedup, op8_decontamination, op9_quality_classifier, op10_jaccard_join)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {"op1_topk_search": sql.TOPK, "op4_warc": sql.ARCHIVES, "op5_url_filter": sql.URLS, "op6_substring_dedup": sql.SUBSTRINGS, "op7_suffix_dedup": sql.BYTES, "op8_decontamination": sql.CONTAMINATION, "op10_jaccard_join": sql.NEAR_DUPLICATES}
