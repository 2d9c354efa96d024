"""From documents to training tokens in five stages, each on all that the one before kept.

quality: poor documents go. near_duplicates: one document of each group of 80 % by sets of five words stays.
repeated_substrings: words in runs of twenty that also start earlier go. decontamination: documents with windows of two
or more benchmark items, or with most of one, go. pieces: what is left becomes sampled pieces of a public vocabulary.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import shared_dir, table
from terrane.llm.decontaminate import without_contaminated
from terrane.llm.jaccard_join import one_of_each
from terrane.llm.quality_classifier import only_selected
from terrane.llm.sentencepiece_sampling import encode_sampled, load_vocabulary
from terrane.llm.substring_dedup import without_repeats

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return only_selected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_sampled(docs, load_vocabulary(PIECES), ("lang", "source"))
    return encoded.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings), ("decontamination", decontamination), ("pieces", pieces)]
#: SQL can't express the fitted classifier and the sampled pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
