"""Text inputs: points of interest, schema lists and schema names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.shapes import point_from_text


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon of lines `id,POINT (lon lat)`, up to the first line that is blank, invalid or has id 0, in each file.

    Lines keep their place in the file, so the cut needs one minimum a file and no order over all lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    number = F.regexp_extract("value", r"^\s*(\d+)\s*,", 1).try_cast("long")
    found = lines.select("_file", "_at", number.alias("id"), point_from_text(F.col("value")).alias("p"))
    bad = F.col("id").isNull() | (F.col("id") == 0) | F.col("p").isNull() | F.col("p.lat").isNull() | F.col("p.lon").isNull()
    ends = found.where(bad).groupBy("_file").agg(F.min("_at").alias("_end"))
    kept = found.join(ends, "_file", "left").where(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    return kept.select("id", "p.lat", "p.lon")


def read_schema_list(spark: SparkSession, path: str) -> DataFrame:
    """TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, SCHEMA_NAME; tables whose names differ only by case or schema are an error."""
    df = spark.read.csv(path, header=True, schema="TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, SCHEMA_NAME string")
    twice = df.select("TABLE_NAME", "SCHEMA_NAME").distinct().groupBy(F.lower("TABLE_NAME").alias("t")).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"tables are not unique: {[r.t for r in twice]}")
    return df


def read_schema_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="schema_id int, schema_name string")
