"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset and all runs in one process (tests), a new folder.

    On a cluster a folder of this machine would be out of the others' reach, so there the setting is asked for.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terrane-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return "file:///" + found[5:].lstrip("/") if found.startswith("file:") else found


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so that a lost executor costs a read and no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
