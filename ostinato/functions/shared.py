"""Intermediate tables in the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` now, so that each later use reads the same rows in the same partitions.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ostinato-"))
    return df.checkpoint(eager=True)
