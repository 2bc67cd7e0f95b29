"""Intermediate tables that a plan reads more than once, written to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only where that is unset and every task runs in the driver's process is a temporary folder used.
    """
    root = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/tidemark-kept-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: later plans start from the table, and so does a lost executor's work."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
