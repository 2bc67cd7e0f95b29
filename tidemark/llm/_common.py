"""Shared pieces of the corpus operators: words, ASCII case, written cut points."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    For a text of ASCII only, ``lower`` does just that and is the faster call.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and all tasks run in the driver's own process
    (tests, a single machine) is a temporary folder used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    The written table cuts the lineage, so a lost executor costs a re-read and
    not a recomputation; it also fixes values that depend on how rows were dealt.
    Shuffle files of the write go as soon as it is done, as nothing reads them again.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.pinned_at = path
    return out


def unpin(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``pin``; only for tables that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.pinned_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
