"""Tables between stages as CSV, typed both ways; rows that do not fit are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.sources.kept import keep

BOM = "﻿"
FAULT = "_malformed"


def write_csv(df: DataFrame, path: str, bom: bool = False, by: tuple[str, ...] = ()) -> None:
    """CSV with a header; with ``bom`` every file begins with a byte order mark. Nulls and empty texts are written alike, as nothing."""
    first = next(c for c in df.columns if c not in by)
    named = df.withColumnRenamed(first, BOM + first) if bom else df
    out = named.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    (out.partitionBy(*by) if by else out).csv(path)


def read_typed(spark: SparkSession, path: str | list[str], columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of CSV files with a header, whose columns are bound by place, after a byte order mark if there is one.

    A line is malformed if it has too few or too many values or one that is not of its column's type. Files are
    parsed once, whole, into a table, as a parser that skips columns does not see what is wrong in them.
    """
    read = spark.read.schema(f"{columns}, {FAULT} STRING").option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
    every = read.option("columnNameOfCorruptRecord", FAULT).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    every = keep(every.select("*", F.col("_metadata.file_path").alias("_file")))
    good, bad = every.filter(F.col(FAULT).isNull()), every.filter(F.col(FAULT).isNotNull())
    return good.drop(FAULT, "_file"), bad.select(F.col(FAULT).alias("line"), F.col("_file").alias("path"))


def write_indices(indices: DataFrame, folder: str) -> None:
    """A folder for each T and mode."""
    write_csv(indices, folder, by=("T", "mode"))


def read_indices(spark: SparkSession, folder: str, percentages=(10, 5, 3, 1)) -> tuple[DataFrame, DataFrame]:
    """The membership table, and malformed lines. Flags are text in the files and booleans here."""
    flags = [f"use_{p}pct" for p in percentages]
    columns = schema.INDICES.format(flags=", ".join(f"{f} STRING" for f in flags))
    rows, bad = read_typed(spark, folder, columns + ", T INT, mode STRING")
    typed = rows.withColumns({f: F.lower(F.trim(F.col(f))) == "true" for f in flags})
    return typed.select("ROUTE_ID", "T", "stratum", *flags, "K", "mode"), bad


def write_injected(injected: DataFrame, path: str, bom: bool = False) -> None:
    write_csv(injected.select(*[c.split()[0] for c in schema.INJECTED.split(", ")]), path, bom)


def read_injected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Injected points, and malformed lines: ANOMALY from text, the type in capitals and '' where there is none."""
    rows, bad = read_typed(spark, path, schema.INJECTED.replace("ANOMALY BOOLEAN", "ANOMALY STRING"))
    anomaly = F.coalesce(F.lower(F.trim(F.col("ANOMALY"))) == "true", F.lit(False))
    return rows.withColumns({"ANOMALY": anomaly, "ANOMALY_TYPE": F.coalesce(F.upper("ANOMALY_TYPE"), F.lit(""))}), bad
