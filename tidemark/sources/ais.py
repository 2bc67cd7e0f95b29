"""Position tables: monthly CSV files, one CSV, and the driver's events seen as positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import RAW_AIS

# The names of folders and of months in file names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
TYPES = ("cargo", "tanker")


def monthly_paths(base: str, years=(2018, 2019, 2020), types=TYPES) -> list[str]:
    """Where the monthly files are; September's folder is ``Sept``."""
    folder = lambda m: "Sept" if m == "Sep" else m
    return [
        f"{base}/{year}/{kind}/{folder(m)}/MPF_{m}_{year}_Grid_{kind.capitalize()}.csv" for year in years for kind in types for m in MONTHS
    ]


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that are there, on any store that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


#: Year, type and month as monthly files have them in their paths.
MONTHLY = r"/(\d{4})/(\w+)/\w+/MPF_(\w+?)_"


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw positions with columns bound by place, and ``src_ord``, by which rows are ordered.

    Monthly files come by year, type and number of the month, others by path; then blocks and rows in order.
    """
    raw = spark.read.schema(RAW_AIS).option("header", True).option("enforceSchema", True).csv(paths)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, MONTHLY, i)
    order = F.struct(
        part(1).alias("year"),
        part(2).alias("kind"),
        F.array_position(F.array(*map(F.lit, MONTHS)), part(3)).alias("month"),
        path.alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return raw.withColumn("src_ord", order)


def monthly_files(spark: SparkSession, base: str, years=(2018, 2019, 2020), types=TYPES) -> list[str]:
    """The monthly files that are there; ValueError if there are none."""
    paths = existing(spark, monthly_paths(base, years, types))
    if not paths:
        raise ValueError(f"no monthly file under {base}")
    return paths


def read_monthly(spark: SparkSession, base: str, years=(2018, 2019, 2020), types=TYPES) -> DataFrame:
    """All monthly files that are there, with TYPE and MONTH from their paths."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.col("src_ord.month").cast("int"))
    return read_csv(spark, monthly_files(spark, base, years, types)).withColumns({"TYPE": F.col("src_ord.kind"), "MONTH": month})


EVENTS_AS_AIS = """
SELECT event_id AS src_ord, user_id AS CRAFT_ID, cast(user_id AS string) AS TRACK_ID, at AS TIMESTAMP,
  112e0 + timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', at) * 1e-2 + (event_id % 100) / 1e4 AS LON,
  -30e0 + ((user_id * 13) % 100) / 1e2 + (event_id % 37) / 1e4 AS LAT,
  cast((event_id * 7919) % 360 AS double) AS COURSE, value / 20e0 AS SPEED
FROM {events}
"""


def events_as_ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as hour-rounded positions: a user is a craft and a track."""
    from tidemark.functions.scalars import nearest_hour

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", nearest_hour(F.col("ts")).alias("at"))
    return spark.sql(EVENTS_AS_AIS, events=events)
