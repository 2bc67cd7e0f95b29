"""Where positions come from, and the hourly table that is made of them and kept.

The kept table knows by a manifest (path, length, time of change) which source files it was made from. When some
change, only they are read again, and only tracks that they hold, or held before, are built again:
cleaned rows are kept by source file, hourly rows by buckets of tracks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import tracks
from tidemark.sources.ais import TYPES, existing, monthly_paths, read_csv
from tidemark.sources.kept import keep

# Fixed value: a folder of monthly files is preferred under this name.
GRID_FOLDER = "West Grid"
SINGLE_FILES = ("positions.csv",)

#: A source file: (path, length in bytes, time of change).
Manifest = set[tuple[str, int, int]]


def grid_base(spark: SparkSession, base: str) -> str:
    """``base``, or the folder of grid files in it if there is one."""
    inner = f"{base}/{GRID_FOLDER}"
    return inner if existing(spark, [inner]) else base


def discover(spark: SparkSession, base: str, single=SINGLE_FILES, years=(2018, 2019, 2020), types=TYPES) -> list[str]:
    """The first of the ``single`` CSV files under ``base``, else its monthly files; ValueError if there is neither."""
    for path in existing(spark, [f"{base}/{name}" for name in single]):
        return [path]
    found = existing(spark, monthly_paths(grid_base(spark, base), years, types))
    if not found:
        raise ValueError(f"no positions under {base}")
    return found


def manifest(spark: SparkSession, paths: list[str]) -> Manifest:
    """The files at ``paths`` as they are now. The driver asks for their state, not for their rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = set()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        state = path.getFileSystem(conf).getFileStatus(path)
        out.add((p, state.getLen(), state.getModificationTime()))
    return out


class HourlyTable:
    """An hourly table below ``folder``; ``refresh`` brings it up to the source files."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, least: int = 10):
        self.spark, self.folder, self.buckets, self.least = spark, folder.rstrip("/"), buckets, least

    def read(self) -> DataFrame:
        """Hourly points with ``built``, the number of the refresh that made a track."""
        return self.stored("hourly").drop("bucket")

    def refresh(self, paths: list[str]) -> DataFrame:
        """Builds what changed since the last refresh and returns the table.

        A refresh that died leaves the names of the tracks it was about to build; the next one takes them up. The
        manifest is written last.
        """
        now, before, build = manifest(self.spark, paths), self.manifest(), self.builds() + 1
        fresh, gone = sorted(p for p, *_ in now - before), sorted({p for p, *_ in before - now} - {p for p, *_ in now})
        if not fresh and not gone and not self.there("pending"):
            return self.read()
        touched = self.tracks_of([*fresh, *gone])
        if self.there("pending"):
            touched = touched.union(self.stored("pending")).distinct()
        touched = keep(touched)
        touched.write.mode("overwrite").parquet(f"{self.folder}/pending")
        for path in gone:
            self.delete(f"cleaned/source={self.source_name(path)}")
        if fresh:
            self.clean(fresh)
        touched = keep(touched.union(self.tracks_of(fresh)).distinct())
        touched.write.mode("overwrite").parquet(f"{self.folder}/pending")
        self.build(touched, build)
        rows = [(*f, build) for f in sorted(now)]
        self.spark.createDataFrame(rows, "path string, length long, changed long, build int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest")
        self.delete("pending")
        return self.read()

    def clean(self, paths: list[str]) -> None:
        rows = tracks.clean(read_csv(self.spark, paths)).withColumn("source", self.source(F.col("src_ord.file_path")))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.folder}/cleaned")

    def build(self, touched: DataFrame, build: int) -> None:
        """Rebuilds the touched tracks; other tracks of their buckets are copied."""
        bucket = F.pmod(F.xxhash64("TRACK_ID"), F.lit(self.buckets)).cast("int")
        rows = self.stored("cleaned").join(touched, "TRACK_ID", "left_semi") if self.there("cleaned") else None
        parts = [] if rows is None else [tracks.hourly(tracks.keep_first(rows), self.least).withColumns({"built": F.lit(build), "bucket": bucket})]
        if self.there("hourly"):
            mine = [r[0] for r in touched.select(bucket).distinct().collect()]  # as many as buckets at most
            parts.append(self.stored("hourly").filter(F.col("bucket").isin(mine)).join(touched, "TRACK_ID", "left_anti"))
        if not parts:
            return
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = keep(out)
        filled = {r[0] for r in out.select("bucket").distinct().collect()}
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/hourly")
        if self.there("hourly"):
            for b in {r[0] for r in touched.select(bucket).distinct().collect()} - filled:
                self.delete(f"hourly/bucket={b}")

    def tracks_of(self, paths: list[str]) -> DataFrame:
        """Names of the tracks that the cleaned rows of these files hold."""
        names = [self.source_name(p) for p in paths]
        if not names or not self.there("cleaned"):
            return self.spark.createDataFrame([], "TRACK_ID string")
        return self.stored("cleaned").filter(F.col("source").isin(names)).select("TRACK_ID").distinct()

    def manifest(self) -> Manifest:
        return {(r.path, r.length, r.changed) for r in self.stored("manifest").collect()} if self.there("manifest") else set()

    def builds(self) -> int:
        return (self.stored("manifest").agg(F.max("build")).first()[0] or 0) if self.there("manifest") else 0

    def source_name(self, path: str) -> str:
        """A source file's name among the cleaned parts: that of its path as Spark writes it."""
        qualified = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = qualified.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        uri = store.makeQualified(qualified).toUri().toString()
        return self.spark.range(1).select(self.source(F.lit(uri))).first()[0]

    @staticmethod
    def source(path: Column) -> Column:
        return F.md5(F.regexp_replace(path, "^file:/+", "file:/"))

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def there(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = path.getFileSystem(conf)
        return store.exists(path) and any(not s.getPath().getName().startswith("_") for s in store.listStatus(path))

    def delete(self, name: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(conf).delete(path, True)
