"""Cleaning, keep-first, hourly grid, routes and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import nearest_hour, parse_time

NUMBERS = ("LON", "LAT", "SPEED", "COURSE", "COURSE_SIN", "COURSE_COS")


def clean(raw: DataFrame) -> DataFrame:
    """Rows without nulls, times at the nearest hour, course as sine and cosine, ``TRACK_ID`` as text.

    ``raw`` has ``src_ord``, the order of its rows, besides the raw columns.
    """
    whole = raw.dropna("any")
    timed = whole.withColumn("TIMESTAMP", parse_time(F.col("TIMESTAMP").cast("string"))).filter("TIMESTAMP IS NOT NULL")
    return timed.withColumns(
        {
            "TIMESTAMP": nearest_hour(F.col("TIMESTAMP")),
            "COURSE_SIN": F.sin(F.radians("COURSE")),
            "COURSE_COS": F.cos(F.radians("COURSE")),
            "TRACK_ID": F.col("TRACK_ID").cast("string"),
        }
    )


def keep_first(points: DataFrame) -> DataFrame:
    """The first row, in source order, of each track and time."""
    order = W.partitionBy("TRACK_ID", "TIMESTAMP").orderBy("src_ord")
    return points.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def long_enough(points: DataFrame, least: int) -> DataFrame:
    """Rows of tracks with at least ``least`` rows."""
    return points.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("TRACK_ID"))).filter(F.col("_n") >= least).drop("_n")


def hourly(points: DataFrame, least: int = 10) -> DataFrame:
    """Every hour from a track's first to its last, straight lines between what was seen; short tracks go."""
    order = W.partitionBy("TRACK_ID").orderBy("TIMESTAMP")
    have = [c for c in NUMBERS if c in points.columns]
    ahead = points.withColumns(
        {"_gap": F.expr("timestampdiff(HOUR, TIMESTAMP, lead(TIMESTAMP) OVER (PARTITION BY TRACK_ID ORDER BY TIMESTAMP))")}
        | {f"_{c}": F.lead(c).over(order) for c in (*have, "CRAFT_ID")}
    )
    steps = ahead.withColumn("_k", F.explode(F.expr("sequence(0, cast(coalesce(_gap, 1) - 1 as int))")))
    share = F.col("_k") / F.coalesce(F.col("_gap"), F.lit(1))
    between = lambda c: F.when(F.col("_k") == 0, F.col(c).cast("double")).otherwise(
        F.col(c) + (F.col(f"_{c}") - F.col(c)) * share
    )
    grid = steps.select(
        "TRACK_ID",
        F.expr("timestampadd(HOUR, _k, TIMESTAMP)").alias("TIMESTAMP"),
        F.floor(between("CRAFT_ID")).cast("bigint").alias("CRAFT_ID"),
        *[between(c).alias(c) for c in have],
        F.lit(False).alias("ANOMALY"),
    )
    return long_enough(grid, least)


def cut_routes(points: DataFrame, T: int = 12, trim: int = 12, min_track_len: int = 36) -> DataFrame:
    """Routes of ``T`` points each by position within the trimmed track; the rest of a track goes.

    One shuffle by track serves the row numbers and the counts.
    """
    if T <= 0 or trim < 0 or min_track_len < 0:
        raise ValueError("T must be positive, trim and min_track_len not negative")
    once = keep_first(points) if "src_ord" in points.columns else points
    track = W.partitionBy("TRACK_ID")
    at = F.row_number().over(track.orderBy("TIMESTAMP")) - 1 - trim
    placed = once.withColumns({"_n": F.count(F.lit(1)).over(track), "_i": at})
    usable = F.floor((F.col("_n") - 2 * trim) / T) * T
    inside = placed.filter((F.col("_n") >= min_track_len) & (F.col("_i") >= 0) & (F.col("_i") < usable))
    anomaly = F.coalesce(F.col("ANOMALY"), F.lit(False)) if "ANOMALY" in points.columns else F.lit(False)
    sin_cos = {"COURSE_SIN": F.sin, "COURSE_COS": F.cos}
    made = {c: f(F.radians("COURSE")) for c, f in sin_cos.items() if c not in points.columns}
    seg = F.floor(F.col("_i") / T).cast("int")
    return inside.withColumns({"SEG": seg, "ROUTE_POINT_IDX": (F.col("_i") % T).cast("int"), "ANOMALY": anomaly} | made).select(
        F.concat_ws("-", "TRACK_ID", "SEG").alias("ROUTE_ID"),
        "ROUTE_POINT_IDX", "TIMESTAMP", "CRAFT_ID", "TRACK_ID", "SEG", "LON", "LAT", "SPEED", "COURSE_SIN", "COURSE_COS", "ANOMALY",
    )


def route_faults(routes: DataFrame, T: int) -> DataFrame:
    """Routes that lack a point, hold one twice or go back in time; none if all is well."""
    route = ["TRACK_ID", "SEG"]
    before = F.lag("TIMESTAMP").over(W.partitionBy(*route).orderBy("ROUTE_POINT_IDX"))
    checked = routes.withColumn("_on", F.coalesce(F.col("TIMESTAMP") >= before, F.lit(True)))
    seen = checked.groupBy(*route).agg(
        F.count(F.lit(1)).alias("points"),
        F.sort_array(F.collect_set("ROUTE_POINT_IDX")).alias("places"),
        F.bool_and("_on").alias("in_time"),
    )
    whole = (F.col("points") == T) & (F.col("places") == F.sequence(F.lit(0), F.lit(T - 1)))
    return seen.filter(~(whole & F.col("in_time"))).select(F.concat_ws("-", *route).alias("ROUTE_ID"), "points", "in_time")


def complete_routes(points: DataFrame, T: int) -> DataFrame:
    """ROUTE_ID of the routes with each of T points once."""
    seen = points.groupBy("ROUTE_ID").agg(
        F.count(F.lit(1)).alias("points"),
        F.countDistinct("T_INDEX").alias("distinct_points"),
        F.min("T_INDEX").alias("first_point"),
        F.max("T_INDEX").alias("last_point"),
    )
    return seen.filter((F.col("points") == T) & (F.col("distinct_points") == T) & (F.col("first_point") == 0) & (F.col("last_point") == T - 1))


def track_neighbours(points: DataFrame, columns: tuple[str, ...] = ("LON", "LAT")) -> DataFrame:
    """Each point with the point before and after it on its whole track, across routes."""
    order = W.partitionBy("TRACK_ID").orderBy("TIMESTAMP")
    return points.withColumns(
        {f"PREV_{c}": F.lag(c).over(order) for c in columns} | {f"NEXT_{c}": F.lead(c).over(order) for c in columns}
    )
