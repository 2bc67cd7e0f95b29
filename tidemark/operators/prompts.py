"""Scoring prompts: one text per selected route and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.geo import circular_step, course_over_ground
from tidemark.functions.scalars import fixed_point

ROUTE = ("TRACK_ID", "SEG")


def point_changes(routes: DataFrame) -> DataFrame:
    """Each point with COG and the change of speed and course from the point before (0 at the first)."""
    order = W.partitionBy(*ROUTE).orderBy("ROUTE_POINT_IDX")
    cog = routes.withColumn("COG", course_over_ground(F.col("COURSE_SIN"), F.col("COURSE_COS")))
    return cog.withColumns(
        {
            "D_SOG": F.coalesce(F.col("SPEED") - F.lag("SPEED").over(order), F.lit(0.0)),
            "D_COG": F.coalesce(circular_step(F.col("COG"), F.lag("COG").over(order)), F.lit(0.0)),
        }
    )


def prompt_stats(routes: DataFrame, *also: Column) -> DataFrame:
    """Mean and sample deviation of speed and of course (arithmetic) per route, with its points, and ``also`` for each, in order."""
    point = F.struct("ROUTE_POINT_IDX", "LAT", "LON", "SPEED", "COG", "D_SOG", "D_COG", *also)
    return (
        point_changes(routes)
        .groupBy(*ROUTE)
        .agg(
            F.avg("SPEED").alias("avg_sog"), F.stddev_samp("SPEED").alias("std_sog"),
            F.avg("COG").alias("avg_cog"), F.stddev_samp("COG").alias("std_cog"),
            F.array_sort(F.collect_list(point)).alias("points"),
        )
        .withColumn("ROUTE_ID", F.concat_ws("-", *ROUTE))
    )


def point_body() -> Column:
    """A point's lines in the text, after its number."""
    c = F.col
    return F.concat(
        F.lit(": [\n  Lat: "), fixed_point(c("LAT"), 6), F.lit(", Lon: "), fixed_point(c("LON"), 6),
        F.lit(",\n  SOG: "), fixed_point(c("SPEED"), 3), F.lit(", COG: "), fixed_point(c("COG"), 1),
        F.lit(",\n  ΔSOG: "), fixed_point(c("D_SOG"), 3, sign=True), F.lit(", ΔCOG: "), fixed_point(c("D_COG"), 1, sign=True), F.lit("\n]"),
    )


def prompt_text(T: int, k: Column, vessel_type: str) -> Column:
    """The text's layout is fixed: scorers are given it as it stands."""
    three = lambda c: fixed_point(F.col(c), 3)
    head = F.concat(
        F.lit(f'[Input Trajectory Segment]\n\n- **Metadata:** {{ "VesselType": "{vessel_type}", "Duration": "{T} hours" }}\n- **Statistics:** {{ "Avg_SOG": '),
        three("avg_sog"), F.lit(' knots, "Std_SOG": '), three("std_sog"), F.lit(', "Avg_COG": '), three("avg_cog"), F.lit(', "Std_COG": '), three("std_cog"), F.lit(" }"),
    )
    anomaly = F.concat(F.lit("\n- **Anomaly Config:** K = "), k.cast("string"))
    series = F.array_join(F.transform("points", lambda p, i: F.concat(F.lit("t="), (i + 1).cast("string"), p["body"])), "\n\n")
    return F.concat(head, F.coalesce(anomaly, F.lit("")), F.lit(f"\n- **Time Series (T={T}h)**\n\n"), series)


def prompts(routes: DataFrame, indices: DataFrame, T: int, percentages=(10, 5, 3, 1), vessel_type: str = "Cargo") -> DataFrame:
    """(ROUTE_ID, anomaly_type, K, T, prompt) of each route and mode in any sample; routes of another length are left out."""
    flags = [F.col(f"use_{p}pct") for p in percentages]
    used = flags[0]
    for flag in flags[1:]:
        used = used | flag
    picked = indices.filter(used).select("ROUTE_ID", F.upper("mode").alias("anomaly_type"), "K")
    asked = routes.join(picked.select("ROUTE_ID").distinct(), "ROUTE_ID", "left_semi")
    whole = prompt_stats(asked, point_body().alias("body")).filter(F.size("points") == T)
    return whole.join(picked, "ROUTE_ID").select(
        "ROUTE_ID", "anomaly_type", "K", F.lit(T).alias("T"), prompt_text(T, F.col("K"), vessel_type).alias("prompt")
    )
