"""The draws of virtual vessels from NumPy's generator, seeded for each route, for results that equal those of scalar code that does so."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_draws(route_id: str, candidates: list[int], seed: int) -> tuple[int, float, bool]:
    """(anchor, scale of speed, whether to the left) in this order from PCG64, whose seed is the last 32 bits of an MD5."""
    rng = np.random.default_rng(int(hashlib.md5(f"{route_id}_{seed}".encode()).hexdigest(), 16) % 2**32)
    return int(rng.choice(candidates)), float(rng.uniform(0.9, 1.1)), bool(rng.random() < 0.5)


def with_numpy_draws(points: DataFrame, seed: int) -> DataFrame:
    """``points`` with ``draw_pick`` (0 at the drawn anchor, else 1), ``draw_scale`` and ``draw_left`` for ``inject_a3``.

    One row a route goes through Python, with the places of its highest scores.
    """
    from tidemark.operators.inject import normal_score, route

    known = points.withColumn("_s", normal_score()).withColumn("_top", F.max("_s").over(route()))
    high = F.when(F.abs(F.col("_top") - F.col("_s")) <= 1e-12, F.col("ROUTE_POINT_IDX"))
    packed = known.groupBy("TRACK_ID", "SEG", "ROUTE_ID").agg(F.array_sort(F.collect_list(high)).alias("high"))

    @F.pandas_udf("pick int, scale double, left boolean")
    def draw(ids: pd.Series, high: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([route_draws(i, list(h), seed) for i, h in zip(ids, high)], columns=["pick", "scale", "left"])

    drawn = packed.select("TRACK_ID", "SEG", draw("ROUTE_ID", "high").alias("d"))
    met = points.join(drawn, ["TRACK_ID", "SEG"])
    pick = F.when(F.col("ROUTE_POINT_IDX") == F.col("d.pick"), 0.0).otherwise(1.0)
    return met.withColumns({"draw_pick": pick, "draw_scale": F.col("d.scale"), "draw_left": F.col("d.left")}).drop("d")
