"""Ranks inside groups of any size, in two steps: no task orders a whole group.

A group is cut into ranges of its order. Ranges are counted, a range's rows start after those of the
ranges before it, and only the rows of one range are ever ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import DRAW_BITS
from tidemark.sources.kept import keep


def ranked_by_draw(df: DataFrame, by: list[str], draw: Column, tie: list[str], bits: int = 10) -> DataFrame:
    """``df`` with ``_r``, a row's rank by ``draw`` (see ``scalars.draw``) and ``tie`` in its group, and ``_n``, the group's rows.

    Draws are uniform, so their first ``bits`` bits cut a group evenly.
    """
    drawn = df.withColumn("_draw", draw)
    return _in_two_steps(drawn.withColumn("_part", F.shiftright("_draw", DRAW_BITS - bits)), by, ["_draw", *tie]).drop("_draw")


def ranked(df: DataFrame, by: list[str], order: list[Column | str], ranges: int | None = None) -> DataFrame:
    """The same for any order. Ranges come from a sample that Spark draws, so the dealt rows are written before they are counted."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    ordered = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order)})
    dealt = ordered.repartitionByRange(ranges, *by, *names).withColumn("_part", F.spark_partition_id())
    return _in_two_steps(keep(dealt), by, names).drop(*names)


def _in_two_steps(parted: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    group = W.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    held = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_held"))
    there = held.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate([*by, "_part"])],
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_ahead"),
        F.sum("_held").over(group).alias("_n"),
    )
    local = parted.withColumn("_l", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order)))
    same = F.lit(True)
    for i, c in enumerate([*by, "_part"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = local.join(there, same)
    return placed.withColumn("_r", F.col("_ahead") + F.col("_l")).drop("_l", "_ahead", "_part", *[f"_g{i}" for i in range(len(by) + 1)])
