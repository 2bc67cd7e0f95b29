"""Exact quantiles of several columns without ordering any of them as a whole.

A sketch proposes pivots. Every value is placed between two pivots or at one of them, the places are
counted, and the counts say where a wanted rank lies. Between two pivots there is a small
share of a column, whatever its distribution, and only the places that hold a wanted rank are
ordered; a value that many rows share is a pivot of its own, and a rank there needs no order.
The sketch decides how much is ordered, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _place(group: int) -> Column:
    """2 * i for a value equal to pivot i, counted from 1, and 2 * i + 1 for one between pivots i and i + 1."""
    first = "size(filter(pivots, g -> g[0] < x))"
    below = f"transform(array({first}), g -> if(g = 0, 0, (g - 1) * {group} + size(filter(pivots[g - 1], p -> p < x))))"
    met = f"coalesce(get(get(pivots, cast(n div {group} as int)), n % {group}) = x, false)"
    return F.expr(f"transform({below}, n -> if({met}, 2 * (n + 1), 2 * n + 1))[0]")


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], pivots: int = 256) -> DataFrame:
    """(feature, n, quantiles): a row for each column that has values; nulls and NaN count as none.

    Between two ranks lies a straight line. ``df`` is read three times: give it as a written table.
    """
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(values).alias("v")).select("v.*").filter("x IS NOT NULL AND NOT isnan(x)")
    group = max(1, int(pivots**0.5))
    proposed = F.array_sort(F.array_distinct(F.percentile_approx("x", [i / pivots for i in range(1, pivots)], 10 * pivots)))
    sketch = long.groupBy("feature").agg(proposed.alias("flat"))
    groups = F.expr(f"transform(sequence(0, cast(ceil(size(flat) / {group}D) as int) - 1), g -> slice(flat, g * {group} + 1, {group}))")
    sketch = sketch.select("feature", groups.alias("pivots"))
    placed = long.join(F.broadcast(sketch), "feature").withColumn("place", _place(group)).drop("pivots")  # a row for each column
    counts = placed.groupBy("feature", "place").agg(F.count(F.lit(1)).alias("here"), F.min("x").alias("least"), F.max("x").alias("most"))
    every = W.partitionBy("feature")
    ahead = F.coalesce(F.sum("here").over(every.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = counts.withColumns({"ahead": ahead, "n": F.sum("here").over(every)})
    spots = F.array(*[(F.col("n") - 1) * F.lit(float(s)) for s in shares])
    known = known.withColumn("spots", spots)
    ranks = F.expr("filter(array_distinct(flatten(transform(spots, s -> array(floor(s), ceil(s))))), r -> r >= ahead AND r < ahead + here)")
    wanted = known.withColumn("ranks", ranks).filter("size(ranks) > 0").select("feature", "place", "least", "most", "ahead", "n", "ranks")
    sure = wanted.filter("least = most").select("feature", "n", F.explode("ranks").alias("rank"), F.col("least").alias("value"))
    # Two places at most for each column and share.
    open_ = F.broadcast(wanted.filter("least < most").select("feature", "place", "ahead", "n", "ranks"))
    inner = placed.join(open_, ["feature", "place"])
    rank = F.col("ahead") + F.row_number().over(W.partitionBy("feature", "place").orderBy("x")) - 1
    found = inner.withColumn("rank", rank).filter(F.array_contains("ranks", F.col("rank"))).select("feature", "n", "rank", F.col("x").alias("value"))
    both = sure.unionByName(found).groupBy("feature").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def line(s: float) -> Column:
        spot = (F.col("n") - 1) * F.lit(float(s))
        low, high = F.col("at")[F.floor(spot)], F.col("at")[F.ceil(spot)]
        return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    return both.select("feature", "n", F.array(*[line(s) for s in shares]).alias("quantiles"))
