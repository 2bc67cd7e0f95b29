"""Route statistics, quantile bins, strata, nested samples and K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.geo import circular_gap, course_over_ground
from tidemark.functions.scalars import bin_label, bin_of, draw, no_nan
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranks import ranked, ranked_by_draw
from tidemark.sources.kept import keep

FEATURES = ("avg_sog", "avg_dcog", "avg_dsog")
ROUTE = ("TRACK_ID", "SEG")


def route_stats(routes: DataFrame, vessel_type: str = "Cargo") -> DataFrame:
    """Per route: mean speed, mean absolute change of course and of speed (0 with under two points)."""
    order = W.partitionBy(*ROUTE).orderBy("ROUTE_POINT_IDX")
    cog = course_over_ground(F.col("COURSE_SIN"), F.col("COURSE_COS"))
    steps = routes.withColumn("_cog", cog).withColumns(
        {
            "_dcog": circular_gap(F.col("_cog"), F.lag("_cog").over(order)),
            "_dsog": F.abs(F.col("SPEED") - F.lag("SPEED").over(order)),
        }
    )
    return (
        steps.groupBy(*ROUTE)
        .agg(
            F.avg(no_nan(F.col("SPEED"))).alias("avg_sog"),
            F.coalesce(F.avg("_dcog"), F.lit(0.0)).alias("avg_dcog"),
            F.coalesce(F.avg("_dsog"), F.lit(0.0)).alias("avg_dsog"),
        )
        .select(F.concat_ws("-", *ROUTE).alias("ROUTE_ID"), *FEATURES, F.initcap(F.lit(vessel_type)).alias("vessel_type"))
    )


def bin_edges(stats: DataFrame, n_bins: int = 5) -> DataFrame:
    """One row: for each feature the different exact quantiles, in order. ``stats`` is read several times."""
    shares = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    found = exact_quantiles(stats, FEATURES, shares)
    edges = lambda c: F.first(F.when(F.col("feature") == c, F.array_sort(F.array_distinct("quantiles"))), ignorenulls=True)
    none = F.array().cast("array<double>")
    return found.agg(*[F.coalesce(edges(c), none).alias(f"{c}_edges") for c in FEATURES])


def stratify(stats: DataFrame, n_bins: int = 5, label_key: bool = False) -> DataFrame:
    """Stats with bin numbers and the stratum's name; with ``label_key`` bins of equal labels are one. Stats are written once."""
    stats = keep(stats)
    edges = bin_edges(stats, n_bins)
    both = stats.crossJoin(F.broadcast(edges))  # one row
    binned = both.withColumns({f"{c}_bin": bin_of(F.col(c), F.col(f"{c}_edges")) for c in FEATURES})
    label = lambda c: bin_label(F.col(f"{c}_bin"), F.col(f"{c}_edges"))
    name = F.concat("vessel_type", F.lit("|sog="), label("avg_sog"), F.lit("|dcog="), label("avg_dcog"), F.lit("|dsog="), label("avg_dsog"))
    key = name if label_key else F.concat_ws("/", "vessel_type", *[F.coalesce(F.col(f"{c}_bin"), F.lit(0)) for c in FEATURES])
    return binned.withColumns({"stratum": name, "stratum_key": key}).drop(*[f"{c}_edges" for c in FEATURES])


def in_stratum_order(strata: DataFrame, order: Column | None, seed: int) -> DataFrame:
    """``strata`` with ``_r`` and ``_n``, a route's rank in its stratum and the stratum's routes; a random order if none is given."""
    if order is None:
        return ranked_by_draw(strata, ["stratum_key"], draw(F.col("ROUTE_ID"), seed=seed), ["ROUTE_ID"])
    return ranked(strata, ["stratum_key"], [order, "ROUTE_ID"])


def nested_sample(strata: DataFrame, percentages=(10, 5, 3, 1), order: Column | None = None, seed: int = 0) -> DataFrame:
    """Flags use_{p}pct: in each stratum the first max(1, n * p / 100) rows of one order, so samples nest."""
    take = lambda p: F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * p / 100))
    return in_stratum_order(strata, order, seed).withColumns({f"use_{p}pct": take(p) for p in percentages}).drop("_n", "_r")


def assign_k(strata: DataFrame, T: int, order: Column | None = None, seed: int = 7) -> DataFrame:
    """K from a quarter, a half and three quarters of T, dealt in turn within each stratum."""
    options = F.array(*[F.lit(int(T * share)) for share in (0.25, 0.5, 0.75)])
    turn = ((F.col("_r") - 1) % 3 + 1).cast("int")
    return in_stratum_order(strata, order, seed).withColumn("K", F.element_at(options, turn)).drop("_n", "_r")


def indices(stats: DataFrame, T: int, modes=("a1", "a2", "a3"), n_bins: int = 5, percentages=(10, 5, 3, 1), seed: int = 0) -> DataFrame:
    """Membership of every route for every mode; strata are made once for all modes. a3 has no K."""
    strata = keep(stratify(stats, n_bins))
    placed = assign_k(nested_sample(strata, percentages, seed=seed), T, seed=seed + 7)
    flags = [f"use_{p}pct" for p in percentages]
    dealt = placed.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    k = F.when(F.col("mode") != "a3", F.col("K"))
    return dealt.select("ROUTE_ID", F.lit(T).alias("T"), "stratum", *flags, k.alias("K"), "mode")
