"""Feature arrays, labels and stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import draw
from tidemark.operators.ranks import ranked, ranked_by_draw
from tidemark.operators.tracks import complete_routes
from tidemark.sources.kept import keep

#: Order of a point's features.
FEATURES = ("SPEED", "COURSE_SIN", "COURSE_COS", "LON", "LAT")


def allowed_routes(indices: DataFrame, pct: int, mode: str) -> DataFrame:
    """ROUTE_ID that may be labelled: those in the sample, and for a3 their virtual vessels too."""
    ids = indices.filter((F.lower("mode") == mode) & F.col(f"use_{pct}pct")).select("ROUTE_ID").distinct()
    return ids.union(ids.select(F.concat(F.lit("A3_"), "ROUTE_ID"))) if mode == "a3" else ids


def labelled(injected: DataFrame, allowed: DataFrame, mode: str, T: int) -> DataFrame:
    """Points of complete routes with label ``y``; virtual vessels only for a3. Other modes' anomalies keep y = 0."""
    own = injected if mode == "a3" else injected.filter(~F.col("ROUTE_ID").startswith("A3_"))
    whole = own.join(complete_routes(own, T).select("ROUTE_ID"), "ROUTE_ID", "left_semi")
    flagged = whole.join(allowed.withColumn("_in", F.lit(True)), "ROUTE_ID", "left")
    y = F.coalesce(F.col("ANOMALY") & (F.coalesce(F.upper("ANOMALY_TYPE"), F.lit("")) == mode.upper()) & F.col("_in"), F.lit(False))
    return flagged.withColumn("y", y.cast("tinyint")).drop("_in")


def packed(points: DataFrame) -> DataFrame:
    """One row per route: X_seq (T x 5), X (flat), y and the number of anomalous points."""
    one = F.struct("T_INDEX", F.array(*[F.col(c).cast("float") for c in FEATURES]).alias("f"), "y")
    rows = points.groupBy("ROUTE_ID").agg(F.array_sort(F.collect_list(one)).alias("p"))
    return rows.select(
        F.col("ROUTE_ID").alias("route_id"),
        F.col("p.f").alias("X_seq"),
        F.flatten("p.f").alias("X"),
        F.col("p.y").alias("y"),
        F.aggregate("p.y", F.lit(0), lambda t, x: t + x.cast("int")).alias("n_anomalous"),
    )


def split(routes: DataFrame, seed: int = 0, train: float = 0.7, valid: float = 0.15, order: Column | None = None) -> DataFrame:
    """``split``: train, valid or test within each number of anomalous points; sizes round half to even."""
    if order is None:
        placed = ranked_by_draw(routes, ["n_anomalous"], draw(F.col("route_id"), seed=seed), ["route_id"])
    else:
        placed = ranked(routes, ["n_anomalous"], [order, "route_id"])
    return in_shares(placed, train, valid)


def in_shares(placed: DataFrame, train: float, valid: float) -> DataFrame:
    """``split`` from a row's rank ``_r`` among ``_n``."""
    if train < 0 or valid < 0 or train + valid > 1 + 1e-9:
        raise ValueError("train and valid are shares that sum to 1 at most")
    n_train = F.bround(F.col("_n") * train)
    n_valid = F.least(F.bround(F.col("_n") * valid), F.col("_n") - n_train)
    part = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_valid, "valid").otherwise("test")
    return placed.withColumn("split", part).drop("_n", "_r")


def packed_routes(injected: DataFrame, T: int) -> DataFrame:
    """One row per complete route: route_id, X_seq, X and ``kinds``, the type of each anomalous point and '' for others."""
    kind = F.when(F.coalesce("ANOMALY", F.lit(False)), F.coalesce(F.upper("ANOMALY_TYPE"), F.lit(""))).otherwise(F.lit(""))
    one = F.struct("T_INDEX", F.array(*[F.col(c).cast("float") for c in FEATURES]).alias("f"), kind.alias("kind"))
    rows = injected.groupBy("ROUTE_ID").agg(F.array_sort(F.collect_list(one)).alias("p"))
    whole = rows.filter((F.size("p") == T) & (F.col("p.T_INDEX").cast("array<int>") == F.sequence(F.lit(0), F.lit(T - 1))))
    return whole.select(F.col("ROUTE_ID").alias("route_id"), F.col("p.f").alias("X_seq"), F.flatten("p.f").alias("X"), F.col("p.kind").alias("kinds"))


def memberships(indices: DataFrame, pcts: tuple[int, ...], modes: tuple[str, ...]) -> DataFrame:
    """(route_id, member): a bit for each mode and sample that the route may be labelled in; virtual vessels go with their host for a3."""
    bits = F.lit(0).cast("long")
    for m, mode in enumerate(modes):
        for i, pct in enumerate(pcts):
            there = (F.lower("mode") == mode) & F.col(f"use_{pct}pct")
            bits = bits.bitwiseOR(F.when(there, F.lit(1 << (m * len(pcts) + i)).cast("long")).otherwise(F.lit(0).cast("long")))
    own = indices.select("ROUTE_ID", F.lower("mode").alias("mode"), bits.alias("bits")).filter("bits != 0")
    names = F.when(F.col("mode") == "a3", F.array("ROUTE_ID", F.concat(F.lit("A3_"), "ROUTE_ID"))).otherwise(F.array("ROUTE_ID"))
    return own.select(F.explode(names).alias("route_id"), "bits").groupBy("route_id").agg(F.bit_or("bits").alias("member"))


def dataset_grid(
    injected: DataFrame, indices: DataFrame, T: int, pcts=(10, 5, 3, 1), modes=("a1", "a2", "a3"), seeds=(2, 12, 32, 42, 52), train: float = 0.7, valid: float = 0.15
) -> DataFrame:
    """Every cell of pct x mode x seed in one frame, ready for one partitioned write.

    Routes are packed and written once, with a bit for each cell that they are labelled in. Cells are
    made from those bits, all of them are ranked together without their arrays, and the arrays join at the end.
    """
    if len(pcts) * len(modes) > 63:
        raise ValueError("at most 63 cells of percentage and mode")
    rows = keep(packed_routes(injected, T).join(memberships(indices, tuple(pcts), tuple(modes)), "route_id", "left"))
    cell = lambda m, i: F.struct(F.lit(modes[m]).alias("mode"), F.lit(pcts[i]).alias("pct"), F.lit(1 << (m * len(pcts) + i)).cast("long").alias("bit"))
    cells = F.array(*[cell(m, i) for m in range(len(modes)) for i in range(len(pcts))])
    dealt = rows.select("*", F.explode(cells).alias("cell")).select("*", "cell.*").filter("mode = 'a3' OR NOT startswith(route_id, 'A3_')")
    member = F.coalesce(F.col("member").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    y = F.when(member, F.transform("kinds", lambda k: (k == F.upper("mode")).cast("tinyint"))).otherwise(F.transform("kinds", lambda k: F.lit(0).cast("tinyint")))
    labelled_ = dealt.withColumn("y", y)
    light = labelled_.select("route_id", "mode", "pct", F.aggregate("y", F.lit(0), lambda t, v: t + v.cast("int")).alias("n_anomalous"))
    light = light.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    placed = ranked_by_draw(light, ["mode", "pct", "seed", "n_anomalous"], draw(F.col("route_id"), seed=F.col("seed")), ["route_id"])
    whole = in_shares(placed, train, valid).join(labelled_.select("route_id", "mode", "pct", "X_seq", "X", "y"), ["route_id", "mode", "pct"])
    return whole.select("route_id", "X_seq", "X", "y", "n_anomalous", "split", F.lit(T).alias("T"), "mode", "pct", "seed")
