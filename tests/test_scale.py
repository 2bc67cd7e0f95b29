"""Ranks, quantiles and the dataset grid: results that no single task could have ordered."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import draw
from tidemark.operators import dataset, inject, ranks, strata
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("given", [False, True])
def test_ranks_in_a_group_of_100_000(spark, given):
    df = spark.range(110_000).select(
        F.when(F.col("id") < 100_000, "all").when(F.col("id") < 100_010, F.lit(None)).otherwise((F.col("id") % 4000).cast("string")).alias("g"),
        F.concat(F.lit("r"), F.col("id") * 7919 % 110_000).alias("id"),
    )
    key = draw(F.col("id"), seed=3)
    got = ranks.ranked(df, ["g"], ["id"], 16) if given else ranks.ranked_by_draw(df, ["g"], key, ["id"])
    rows = got.withColumn("key", F.col("id") if given else key).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append(r)
    assert len(rows) == 110_000 and len(groups) == 4002 - sum(str(k) not in groups for k in range(4000))
    for members in groups.values():
        members.sort(key=lambda r: (r["key"], r["id"]))
        assert [r["_r"] for r in members] == list(range(1, len(members) + 1)) and {r["_n"] for r in members} == {len(members)}


def test_no_task_orders_the_large_group(spark):
    df = spark.range(100_000).select(F.lit("all").alias("g"), F.col("id").cast("string").alias("id"))
    for got in (ranks.ranked(df, ["g"], ["id"], 16), ranks.ranked_by_draw(df, ["g"], draw(F.col("id"), seed=1), ["id"])):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "row_number" in line]
        assert windows and all("_part" in line for line in windows)


def numbers(kind, n):
    rng = np.random.default_rng(4)
    return {
        "even": rng.random(n), "ties": rng.integers(0, 4, n).astype(float), "one": np.full(n, 2.5), "steep": np.exp(rng.normal(0, 40, n)),
        "third": np.where(np.arange(n) % 3 == 0, 0.0, rng.normal(0, 1, n)),
    }[kind]


@pytest.mark.parametrize("n", [1, 2, 7, 20_000])
def test_quantiles_equal_numpy(spark, n):
    kinds = ["even", "ties", "one", "steep", "third"]
    columns = {k: numbers(k, n) for k in kinds}
    odd = [(None,) * 5, (float("nan"),) * 5]
    rows = [tuple(map(float, r)) for r in zip(*columns.values())]
    df = spark.createDataFrame(rows + odd, ", ".join(f"{k} double" for k in kinds)).withColumn("down", -F.col("third"))
    shares = [0, 0.1, 0.25, 0.5, 0.9999, 1]
    got = {r["feature"]: r for r in exact_quantiles(df, [*kinds, "down"], shares, pivots=32).collect()}
    for kind, x in {**columns, "down": -columns["third"]}.items():
        assert got[kind]["n"] == n
        np.testing.assert_allclose(got[kind]["quantiles"], np.quantile(x, shares), rtol=1e-12, atol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).collect() == []
    edges = strata.bin_edges(spark.createDataFrame([], "avg_sog double, avg_dcog double, avg_dsog double")).first()
    assert edges["avg_sog_edges"] == []


def test_bins_use_no_percentile(spark):
    stats = spark.createDataFrame([("r", 1.0, 2.0, 3.0, "Cargo")], "ROUTE_ID string, avg_sog double, avg_dcog double, avg_dsog double, vessel_type string")
    plan = strata.stratify(stats)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def plain(df):
    out = df.collect()
    return {tuple(r[c] for c in ("route_id", "mode", "pct", "seed")): (r["split"], r["n_anomalous"], list(r["y"]), list(r["X"]), len(r["X_seq"])) for r in out}


def test_grid_equals_its_cells(spark):
    injected = catalogue.injected(spark, SF).filter("NOT (ROUTE_POINT_IDX = 3 AND ROUTE_ID LIKE '%1-1')").cache()
    index = strata.indices(strata.route_stats(catalogue.routes(spark, SF)), 12).cache()
    got = dataset.dataset_grid(injected, index, 12, pcts=(10, 1), modes=("a1", "a2", "a3"), seeds=(2, 12))
    want = {}
    for mode in ("a1", "a2", "a3"):
        for pct in (10, 1):
            rows = dataset.packed(dataset.labelled(injected, dataset.allowed_routes(index, pct, mode), mode, 12)).cache()
            for seed in (2, 12):
                cell = dataset.split(rows, seed).withColumns({"mode": F.lit(mode), "pct": F.lit(pct), "seed": F.lit(seed)})
                want |= plain(cell)
    assert plain(got) == want
    assert any(v[1] for v in want.values())


def test_grid_reads_the_injected_table_once(spark, tmp_path, monkeypatch):
    catalogue.injected(spark, SF).write.parquet(f"file://{tmp_path}/injected")
    injected, plans = spark.read.parquet(f"file://{tmp_path}/injected"), []
    kept = dataset.keep
    monkeypatch.setattr(dataset, "keep", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    index = strata.indices(strata.route_stats(catalogue.routes(spark, SF)), 12)
    plans.append(dataset.dataset_grid(injected, index, 12)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("ANOMALY_TYPE#") > 0 for p in plans) == 1


def test_two_plans_of_a_type_are_one(spark):
    rng = random.Random(1)
    points = catalogue.routes(spark, SF).cache()
    ids = sorted(r[0] for r in points.select("ROUTE_ID").distinct().collect())[:9]
    scores = lambda: [round(rng.random(), 3) for _ in range(12)]
    first, last = ([(i, kind, 12, 3, scores()) for i in ids for kind in ("A1", "A2", "A3")] for _ in range(2))
    schema = "ROUTE_ID string, anomaly_type string, T int, K int, scores array<double>"
    stamp = lambda rows, at: spark.createDataFrame(rows, schema).withColumns({"scored_at": F.lit(at).cast("timestamp_ntz"), "path": F.lit(f"f{at}")})
    both = stamp(first, "2024-01-02 00:00:00").unionByName(stamp(last, "2024-01-03 00:00:00"))
    alone = inject.apply_plans(points, stamp(last, "2024-01-03 00:00:00")).orderBy("ROUTE_ID", "T_INDEX").collect()
    assert inject.apply_plans(points, both).orderBy("ROUTE_ID", "T_INDEX").collect() == alone
    assert len({(r["ROUTE_ID"], r["T_INDEX"]) for r in alone}) == len(alone)


def test_numpy_draws_are_numpys(spark):
    import hashlib

    from tidemark.operators.numpy_draws import with_numpy_draws

    rng = random.Random(6)
    rows = [(f"t{r}", r % 3, f"t{r}-{r % 3}", i, rng.choice([0.1, 0.5, 0.9, 0.9]) if r % 10 else 0.5) for r in range(1000) for i in range(6)]
    points = spark.createDataFrame(rows, "TRACK_ID string, SEG int, ROUTE_ID string, ROUTE_POINT_IDX int, score double")
    got = {}
    for r in with_numpy_draws(points, 17).collect():
        got.setdefault(r.ROUTE_ID, [None, r.draw_scale, r.draw_left])
        if r.draw_pick == 0:
            got[r.ROUTE_ID][0] = r.ROUTE_POINT_IDX
    scores = {}
    for _, _, route, _, s in rows:
        scores.setdefault(route, []).append(s)
    for route, values in scores.items():
        own = np.random.default_rng(int(hashlib.md5(f"{route}_17".encode()).hexdigest(), 16) % 2**32)
        anchor = own.choice(np.flatnonzero(np.array(values) == max(values)))
        assert got[route] == [anchor, own.uniform(0.9, 1.1), own.random() < 0.5]


def test_virtual_vessels_by_numpys_draws(spark):
    points = catalogue.routes(spark, SF)
    plans = catalogue.plans_of(spark, SF)
    one, two, hashed = (inject.apply_plans(points, plans, seed=3, rng=r).orderBy("ROUTE_ID", "T_INDEX").collect() for r in ("numpy", "numpy", "hash"))
    assert one == two and len(one) == len(hashed) and one != hashed
    with pytest.raises(ValueError):
        inject.apply_plans(points, plans, rng="other")


def test_courses_and_their_means_have_the_bits_of_sql(spark):
    """Means of whole degrees tie with their own quantiles, where one bit moves a route to another bin."""
    import duckdb

    from tidemark.functions.geo import course_over_ground
    from tidemark.plans import oracles

    degrees = spark.range(360).select(F.col("id").cast("int").alias("d"), course_over_ground(F.sin(F.radians("id")), F.cos(F.radians("id"))).alias("cog"))
    sql = "SELECT d, (degrees(atan2(sin(radians(d)), cos(radians(d)))) + 360e0) % 360e0 FROM (SELECT CAST(range AS INTEGER) AS d FROM range(360)) ORDER BY d"
    assert [tuple(r) for r in degrees.orderBy("d").collect()] == duckdb.sql(sql).fetchall()
    db = duckdb.connect(config={"threads": 1})  # several threads add up in any order
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = db.execute(oracles._with(oracles._STATS, "SELECT ROUTE_ID, avg_dcog FROM s ORDER BY ROUTE_ID")).fetchall()
    got = strata.route_stats(catalogue.routes(spark, SF)).select("ROUTE_ID", "avg_dcog").orderBy("ROUTE_ID").collect()
    assert [tuple(r) for r in got] == want


def test_answers_are_parsed_once_where_they_are_filtered(spark):
    """The filter on the reason goes down to the scan; each rule parsed the answer again there."""
    plan = catalogue.answers_latest_valid(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") + plan.count("try_parse_json(") == 1 and "Join" not in plan
