"""Hand-made cases, and the injections against scalar arithmetic."""

import math
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import Settings, parse
from tidemark.functions import geo, scalars
from tidemark.operators import dataset, inject, prompts, scoring, strata, tracks
from tidemark.plans import catalogue
from tidemark.plans.pipeline import Pipeline
from tidemark.sources import files
from tidemark.sources.ais import events_as_ais, monthly_paths, read_csv, read_monthly

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def points(spark, hours, track="t", **columns):
    rows = [(track, START + timedelta(hours=h), i, 7, *[float(c[i]) for c in columns.values()]) for i, h in enumerate(hours)]
    names = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(rows, f"TRACK_ID string, TIMESTAMP timestamp_ntz, src_ord int, CRAFT_ID bigint, {names}")


def test_hour_rounding_is_half_even(spark):
    df = spark.sql("SELECT col1 AS s FROM VALUES ('2024-01-01 00:30:00'), ('2024-01-01 01:30:00'), ('2024-01-01 02:30:00'), ('2024-01-01 00:29:59'), ('2024-01-01 00:30:01'), ('x')")
    hours = [r[0].hour if r[0] else None for r in df.select(scalars.nearest_hour(scalars.parse_time(F.col("s")))).collect()]
    assert hours == [0, 2, 2, 0, 1, None]


def test_keep_first_and_interpolation(spark):
    df = points(spark, [0, 0, 3, 5], LON=[0, 99, 3, 5], LAT=[0, 0, 0, 0])
    df = df.withColumn("CRAFT_ID", F.when(F.col("src_ord") < 3, 7).otherwise(8).cast("bigint"))
    got = tracks.hourly(tracks.keep_first(df), least=1).orderBy("TIMESTAMP").collect()
    assert [r.LON for r in got] == [0, 1, 2, 3, 4, 5] and [r.CRAFT_ID for r in got] == [7, 7, 7, 7, 7, 8]
    assert tracks.hourly(tracks.keep_first(df), least=7).count() == 0


@pytest.mark.parametrize("n, routes", [(9, 0), (35, 0), (36, 1), (47, 1), (48, 2)])
def test_route_counts(spark, n, routes):
    df = points(spark, range(n), LON=range(n), LAT=range(n), SPEED=range(n), COURSE=range(n))
    cut = tracks.cut_routes(df, 12, 12, 36)
    assert cut.count() == 12 * routes and tracks.route_faults(cut, 12).count() == 0
    with pytest.raises(ValueError):
        tracks.cut_routes(df, 0)


def test_angles(spark):
    row = spark.range(1).select(
        geo.circular_gap(F.lit(359.0), F.lit(1.0)), geo.circular_step(F.lit(1.0), F.lit(359.0)), geo.circular_step(F.lit(180.0), F.lit(0.0)),
        geo.wrap(F.lit(-180.0)), geo.wrap(F.lit(540.0)), geo.wrap(F.lit(190.0)),
    ).first()
    assert list(row) == [2, 2, 180, -180, 180, -170]


def scalar_destination(x, y, course, m):
    a, la, c = m / 6_371_000, math.radians(y), math.radians(course)
    lb = math.asin(math.sin(la) * math.cos(a) + math.cos(la) * math.sin(a) * math.cos(c))
    return x + math.degrees(math.atan2(math.sin(c) * math.sin(a) * math.cos(la), math.cos(a) - math.sin(la) * math.sin(lb))), math.degrees(lb)


def scalar_distance(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def scalar_bearing(a, b):
    (x1, y1), (x2, y2) = [tuple(map(math.radians, p)) for p in (a, b)]
    return math.degrees(math.atan2(math.sin(x2 - x1) * math.cos(y2), math.cos(y1) * math.sin(y2) - math.sin(y1) * math.cos(y2) * math.cos(x2 - x1))) % 360


def test_degenerate_cross_track(spark):
    one = (F.lit(1.0), F.lit(1.0))
    d = spark.range(1).select(geo.cross_track(one, one, (F.lit(1.0), F.lit(2.0)))).first()[0]
    assert abs(d - scalar_distance((1, 1), (1, 2))) < 1e-6


def turn(a):
    while a > 180:
        a -= 360
    while a < -180:
        a += 360
    return a


def scalar_a2(pts, before, K, scores, sign):
    """A2 on one route, step by step."""
    T, p = len(pts), [dict(q) for q in pts]
    lo, hi = min(scores), max(scores)
    s = [(v - lo) / (hi - lo) if hi > lo else 0.0 for v in scores]
    at = lambda q: (q["x"], q["y"])
    legs = [scalar_distance(at(a), at(b)) / 3600 for a, b in zip(pts, pts[1:])]
    accel = max(np.mean(np.abs(np.diff(legs))) / 3600, 1e-4)
    omega = max(np.mean([abs(turn(b["h"] - a["h"])) for a, b in zip(pts, pts[1:])]), 3)
    start = max(0, min(int(np.argmax(scores)) - (K - 1) // 2, T - K))
    push = max(1, 2 * K // 3)
    goal = at(pts[min(start + K, T - 1)])
    total = sum(1 + s[start + j] for j in range(push, K)) + 1
    share, out = 0.0, {}
    for j in range(K):
        i = start + j
        if i == 0 and before is None:
            continue
        prev = p[i - 1] if i else before
        v_in = scalar_distance(at(prev), at(pts[i])) / 3600 if i == 0 or (i == 1 and 0 in out) else legs[i - 1]
        if j < push:
            v = max(0.1, v_in + 2 * (1 + s[i]) * accel * 3600)
            h = turn(prev["h"] + sign * 2 * (1 + s[i]) * omega)
            x, y = scalar_destination(*at(prev), h % 360, v * 3600)
        else:
            share += (1 + s[i]) / total
            e = p[start + push - 1]
            x, y = e["x"] + (goal[0] - e["x"]) * share, e["y"] + (goal[1] - e["y"]) * share
            h = turn(prev["h"] + turn(scalar_bearing(at(prev), goal) - prev["h"]) * share)
            v = max(v_in, 0.1, 0.7 * v_in + 0.3 * scalar_distance(at(prev), goal) / (max(1, K - j) * 3600))
        p[i] = {"x": x, "y": y, "h": h}
        out[i] = (x, y, v / 0.514444, math.sin(math.radians(h)), math.cos(math.radians(h)))
    return out


def test_a2_against_scalar_steps(spark):
    rows = catalogue.scored(spark, SF).orderBy("TRACK_ID", "TIMESTAMP").collect()
    got = {(r.ROUTE_ID, r.ROUTE_POINT_IDX): r for r in catalogue.a2_of(spark, SF).collect()}
    routes, before, last = {}, {}, {}
    for r in rows:
        q = {"x": r.LON, "y": r.LAT, "h": math.degrees(math.atan2(r.COURSE_SIN, r.COURSE_COS))}
        if r.ROUTE_POINT_IDX == 0:
            before[r.ROUTE_ID] = last.get(r.TRACK_ID)
        routes.setdefault(r.ROUTE_ID, []).append((r, q))
        last[r.TRACK_ID] = q
    assert len(got) == len(rows)
    for rid, ps in routes.items():
        r0 = ps[0][0]
        want = scalar_a2([q for _, q in ps], before[rid], r0.K, [r.score for r, _ in ps], 1 if (r0.CRAFT_ID + r0.SEG) % 2 == 0 else -1)
        for r, q in ps:
            g = got[rid, r.ROUTE_POINT_IDX]
            assert g.ANOMALY == (r.ROUTE_POINT_IDX in want)
            if g.ANOMALY:
                assert np.allclose((g.LON, g.LAT, g.SPEED, g.COURSE_SIN, g.COURSE_COS), want[r.ROUTE_POINT_IDX], atol=1e-7)
            else:
                assert (g.LON, g.LAT, g.SPEED) == (r.LON, r.LAT, r.SPEED)


def test_a1_moves_at_most_k_and_leaves_the_rest(spark):
    before = {(r.ROUTE_ID, r.ROUTE_POINT_IDX): r for r in catalogue.scored(spark, SF).collect()}
    after = catalogue.a1_of(spark, SF).collect()
    moved: dict = {}
    for r in after:
        if r.ANOMALY:
            moved[r.ROUTE_ID] = moved.get(r.ROUTE_ID, 0) + 1
        else:
            assert (r.LON, r.LAT) == (before[r.ROUTE_ID, r.ROUTE_POINT_IDX].LON, before[r.ROUTE_ID, r.ROUTE_POINT_IDX].LAT)
    assert moved and all(n <= before[k, 0].K for k, n in moved.items())


def test_plans_together(spark):
    out = catalogue.injected(spark, SF).collect()
    host = [r for r in out if not r.ROUTE_ID.startswith("A3_")]
    assert len(host) == catalogue.routes(spark, SF).count()
    assert {r.ANOMALY_TYPE for r in out} == {"", "A1", "A2", "A3"}
    assert all(r.ANOMALY == (r.ANOMALY_TYPE != "") for r in out)
    virtual: dict = {}
    for r in out:
        if r.ROUTE_ID.startswith("A3_"):
            virtual.setdefault(r.ROUTE_ID, []).append(r)
    assert virtual and all(sum(r.ANOMALY for r in rs) == 3 for rs in virtual.values())
    n = inject.counters(catalogue.injected(spark, SF)).first()
    assert n.rows == len(out) and n.a3_routes == len(virtual)


def test_score_rules(spark):
    made = catalogue.score_validate(spark, SF).collect()
    reasons = {i % 18: {r.reason for r in made if r.id % 18 == i % 18} for i in range(18)}
    assert all(len(v) == 1 for v in reasons.values()) and reasons[0] == reasons[1] == {None}
    assert len({next(iter(reasons[i])) for i in range(4, 18)}) == 14


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in ("route_2018CargoApr1-0_A1", "a_A2_b", "A3", "xA1y", "none", "route_a_b-3_A2_20240101-000000-000001")], "stem string")
    route, kind = scalars.plan_name(F.col("stem"))
    got = {r[0]: tuple(r)[1:] for r in df.select("stem", scalars.type_in_name(F.col("stem")), route, kind).collect()}
    assert got["route_2018CargoApr1-0_A1"] == ("A1", "2018CargoApr1-0", "A1") and got["xA1y"][0] == "A1" and got["none"] == (None, None, None)
    assert got["route_a_b-3_A2_20240101-000000-000001"] == ("A2", "a_b-3", "A2")


def test_bins_and_samples(spark):
    stats = strata.route_stats(catalogue.routes(spark, SF))
    got = strata.nested_sample(strata.stratify(stats)).collect()
    assert all((not r.use_1pct or r.use_3pct) and (not r.use_3pct or r.use_5pct) and (not r.use_5pct or r.use_10pct) for r in got)
    assert {r.stratum_key for r in got if r.use_1pct} == {r.stratum_key for r in got}
    flat = strata.stratify(stats.withColumn("avg_sog", F.lit(1.0))).first()
    assert flat.avg_sog_bin is None and "sog=nan" in flat.stratum


def test_split_is_whole(spark):
    rows = spark.createDataFrame([(f"r{i}", i % 3) for i in range(90)], "route_id string, n_anomalous int")
    n = {(r.n_anomalous, r.split): r["count"] for r in dataset.split(rows).groupBy("n_anomalous", "split").count().collect()}
    assert n == {(k, s): c for k in range(3) for s, c in (("train", 21), ("valid", 4), ("test", 5))}


def test_pipeline_and_files(spark, tmp_path):
    raw = events_as_ais(spark, SF).withColumn("TIMESTAMP", F.col("TIMESTAMP").cast("string"))
    flow = Pipeline(spark, Settings(percentages=(10,), modes=("a1", "a2"), seeds=(2,)))
    out = flow.run(raw, str(tmp_path))
    assert {"train", "valid", "test"} >= {r.split for r in out.select("split").distinct().collect()}
    files.write_npz(out, str(tmp_path / "npz"))
    found = list((tmp_path / "npz").rglob("*.npz"))
    assert found and np.load(found[0])["X_seq"].shape[1:] == (12, 5)
    asked = spark.read.parquet(str(tmp_path / "prompts"))
    assert asked.filter(~F.col("prompt").startswith("[Input Trajectory Segment]")).isEmpty()
    files.write_prompt_files(asked, str(tmp_path / "txt"))
    assert files.whole_files(spark, str(tmp_path / "txt"), "*.txt").count() > 0


def test_plan_files(spark, tmp_path):
    (tmp_path / "out_route_t-1_A1_x.json").write_text('{"T": 2, "anomaly_type": "A1", "K": 1, "scores": [0, 1]}')
    (tmp_path / "out_route_t-2_A3.json").write_text('text {"T": 2, "scores": [0, 1]} text')
    (tmp_path / "bad.json").write_text("{")
    got = {(r.ROUTE_ID, r.anomaly_type, r.K) for r in files.read_plans(spark, str(tmp_path)).collect()}
    assert got == {("t-1", "A1", 1), ("t-2", "A3", None)}
    assert files.first_with_plans(spark, [str(tmp_path / "none"), str(tmp_path)]).count() == 2


def test_monthly_files(spark, tmp_path):
    paths = monthly_paths(str(tmp_path), (2019,), ("cargo",))
    assert paths[8].endswith("/Sept/MPF_Sep_2019_Grid_Cargo.csv")
    with pytest.raises(ValueError):
        read_monthly(spark, str(tmp_path))
    from pathlib import Path

    Path(paths[0]).parent.mkdir(parents=True)
    Path(paths[0]).write_text("id,x,y,c,s,t,k\n1,2.5,3.5,90,10,2019-01-01 00:10:00,a\n")
    row = read_monthly(spark, str(tmp_path), (2019,), ("cargo",)).first()
    assert (row.CRAFT_ID, row.TRACK_ID, row.TYPE, row.MONTH) == (1, "a", "cargo", "Jan")
    assert tracks.clean(read_csv(spark, paths[0])).first().TIMESTAMP == datetime(2019, 1, 1)


def test_settings():
    assert Settings().merged(**parse("T: 24\nseeds: [1, 2]  # two\n")).seeds == (1, 2)
    with pytest.raises(ValueError):
        Settings(T=0).check()
    with pytest.raises(ValueError):
        scoring.system_text("A9")


def test_prompts_hold_every_point(spark):
    asked = prompts.prompts(catalogue.routes(spark, SF), strata.indices(strata.route_stats(catalogue.routes(spark, SF)), 12), 12)
    text = asked.filter("anomaly_type = 'A1'").first().prompt
    assert text.count("Lat:") == 12 and "K = " in text and "t=12: [" in text


def test_months_are_read_in_order(spark, tmp_path):
    """Of two rows for one hour the earlier month's counts, though its name sorts later."""
    for month, stamp, lon in (("Jan", "2019-01-31 23:50:00", 111.0), ("Feb", "2019-02-01 00:10:00", 222.0)):
        path = next(p for p in monthly_paths(str(tmp_path), (2019,), ("cargo",)) if f"MPF_{month}_" in p)
        Path(path).parent.mkdir(parents=True)
        Path(path).write_text(f"CRAFT_ID,LON,LAT,COURSE,SPEED,TIMESTAMP,Track_ID\n7,{lon},-30,0,10,{stamp},t1\n")
    rows = read_monthly(spark, str(tmp_path))
    assert {(r.TYPE, r.MONTH) for r in rows.collect()} == {("cargo", "Jan"), ("cargo", "Feb")}
    kept = tracks.keep_first(tracks.clean(rows)).collect()
    assert [r.LON for r in kept] == [111.0]


SECTIONS = """
slices: [12, 24]   # lengths
seed: 3
verbose: true
preprocess:
  input_csv: ./data/positions.csv
  trim: 6
  ratios: [10, 5]
inject:
  theta_g: 2.5
prepare-dataset:
  ratios: [5]
  modes: [a1, a3]
  seeds: [2, 12]
  train: 0.6
  valid: 0.2
  test: 0.2
"""


def test_settings_of_a_file_with_sections(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(SECTIONS)
    s = config.load(str(path))
    assert (s.T, s.slices, s.seed, s.verbose, s.input_csv, s.trim) == (12, (12, 24), 3, True, "./data/positions.csv", 6)
    assert (s.percentages, s.grid_percentages, s.modes, s.seeds) == ((10, 5), (5,), ("a1", "a3"), (2, 12))
    assert (s.theta_g, s.train, s.valid, s.test) == (2.5, 0.6, 0.2, 0.2) and config.Settings().seeds == (2, 12, 32, 42, 52)
    path.write_text(config.as_text(s))
    assert config.load(str(path)) == s
    for wrong in ("unheard: 1", "prepare-dataset:\n  train: 0.9\n  test: 0.9", "slices: [0]"):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            config.load(str(path))


def test_prompt_files_are_read_back(spark, tmp_path):
    prompts = spark.createDataFrame([("7-0", "A1", "one\ntwo"), ("7-1", "A3", "three")], "ROUTE_ID string, anomaly_type string, prompt string")
    files.write_prompt_files(prompts, str(tmp_path / "prompts"))
    got = {(r.stem, r.anomaly_type, r.text.strip()) for r in files.read_prompts(spark, str(tmp_path / "prompts")).collect()}
    assert got == {("route_7-0_A1", "A1", "one\ntwo"), ("route_7-1_A3", "A3", "three")}
