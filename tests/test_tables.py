"""The kept hourly table, typed CSV, and numbers as text."""

import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions.scalars import fixed_point
from tidemark.operators import strata, tracks
from tidemark.plans import catalogue
from tidemark.sources import csv_tables
from tidemark.sources.ais import monthly_paths, read_csv
from tidemark.sources.hourly_table import HourlyTable, discover, grid_base

SF = "/root/testdata/sf0.001"
HEAD = "CRAFT_ID,LON,LAT,COURSE,SPEED,TIMESTAMP,Track_ID\n"


def month(base, name, rows, kind="cargo"):
    path = next(p for p in monthly_paths(str(base), (2019,), (kind,)) if f"MPF_{name}_" in p)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HEAD + "".join(f"7,{lon},-30,90,10,{stamp},{track}\n" for track, stamp, lon in rows))
    return path


def day(track, date, hours=12, lon=100.0):
    return [(track, f"{date} {h:02d}:00:00", lon + h) for h in range(hours)]


def of(df):
    return sorted((r.TRACK_ID, str(r.TIMESTAMP), r.LON) for r in df.collect())


def made(spark, paths):
    return of(tracks.hourly(tracks.keep_first(tracks.clean(read_csv(spark, paths)))))


def builds(df):
    return {r.TRACK_ID: r.built for r in df.select("TRACK_ID", "built").distinct().collect()}


def test_only_tracks_of_changed_files_are_built_again(spark, tmp_path):
    month(tmp_path, "Jan", day("a", "2019-01-05") + day("both", "2019-01-31"))
    feb = month(tmp_path, "Feb", day("b", "2019-02-05") + day("both", "2019-02-01"))
    month(tmp_path, "Mar", day("c", "2019-03-05"))
    paths = discover(spark, str(tmp_path))
    assert len(paths) == 3
    table = HourlyTable(spark, f"{tmp_path}/kept", buckets=4)
    assert of(table.refresh(paths)) == made(spark, paths) and set(builds(table.read()).values()) == {1}
    assert builds(table.refresh(paths)) == {"a": 1, "b": 1, "both": 1, "c": 1}
    # One month changes: it loses track b, changes both, and gains d.
    time.sleep(1.1)
    month(tmp_path, "Feb", day("d", "2019-02-07") + day("both", "2019-02-02", lon=50.0))
    assert of(table.refresh(paths)) == made(spark, paths) and builds(table.read()) == {"a": 1, "both": 2, "c": 1, "d": 2}
    # A month goes, and comes back.
    less = [p for p in paths if p != feb]
    assert of(table.refresh(less)) == made(spark, less) and builds(table.read()) == {"a": 1, "both": 3, "c": 1}
    assert of(table.refresh(paths)) == made(spark, paths) and builds(table.read()) == {"a": 1, "both": 4, "c": 1, "d": 4}


def test_a_refresh_that_died_is_taken_up(spark, tmp_path, monkeypatch):
    month(tmp_path, "Jan", day("a", "2019-01-05") + day("gone", "2019-01-07"))
    paths = discover(spark, str(tmp_path))
    table = HourlyTable(spark, f"{tmp_path}/kept", buckets=2)
    table.refresh(paths)
    time.sleep(1.1)
    month(tmp_path, "Jan", day("a", "2019-01-06"))
    monkeypatch.setattr(HourlyTable, "build", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.refresh(paths)
    monkeypatch.undo()
    assert of(table.refresh(paths)) == made(spark, paths) and set(builds(table.read())) == {"a"}


def test_discovery(spark, tmp_path):
    with pytest.raises(ValueError):
        discover(spark, str(tmp_path))
    month(tmp_path / "West Grid", "Jan", day("a", "2019-01-05"), "tanker")
    assert grid_base(spark, str(tmp_path)).endswith("/West Grid") and len(discover(spark, str(tmp_path))) == 1
    (tmp_path / "positions.csv").write_text(HEAD)
    assert discover(spark, str(tmp_path)) == [f"{tmp_path}/positions.csv"]


def test_the_command_line_keeps_the_hourly_table(spark, tmp_path):
    rows = [(t, f"2019-01-{d:02d} {h:02d}:00:00", 100.0 + h + d) for t in ("a", "b") for d in range(1, 5) for h in range(24)]
    month(tmp_path / "data", "Jan", rows)
    args = ["preprocess", "--data", f"{tmp_path}/data", "--cache", f"{tmp_path}/kept", "--out"]
    assert cli.main([*args, f"{tmp_path}/o1"]) == 0 and cli.main([*args, f"{tmp_path}/o2"]) == 0
    assert spark.read.parquet(f"{tmp_path}/kept/hourly").count() == len(rows)
    one, two = (spark.read.parquet(f"{tmp_path}/{o}/routes").orderBy("ROUTE_ID", "ROUTE_POINT_IDX").collect() for o in ("o1", "o2"))
    assert one == two and len(one) == 2 * 72


def test_indices_and_injected_rows_go_through_csv(spark, tmp_path):
    index = strata.indices(strata.route_stats(catalogue.routes(spark, SF)), 12)
    csv_tables.write_indices(index, f"{tmp_path}/i")
    back, bad = csv_tables.read_indices(spark, f"{tmp_path}/i")
    assert bad.count() == 0 and back.exceptAll(index).count() == 0 and index.exceptAll(back).count() == 0
    injected = catalogue.injected(spark, SF).cache()
    csv_tables.write_injected(injected, f"{tmp_path}/p", bom=True)
    part = next(f for f in os.listdir(tmp_path / "p") if f.endswith(".csv"))
    assert (tmp_path / "p" / part).read_bytes().startswith(b"\xef\xbb\xbfROUTE_ID,")
    back, bad = csv_tables.read_injected(spark, f"{tmp_path}/p")
    assert bad.count() == 0 and back.exceptAll(injected.select(*back.columns)).count() == 0 and back.count() == injected.count()


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    lines = ["﻿ROUTE_ID,stratum,use_10pct,K", 'r1,"s, (1]",True,3', "r2,s,false,x", "r3,s", "r4,,TRUE,", "r5,s,False,6,more", "r6,s,,9"]
    (tmp_path / "T=12" / "mode=a1").mkdir(parents=True)
    (tmp_path / "T=12" / "mode=a1" / "x.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows, bad = csv_tables.read_indices(spark, str(tmp_path), (10,))
    assert sorted((r.ROUTE_ID, r.stratum, r.use_10pct, r.K, r["T"], r["mode"]) for r in rows.collect()) == [
        ("r1", "s, (1]", True, 3, 12, "a1"), ("r4", None, True, None, 12, "a1"), ("r6", "s", None, 9, 12, "a1"),
    ]
    assert sorted(r.line for r in bad.collect()) == ["r2,s,false,x", "r3,s", "r5,s,False,6,more"]


def doubles(n):
    rng = random.Random(11)
    out = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 0.25, 0.35, 0.125, 2.675, 1e-9, -1e-9, -0.0004, 0.0005, 0.9996, 999.9995, 4503599627370495.5, 9e12, 1e22, -8e12 - 1 / 1024, float("inf"), -float("inf"), float("nan")]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            out.append(rng.uniform(-400, 400))
        elif kind == 1:
            out.append((2 * rng.randrange(-10_000, 10_000) + 1) / 2 ** rng.randrange(1, 8))
        elif kind == 2:
            out.append(rng.randrange(-10**7, 10**7) / 10 ** rng.randrange(1, 8))
        elif kind == 3:
            x = (2 * rng.randrange(10**6) + 1) / 2 / 10 ** rng.choice([1, 3, 6])
            out.append(struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", x))[0] + rng.randrange(-2, 3)))[0])
        else:
            out.append(rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 12))
    return out


def test_decimal_text_is_pythons(spark):
    values = doubles(100_000)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shapes = [(1, False), (3, False), (6, False), (1, True), (3, True)]
    rows = df.select("x", *[fixed_point(F.col("x"), p, s).alias(f"p{p}{s}") for p, s in shapes]).collect()
    wrong = [(r.x, p, got) for r in rows for (p, s), got in zip(shapes, r[1:]) if got != f"{r.x:{'+' if s else ''}.{p}f}"]
    assert wrong == [] and df.limit(0).select(fixed_point(F.col("x"), 3)).collect() == []
    assert spark.range(1).select(fixed_point(F.lit(None).cast("double"), 3)).first()[0] is None
