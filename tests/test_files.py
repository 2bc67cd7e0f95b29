"""Files that tasks write, the ledger of answers, review, settings, counts and the staged command line."""

import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidemark import cli, config
from tidemark.config import Settings, parse
from tidemark.operators import dataset, inject, ledger, scoring, strata
from tidemark.plans import catalogue
from tidemark.plans.pipeline import Pipeline
from tidemark.sources import files
from tidemark.sources.ais import events_as_ais
from tidemark.sources.array_files import ArrayFiles
from tidemark.sources.named_files import read_named, write_named

SF = "/root/testdata/sf0.001"
ODD = ["a b:1-0", "50%-1", "x/y-2", "plus+plus-3", "ünï-4", "route_A2-5", "a%2Fb-6"]


def test_prompt_files_have_their_own_names(spark, tmp_path):
    rows = [(i, k, 24, f"text of {i} {k}") for i in ODD for k in ("A1", "A3")]
    prompts = spark.createDataFrame(rows, "ROUTE_ID string, anomaly_type string, T int, prompt string").repartition(3)
    files.write_prompt_files(prompts, f"{tmp_path}/out")
    assert (tmp_path / "out/route_sliced_24/user_query/route_a b:1-0_A1.txt").read_text() == "text of a b:1-0 A1"
    assert len(list((tmp_path / "out/route_sliced_24/user_query").iterdir())) == len(rows)
    got = files.read_prompts(spark, f"file://{tmp_path}/out").collect()
    assert {(r.stem, r.T, r.text) for r in got} == {(f"route_{i}_{k}", 24, t) for i, k, _, t in rows}


def test_files_replace_or_stay_and_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/out"
    make = lambda names: spark.createDataFrame([(n, n.upper()) for n in names], "name string, content string")
    write_named(make(["a", "sub/b"]), folder)
    write_named(make(["b"]), folder, replace=False)
    assert {tuple(r) for r in read_named(spark, folder).collect()} == {("a", "A"), ("sub/b", "SUB/B"), ("b", "B")}
    broken = make(["c", "d", "e", "f"]).repartition(4).withColumn("content", F.when(F.col("name") == "d", F.lit(None)).otherwise(F.col("content")))
    with pytest.raises(Exception, match="NoneType"):
        write_named(broken, folder)
    assert sorted(os.listdir(tmp_path)) == ["out"] and read_named(spark, folder).count() == 3
    write_named(make(["z.gz"]), folder)
    with open(f"{folder}/z.gz", "rb") as f:
        assert f.read() == b"Z.GZ"
    assert [tuple(r) for r in read_named(spark, folder).collect()] == [("z.gz", "Z.GZ")]
    write_named(make(["z"]), folder)
    assert [r.name for r in read_named(spark, folder, "*").collect()] == ["z"]
    assert read_named(spark, f"{tmp_path}/none").count() == 0


def grid(spark, n=60):
    rows = [(f"r{i:03d}", [float(i + k) for k in range(10)], [i % 2, 0], p, 2, m, 7, ("train", "valid", "test")[i % 3]) for i in range(n) for p in (10, 1) for m in ("a1", "a2")]
    return spark.createDataFrame(rows, "route_id string, X array<float>, y array<tinyint>, pct int, T int, mode string, seed int, split string")


def test_array_files_read_back_in_bounded_shards(spark, tmp_path):
    df = grid(spark).repartition(5)
    files.write_npz(df, f"{tmp_path}/npz", rows_per_file=7)
    found = list((tmp_path / "npz").rglob("*.npz"))
    sizes = [np.load(f)["X_seq"].shape for f in found]
    assert sum(s[0] for s in sizes) == 240 and max(s[0] for s in sizes) <= 7 and {s[1:] for s in sizes} == {(2, 5)}
    assert {f.relative_to(tmp_path / "npz").parts[:3] for f in found} == {(p, f"slice_2_{m}", "seed_7") for p in ("10", "1") for m in ("a1", "a2")}
    columns = df.columns
    key = lambda r: (r["route_id"], r["pct"], r["mode"])
    got = sorted(files.read_npz(spark, f"file://{tmp_path}/npz").select(*columns).collect(), key=key)
    assert got == sorted(df.collect(), key=key)


def test_a_failed_array_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(ArrayFiles)
    bad = grid(spark).repartition(4).withColumn("X", F.when(F.col("route_id") == "r007", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("X")))
    with pytest.raises(PythonException):
        files.write_npz(bad, f"{tmp_path}/npz")
    assert os.listdir(tmp_path) == []


def test_answer_files(spark, tmp_path):
    good, bad, broken = 'Yes: {"T": 2, "ü": ["é", 1]} .', "no object", '{"T": }'
    answers = spark.createDataFrame([("a b:1", good), ("b", bad), ("c", broken), ("d", None)], "source_name string, answer string")
    files.write_answer_files(answers.withColumn("scored_at", F.lit("2024-02-03 04:05:06.000007").cast("timestamp_ntz")), f"{tmp_path}/a", "out")
    text = (tmp_path / "a/out_a b:1_20240203-040506-000007.json").read_text()
    assert text == json.dumps({"T": 2, "ü": ["é", 1]}, indent=2, ensure_ascii=False) + "\n"
    assert json.loads((tmp_path / "a/out_b_20240203-040506-000007.json").read_text()) == {"parse_error": "no JSON object", "raw_output": bad}
    (tmp_path / "a/other_x_20240203-040506-000007.json").write_text("{}")
    (tmp_path / "a/out_unstamped.json").write_text("{}")
    got = {r.source_name: (r.answer, str(r.scored_at)) for r in files.read_answers(spark, f"{tmp_path}/a", "out").collect()}
    assert set(got) == {"a b:1", "b", "c", "d", None} and got["b"] == (bad, "2024-02-03 04:05:06.000007") and got["c"][0] == broken


def test_the_latest_plan_file_counts(spark, tmp_path):
    for stamp, k in (("20240101-000000-000009", 1), ("20240101-000001-000000", 2)):
        (tmp_path / f"answer_route_t-1_A1_{stamp}.json").write_text(json.dumps({"T": 4, "anomaly_type": "A1", "K": k, "scores": [0, 0, 1, 1]}))
    plans = files.read_plans(spark, str(tmp_path))
    assert plans.count() == 2 and inject.one_plan_each(plans).first().K == 2


def prompts_of(spark, n):
    return spark.createDataFrame([(f"r{i}", "A1", 1, 4, f"t={i} K = 1") for i in range(n)], "ROUTE_ID string, anomaly_type string, K int, T int, prompt string")


def scorer_that(log, dies_at=None, bad=()):
    """Writes down what it is asked; dies at a prompt, and answers some wrongly at first."""

    def make():
        def scorer(system, text):
            with open(log, "a") as f:
                f.write(text.split()[0] + "\n")
            i = int(text.split()[0][2:])
            if i == dies_at:
                raise RuntimeError("out of memory")
            if i in bad and "refused" not in text:
                return "no"
            return json.dumps({"T": 4, "anomaly_type": "A1", "K": 1, "scores": [0.1, 0.2, 0.3, i / 100]})

        return scorer

    return make


def test_a_scorer_that_dies_is_called_once_for_each_prompt_over_two_runs(spark, tmp_path):
    log, folder, prompts = tmp_path / "log", f"{tmp_path}/ledger", prompts_of(spark, 40).coalesce(1)
    with pytest.raises(PythonException, match="out of memory"):
        ledger.score_with_repairs(prompts, scorer_that(log, dies_at=25), folder)
    asked = Counter(log.read_text().split())
    assert 1 < len(asked) < 40 and set(asked.values()) == {1}
    died = next(a for a in asked if a == "t=25")
    out = ledger.score_with_repairs(prompts, scorer_that(log), folder).collect()
    asked = Counter(log.read_text().split())
    assert len(out) == 40 and asked.pop(died) == 2 and set(asked.values()) == {1} and len(asked) == 39
    again = ledger.score_with_repairs(prompts, scorer_that(log), folder).collect()
    assert sum(Counter(log.read_text().split()).values()) == 41 and {tuple(r) for r in map(str, again)} == {tuple(r) for r in map(str, out)}


def test_repairs_are_bounded_and_kept(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/ledger"
    out = {r.ROUTE_ID: r for r in ledger.score_with_repairs(prompts_of(spark, 6), scorer_that(log, bad={2, 3}), folder, max_retries=2).collect()}
    assert {k: r.attempts for k, r in out.items()} == {"r0": 1, "r1": 1, "r2": 2, "r3": 2, "r4": 1, "r5": 1} and all(r.reason is None for r in out.values())
    assert Counter(log.read_text().split())["t=2"] == 2
    never = {r.ROUTE_ID: (r.attempts, r.reason) for r in ledger.score_with_repairs(prompts_of(spark, 2), lambda: lambda s, t: "no", f"{tmp_path}/other", max_retries=1).collect()}
    assert never == {"r0": (2, "no JSON object"), "r1": (2, "no JSON object")}


def test_a_cut_line_of_the_ledger_is_asked_again(spark, tmp_path):
    log, folder = tmp_path / "log", tmp_path / "ledger"
    ledger.score_with_repairs(prompts_of(spark, 3).coalesce(1), scorer_that(log), str(folder)).collect()
    file = next(folder.glob("*.jsonl"))
    file.write_text(file.read_text()[:-20])
    assert len(ledger.score_with_repairs(prompts_of(spark, 3), scorer_that(log), str(folder)).collect()) == 3
    assert len(log.read_text().split()) == 4


def test_review_and_fix_by_the_command_line(spark, tmp_path, capsys):
    prompt = "K = 3\n" + "\n".join(f"ΔSOG: +{i}.0, ΔCOG: +0.0" for i in range(12))
    rows = [(i, "A1", 12, prompt) for i in ("1-0", "a b:2-0", "3-0")]
    files.write_prompt_files(spark.createDataFrame(rows, "ROUTE_ID string, anomaly_type string, T int, prompt string"), f"{tmp_path}/q")
    good = json.dumps({"T": 12, "anomaly_type": "A1", "K": 3, "scores": [0.1 * (i % 10) + 0.05 for i in range(12)]})
    answers = [("route_1-0_A1", good), ("route_a b:2-0_A1", "no"), ("route_3-0_A1", '{"T": 12}'), ("route_gone_A1", "no")]
    stored = spark.createDataFrame(answers, "source_name string, answer string").withColumn("scored_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    files.write_answer_files(stored, f"{tmp_path}/a", "out")
    args = ["review", "--answers", f"{tmp_path}/a", "--prompts", f"{tmp_path}/q", "--prefix", "out", "--out", f"{tmp_path}/o"]
    assert cli.main(args) == 0
    assert "{'ok': 1, 'bad': 3, 'missing': 1, 'fixed': 0}" in capsys.readouterr().out
    assert cli.main([*args, "--fix"]) == 0
    assert "{'ok': 1, 'bad': 3, 'missing': 1, 'fixed': 2}" in capsys.readouterr().out
    checked = scoring.validated(files.read_answers(spark, f"{tmp_path}/a", "out").withColumns({"anomaly_type": F.lit("A1"), "T": F.lit(12)}))
    assert {r.source_name for r in scoring.latest_valid(checked).collect()} == {"route_1-0_A1", "route_a b:2-0_A1", "route_3-0_A1"}


def test_block_lists_and_unknown_lines():
    text = "slices:\n  - 12\n  - 24\nseed: 3\npreprocess:\n  ratios:\n    - 10\n    - 5\n  trim: 6\nprepare-dataset:\n  modes: [a1]\n  seeds:\n  - 2\n"
    s = config.from_sections(parse(text))
    assert (s.slices, s.T, s.seed, s.percentages, s.trim, s.modes, s.seeds) == ((12, 24), 12, 3, (10, 5), 6, ("a1",), (2,))
    for wrong in ("- 1", "seed 3", "a: 1\n - 2", "just words"):
        with pytest.raises(ValueError, match="not understood"):
            parse(wrong)
    with pytest.warns(UserWarning, match="score.model_id"):
        assert config.from_sections(parse("score:\n  model_id: some/model\n  max_retries: 1")).max_retries == 1


def csv_of_events(spark, path):
    raw = events_as_ais(spark, SF).select("CRAFT_ID", "LON", "LAT", "COURSE", "SPEED", F.col("TIMESTAMP").cast("string"), "TRACK_ID", "src_ord")
    raw.orderBy("src_ord").drop("src_ord").coalesce(1).write.option("header", True).csv(path)


def test_the_staged_command_line_takes_every_length(spark, tmp_path):
    csv_of_events(spark, f"{tmp_path}/in")
    (tmp_path / "config.yaml").write_text("slices:\n  - 6\n  - 12\ntrim: 6\nmin_track_len: 20\npreprocess:\n  ratios: [10]\nprepare-dataset:\n  modes: [a1, a2]\n  seeds: [2]\n")
    common = ["--config", f"{tmp_path}/config.yaml", "--out", f"{tmp_path}/out"]
    for stage in ("preprocess", "score", "inject", "prepare-dataset"):
        assert cli.main([stage, "--input", f"{tmp_path}/in", *common]) == 0
    for t in (6, 12):
        assert {r[0] for r in spark.read.parquet(f"{tmp_path}/out/{t}h/dataset").select(F.size("X_seq")).distinct().collect()} == {t}


def test_counts_come_from_the_writes(spark, tmp_path):
    raw = events_as_ais(spark, SF).withColumn("TIMESTAMP", F.col("TIMESTAMP").cast("string"))
    flow = Pipeline(spark, Settings(percentages=(10, 1), modes=("a1", "a2"), seeds=(2,)))
    flow.run(raw, f"{tmp_path}/out")
    table = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}")
    index, asked, injected = table("indices"), table("prompts"), table("injected")
    tiers = {f"{m}_{p}pct": index.filter((F.col("mode") == m) & F.col(f"use_{p}pct")).count() for m in ("a1", "a2") for p in (10, 1)}
    assert flow.counts["indices"] == {"rows": index.count(), **tiers}
    assert flow.counts["prompts"] == {"prompts": asked.count(), "a1": asked.filter("anomaly_type = 'A1'").count(), "a2": asked.filter("anomaly_type = 'A2'").count()}
    assert flow.counts["answers"]["valid"] + flow.counts["answers"]["refused"] == asked.count()
    recount = inject.counters(injected).first().asDict()
    assert {k: flow.counts["injected"][k] for k in ("routes_total", "a3_routes", "rows", "anomalous_rows")} == {k: recount[k] for k in ("routes_total", "a3_routes", "rows", "anomalous_rows")}
    assert sum(flow.counts["injected"][f"a{i}_rows"] for i in (1, 2, 3)) == recount["anomalous_rows"]


def test_numbered_files_come_first(spark, tmp_path):
    for n in ("10_A1.txt", "b_A1.txt", "9.txt", "10.txt", "a.txt"):
        (tmp_path / n).write_text("x")
    assert [r.stem for r in files.by_number(files.whole_files(spark, str(tmp_path), "*.txt")).collect()] == ["9", "10", "10_A1", "a", "b_A1"]


def test_labels_of_virtual_vessels(spark):
    index = strata.indices(strata.route_stats(catalogue.routes(spark, SF)), 12)
    allowed = {r[0] for r in dataset.allowed_routes(index, 10, "a3").collect()}
    assert allowed == {p + r[0] for r in index.filter("mode = 'a3' AND use_10pct").select("ROUTE_ID").collect() for p in ("", "A3_")}
