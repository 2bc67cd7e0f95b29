"""``python -m tidemark.cli STAGE ...``: preprocess, score, inject, prepare-dataset, pipeline, review or config."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Settings, as_text, load
from tidemark.operators import ledger, scoring
from tidemark.plans.pipeline import Pipeline
from tidemark.session import build_session
from tidemark.sources.ais import monthly_files, read_csv, read_monthly
from tidemark.sources.files import read_answers, read_plans, read_prompts, write_answer_files, write_table
from tidemark.sources.hourly_table import HourlyTable, discover
from tidemark.sources.kept import keep


def positions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Raw positions of --input, or what is found below --data; with --cache the hourly table that is kept there, brought up to date."""
    if a.cache and a.stage == "preprocess":
        paths = discover(spark, a.data) if not a.input else monthly_files(spark, a.input) if a.monthly else [a.input]
        return HourlyTable(spark, a.cache).refresh(paths)
    if a.input:
        return read_monthly(spark, a.input) if a.monthly else read_csv(spark, a.input)
    return read_csv(spark, discover(spark, a.data))


def one_stage(stage: str, flow: Pipeline, out: str, raw: DataFrame | None, plans_folder: str | None) -> None:
    """A stage for one length of routes, from and to the tables of its folder."""
    spark = flow.spark
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    if stage == "preprocess":
        routes, index, asked = flow.from_grid(raw) if "built" in raw.columns else flow.preprocess(raw)
        for name, df in (("routes", routes), ("indices", index), ("prompts", asked)):
            write_table(df, f"{out}/{name}")
    elif stage == "score":
        answers = write_table(flow.score(table("prompts"), scoring.rule_scorer, f"{out}/ledger"), f"{out}/answers")
        write_table(flow.plans(answers), f"{out}/plans")
    elif stage == "inject":
        plans = read_plans(spark, plans_folder) if plans_folder else table("plans")
        write_table(flow.inject(table("routes"), plans), f"{out}/injected")
    else:
        write_table(flow.prepare(table("injected"), table("indices")), f"{out}/dataset", ("pct", "T", "mode", "seed", "split"))


def review_stage(flow: Pipeline, a: argparse.Namespace) -> DataFrame:
    """Counts of stored answers; with --fix bad ones are asked for again and stored beside them."""
    stored, queries = read_answers(flow.spark, a.answers, a.prefix), read_prompts(flow.spark, a.prompts)
    reviewed = scoring.review(stored, queries)
    if not a.fix:
        return scoring.review_summary(reviewed)
    reviewed = keep(reviewed)
    fixed = keep(ledger.score_with_repairs(scoring.to_fix(reviewed), scoring.rule_scorer, f"{a.out}/ledger", flow.s.max_retries))
    write_answer_files(fixed.withColumnRenamed("ROUTE_ID", "source_name"), a.answers, a.prefix)
    return scoring.review_summary(reviewed, fixed)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("stage", choices=("preprocess", "score", "inject", "prepare-dataset", "pipeline", "review", "config"))
    p.add_argument("--input", help="a CSV of positions, or a folder of monthly files with --monthly")
    p.add_argument("--monthly", action="store_true")
    p.add_argument("--data", default="data", help="where positions are looked for without --input")
    p.add_argument("--cache", help="with preprocess: a folder in which the hourly table is kept between runs")
    p.add_argument("--out", default="data")
    p.add_argument("--plans", help="a folder of plan files, used by inject in place of scored answers")
    p.add_argument("--answers", help="with review: the folder of answer files")
    p.add_argument("--prompts", help="with review: the folder of prompt files")
    p.add_argument("--prefix", default="answer", help="with review: what the names of answer files begin with")
    p.add_argument("--fix", action="store_true", help="with review: ask again where an answer is bad")
    p.add_argument("--config")
    p.add_argument("--write-config", help="with config: the file to write the settings to")
    for name, kind in (("T", int), ("trim", int), ("min-track-len", int), ("seed", int), ("theta-g", float), ("theta-v", float)):
        p.add_argument(f"--{name}", type=kind)
    a = p.parse_args(argv)
    given = {k: getattr(a, k) for k in ("T", "trim", "min_track_len", "seed", "theta_g", "theta_v")}
    settings: Settings = load(a.config).merged(**given, slices=None if a.T is None else [a.T]).check()
    if a.stage == "config":
        if a.write_config:
            Path(a.write_config).write_text(as_text(settings))
        else:
            print(as_text(settings), end="")
        return 0
    a.input = a.input or settings.input_csv
    spark = build_session()
    whole = Pipeline(spark, settings)
    if a.stage == "review":
        print(review_stage(whole, a).first().asDict())
        return 0
    raw = None
    if a.stage in ("preprocess", "pipeline"):
        raw = positions(spark, a)
    if a.stage == "pipeline":
        whole.run(raw, a.out)
        print(whole.counts)
        return 0
    for flow, out in whole.lengths(a.out):
        one_stage(a.stage, flow, out, raw, a.plans)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
