"""The four stages chained: each takes and returns DataFrames; ``run`` writes what must not be made twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession

from tidemark.config import Settings
from tidemark.operators import counts, dataset, inject, ledger, prompts, scoring, strata, tracks
from tidemark.sources.files import write_table


class Pipeline:
    """``points`` are raw positions with ``src_ord``; see ``sources.ais``."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.s = spark, (settings or Settings()).check()
        #: What ``run`` counted while it wrote, by stage.
        self.counts: dict[str, dict[str, int]] = {}

    def preprocess(self, raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(routes, indices, prompts) of raw positions."""
        return self.from_grid(tracks.hourly(tracks.keep_first(tracks.clean(raw.drop("TYPE", "MONTH")))))

    def from_grid(self, grid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(routes, indices, prompts) of hourly points."""
        s = self.s
        routes = tracks.cut_routes(grid, s.T, s.trim, s.min_track_len)
        index = strata.indices(strata.route_stats(routes), s.T, s.modes, s.n_bins, s.percentages, s.seed)
        return routes, index, prompts.prompts(routes, index, s.T, s.percentages)

    def score(self, asked: DataFrame, make_scorer: Callable, folder: str) -> DataFrame:
        """Answers with what is wrong with them; ``folder`` holds those of this and of earlier runs."""
        return ledger.score_with_repairs(asked, make_scorer, folder, self.s.max_retries)

    def plans(self, answers: DataFrame) -> DataFrame:
        """The valid answers."""
        return answers.filter("reason IS NULL").select("ROUTE_ID", "anomaly_type", "T", "K", "scores", "scored_at")

    def lengths(self, out: str) -> list[tuple[Pipeline, str]]:
        """A pipeline and a folder for each length of routes: ``out`` itself for one, a folder each below it for several."""
        if len(self.s.slices) < 2:
            return [(self, out)]
        return [(Pipeline(self.spark, replace(self.s, T=t, slices=(t,))), f"{out}/{t}h") for t in self.s.slices]

    def inject(self, routes: DataFrame, plans: DataFrame) -> DataFrame:
        return inject.apply_plans(routes, plans, self.s.seed, self.s.theta_g, self.s.theta_v)

    def prepare(self, injected: DataFrame, index: DataFrame) -> DataFrame:
        s = self.s
        return dataset.dataset_grid(injected, index, s.T, s.grid_percentages or s.percentages, s.modes, s.seeds, s.train, s.valid)

    def run(self, raw: DataFrame, out: str, make_scorer: Callable = scoring.rule_scorer) -> DataFrame:
        """All stages; routes, indices, answers, injected rows and the dataset are tables under ``out``.

        With several ``slices`` each has a folder of its own below ``out``, and their datasets are returned as one.
        """
        if len(self.s.slices) > 1:
            return reduce(DataFrame.unionByName, [flow.run(raw, folder, make_scorer) for flow, folder in self.lengths(out)])
        routes, index, _ = self.preprocess(raw)
        routes = write_table(routes, f"{out}/routes")
        faults = tracks.route_faults(routes, self.s.T)
        if not faults.isEmpty():
            raise ValueError(f"routes are not whole: {faults.limit(5).collect()}")
        index = self.written("indices", counts.tier_counts(index, self.s.percentages, self.s.modes), f"{out}/indices", ("T", "mode"))
        asked = prompts.prompts(routes, index, self.s.T, self.s.percentages)
        asked = self.written("prompts", counts.prompt_counts(asked, self.s.modes), f"{out}/prompts")
        answers = self.written("answers", counts.answer_counts(self.score(asked, make_scorer, f"{out}/ledger")), f"{out}/answers")
        plans = write_table(self.plans(answers), f"{out}/plans")
        injected = self.written("injected", counts.injection_counts(self.inject(routes, plans)), f"{out}/injected")
        return write_table(self.prepare(injected, index), f"{out}/dataset", ("pct", "T", "mode", "seed", "split"))

    def written(self, name: str, counting: tuple[DataFrame, Observation], path: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Writes a table and keeps what the write counted."""
        df, seen = counting
        table = write_table(df, path, by)
        self.counts[name] = counts.counts_of(seen)
        return table
