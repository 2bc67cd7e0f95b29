"""Counts that a write gathers on its way, in place of a second pass over what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, **what: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds the counts once an action has run over all of it."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in what.items()]), seen


def counts_of(seen: Observation) -> dict[str, int]:
    """The counts as numbers; 0 where nothing was counted. Waits for the action to end."""
    return {k: v or 0 for k, v in seen.get.items()}


def tier_counts(indices: DataFrame, percentages, modes) -> tuple[DataFrame, Observation]:
    """Routes in each sample of each mode, as ``{mode}_{pct}pct``."""
    tier = lambda m, p: F.count_if((F.col("mode") == m) & F.col(f"use_{p}pct"))
    return counted(indices, rows=F.count(F.lit(1)), **{f"{m}_{p}pct": tier(m, p) for m in modes for p in percentages})


def prompt_counts(prompts: DataFrame, modes) -> tuple[DataFrame, Observation]:
    """Prompts in all and of each type."""
    return counted(prompts, prompts=F.count(F.lit(1)), **{m: F.count_if(F.col("anomaly_type") == m.upper()) for m in modes})


def answer_counts(answers: DataFrame) -> tuple[DataFrame, Observation]:
    """Prompts that ended with a valid and with a refused answer, and the calls that they took."""
    good = F.col("reason").isNull()
    return counted(answers, valid=F.count_if(good), refused=F.count_if(~good), calls=F.sum("attempts"))


def injection_counts(injected: DataFrame) -> tuple[DataFrame, Observation]:
    """Host routes, virtual ones, rows, and the anomalous rows of each type."""
    host, first = ~F.col("ROUTE_ID").startswith("A3_"), F.col("T_INDEX") == 0
    kinds = {f"{k.lower()}_rows": F.count_if(F.col("ANOMALY") & (F.col("ANOMALY_TYPE") == k)) for k in ("A1", "A2", "A3")}
    return counted(
        injected, routes_total=F.count_if(host & first), a3_routes=F.count_if(~host & first), rows=F.count(F.lit(1)),
        anomalous_rows=F.count_if(F.col("ANOMALY")), **kinds,
    )
