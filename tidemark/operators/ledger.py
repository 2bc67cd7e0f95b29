"""Scoring that can be taken up again: every answer is in a ledger as soon as it is there, and no prompt with an answer is asked again.

The ledger is a folder of JSON lines. A task appends a line to a file of its own after each call, so a job that
dies leaves what it was told, and so does a task that is tried again: it looks first for what its earlier
tries wrote. A scorer that fails fails the job; the next run asks what is still open.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_query
from tidemark.operators.scoring import Scorer, system_text, validated
from tidemark.sources.staged import opened

LINE = "prompt_hash string, attempt int, answer string, seconds double, scored_at timestamp_ntz"


def prompt_hash() -> Column:
    """A prompt's name in the ledger: its type, K, T and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\n", part("ROUTE_ID"), part("anomaly_type"), part("K"), part("T"), part("prompt")), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Whole lines of the ledger, the first for each prompt and attempt."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    lines = spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(folder).filter("prompt_hash IS NOT NULL AND answer IS NOT NULL")
    first = W.partitionBy("prompt_hash", "attempt").orderBy("scored_at", "answer")
    return lines.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def ask(prompts: DataFrame, make_scorer: Callable[[], Scorer], folder: str, attempt: int) -> int:
    """Asks (prompt_hash, anomaly_type, prompt) and writes the answers down; returns how many there were."""
    job = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, root = opened(folder)
        mine = f"{job}-{context.partitionId()}-"
        earlier = [f for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(mine)]
        told = set()
        for f in earlier:
            with store.open_input_stream(f.path) as held:
                lines = held.read().decode(errors="replace").split("\n")[:-1]
            told.update(json.loads(line)["prompt_hash"] for line in lines)
        scorer, out, n = None, None, 0
        try:
            for frame in frames:
                for key, kind, text in zip(frame["prompt_hash"], frame["anomaly_type"], frame["prompt"]):
                    if key in told:
                        continue
                    scorer = scorer or make_scorer()
                    began = time.monotonic()
                    answer = scorer(system_text(kind), text)
                    at = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds")
                    line = {"prompt_hash": key, "attempt": attempt, "answer": answer, "seconds": time.monotonic() - began, "scored_at": at}
                    out = out or store.open_output_stream(f"{root}/{mine}{context.attemptNumber()}-{uuid.uuid4().hex}.jsonl")
                    out.write((json.dumps(line, ensure_ascii=False) + "\n").encode())
                    out.flush()
                    n += 1
        finally:
            if out:
                out.close()
        yield pd.DataFrame({"n": [n]})

    return prompts.select("prompt_hash", "anomaly_type", "prompt").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def repair_text() -> Column:
    """What is asked after a refused answer: the prompt, the reason and that answer."""
    return F.concat(
        F.col("prompt"), F.lit("\n\nThe answer was refused: "), F.col("reason"),
        F.lit(". Give the JSON object again, whole and nothing else. It was:\n"), F.col("answer"),
    )


def score_with_repairs(prompts: DataFrame, make_scorer: Callable[[], Scorer], folder: str, max_retries: int = 3) -> DataFrame:
    """(ROUTE_ID, anomaly_type, K, T, answer, reason, scores, attempts, seconds, scored_at) of every prompt with a text.

    A refused prompt is asked again, ``max_retries`` times at most; the last answer counts. ``folder`` is the
    ledger. Prompts that are the same in all their columns are one.
    """
    spark = prompts.sparkSession
    asked = prompts.select("ROUTE_ID", "anomaly_type", "K", "T", clean_query(F.col("prompt")).alias("prompt")).filter("prompt != ''")
    asked = asked.withColumn("prompt_hash", prompt_hash()).dropDuplicates(["prompt_hash"])
    todo, out = asked, None
    for attempt in range(1, max_retries + 2):
        done = read_ledger(spark, folder).filter(F.col("attempt") == attempt)
        open_ = todo.join(done, "prompt_hash", "left_anti")
        if not open_.isEmpty():
            ask(open_, make_scorer, folder, attempt)
            done = read_ledger(spark, folder).filter(F.col("attempt") == attempt)
        told = todo.select("prompt_hash").join(done, "prompt_hash").join(asked, "prompt_hash")
        checked = validated(told.withColumnRenamed("K", "asked_K")).withColumnRenamed("attempt", "attempts")
        bad, last = checked.filter("reason IS NOT NULL"), attempt == max_retries + 1
        part = checked if last else checked.filter("reason IS NULL")
        out = part if out is None else out.unionByName(part)
        if last or bad.isEmpty():
            break
        todo = bad.select("prompt_hash", "anomaly_type", repair_text().alias("prompt"))
    return out.drop("asked_K", "prompt")
