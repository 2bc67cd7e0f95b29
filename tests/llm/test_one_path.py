"""Joins that shuffle on large tables do so on small ones, so that what a small run needs tells what a large one will."""

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_join
from tidemark.llm._common import pin


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_texts_that_stay_are_met_by_a_shuffle(docs):
    kept = exact_dedup.drop_exact_copies(docs(["one two", "One two", "three"])).select("doc_id")
    plan = final_plan(kept)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert any("SortMergeJoin" in x and "LeftSemi" in x for x in plan.splitlines()), plan


def test_sketches_of_pairs_are_met_by_a_shuffle(spark, docs):
    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61)), " ".join(f"v{i}" for i in range(60))]
    base = pin(docs(texts).select("doc_id", "text", F.col("doc_id").alias("row")))
    profile = pin(near_join.set_profile(base, 4, 85, 100))
    pairs = pin(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"))
    found = near_join.possible(pairs, profile, 85)
    plan = final_plan(found)
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan, plan
