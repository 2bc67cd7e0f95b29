"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only.

Every input partition is one run: its rows' digests, sorted. Runs are merged in
binomial rounds. In round ``r`` the runs whose numbers agree above bit ``r * bits``
meet, keyed by (merged run, digest), and each digest keeps the identifier that
stays and the number of copies. A digest that a third of all rows share has at
most one row per run after the first round and ``2 ** bits`` rows per key in every
later one, so no round gathers a group in one task. The decisions then go back
down the same tree, and a document meets them under (its own run, digest).

Equal means equal SHA-256, byte length and 64-bit xxHash of the normalised text;
all three are in the key of every merge.

Defined results: a null text is the empty text. Of rows equal in text *and*
doc_id one stays (whichever the pinned row number orders last). A null doc_id
counts as smaller than any other. An empty table gives an empty result. Columns
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import lower_ascii, pin

KEY = ["sha", "n_bytes", "xx"]


def digest_runs(numbered: DataFrame) -> DataFrame:
    """(doc_id, row, run, sha, n_bytes, xx) of (doc_id, text, row), each run sorted by digest, written once."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return pin(
        numbered.select("doc_id", "row", text.alias("norm"))
        .select(
            "doc_id",
            "row",
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("xx"),
        )
        .sortWithinPartitions("run", *KEY)
    )


def merge_round(level: DataFrame, key: list[str], bits: int, keep: Callable[[str], Column]) -> DataFrame:
    """One round: runs that share all but their last ``bits`` bits become one run."""
    return (
        level.withColumn("run", F.shiftright("run", bits))
        .groupBy("run", *key)
        .agg(keep("best").alias("best"), F.sum("copies").alias("copies"))
    )


def tree_merge(
    runs: DataFrame, key: list[str], bits: int, best: Column, keep: Callable[[Column | str], Column]
) -> DataFrame:
    """(run, *key, best, copies): for every key of every run, what the whole tree keeps.

    ``runs`` must be pinned. The way up merges; the way down hands each run the
    decision on its own keys, at most ``2 ** bits`` rows for a key at each level.
    """
    levels = [runs.groupBy("run", *key).agg(keep(best).alias("best"), F.count(F.lit(1)).alias("copies"))]
    top = runs.agg(F.max("run")).first()[0] or 0
    while top:
        levels.append(merge_round(levels[-1], key, bits, keep))
        top >>= bits
    decided = levels.pop()
    while levels:
        below = levels.pop().select("run", *key).withColumn("up", F.shiftright("run", bits))
        above = decided.withColumnRenamed("run", "up")
        decided = below.join(above, ["up", *key]).select("run", *key, "best", "copies")
    return decided


def _decisions(numbered: DataFrame, bits: int) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 of each row of (doc_id, text, row)."""
    runs = digest_runs(numbered)
    decided = tree_merge(runs, KEY, bits, F.struct("doc_id", "row"), F.max)
    return runs.join(decided, ["run", *KEY]).select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("copies").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after lower-casing A-Z; the largest doc_id of a group stays.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return _decisions(numbered, bits).drop("row")


def drop_exact_copies(docs: DataFrame, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows are pinned with a number and dropped by it, so null and repeated doc_ids
    are decided like any other: one row of each text stays.
    """
    marked = pin(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    numbered = marked.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row")
    kept = _decisions(numbered, bits).filter("kept").select("row")
    # One path for all sizes: few rows would be broadcast, more of them shuffle the texts.
    return marked.join(kept.hint("merge"), "row", "left_semi").select("doc.*")
