"""Stretches: runs of places with one mark, of which equal ones are read once.

A mark is something that a string of fixed length settles by itself (its least gram, a
symbol inside it), so equal strings have equal marks at equal places in them. A
*stretch* is a run of places whose strings have one and the same mark; it is named by
all that its strings hold. Where two stretches are equal so are their strings, place by
place; and a string that stands twice stands in two stretches with one mark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import pin

#: Mark, first place and the place after the last one, and a 128-bit name of what the stretch holds.
STRETCHES = "array<struct<mark:long,begin:int,end:int,x1:long,x2:long>>"


def runs_of(begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a new run of stretches starts: another text, or not right after the one before."""
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] != end[:-1]) | (text[1:] != text[:-1])
    return np.flatnonzero(new)


def found_marks(profile: DataFrame, firsts: DataFrame, marks: str) -> DataFrame:
    """(row, found): of each row in ``firsts`` those of its marks that stand at two places; ``profile`` lists them by row."""
    each = profile.filter(F.size(marks) > 0).join(firsts, "row", "left_semi").select("row", F.explode(marks).alias("mark"))
    # Pinned, so that Spark can split the join at marks with very many holders.
    shared = pin(each.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("mark"))
    return each.join(shared, "mark", "left_semi").groupBy("row").agg(F.collect_set("mark").alias("found"))


def judged_stretches(strings: DataFrame) -> DataFrame:
    """(row, at, stretches) of (row, at, stretches); a stretch becomes (begin, end, equal, enters).

    ``equal``: what it holds stands elsewhere too. ``enters``: its strings must be compared
    with those of other stretches; equal stretches enter once, and not at all where each
    stretch with that mark has an equal.
    """
    each = strings.select("row", "at", F.explode("stretches").alias("s")).select("row", "at", "s.*")
    name = ["x1", "x2"]
    names = each.groupBy(*name).agg(
        F.min("mark").alias("mark"), F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "begin")).alias("first")
    )
    open_marks = names.groupBy("mark").agg(F.min("times").alias("least")).filter("least = 1").select("mark", F.lit(True).alias("open"))
    kinds = names.join(open_marks, "mark", "left").select(*name, "times", "first", F.coalesce("open", F.lit(False)).alias("open"))
    is_first = F.struct("row", "begin") == F.col("first")
    return (
        each.join(kinds, name)
        .select("row", "at", F.struct("begin", "end", (F.col("times") > 1).alias("equal"), (F.col("open") & is_first).alias("enters")).alias("s"))
        .groupBy("row", "at")
        .agg(F.sort_array(F.collect_list("s")).alias("stretches"))
    )


def equal_starts(judged: DataFrame) -> DataFrame:
    """(row, starts): ranges of places whose string stands in an equal stretch too."""
    equal = judged.select("row", F.filter("stretches", lambda s: s["equal"]).alias("starts")).filter(F.size("starts") > 0)
    return equal.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
