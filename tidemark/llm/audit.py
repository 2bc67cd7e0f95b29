"""Audit of five filters in every order, from Walsh-Hadamard sums of their failures.

A document's failures are a mask of five bits. For each part and label, 32 parity sums
are aggregated, each the sum of +1 or -1 by the parity of the failures that a subset of
the filters selects; a task sends one row of 32 sums for a part and label, however many
documents it has. The transform is its own inverse up to a factor of 32, so the sums give
back exactly how many documents have each mask. What a filter removes depends only on the
set of filters before it: 80 cases a part, from which the 120 orders are read. A document
that fails k filters is removed by each of them in 120 / k orders, which sums to Shapley's
value without going through the orders.

Whether a text stands under a smaller doc_id is decided by SHA-256 and length: the least
doc_id of each digest is aggregated, and a row looks for itself under (digest, doc_id), a
key that no group of copies makes hot.

Defined results: a null text is empty, a null source is the part ''. A text without words
fails A and not B. Rows equal in text and doc_id both count, and neither is the other's
copy. A null doc_id is neither smaller nor larger than another, and has no label. Where
``labels`` has a doc_id several times, one row with quality 1 makes it good and one with
toxic 1 toxic. An empty table gives an empty result. Texts of any length are judged whole;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, pin

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: What the contract counts as a document's identity.
DIGEST = ["sha", "n_bytes"]
COPY = MASKS >> 1


def failures(docs: DataFrame, least_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, symbols: str = "[#$%&*|]") -> DataFrame:
    """(doc_id, part, mask, sha, n_bytes), written once: the failures that a text shows by itself, and its digest."""
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    sized = words.withColumns({"n_words": F.size("words").cast("long"), "n_distinct": F.size(F.array_distinct("words")).cast("long")})
    fails = (
        F.col("n_words") < least_words,
        100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > upper_percent * F.char_length("text").cast("long"),
        F.col("text").rlike(symbols),
    )
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)), F.lit(0))
    return pin(sized.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n_bytes")))


def with_copies(rows: DataFrame) -> DataFrame:
    """The mask completed by its last bit: the text stands under a smaller doc_id."""
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy(*DIGEST).agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = known.join(first, [*DIGEST, "doc_id"], "left")
    mask = F.col("mask") + F.when(F.col("first").isNull(), COPY).otherwise(0)
    out = met.select("doc_id", "part", mask.alias("mask"))
    return out.unionByName(rows.filter("doc_id IS NULL").select(*out.columns))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` of each row."""
    good, toxic = F.coalesce(F.max(labels["quality"] == 1), F.lit(False)), F.coalesce(F.max(labels["toxic"] == 1), F.lit(False))
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("good"), toxic.alias("toxic")).filter("good OR toxic")
    known = rows.filter("doc_id IS NOT NULL").join(one, "doc_id", "left").select("part", "mask", "good", "toxic")
    unknown = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.fillna(False, ["good", "toxic"]).unionByName(unknown)


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed sums of each part and label."""
    sign = lambda s: F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 0, 1).otherwise(-1)
    summed = rows.groupBy("part", "good", "toxic").agg(*[F.sum(sign(s)).alias(f"w{s}") for s in range(MASKS)])
    return summed.select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(MASKS)]).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, cells): for each mask how many documents of the part have it, in all, good and toxic."""
    back = f"""transform(sequence(0, {MASKS - 1}), m -> aggregate(sequence(0, {MASKS - 1}), 0L,
        (t, s) -> t + if(bit_count(m & s) % 2 = 0, sums[s], -sums[s])) div {MASKS})"""
    one = sums.select("part", "good", "toxic", F.posexplode(F.expr(back)).alias("mask", "n"))
    of = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label)
    cells = one.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))
    return cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def cases(cells: DataFrame) -> DataFrame:
    """One row for each part, filter and set of filters before it."""
    spread = cells.select("part", "cells", F.explode(F.sequence(F.lit(0), F.lit(MASKS - 1))).alias("before"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("at")).withColumn("bit", F.expr("shiftleft(1, at)"))
    spread = spread.filter("before & bit = 0")
    total = lambda what, when: F.expr(f"aggregate(cells, 0L, (t, c) -> t + if({when}, {what}, 0L))")
    here = "c.mask & before = 0 AND c.mask & bit != 0"
    return spread.select(
        "part", "before", "at",
        total("c.n", "c.mask & (before | bit) = 0").alias("kept"),
        total("c.n", here).alias("removed"),
        total("c.n", "c.mask & before != 0 AND c.mask & bit != 0").alias("redundant"),
        total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", here).alias("good_lost"),
        total("c.toxic", here).alias("toxic_lost"),
        total("c.n * (120 div bit_count(c.mask))", "c.mask & bit != 0").alias("shapley"),
    )


def all_orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits of the filters before, number of the filter): 600 of them."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = ["".join(p) for p in permutations(FILTERS)]
    return [(o, k + 1, sum(bits[f] for f in o[:k]), FILTERS.index(o[k])) for o in orders for k in range(len(FILTERS))]


def audit_filters(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """One row for each part, order of the filters and step; see the module for ``limits`` and results."""
    rows = with_labels(with_copies(failures(docs, **limits)), labels)
    found = cases(mask_cells(parity_sums(rows)))
    orders = docs.sparkSession.createDataFrame(all_orders(), "filter_order string, step int, before int, at int")
    counts: list[Column | str] = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return found.join(F.broadcast(orders), ["before", "at"]).select("part", "filter_order", "step", *counts)  # 600 rows
