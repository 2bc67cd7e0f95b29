"""Mixing sources to target weights with exact word budgets. DataFrame functions only.

Every document gets a hash-random key. Within a source, documents are ordered by
that key; the key's top bits cut the order into ranges of equal width, so a source
with a third of all rows is sorted in many pieces. Null doc_ids have no key and come
last. A range that holds far more rows than its source's others, as null or repeated
doc_ids make it, is cut further by key, doc_id, size and a hash of the text. Prefix
sums are made in two steps: the sizes of the pieces before (one row per piece), then
a running sum inside the piece. A source's budget is its target in whole words:
whole epochs take every document, and the rest of the budget is cut exactly where
the prefix sum reaches it.

Defined results: a null text has size 0; sources are ordered by code point with
null last, and null is a source like any other. Rows with equal keys (repeated
doc_ids) are ordered by doc_id, size, text hash and a pinned row number. With no words at all
every target is 0. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, pin

KEY_BITS = 60


def random_key(doc_id: Column, seed: int) -> Column:
    """60 uniform bits that depend on the document and the seed only; null for a null doc_id."""
    name = F.concat(doc_id.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target): water-filling, one row per source.

    Sources in order of ceiling * size / weight reach their ceiling first. The
    first one that stays under it fixes the level for all that follow.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = W.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("w", F.element_at(cycle, (F.col("rn") - 1) % len(weights) + 1).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    per = per.withColumn("pool", F.sum("source_size").over(everyone) * F.lit(float(share)))
    order = W.orderBy(F.col("cap") / F.col("w"), "rn")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", (F.col("pool") - before) / weight)
    free = F.col("level") * F.col("w") < F.col("cap")
    per = per.withColumn("place", F.row_number().over(order))
    per = per.withColumn("first_free", F.min(F.when(free, F.struct("place", "level"))).over(everyone))
    level = F.col("first_free.level")
    return per.select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap")).alias("target")
    )


def sized_rows(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, key, tie, row), written once so that keys and rows stay as they are."""
    return pin(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            random_key(F.col("doc_id"), seed).alias("key"),
            F.xxhash64("text").alias("tie"),
            (F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()).alias("row"),
        )
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 17,
    range_bits: int = 10,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    picked = docs.select("doc_id", "source", "text")
    return _take(sized_rows(picked, seed), weights, share, ceiling, range_bits).drop("row")


def repeat_to_targets(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 17,
    range_bits: int = 10,
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Texts stay whole: the one document of a source that its budget cuts is there once
    more if at least half of it is taken. Documents without words are not taken.
    """
    marked = pin(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    flat = marked.select(*[F.col("doc")[c].alias(c) for c in ("doc_id", "source", "text")], "row")
    taken = _take(sized_rows(flat, seed), weights, share, ceiling, range_bits)
    times = taken.filter("size > 0").select("row", F.expr("cast((2 * taken + size) div (2 * size) as int)").alias("times"))
    rows = marked.join(times.filter("times > 0"), "row")
    return rows.select("doc", F.explode(F.expr("sequence(1, times)"))).select("doc.*")


PIECE = ["range", "part"]


def in_pieces(sized: DataFrame, range_bits: int, crowd: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(``sized`` with range and part, the sizes of (source, range)).

    Ranges and parts sort as the rows do. A part is null but in ranges of more than
    ``crowd`` rows over four times the mean of their source.
    """
    sized = sized.withColumn("range", F.coalesce(F.shiftright("key", KEY_BITS - range_bits), F.lit(1 << range_bits).cast("long")))
    ranges = pin(sized.groupBy("source", "range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    mean = F.sum("rows").over(W.partitionBy("source")) / F.lit(1 << range_bits)
    crowded = ranges.withColumn("mean", mean).filter(F.col("rows") > crowd + 4 * F.col("mean"))
    crowded = pin(crowded.select(F.col("source").alias("c_source"), F.col("range").alias("c_range")))
    part = F.struct("key", "doc_id", "size", F.shiftright("tie", 54).alias("tie"))
    if crowded.isEmpty():
        return sized.withColumn("part", F.when(F.lit(False), part)), ranges
    on = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("range") == F.col("c_range"))
    sized = sized.join(F.broadcast(crowded), on, "left").withColumn("part", F.when(F.col("c_range").isNotNull(), part))
    return sized.drop("c_source", "c_range"), ranges


def _take(
    sized: DataFrame, weights: tuple[int, ...], share: float, ceiling: float, range_bits: int, crowd: int = 100_000
) -> DataFrame:
    sized, ranges = in_pieces(sized, range_bits, crowd)
    pieces = sized.groupBy("source", *PIECE).agg(F.sum("size").alias("size"))
    ahead = F.coalesce(
        F.sum("size").over(W.partitionBy("source").orderBy(*PIECE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = pieces.select("source", *PIECE, ahead.alias("ahead"))
    targets = source_targets(ranges, weights, share, ceiling)
    o, t = offsets.alias("o"), targets.alias("t")
    plan = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("p_source"),
        F.col("o.range").alias("p_range"),
        F.col("o.part").alias("p_part"),
        "ahead",
        "source_size",
        "target",
    )
    inside = W.partitionBy("source", *PIECE).orderBy("key", "doc_id", "size", "tie", "row")
    placed = sized.withColumn(
        "within", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    )
    both = placed.join(
        plan,
        F.col("source").eqNullSafe(F.col("p_source"))
        & (F.col("range") == F.col("p_range"))
        & F.col("part").eqNullSafe(F.col("p_part")),
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("within")))
    return both.select(
        "row",
        "doc_id",
        "source",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (epochs * F.col("size") + cut).cast("long").alias("taken"),
    )
