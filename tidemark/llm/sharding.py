"""Sharding by sampled splitters. DataFrame functions only.

Law ``bytes``: shards of nearly equal size. A record's key is a hash of its text, then a
hash of its row, so equal texts are neighbours and a text that a third of all rows share can
still be cut. Keys are sampled with a chance that is a record's share of all bytes, the
sample's quantiles are the splitters of many more ranges than shards, and every record gets
its range. Ranges are then weighed exactly; one that holds more than twice its due is
subdivided by the row's hash. Prefix sums over the pieces and inside them put every record
at its place in the order of keys, and a shard is a stretch of that order.

Equal texts inside one piece go to one shard. A piece is a 32nd of a shard, so shards differ
by about that much at most, if no document is larger. Ranges grow in number with the rows
(``per_range``), within bounds: at most ``most`` ranges and ``samples`` times as many keys are
ever in one place.

Defined results: a null text has no bytes and checksum 0. Rows with null or repeated doc_ids, and
equal rows, are records like any other; ties are ordered by a number that is written with
them. With fewer documents than shards some shards are empty. An empty table gives an empty
result; extra columns are ignored, whatever their names. Of long texts only size, checksum
and hash are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import pin

#: Bytes that a record takes besides its text.
OVERHEAD = 16
LOWEST = -(1 << 63)
ORDER = ("high", "low", "row")


def light_records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, high, low, row) of (doc_id, text, row), written once: all that sharding needs of a document."""
    text = F.coalesce("text", F.lit(""))
    return pin(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD).cast("long")).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("high"),
            F.xxhash64("row").alias("low"),
            "row",
        )
    )


def sampled_keys(records: DataFrame, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` keys, each drawn with the chance of its record's share of ``total`` bytes, and the bytes it stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * (wanted / total))
    draw = F.shiftrightunsigned(F.xxhash64("row", F.lit("sample")), 11) / float(1 << 53)
    return records.filter(draw < chance).select("high", "low", (F.col("size") / chance).alias("weight"))


def splitters(sample: DataFrame, ranges: int) -> DataFrame:
    """One row ``cuts``: the keys at which the second and later ranges begin, in order, in groups of equal length.

    The first splitter inside a run of equal texts is moved to its start, so that only runs
    which hold several are cut. The sample has a bound, so one task may sort it.
    """
    order = W.orderBy("high", "low")
    so_far = F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0))
    share = F.floor(so_far * ranges / F.sum("weight").over(W.partitionBy()))
    at = sample.select("high", "low", share.alias("share")).withColumn("before", F.coalesce(F.lag("share").over(order), F.lit(0)))
    cut = at.filter("share > before AND share > 0")
    nth = F.row_number().over(W.partitionBy("high").orderBy("low"))
    cut = cut.select("high", F.when(nth == 1, F.lit(LOWEST)).otherwise(F.col("low")).alias("low"))
    each = max(1, int(ranges**0.5))
    flat = cut.agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("flat"))
    groups = F.expr(f"transform(sequence(0, greatest(0, cast(ceil(size(flat) / {each}D) as int) - 1)), g -> slice(flat, g * {each} + 1, {each}))")
    return flat.select(groups.alias("cuts"))


def range_of(each: int) -> Column:
    """Number of a record's range: the cuts at or before its key, found by groups first."""
    at_or_before = "(c.high < high OR (c.high = high AND c.low <= low))"
    group = f"size(filter(cuts, g -> exists(slice(g, 1, 1), c -> {at_or_before})))"
    return F.expr(f"transform(array({group}), n -> if(n = 0, 0, (n - 1) * {each} + size(filter(cuts[n - 1], c -> {at_or_before}))))[0]")


def in_ranges(records: DataFrame, total: int, rows: int, shards: int, per_shard: int, per_range: int, most: int, samples: int) -> DataFrame:
    """``records`` with ``range`` and ``piece``, written once."""
    ranges = min(max(shards * per_shard, rows // per_range), max(most, shards * per_shard))
    cuts = splitters(sampled_keys(records, total, samples * ranges), ranges)
    ranged = records.crossJoin(F.broadcast(cuts)).withColumn("range", range_of(max(1, int(ranges**0.5)))).drop("cuts")  # one row, at most `most` keys
    ranged = pin(ranged)
    due = -(-total // ranges)
    heavy = ranged.groupBy("range").agg(F.sum("size").alias("held")).filter(F.col("held") > 2 * due)
    pieces = heavy.select("range", F.expr(f"cast(ceil(held / {due}D) as int)").alias("pieces"))
    piece = F.coalesce(F.pmod("low", F.col("pieces").cast("long")).cast("int"), F.lit(0))
    # A heavy range holds two shares of the bytes at least, so there are half as many as ranges at most.
    return ranged.join(F.broadcast(pieces), "range", "left").withColumn("piece", piece).drop("pieces")


def placed_records(
    docs: DataFrame, shards: int, per_shard: int, per_range: int, most: int, samples: int
) -> DataFrame:
    """``light_records`` with ``shard`` and ``slot``."""
    records = light_records(docs)
    rows, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = in_ranges(records, max(total, 1), rows, shards, per_shard, per_range, most, samples)
    piece = W.partitionBy("range", "piece")
    ahead = W.orderBy("range", "piece").rowsBetween(W.unboundedPreceding, -1)
    weighed = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = weighed.select("range", "piece", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("bytes", "rows")])
    inside = placed.withColumns(
        {
            "within": F.sum("size").over(piece.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)) - F.col("size"),
            "nth": F.row_number().over(piece.orderBy(*ORDER)) - 1,
        }
    )
    same = W.partitionBy("range", "piece", "high")
    inside = inside.withColumns({"start": F.min("within").over(same), "run": F.sum("size").over(same)})
    both = inside.join(F.broadcast(offsets), ["range", "piece"])  # at most 2.5 rows for each range
    middle = F.col("bytes_ahead") + F.col("start") + F.col("run") / 2
    shard = F.least(F.floor(middle * shards / max(total, 1)).cast("int"), F.lit(shards - 1))
    place = F.col("rows_ahead") + F.col("nth")
    cut = pin(both.select("row", "doc_id", "size", "text_crc32", shard.alias("shard"), place.alias("place")))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    slot = (F.col("place") - F.col("first")).cast("long").alias("slot")
    return cut.join(F.broadcast(first), "shard").select("row", "doc_id", "size", "text_crc32", "shard", slot)  # a row for each shard


def shard_records(
    docs: DataFrame, shards: int = 40, per_shard: int = 32, per_range: int = 1_000_000, most: int = 40_960, samples: int = 8
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    placed = placed_records(docs.withColumn("row", F.monotonically_increasing_id()), shards, per_shard, per_range, most, samples)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", grown)


def write_shards(docs: DataFrame, path: str, shards: int = 40, files: int | None = None) -> DataFrame:
    """Writes ``docs`` as Parquet to a folder ``shard=N`` each, in order of ``slot``, and returns what was written.

    A shard is cut into files by slot: ``files`` of them in all, by default as many as a shuffle has tasks.
    """
    named = F.struct(*[docs[c].alias(c) for c in docs.columns])
    marked = pin(docs.select(named.alias("doc"), F.monotonically_increasing_id().alias("row")))
    flat = marked.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row")
    placed = placed_records(flat, shards, 32, 1_000_000, 40_960, 8).select("row", "shard", "slot")
    whole = marked.join(placed, "row").select("shard", "slot", "doc")
    dealt = whole.repartitionByRange(files, "shard", "slot") if files else whole.repartitionByRange("shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(whole.schema).parquet(path)
