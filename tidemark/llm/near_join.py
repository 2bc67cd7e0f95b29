"""N-gram Jaccard join with token-combination prefixes, and the groups it links.

A document's tokens are its distinct word shingles (64-bit names). Two documents link
when ``100 * shared >= percent * union``. The join is exact:

* Tokens have one global order: by how many documents hold the rarest word of the
  shingle (words outside the ``top_words`` most frequent count as 0; one whose name begins
  with the same ``BITS`` bits as a frequent one's counts as that), then by name.
  A passage in many documents has frequent words only, so its shingles come last.
* A set of n tokens may lack at most e of them in a partner. Its prefix is its first
  e + 1 + g tokens, g being the groups (see next) that its frequent ones lie in: of two
  linked sets' prefixes, the shorter shares at least 1 + g of its tokens.
* Spark counts the prefix tokens. A rare one (in up to ``frequent`` prefixes) is a
  signature alone. Frequent ones are dealt by hash into G groups, and every pair of
  tokens within a group is a signature. Either a shared token is rare, or 1 + g
  shared frequent tokens lie in g groups, so two lie in one: linked sets share a
  signature. G depends on the set's size level; linked sets differ by one level at
  most, so each set makes its pairs for its own level and the next.

Sets that are equal are one set from the start. Signatures with the same holders are
one signature. In each of ``rounds`` rounds up to ``FEW`` holders of a signature are paired with
each other and more with one pivot, which links most copies at small cost; pairs that are already
linked through others are left out. Then up to ``SOME`` holders of a signature that still
falls apart are paired with each other. Pairs whose sets cannot share enough, by counts over
parts of the hash range, go first; the others are verified on the whole texts. Documents whose
signatures have more holders and fall apart hold passages that many hold. They are indexed again
with longer combinations: their tokens are dealt by hash into more parts than two linked
sets differ in tokens, so two linked sets have a part that is the same in both, and all
tokens of a part are one signature. A part with more than ``CROWD`` holders is not paired;
its holders are indexed by the single tokens that are rarest among them, by count, and meet
only where what follows in both is enough for a link; first each meets the one that changes least
of what they share, which links most near copies of one text. The remaining pairs are verified in one pass, so no link is lost. Components are found by passing on least labels with pointer jumps. Nothing is
collected but the ``top_words`` words.

Defined results: a document without words has no shingles and links with nothing; its
component is itself. Rows with equal sets of shingles form one group. A null doc_id
counts as larger than any other. An empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import pin, unpin
from tidemark.llm._tokens import MIX_1, MIX_2, ODD, in_chunks, list_column, long_column, mix, named_words, window_names

#: Average number of a set's prefix tokens in a group.
PER_GROUP = 8
#: Parts of the hash range in which a set's tokens are counted, a byte each, and holders of a signature that are paired at once.
SKETCH, FEW = 256, 4
#: Holders of a signature that are paired at once after the rounds of pivots.
SOME = 32
#: Row numbers that are broadcast at most, with up to 8 bytes besides the 8 of each.
SENT = 1_000_000
#: Holders of a part that are paired at once.
CROWD = 16
#: Bits of a word's name that tell how frequent it is, and bytes of text that are named at once.
BITS, CHUNK = 21, 500_000


def shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Names of each row's shingles in order; a shorter text is one shingle."""
    words, begin = named_words(texts)
    windows = window_names(words, size, 5)
    found = []
    for start, end in zip(begin[:-1].tolist(), begin[1:].tolist()):
        found.append(windows[start : end - size + 1] if end - start >= size else window_names(words[start:end], end - start, 5) if end > start else windows[:0])
    return found


def may_lack(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100


@cache
def level(n: int, percent: int) -> int:
    """Sets that link are on the same level or on neighbouring ones."""
    at = 0
    low = 1
    while n > 100 * low // percent:
        low = 100 * low // percent + 1
        at += 1
    return at


@cache
def level_top(at: int, percent: int) -> int:
    """Size of the largest set on a level."""
    low = 1
    for _ in range(at):
        low = 100 * low // percent + 1
    return 100 * low // percent


@cache
def level_groups(at: int, percent: int) -> int:
    """G of a level, from the largest set on it."""
    return max(1, int(may_lack(level_top(at, percent), percent)) // PER_GROUP)


def word_counts(base: DataFrame) -> DataFrame:
    """(word, docs) summed up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            kinds, of = np.unique(names, return_inverse=True)
            return kinds, np.bincount(of, weights=counts, minlength=len(kinds)).astype(np.int64)

        def out() -> pa.RecordBatch:
            kinds, counts = merged()
            return pa.RecordBatch.from_arrays([long_column(kinds), pa.array(counts)], ["word", "docs"])

        for batch in in_chunks(batches, 0, CHUNK):
            words, begin = named_words(batch.column(0))
            sets = [np.unique(words[start:end]) for start, end in zip(begin[:-1].tolist(), begin[1:].tolist())]
            if sets:
                held.append(np.unique(np.concatenate(sets), return_counts=True))
            if len(held) >= 64:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield out()
                    held = []
        if held:
            yield out()

    return base.select("text").mapInArrow(run, "word long, docs long")


def frequent_words(base: DataFrame, top_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words by name, sorted, and in how many documents they are."""
    top = word_counts(base).groupBy("word").agg(F.sum("docs").alias("docs")).filter("docs > 1")
    rows = top.orderBy(F.desc("docs"), "word").limit(top_words).toPandas()
    names = rows["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], rows["docs"].to_numpy(dtype=np.int64)[order]


def set_profile(base: DataFrame, size: int, percent: int, top_words: int) -> DataFrame:
    """Per row: n (size of the set), two keys of the set, its prefix in order."""
    sent = base.sparkSession.sparkContext.broadcast(frequent_words(base, top_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs = sent.value
        by_docs = np.argsort(docs, kind="stable")  # of words with the same bits the most frequent one is told
        rarity = np.zeros(2**BITS, dtype=np.uint16)
        rarity[names[by_docs] >> np.uint64(64 - BITS)] = np.minimum(np.unique(docs[by_docs], return_inverse=True)[1] + 1, 65_535)
        for batch in in_chunks(batches, 1, CHUNK):
            words, begin = named_words(batch.column(1))
            windows = window_names(words, size, 5)
            rare = rarity[words >> np.uint64(64 - BITS)]
            least = rare[: len(windows)]
            for i in range(1, size):
                least = np.minimum(least, rare[i : len(windows) + i])
            sets, prefixes = [], []
            for start, end in zip(begin[:-1].tolist(), begin[1:].tolist()):
                if end - start < size:  # one shingle: only its equals link with it
                    sets.append(window_names(words[start:end], end - start, 5) if end > start else windows[:0])
                    prefixes.append(windows[:0])
                    continue
                tokens = windows[start : end - size + 1]
                order = np.argsort(tokens)
                kinds = tokens[order]
                new = np.concatenate([[True], kinds[1:] != kinds[:-1]])
                if len(kinds := kinds[new]) < len(order):
                    order = order[new]
                sets.append(kinds)
                long = int(may_lack(len(kinds), percent)) + 1 + level_groups(level(len(kinds), percent) + 1, percent)
                prefixes.append(kinds[np.argsort(least[start:end][order], kind="stable")[:long]])
            n = np.array([len(x) for x in sets], dtype=np.int64)
            every, of = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(every * MIX_1))]), np.concatenate([[np.uint64(0)], np.cumsum(mix(every * MIX_2 + ODD))])
            ends = np.cumsum(n)
            k1, k2 = (x[ends] - x[ends - n] for x in sums)
            parts = np.bincount(of * SKETCH + (every >> np.uint64(56)).astype(np.int64), minlength=len(n) * SKETCH).reshape(-1, SKETCH)
            sketches = [row.tobytes() if fits else b"" for row, fits in zip(parts.astype(np.uint8), parts.max(axis=1) < 256)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), long_column(k1),
                    long_column(k2), list_column(prefixes, pa.int64()), pa.array(sketches, pa.binary()),
                ],
                ["row", "n", "k1", "k2", "prefix", "sketch"],
            )

    return base.select("row", "text").mapInArrow(run, "row long, n long, k1 long, k2 long, prefix array<long>, sketch binary")


def signatures(held: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(sig, row, n) from (row, n, tokens), a token being its name, place in the prefix and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat = batch.column(2).flatten()
            names = flat.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
            counts, places = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("times", "place"))
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)).tolist()
            for n, start, end in zip(batch.column(1).to_pylist(), [0, *ends], ends):
                name, times, place = names[start:end], counts[start:end], places[start:end]
                found, least = [], int(may_lack(n, percent)) + 1
                if not (times > frequent).any():
                    out.append(np.unique(mix(name[place < least])))
                    continue
                for at in (own := level(n, percent), own + 1):
                    groups = np.uint64(level_groups(at, percent))
                    # Only groups that the prefix reaches lengthen it, by one token each.
                    often = times > frequent
                    _, begin = np.unique(mix(name[often])[np.argsort(place[often])] % groups, return_index=True)
                    begin = np.sort(np.sort(place[often])[begin])
                    long = least
                    while (longer := least + int(np.searchsorted(begin, long))) > long:
                        long = longer
                    found.append(mix(name[~often & (place < long)]))
                    many = np.sort(name[often & (place < long)])
                    group = mix(many) % groups
                    order = np.argsort(group, kind="stable")
                    many, group = many[order], group[order]
                    step = 1
                    while step < len(many):
                        same = group[step:] == group[:-step]
                        if not same.any():
                            break
                        found.append(mix((many[:-step][same] * ODD + many[step:][same]) * MIX_1 + np.uint64(at + 1)))
                        step += 1
                out.append(np.unique(np.concatenate(found)))
            size = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    long_column(np.concatenate(out) if out else np.zeros(0, np.uint64)),
                    pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size), pa.int64()),
                    pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), size), pa.int64()),
                ],
                ["sig", "row", "n"],
            )

    return held.mapInArrow(run, "sig long, row long, n long")


def prefix_counts(prefixes: DataFrame, frequent: int) -> DataFrame:
    """(row, token, place, times) of the tokens in two or more of ``prefixes`` (row, prefix), times ending at ``frequent + 1``.

    One shuffle by token, then a pass over sorted tokens that holds up to ``frequent`` rows. A token that a batch
    has in more prefixes than that is known to be frequent: its rows are spread over all tasks, and one row tells the
    token's own task.
    """
    most = frequent + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            token = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            kinds, of, times = np.unique(token, return_inverse=True, return_counts=True)
            told = kinds[times > frequent]
            at = place * 2 + (times > frequent)[of]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([token, told]), pa.int64()),
                    pa.array(np.concatenate([row, np.zeros(len(told), dtype=np.int64)]), pa.int64()),
                    pa.array(np.concatenate([at, np.full(len(told), -1)]), pa.int32()),
                ],
                ["token", "row", "at"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)]
        known = None  # the token that the last batch ended with, if it is frequent

        def out(token: np.ndarray, row: np.ndarray, at: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            keep = (at >= 0) & (times > 1)
            columns = [pa.array(x[keep]) for x in (row, token, at >> 1, times.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["row", "token", "place", "times"])

        def totals(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sums = np.minimum(np.add.reduceat(np.where(at % 2 == 1, most, 1), begin), most)
            if token[0] == known:
                sums[0] = most
            return begin, sums

        for batch in batches:
            if not batch.num_rows:
                continue
            token, row, at = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            begin, sums = totals(token, at)
            known = token[-1] if sums[-1] == most else None
            end = len(token) if known is not None else begin[-1]
            times = np.repeat(sums, np.diff(np.append(begin, len(token))))
            held = [token[end:], row[end:], at[end:]]
            yield out(token[:end], row[:end], at[:end], times[:end])
        if len(held[0]):
            _, sums = totals(held[0], held[2])
            yield out(*held, np.repeat(sums, len(held[0])))

    dealt = prefixes.mapInArrow(deal, "token long, row long, at int")
    spread = F.when((F.col("at") > 0) & (F.col("at") % 2 == 1), F.xxhash64("token", "row")).otherwise(F.col("token"))
    return dealt.repartition(spread).sortWithinPartitions("token").mapInArrow(count, "row long, token long, place int, times int")


def holders(profile: DataFrame, firsts: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(sig, row, n, label), pinned: each different set of two or more holders once, under one of its signatures."""
    counted = prefix_counts(profile.join(firsts, "row", "left_semi").select("row", "prefix"), frequent)
    held = counted.groupBy("row").agg(F.collect_list(F.struct("token", "place", "times")).alias("tokens")).join(firsts, "row")
    sigs = pin(signatures(held.select("row", "n", "tokens"), percent, frequent))
    members = pin(one_of_each_set(sigs.withColumn("label", F.col("row"))))
    unpin(sigs)
    return members


def one_of_each_set(sigs: DataFrame) -> DataFrame:
    """Those of (sig, row, n, label) whose holders have different labels, each set of holders under one signature."""
    part = lambda seed: F.sum(F.shiftright(F.xxhash64("row", F.lit(seed)), 20)).alias(f"s{seed}")
    both = [F.min("label").alias("low"), F.max("label").alias("high")]
    groups = sigs.groupBy("sig").agg(part(1), part(2), F.count(F.lit(1)).alias("size"), *both).filter("low != high")
    kept = groups.groupBy("s1", "s2", "size").agg(F.min("sig").alias("sig")).select("sig")
    return sigs.join(kept, "sig", "left_semi")


def part_names(kinds: np.ndarray, percent: int) -> np.ndarray:
    """Names of the parts of a set of tokens; of two linked sets at least one is the same.

    Sets that link differ in at most ``most`` tokens, so of ``count`` parts ``count - most``
    are equal. Empty parts only count for a set that has as many.
    """
    found, own = [], level(len(kinds), percent)
    for at in (own, own + 1):
        most = level_top(at, percent) * (100 - percent) // percent
        count = most + most // 10 + 3
        part = (mix(kinds ^ ODD) % np.uint64(count)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        full, begin = np.unique(part[order], return_index=True)
        sums = np.zeros(count, dtype=np.uint64)
        sums[full] = np.add.reduceat(mix(kinds[order] * MIX_2), begin)
        names = mix((sums * ODD + np.arange(count, dtype=np.uint64)) * MIX_1 + np.uint64(at + 1))
        found.append(names if count - len(full) >= count - most else names[full])
    return np.concatenate(found)


def part_signatures(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, row, n, label) for the parts of every row of ``texts`` (row, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 2, CHUNK):
            sets = [np.unique(x) for x in shingles(batch.column(2), size)]
            out = [part_names(x, percent) for x in sets]
            times = [len(x) for x in out]
            spread = lambda values: pa.array(np.repeat(values, times), pa.int64())
            row, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [long_column(np.concatenate(out)), spread(row), spread(np.array([len(x) for x in sets])), spread(label)],
                ["sig", "row", "n", "label"],
            )

    return texts.mapInArrow(run, "sig long, row long, n long, label long")


def token_signatures(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, row, n, label, place), pinned: of each row of ``texts`` (row, label, text) the tokens that are rarest among these rows.

    A set may lack ``e`` of its tokens in a partner, so linked sets share one of the first ``e + 1`` in a common order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 2, CHUNK):
            sets = [np.unique(x) for x in shingles(batch.column(2), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_column(sets, pa.int64())], ["row", "label", "tokens"])

    sets = pin(texts.mapInArrow(run, "row long, label long, tokens array<long>"))
    each = sets.select("row", "label", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("sig"))
    counts = pin(each.groupBy("sig").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))  # written, so that Spark can split the join at a common token
    place = F.row_number().over(Window.partitionBy("row").orderBy("times", "sig"))
    lack = F.expr(f"n - ({percent} * n + 99) div 100")
    first = each.join(counts, "sig", "left").withColumn("times", F.coalesce("times", F.lit(1))).withColumn("place", place).filter(F.col("place") <= lack + 1)
    out = pin(first.filter("times > 1").select("sig", "row", "n", "label", (F.col("place") - 1).alias("place")))
    unpin(sets, counts)
    return out


def relabelled(members: DataFrame, moved: DataFrame) -> DataFrame:
    """(sig, row, n, label, place) with the labels of ``moved`` (label, to)."""
    return members.join(moved, "label", "left").select("sig", "row", "n", F.coalesce("to", "label").alias("label"), "place")


def around_pivots(crowd: DataFrame, texts: DataFrame, profile: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of ``crowd`` (sig, row, n, label, place), pinned, to pivots: pairs (a, b) compared, those that link, and labels (label, to) that they change.

    A signature of more than ``SOME`` holders has as pivot the set with the smallest share of tokens that are rarer: what two sets
    change in a passage adds up, so the set that changes least links with most of those that link at all. Rounds go on while they
    leave half of the labels or fewer, and each compares a holder with one pivot. Pairs that no pivot joins stay open.
    """
    spark = crowd.sparkSession
    pairs = links = spark.createDataFrame([], "a long, b long")
    moved, now = spark.createDataFrame([], "label long, to long"), crowd
    shares = f"label != other AND {100 + percent} * least(n - place, m - at) >= {percent} * (n + m)"
    label_of = pin(crowd.select("row", "label").distinct())
    count = label_of.select("label").distinct().count()
    while True:
        first = F.struct((F.col("place") / F.col("n")).alias("share"), "row", "n", "label", "place")
        both = [F.min("label").alias("low"), F.max("label").alias("high")]
        wide = now.groupBy("sig").agg(F.min(first).alias("p"), F.count(F.lit(1)).alias("size"), *both).filter(f"size > {SOME} AND low != high")
        pivots = wide.select("sig", "p.row", "p.n", "p.label", "p.place").toDF("sig", "a", "m", "other", "at")
        met = now.join(pivots, "sig").filter(shares).select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b"))
        new = pin(met.distinct().join(pairs, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        ends = pin(new.select("a").union(new.select("b")).toDF("row").distinct())
        near, held = (pin(t.join(sent(ends), "row", "left_semi")) for t in (profile.select("row", "n", "sketch"), texts.select("row", "text")))
        open_pairs = pin(possible(new, near, percent))
        found = pin(verified(open_pairs, held, size, percent))
        unpin(ends, near, held, open_pairs)
        pairs, links = pairs.union(new), links.union(found)
        joined = links.join(label_of.toDF("a", "x"), "a").join(label_of.toDF("b", "y"), "b").select("x", "y").toDF("a", "b")
        moved = pin(least_labels(joined).filter("row != label").toDF("label", "to"))
        before, count = count, label_of.join(moved, "label", "left").select(F.coalesce("to", "label")).distinct().count()
        if 2 * count > before:
            break
        now = relabelled(crowd, sent(moved))
    unpin(label_of)
    return pairs, links, moved


def open_signatures(open_texts: DataFrame, members: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sig, row, n, label, place), pinned, under which all pairs of the rows of ``members`` that link and differ in label meet: parts, and tokens of a crowd."""

    def texts(held: DataFrame) -> DataFrame:
        return open_texts.join(sent(pin(held.select("row", "label").distinct())), "row").select("row", "label", "text")

    every = pin(part_signatures(texts(members), size, percent))
    parts = pin(one_of_each_set(every))
    unpin(every)
    sizes = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    small, large = sizes.filter(F.col("size") <= CROWD), sizes.filter(F.col("size") > CROWD)
    crowd = token_signatures(texts(parts.join(large, "sig", "left_semi")), size, percent)
    few = pin(parts.join(small, "sig", "left_semi").select("sig", "row", "n", "label", F.lit(0).alias("place")))
    unpin(parts)
    return few, crowd


def last_signatures(
    texts: DataFrame, members: DataFrame, profile: DataFrame, size: int, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sig, row, n, label, place): those of up to ``SOME`` holders as they are, the holders of others indexed again.

    With them the pairs (a, b) of a crowd that were compared on the way, and those that link.
    """
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    large = pin(members.join(sizes.filter(F.col("size") > SOME), "sig", "left_semi"))
    few = members.join(sizes.filter(F.col("size") <= SOME), "sig", "left_semi").select("sig", "row", "n", "label", "place")
    found = pin(few)
    pairs = links = texts.sparkSession.createDataFrame([], "a long, b long")
    if not large.isEmpty():
        parts, crowd = open_signatures(texts, large, size, percent)
        pairs, links, moved = around_pivots(crowd, texts, profile, size, percent)
        found = relabelled(found.union(parts).union(crowd), sent(moved))
    unpin(large)
    return found, pairs, links


def possible(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets may share enough: in no part of the hash range can they share more than the smaller count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            known = np.array([bool(x and y) for x, y in zip(left, right)], dtype=bool)
            if known.any():
                read = lambda side: np.frombuffer(b"".join(x for x, k in zip(side, known) if k), dtype=np.uint8).reshape(-1, SKETCH)
                most = np.minimum(read(left), read(right)).sum(axis=1, dtype=np.int64)
                keep[known] = 100 * most >= percent * (n[known] + m[known] - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda row, *names: profile.select("row", "n", "sketch").toDF(row, *names)
    # One path for all sizes: few pairs would be broadcast, more of them shuffle the sketches.
    both = pairs.join(side("a", "n", "left").hint("merge"), "a").join(side("b", "m", "right").hint("merge"), "b")
    return both.select("a", "b", "n", "m", "left", "right").mapInArrow(run, "a long, b long")


def sent(rows: DataFrame) -> DataFrame:
    """Pinned numbers of rows, to be broadcast if they are ``SENT`` at most; otherwise the join shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs``, pinned, whose whole texts link; ``texts`` hold no other rows than those of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, np.zeros(0, dtype=np.uint64)
        for batch in in_chunks(batches, 2, CHUNK):
            hit = []
            a = batch.column(0).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or a[0] != last], a[1:] != a[:-1]])
            left = iter(shingles(batch.column(3).filter(pa.array(new)), size))
            for other, changed in zip(shingles(batch.column(2), size), new.tolist()):
                if changed:
                    tokens = np.unique(next(left))
                other = np.unique(other)
                shared = len(np.intersect1d(tokens, other, assume_unique=True))
                hit.append(100 * shared >= percent * (len(tokens) + len(other) - shared))
            last = a[-1]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    with_b = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")).join(sent(pairs), "b")
    with_both = with_b.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_b", "text_a").mapInArrow(run, "a long, b long")


def least_labels(links: DataFrame) -> DataFrame:
    """(row, label) for every row of ``links`` (a, b): the least row of its component."""
    both = pin(links.select(F.col("a").alias("row"), F.col("b").alias("to")).union(links.select("b", "a")).distinct())
    labels = pin(both.groupBy("row").agg(F.least(F.col("row"), F.min("to")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("row").alias("to"), F.col("label").alias("near")), "to")
        near = seen.groupBy("row").agg(F.min("near").alias("near"))
        via = labels.join(near, "row").select("row", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("row").alias("via"), F.col("label").alias("far"))
        moved = pin(via.join(jump, "via").select("row", "old", F.least("via", "far").alias("label")))
        unpin(labels)
        labels = moved
        if moved.filter("label != old").isEmpty():
            unpin(both)
            return moved.select("row", "label")


def link_pairs(base: DataFrame, profile: DataFrame, members: DataFrame, size: int, percent: int, rounds: int) -> DataFrame:
    """Links (a, b) that join all that is linked through the holders (sig, row, n) in ``members``."""
    spark = base.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    done = spark.createDataFrame([], "a long, b long")
    members = members.select("sig", "row", "n", "label", F.lit(0).alias("place"))
    # All that two sets can share from their first shared token on is what is left of the shorter one.
    meets = f"(m < n OR m = n AND a < row) AND label != other AND {100 + percent} * least(n - place, m - at) >= {percent} * (n + m)"
    # Of two linked sets the shorter one has that token so early that it could link with its equals; a tie goes by row.
    early = f"{100 + percent} * (n - place) >= {2 * percent} * n"
    fits = f"label != other AND 100 * least(n, m) >= {percent} * greatest(n, m)"

    def texts_of(rows: DataFrame, texts: DataFrame) -> DataFrame:
        """(row, text) of ``rows``, pinned."""
        wanted = pin(rows.distinct())
        found = pin(texts.select("row", "text").join(sent(wanted), "row", "left_semi"))
        unpin(wanted)
        return found

    for turn in range(rounds + 1):
        if members.isEmpty():
            break
        last = turn == rounds
        if last:  # all that is still open is fetched once, to be indexed and to be verified
            held = texts_of(members.select("row"), base)
            members, compared, linked = last_signatures(held, members, profile, size, percent)
            done, links = done.union(compared), links.union(linked)
        heads = members.groupBy("sig").agg(F.min(F.struct("row", "n", "label")).alias("p"), F.count(F.lit(1)).alias("size"))
        few = heads if last else heads.filter(F.col("size") <= FEW)
        some = members.join(few.select("sig"), "sig", "left_semi")
        index = some.filter(early).toDF("sig", "a", "m", "other", "at")
        met = some.join(index, "sig").filter(meets).select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b"))
        if not last:
            many = heads.filter(F.col("size") > FEW)
            pivots = many.select("sig", "p.*").toDF("sig", "a", "m", "other")
            met = met.union(members.join(pivots, "sig").filter("row != a").filter(fits).select("a", F.col("row").alias("b")))
        pairs = pin(met.distinct().join(done, ["a", "b"], "left_anti"))
        open_pairs = pin(possible(pairs, profile, percent))
        texts = texts_of(open_pairs.select("a").union(open_pairs.select("b")).toDF("row"), held if last else base)
        found = pin(verified(open_pairs, texts, size, percent))
        unpin(open_pairs, texts)
        done, links = done.union(pairs), links.union(found)
        if last:
            unpin(held)
            break
        labels = least_labels(links)
        rest = members.join(many.select("sig", F.col("p.row").alias("a")), "sig").filter("row != a").select("sig", "row", "n")
        rest = rest.join(labels, "row", "left").select("sig", "row", "n", F.coalesce("label", "row").alias("label"), F.lit(0).alias("place"))
        apart = rest.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
        members = pin(rest.join(apart.select("sig"), "sig", "left_semi"))
    return links


def near_duplicates(
    docs: DataFrame, size: int = 4, percent: int = 85, top_words: int = 65_536, frequent: int = 32, rounds: int = 1
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    base = pin(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    return _components(base, size, percent, top_words, frequent, rounds).drop("row", "lead")


def _components(base: DataFrame, size: int, percent: int, top_words: int, frequent: int, rounds: int) -> DataFrame:
    profile = pin(set_profile(base, size, percent, top_words))
    key = ["k1", "k2", "n"]
    sets = pin(profile.filter("n > 0").groupBy(*key).agg(F.min("row").alias("first")))
    firsts = sent(sets.select(F.col("first").alias("row"), "n"))
    members = holders(profile, firsts, percent, frequent)
    links = link_pairs(base, profile, members, size, percent, rounds)
    labels = least_labels(links).toDF("first", "label")
    of = (
        base.select("row", "doc_id")
        .join(profile.select("row", *key), "row")
        .join(sets, key, "left")
        .join(labels, "first", "left")
        .select("row", "doc_id", "n", F.coalesce("label", "first", "row").alias("label"))
    )
    least = of.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("least")
    )
    return of.join(least, "label").select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("least.doc_id").alias("component_id"),
        F.col("least.row").alias("lead"),
    )


def keep_one_of_each(
    docs: DataFrame, size: int = 5, percent: int = 80, top_words: int = 65_536, frequent: int = 32, rounds: int = 1
) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their group, with the columns of ``docs``."""
    marked = pin(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    base = marked.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row")
    found = _components(base, size, percent, top_words, frequent, rounds)
    return marked.join(found.filter("row = lead").select("row"), "row", "left_semi").select("doc.*")
