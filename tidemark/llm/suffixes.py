"""Suffix-array dedup: byte strings that stand twice are found by a difference cover and removed.

Suffixes are compared by their first ``length`` bytes only. Let D be a difference
cover modulo v: any two places differ from two sampled places (those whose remainder
is in D) by one and the same shift of less than v. The steps, on the strings that
may hold a repeat (see below):

1. *Sort sampled triples.* A character is ``v / 3`` bytes, named by 64 bits. Each
   sampled suffix becomes the triple of its first three characters, its first v bytes.
   Spark sorts the triples over ranges and names each by its rank; those that stand
   once leave, as no suffix like them is found elsewhere.
2. *Recurse on names.* The string of names at a sampled place and at each v-th place
   after it is sorted in turn, which ranks the suffixes by their first ``depth`` bytes:
   all whole blocks of v bytes in ``length - v + 1``.
3. *Merge the remaining suffixes.* A suffix of ``length`` bytes is, for some shift of
   less than v, that many bytes, a sampled suffix's rank, and the bytes that follow its
   depth. Tuples of the second sort carry the bytes on either side.
4. *Compare adjacent prefixes.* Within a rank and shift, suffixes are ordered by
   those bytes; neighbours that agree are equal in all ``length`` bytes, and all of these go.

Three exact reductions keep the sorts small. Equal texts enter once; all their bytes
go if they are long enough. Of the other places only those enter whose string has a
shared least gram: of the grams of ``GRAM`` bytes in a string the one with the least
hash depends on the string alone, so equal strings have the same, and one that is
least at no other place of all texts rules its strings out. A *stretch* is a run of places
with one least gram and all bytes of their strings; equal stretches are one string
with a count: they enter once, as what others may equal, and not at all if each
stretch with that gram has an equal.

Texts are read twice, to find stretches and to cut; all between works on the strings
of stretches. Characters are hashes, so the first sort's ranges are cut evenly; the
second sort deals by the first one's ranges. A rank with very many holders is split by
Spark's own aggregation, shift by shift, so no task holds it.

Defined results: a null text has no bytes. Texts shorter than ``length`` lose
nothing. Texts of any length are read whole, a long one in a batch of its own. Repeated rows
count as copies of each other. An empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import pin, unpin
from tidemark.llm._stretches import STRETCHES, equal_starts, found_marks, judged_stretches, runs_of
from tidemark.llm._tokens import MIX_1, ODD, in_chunks, key_pair, list_column, long_column, mix

#: A difference cover: every remainder modulo 39 is a difference of two members.
PERIOD, COVER = 39, (0, 1, 2, 4, 13, 18, 33)
CHARACTER = PERIOD // 3
GRAM = 64
#: A name is the number of its range and, below these bits, its rank in the range.
RANK_BITS = 40


class Bytes:
    """Bytes of several texts end to end."""

    def __init__(self, raws: list[bytes]):
        self.counts = np.array([len(r) for r in raws], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.all = np.frombuffer(b"".join(raws), dtype=np.uint8)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def fits(self, width: int) -> np.ndarray:
        """True where a string of ``width`` bytes starts that lies in one text."""
        ok = np.zeros(len(self.all), dtype=bool)
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            if b - a >= width:
                ok[a : b - width + 1] = True
        return ok


def string_names(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name for each string of ``width`` bytes; built from powers of two, so in O(log width) passes."""
    level = mix(data.astype(np.uint64) + np.uint64(1))
    base, span, done = int(ODD), 1, 0
    out = None
    while True:
        if width & span:
            if out is None:
                out = level.copy()
            else:
                n = len(level) - done
                out = (out[: max(0, n)] * np.uint64(base) + level[done : done + max(0, n)]) if n > 0 else out[:0]
            done += span
        if span * 2 > width:
            return mix(out[: max(0, len(data) - width + 1)])
        level = level[:-span] * np.uint64(base) + level[span:] if len(level) > span else level[:0]
        level = mix(level)
        base = base * base % 2**64 | 1
        span *= 2


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values."""
    span = 1
    out = x
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def least_grams(b: Bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of the grams at all places, the least name in the string of ``length`` bytes from each place; 0 across texts)."""
    names = string_names(b.all, GRAM)
    least = sliding(names, length - GRAM + 1, np.minimum)
    return names, np.where(b.fits(length)[: len(least)], least, np.uint64(0))


def picks(b: Bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram) of each gram that is the least of some string of ``length`` bytes that holds it."""
    if len(b.all) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    names, least = least_grams(b, length)
    width = length - GRAM + 1
    zeros = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([zeros, least, zeros]), width, np.maximum) == names)
    return at, names[at]


def stretches(b: Bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, gram): strings of ``length`` bytes that start from begin on and before end have this gram as their least.

    The least gram of a string depends on nothing but the string, so equal strings have the same.
    """
    if len(b.all) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    _, least = least_grams(b, length)
    turn = np.ones(len(least), dtype=bool)
    turn[1:] = least[1:] != least[:-1]
    begin = np.flatnonzero(turn)
    end = np.append(begin[1:], len(least))
    good = least[begin] > 0
    return begin[good], end[good], least[begin[good]]


def raw_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_profile(base: DataFrame, length: int) -> DataFrame:
    """Per row: n_bytes, two keys of the bytes, their SHA-256, and the gram of every place picked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1):
            raws = raw_bytes(batch.column(1))
            b = Bytes(raws)
            keys = [key_pair(r) for r in raws]
            at, names = picks(b, length)
            cut = np.searchsorted(at, b.bounds).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(b.counts), pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()), pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()),
                    list_column([names[i:j] for i, j in zip(cut[:-1], cut[1:])], pa.int64()),
                ],
                ["row", "n_bytes", "k1", "k2", "sha", "grams"],
            )

    return base.select("row", "text").mapInArrow(run, "row long, n_bytes long, k1 long, k2 long, sha binary, grams array<long>")


def stretch_strings(texts: DataFrame, length: int) -> DataFrame:
    """(row, at, bytes, stretches) for each run of stretches of ``texts`` (row, text, found) whose grams are in ``found``.

    ``bytes`` are the text's from place ``at`` on; a stretch's places are those in the text, its name is that of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1):
            raws = raw_bytes(batch.column(1))
            b = Bytes(raws)
            begin, end, names = stretches(b, length)
            found = batch.column(2)
            size = np.diff(found.offsets.to_numpy())
            both = lambda text, m: mix(m + text.astype(np.uint64) * ODD)
            known = both(np.repeat(np.arange(batch.num_rows), size), found.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            hit = np.isin(both(b.text_of(begin), names), known)
            begin, end, names = begin[hit], end[hit], names[hit]
            text, whole = b.text_of(begin), b.all.tobytes()
            x = np.array([key_pair(whole[i:j]) for i, j in zip(begin.tolist(), (end + length - 1).tolist())], dtype=np.int64).reshape(-1, 2)
            first = runs_of(begin, end, text)
            last = np.append(first[1:], len(begin))
            off = b.bounds[text]
            parts = pa.StructArray.from_arrays(
                [long_column(names), pa.array((begin - off).astype(np.int32)), pa.array((end - off).astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1])],
                ["mark", "begin", "end", "x1", "x2"],
            )
            strings = [whole[i:j] for i, j in zip(begin[first].tolist(), (end[last - 1] + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(0).to_numpy(zero_copy_only=False)[text[first]], pa.int64()),
                    pa.array((begin - off)[first].astype(np.int32)),
                    pa.array(strings, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(begin)).astype(np.int32)), parts),
                ],
                ["row", "at", "bytes", "stretches"],
            )

    return texts.mapInArrow(run, f"row long, at int, bytes binary, stretches {STRETCHES}")


def blocks_of(length: int) -> int:
    """Blocks of ``PERIOD`` bytes by which sampled suffixes are ranked."""
    return (length - PERIOD + 1) // PERIOD


class Entered:
    """Strings of a batch end to end, and the places of their stretches that enter."""

    def __init__(self, batch: pa.RecordBatch):
        self.b = Bytes(raw_bytes(batch.column("bytes")))
        self.row, self.at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "at"))
        parts = batch.column("stretches")
        of = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
        flat = parts.flatten()
        begin, end, enters = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end", "enters"))
        keep = enters.astype(bool)
        of = of[keep]
        shift = self.b.bounds[of] - self.at[of]
        begin, end = begin[keep] + shift, end[keep] + shift
        first = runs_of(begin, end, of)
        #: Strings of ``length`` bytes start from ``low`` on and before ``high``; runs neither touch nor overlap.
        self.low, self.high = begin[first], end[np.append(first[1:], len(begin)) - 1] if len(begin) else end

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, run) of each sampled place less than ``PERIOD`` after a start; twice where two runs are that near."""
        size = self.high - self.low + PERIOD - 1
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.low[run]
        residues = np.zeros(PERIOD, dtype=bool)
        residues[list(COVER)] = True
        keep = residues[self.in_text(place) % PERIOD]
        return place[keep], run[keep]

    def in_text(self, place: np.ndarray) -> np.ndarray:
        of = self.b.text_of(place)
        return place - self.b.bounds[of] + self.at[of]


def sampled_triples(strings: DataFrame, length: int) -> DataFrame:
    """(c0, c1, c2, row, string, place): the first three characters at every place whose name the second sort needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 2):
            e = Entered(batch)
            place, _ = e.sampled()
            place = np.unique(np.concatenate([place + k * PERIOD for k in range(blocks_of(length))]))
            of = e.b.text_of(place)
            names = string_names(e.b.all, CHARACTER) if len(place) else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(long_column(names[place + k * CHARACTER]) for k in range(3)),
                    pa.array(e.row[of], pa.int64()), pa.array(e.at[of], pa.int32()), pa.array(e.in_text(place).astype(np.int32)),
                ],
                ["c0", "c1", "c2", "row", "string", "place"],
            )

    kind = "c0 long, c1 long, c2 long, row long, string int, place int"
    return strings.select("row", "at", "bytes", "stretches").mapInArrow(run, kind)


def ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def named_triples(triples: DataFrame) -> DataFrame:
    """(row, string, place, name) of the triples that stand twice; names order as triples do."""
    key, n = ["c0", "c1", "c2"], ranges(triples)
    # First characters are hashes, so equal parts of their values hold equally many.
    part = F.pmod(F.floor((F.col("c0") / F.lit(2.0**64) + 0.5) * n), F.lit(n)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose next one is not known yet
        rank, before = 0, False

        def out(t: pa.RecordBatch, tied: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
            keep = pa.array(tied)
            columns = [t.column(c) for c in ("row", "string", "place")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(names)], ["row", "string", "place", "name"]).filter(keep)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            c = [t.column(k).to_numpy() for k in key]
            same = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1]) & (c[2][1:] == c[2][:-1])
            names = rank + np.concatenate([[0], np.cumsum(~same)])
            tied = np.concatenate([[before], same])
            tied[:-1] |= same
            high = t.column("part").to_numpy().astype(np.int64) << RANK_BITS
            yield out(t.slice(0, t.num_rows - 1), tied[:-1], (high | names)[:-1])
            held, rank, before = t.slice(t.num_rows - 1), int(names[-1]), bool(tied[-1])
        if held is not None:
            name = (held.column("part").to_numpy().astype(np.int64) << RANK_BITS) | rank
            yield out(held, np.array([before]), name)

    dealt = triples.withColumn("part", part).repartitionById(n, F.col("part")).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "row long, string int, place int, name long")


def sampled_tuples(strings: DataFrame, length: int) -> DataFrame:
    """(n0, n1, .., around, row, place): names of the blocks from each sampled place on, and the bytes on either side.

    ``strings`` also has ``named``, an array of (place, name). Places of which a block has no name stand alone and are left out.
    ``around`` is the least and the greatest shift allowed, the ``PERIOD - 1`` bytes before, nearest first, and those after the blocks.
    """
    blocks = blocks_of(length)
    side, tail = PERIOD - 1, length - blocks * PERIOD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 2):
            e = Entered(batch)
            place, of_run = e.sampled()
            known = batch.column("named")
            of = np.repeat(np.arange(batch.num_rows), np.diff(known.offsets.to_numpy()))
            flat = known.flatten()
            names = np.zeros(len(e.b.all) + 1, dtype=np.int64)
            names[flat.field("place").to_numpy(zero_copy_only=False) - e.at[of] + e.b.bounds[of]] = flat.field("name").to_numpy(zero_copy_only=False) + 1
            columns = [names[np.minimum(place + k * PERIOD, len(names) - 1)] for k in range(blocks)]
            keep = np.logical_and.reduce([c > 0 for c in columns])
            place, of_run, columns = place[keep], of_run[keep], [c[keep] - 1 for c in columns]
            around = np.zeros((len(place), 2 + side + tail), dtype=np.uint8)
            around[:, 0] = np.maximum(0, place - e.high[of_run] + 1)
            around[:, 1] = np.minimum(side, place - e.low[of_run])
            padded = np.concatenate([np.zeros(side, np.uint8), e.b.all, np.zeros(length, np.uint8)])
            for i in range(side):
                around[:, 2 + i] = padded[side + place - 1 - i]
            for i in range(tail):
                around[:, 2 + side + i] = padded[side + place + blocks * PERIOD + i]
            of = e.b.text_of(place)
            width = around.shape[1]
            offsets = pa.py_buffer((np.arange(len(place) + 1) * width).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(place), [None, offsets, pa.py_buffer(around.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in columns), packed, pa.array(e.row[of], pa.int64()), pa.array(e.in_text(place).astype(np.int32))],
                [*(f"n{k}" for k in range(blocks)), "around", "row", "place"],
            )

    kind = ", ".join(f"n{k} long" for k in range(blocks)) + ", around binary, row long, place int"
    return strings.select("row", "at", "bytes", "stretches", "named").mapInArrow(run, kind)


def shift_keys(rank: np.ndarray, around: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shift, tuples that have a string at this shift, 64-bit names of those strings)."""
    side = PERIOD - 1
    tail = around.shape[1] - 2 - side
    least, most = around[:, 0], around[:, 1]
    # Names of what follows, by length, and of what comes before, grown by one byte for each shift.
    follow = np.zeros((tail + 1, len(rank)), dtype=np.uint64)
    for i in range(tail):
        follow[i + 1] = mix(follow[i] * ODD + around[:, 2 + side + i] + np.uint64(1))
    lead = mix(rank)
    for shift in range(side + 1):
        if shift:
            lead = mix(lead * MIX_1 + around[:, 1 + shift] + np.uint64(1))
        can = np.flatnonzero((least <= shift) & (most >= shift))
        yield shift, can, mix(lead[can] ^ (follow[tail - shift][can] * ODD))


def rank_arrays(data: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(name of the rank, bytes around) of each tuple."""
    rank = np.zeros(data.num_rows, dtype=np.uint64)
    for c in sorted(x for x in data.schema.names if x[0] == "n"):
        rank = mix(rank * ODD + data.column(c).to_numpy().view(np.uint64))
    around = np.frombuffer(b"".join(data.column("around").to_pylist()), dtype=np.uint8).reshape(len(rank), -1)
    return rank, around


def split_ranks(tuples: DataFrame, length: int) -> DataFrame:
    """(row, place, shifts): shifts whose string stands twice, as bits, for each tuple that has one; ranks are sorted by names."""
    key, limit = [f"n{k}" for k in range(blocks_of(length))], 100_000

    def judge(t: pa.Table) -> pa.RecordBatch:
        rank, around = rank_arrays(t)
        bits = np.zeros(len(rank), dtype=np.int64)
        for shift, can, names in shift_keys(rank, around):
            order = np.argsort(names)
            k = names[order]
            same = np.zeros(len(k), dtype=bool)
            if len(k) > 1:
                next_to = k[1:] == k[:-1]
                same[1:] |= next_to
                same[:-1] |= next_to
            bits[can[order[same]]] |= 1 << shift
        t = t.combine_chunks()
        columns = [t.column(c).combine_chunks() for c in ("row", "place")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(bits)], ["row", "place", "shifts"]).filter(pa.array(bits > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < limit:
                continue
            t = pa.Table.from_batches(held)
            other = np.zeros(t.num_rows, dtype=bool)
            for c in key:
                values = t.column(c).to_numpy()
                other |= values != values[-1]
            whole = np.flatnonzero(other)
            end = int(whole[-1]) + 1 if len(whole) else 0  # the last rank may go on in the next batch
            if end:
                yield judge(t.slice(0, end))
            held, count = t.slice(end).to_batches(), t.num_rows - end
        if count:
            yield judge(pa.Table.from_batches(held))

    n = ranges(tuples)
    part = F.shiftright("n0", RANK_BITS).cast("int")
    # The second sort keeps the first one's ranges: names begin with them.
    dealt = tuples.repartitionById(n, F.pmod(part, F.lit(n))).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "row long, place int, shifts long")


def split_crowds(tuples: DataFrame, length: int) -> DataFrame:
    """``split_ranks`` by Spark's own aggregation, so no rank is held in a task; any order of rows will do."""
    key = [f"n{k}" for k in range(blocks_of(length))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(c) for c in ("row", "place")]
            for shift, can, names in shift_keys(*rank_arrays(batch)):
                picked = pa.array(can)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(picked) for c in ids), pa.array(np.full(len(can), shift, dtype=np.int64)), long_column(names)],
                    ["row", "place", "shift", "name"],
                )

    keyed = tuples.select(*key, "around", "row", "place").mapInArrow(run, "row long, place int, shift long, name long")
    twice = keyed.groupBy("shift", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shift", "name")
    found = keyed.join(twice, ["shift", "name"], "left_semi")
    return found.groupBy("row", "place").agg(F.expr("bit_or(shiftleft(1L, cast(shift as int)))").alias("shifts"))


def crowded_names(named: DataFrame, crowd: int, part: int = 64) -> DataFrame:
    """Names with about ``crowd`` holders or more, estimated on one in ``part`` of them.

    Either way of splitting is exact, so the estimate bears on memory only.
    """
    some = named.filter(F.pmod(F.xxhash64("row", "place"), F.lit(part)) == 0)
    return some.groupBy("name").count().filter(F.col("count") * part >= crowd).select(F.col("name").alias("n0"))


def repeated_places(strings: DataFrame, length: int, crowd: int, part: int = 64) -> DataFrame:
    """(row, place, shifts), pinned: sampled places and the shifts before them at which a string starts that stands twice.

    ``strings`` is (row, at, bytes, stretches), pinned, with judged stretches.
    """
    named = pin(named_triples(sampled_triples(strings, length)))
    of_string = named.groupBy("row", "string").agg(F.collect_list(F.struct("place", "name")).alias("named"))
    tuples = sampled_tuples(strings.join(of_string.withColumnRenamed("string", "at"), ["row", "at"]), length)
    crowded = pin(crowded_names(named, crowd, part))
    if crowded.isEmpty():
        found = pin(split_ranks(tuples, length))
    else:
        held = pin(tuples)
        rest, crowds = (held.join(crowded, "n0", how) for how in ("left_anti", "left_semi"))
        found = pin(split_ranks(rest, length).unionByName(split_crowds(crowds, length)))
        unpin(held)
    unpin(named, crowded)
    return found


def cut_bytes(texts: DataFrame, length: int) -> DataFrame:
    """(row, gone, cuts, left_sha, left_bytes, spans) of ``texts`` (row, text, starts, hits).

    ``starts`` are ranges (begin, end) of places whose string goes; a hit is a sampled place and its shifts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1):
            gone, spans, digests, lefts, starts = [], [], [], [], []
            for raw, whole, hits in zip(raw_bytes(batch.column(1)), batch.column(2), batch.column(3)):
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                if whole.is_valid:
                    np.add.at(edge, whole.values.field("begin").to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, whole.values.field("end").to_numpy(zero_copy_only=False) + length - 1, -1)
                if hits.is_valid:
                    at = hits.values.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
                    bits = hits.values.field("shifts").to_numpy(zero_copy_only=False)
                    for shift in range(PERIOD):
                        s = at[(bits >> shift) & 1 == 1] - shift
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + length, -1)
                cut = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(raw, dtype=np.uint8)[~cut].tobytes()
                turn = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                gone.append(int(cut.sum()))
                spans.append(len(turn) // 2)
                digests.append(hashlib.sha256(left).digest())
                lefts.append(left)
                starts.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
            where = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.binary()), pa.array(lefts, pa.binary()), pa.array(starts, where)],
                ["row", "gone", "cuts", "left_sha", "left_bytes", "spans"],
            )

    schema = "row long, gone long, cuts long, left_sha binary, left_bytes binary, spans array<struct<start:long,end:long>>"
    return texts.mapInArrow(run, schema)


def remove_repeated_bytes(
    docs: DataFrame, length: int = 200, with_text: bool = False, crowd: int = 200_000
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans and kept_bytes, if asked for).

    ``length`` must be at least ``2 * PERIOD``. Ranks of about ``crowd`` holders or more are split by Spark.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"length must be at least {2 * PERIOD}")
    base = pin(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    profile = pin(byte_profile(base, length))
    key = ["k1", "k2", "n_bytes"]
    groups = profile.groupBy(*key).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = groups.select(F.col("first").alias("row"))
    found = found_marks(profile, firsts, "grams")
    texts = base.select("row", "text")
    regions = pin(stretch_strings(texts.join(found, "row").select("row", "text", "found"), length))
    judged = pin(judged_stretches(regions))
    entered = judged.filter(F.exists("stretches", lambda s: s["enters"]))
    strings = pin(regions.drop("stretches").join(entered, ["row", "at"]).select("row", "at", "bytes", "stretches"))
    unpin(regions)
    places = repeated_places(strings, length, crowd)
    unpin(strings)
    hits = places.groupBy("row").agg(F.collect_list(F.struct("place", "shifts")).alias("hits"))
    both = equal_starts(judged).join(hits, "row", "full")
    cut = cut_bytes(texts.join(both, "row").select("row", "text", "starts", "hits"), length)
    if not with_text:
        cut = cut.drop("left_bytes", "spans")
    ids = base.select("row", "doc_id", *(["text"] if with_text else []))
    whole_rows = profile.select("row", "sha", *key).join(groups, key).join(cut, "row", "left").join(ids, "row")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda all_gone, part, none: F.when(whole, all_gone).when(F.col("gone").isNotNull(), part).otherwise(none)
    out = [
        F.col("doc_id"),
        F.col("n_bytes"),
        pick(F.col("n_bytes"), F.col("gone"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("cuts"), F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(pick(F.unhex(F.sha2(F.lit(""), 256)), F.col("left_sha"), F.col("sha")))).alias("kept_sha256"),
    ]
    if with_text:
        all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        none = F.array().cast("array<struct<start:long,end:long>>")
        out.append(pick(all_of, F.col("spans"), none).alias("spans"))
        out.append(pick(F.lit(b""), F.col("left_bytes"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kept_bytes"))
    return whole_rows.select(*out)
