"""Substring dedup by recompression: repeated windows of words are found and removed.

Rounds of recompression turn each text, a string of word names, into ever shorter
strings: first every run of one word becomes a symbol, then in each round every pair
of a left and a right symbol does (a bit of a symbol's hash says which it is). Equal
substrings get equal symbols inside, up to a few at their ends: for a window of words
the symbols that its own words settle are known, as what stands outside cannot change them.

1. *Mark.* Each task parses its texts with symbols named by hash. A window's mark is, of the
   highest round in which it settles enough symbols, the few in a row with the least hash. Equal windows have equal
   marks, wherever they stand; Spark counts the marks of all texts, and a window whose mark
   stands at one place only is left out. What is left are stretches of windows with one
   mark; equal stretches are one string with a count (see ``_stretches``).
2. *Name.* The strings of words that enter go through Spark rounds. In each, every run or
   pair is counted over all strings and those that stand twice get a name, unique
   among all rounds: a number, no hash. One that stands once is in no repeated window, and ends them.
3. *Reveal and verify.* A window is read as its symbols: those that each round leaves at its
   two ends, and those of the last round inside. Symbols stand for one sequence of words
   each, so windows with the same symbols are equal in all words. Spark counts them.

Texts are read twice, to find stretches and to cut; all between works on strings of
word names. Equal texts are read as one: all their words go if they hold a window. No group is ever
gathered: marks, runs, pairs and windows are pre-aggregated before each shuffle and
looked up with joins that Spark splits.

Defined results: a null or empty text has no words and loses none; a text of under
``window`` words loses none. Texts of any length are read whole, a long one in a batch of its own.
Repeated rows count as copies of each other; ties do not arise. An empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
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
from tidemark.llm._tokens import MIX_1, MIX_2, ODD, WordNames, in_chunks, key_pair, list_column, long_column, mix

ROUNDS = 4


class Strings:
    """Words of several texts end to end; text ``i`` has the places ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, texts: list[list[bytes]], namer: WordNames):
        self.counts = np.array([len(t) for t in texts], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)
        self.names = namer.of([w for t in texts for w in t])

    def windows(self, width: int) -> np.ndarray:
        """Places where a window of ``width`` words starts that lies in one text."""
        n = len(self.names) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.text_of[:n] == self.text_of[width - 1 :])


def settled_rounds(s: Strings, width: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round (names of its symbols, a, z): the window from each start settles the symbols from a on and before z."""
    start = s.windows(width)
    name, text = mix(s.names), s.text_of
    a, z = start.copy(), start + width
    yield name, a, z
    # Runs of one word. What stands before a window may belong to its first run.
    fresh = np.ones(len(name), dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    of = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(name)))
    a, z = of[a] + 1, of[z - 1]
    name, text = mix(name[first] * ODD + length.astype(np.uint64)), text[first]
    yield name, a, z
    for r in range(rounds):
        left = (name >> np.uint64(63)) == 0
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & (text[:-1] == text[1:])
        begins = np.ones(len(name), dtype=bool)
        begins[1:] = ~pair[:-1]
        of = np.append(np.cumsum(begins) - 1, begins.sum())
        # A right symbol at the window's start may be paired with what stands before; a left one at its end with what follows.
        size = len(name)
        a_in, z_in = np.minimum(a, size - 1), np.clip(z - 1, 0, size - 1)
        a = of[np.minimum(np.where(left[a_in], a_in, a_in + 1), size)]
        z = np.where(left[z_in], of[z_in], of[z_in] + 1)
        head = np.flatnonzero(begins)
        paired = pair[head]
        follow = name[np.minimum(head + 1, size - 1)]
        name = np.where(paired, mix(name[head] * ODD + follow * MIX_2 + np.uint64(r + 1)), mix(name[head] + np.uint64(r + 1)))
        text = text[head]
        yield name, a, z


#: Symbols in a row that make a mark, and bits for a place in a batch, which holds fewer words than 2 ** 32. Of equal
#: hashes in a window the first place counts, wherever the window stands.
TOGETHER, PLACE_BITS = 3, 32


def least_between(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of ``values`` from a on and before z, for a < z."""
    level = np.frexp((z - a).astype(np.float64))[1] - 1
    table = [values]
    for k in range(int(level.max()) if len(level) else 0):
        below, span = table[-1], 1 << k
        table.append(np.minimum(below, np.append(below[span:], below[-span:])))
    flat, size = np.concatenate(table), len(values)
    return np.minimum(flat[level * size + a], flat[level * size + z - (1 << level)])


def marks(s: Strings, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, name of its mark, place of the mark among all symbols of all rounds).

    Of the highest round with enough settled symbols the ``TOGETHER`` in a row that have the least hash, the first of equals.
    """
    start = s.windows(width)
    mark, place = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.int64)
    if not len(start):
        return start, mark, place
    together = min(TOGETHER, width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    todo, levels = np.ones(len(start), dtype=bool), list(settled_rounds(s, width, rounds))
    for turn in range(len(levels) - 1, -1, -1):
        name, a, z = levels[turn]
        use = np.flatnonzero(todo & (z - a >= together))
        if not len(use):
            continue
        todo[use] = False
        row = name.copy()
        for i in range(1, together):
            row[:-i] = mix(row[:-i] * ODD + name[i:])
        least = least_between((row & ~low) | np.arange(len(row)).astype(np.uint64), a[use], z[use] - together + 1)
        at = (least & low).astype(np.int64)
        mark[use] = mix(row[at] + np.uint64(turn))
        place[use] = at + (turn << PLACE_BITS)
    return start, mark, place


def split_words(raw: bytes | None) -> list[bytes]:
    return raw.split() if raw else []


def marked_stretches(s: Strings, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, mark): windows that start from begin on and before end have the very same symbol as mark."""
    start, mark, place = marks(s, width, rounds)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return start[first], start[np.append(first[1:], len(start)) - 1] + 1 if len(start) else start, mark[first]


def word_profile(base: DataFrame, window: int, rounds: int) -> DataFrame:
    """``base`` with n_words, two keys of the word sequence, its SHA-256, and mark and first place of each stretch.

    Stretches cover all windows of a text, so each ends where the next one begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = WordNames()
        for batch in in_chunks(batches, 1):
            texts = [split_words(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            s = Strings(texts, namer)
            joined = [b" ".join(t) for t in texts]
            keys = [key_pair(x) for x in joined]
            begin, _, mark = marked_stretches(s, window, rounds)
            place = begin - s.bounds[s.text_of[begin]]
            cut = np.searchsorted(begin, s.bounds).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(s.counts), pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in joined], pa.binary()),
                    list_column([mark[i:j] for i, j in zip(cut[:-1], cut[1:])], pa.int64()),
                    list_column([place[i:j] for i, j in zip(cut[:-1], cut[1:])], pa.int32()),
                ],
                ["row", "text", "doc_id", "n_words", "k1", "k2", "sha", "marks", "begins"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("row", "text", "doc_id").mapInArrow(
        run, f"row long, text string, doc_id {kind}, n_words long, k1 long, k2 long, sha binary, marks array<long>, begins array<int>"
    )


def stretch_strings(texts: DataFrame, window: int) -> DataFrame:
    """(row, at, words, stretches) for each run of stretches of ``texts`` (row, text, found, marks, begins) whose marks are in ``found``.

    ``words`` are names of the text's words from place ``at`` on; a stretch's places are those in the text. Only these words are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = WordNames()
        for batch in in_chunks(batches, 1):
            words = [split_words(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            known_of, text = (np.repeat(np.arange(batch.num_rows), np.diff(batch.column(c).offsets.to_numpy())) for c in (2, 3))
            known, mark, begin = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            begin = begin.astype(np.int64)
            count = np.array([len(w) for w in words], dtype=np.int64)
            end = np.append(begin[1:], 0)
            is_last = np.append(text[1:] != text[:-1], True)
            end[is_last] = count[text[is_last]] - window + 1
            both = lambda text, m: mix(m.view(np.uint64) + text.astype(np.uint64) * ODD)
            hit = np.isin(both(text, mark), both(known_of, known))
            begin, end, mark, text = begin[hit], end[hit], mark[hit], text[hit]
            first = runs_of(begin, end, text)
            last = np.append(first[1:], len(begin))
            held = [words[t][i:j] for t, i, j in zip(text[first].tolist(), begin[first].tolist(), (end[last - 1] + window - 1).tolist())]
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
            names = namer.of([w for h in held for w in h])
            shift, whole = np.repeat(bounds[:-1] - begin[first], last - first), names.tobytes()
            spans = zip((8 * (begin + shift)).tolist(), (8 * (end + shift + window - 1)).tolist())
            x = np.array([key_pair(whole[i:j]) for i, j in spans], dtype=np.int64).reshape(-1, 2)
            parts = pa.StructArray.from_arrays(
                [long_column(mark), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1])],
                ["mark", "begin", "end", "x1", "x2"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(0).to_numpy(zero_copy_only=False)[text[first]], pa.int64()),
                    pa.array(begin[first].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), long_column(names)),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(begin)).astype(np.int32)), parts),
                ],
                ["row", "at", "words", "stretches"],
            )

    return texts.mapInArrow(run, f"row long, at int, words array<long>, stretches {STRETCHES}")


def entering_strings(strings: DataFrame, window: int) -> DataFrame:
    """(row, at, s0) for each run of stretches of ``strings`` that enter: the names of its words; a window starts at all but the last ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, out = [], [], []
            for row, at, words, parts in zip(*(batch.column(c) for c in ("row", "at", "words", "stretches"))):
                p = parts.values
                begin, end, enters = (p.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end", "enters"))
                begin, end = begin[enters.astype(bool)], end[enters.astype(bool)]
                first = runs_of(begin, end, np.zeros(len(begin), dtype=np.int64))
                names = words.values.to_numpy(zero_copy_only=False)
                for i, j in zip(begin[first].tolist(), end[np.append(first[1:], len(begin)) - 1].tolist() if len(begin) else []):
                    rows.append(row.as_py())
                    ats.append(i)
                    out.append(names[i - at.as_py() : j - at.as_py() + window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ats, pa.int32()), list_column(out, pa.int64())], ["row", "at", "s0"])

    return strings.select("row", "at", "words", "stretches").mapInArrow(run, "row long, at int, s0 array<long>")


#: In the place of a run or pair that stands once.
ALONE = 0


def parsed(names: np.ndarray, text: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of round ``turn`` of strings end to end: (first symbol of each, its second part or 0, block of each symbol).

    Round 0 makes runs, a block's second part being its length; later ones make pairs. A block of one symbol has no second part.
    """
    size = len(names)
    fresh = np.ones(size, dtype=bool)
    if turn == 0:
        fresh[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, size))
        return first, np.where(length > 1, length, 0), np.cumsum(fresh) - 1
    left, live = left_symbols(names, turn), names != ALONE
    pair = left[:-1] & ~left[1:] & live[:-1] & live[1:] & (text[:-1] == text[1:])
    fresh[1:] = ~pair
    first = np.flatnonzero(fresh)
    second = np.zeros(size, dtype=np.int64)
    second[:-1][pair] = names[1:][pair]
    return first, second[first], np.cumsum(fresh) - 1


def left_symbols(names: np.ndarray, turn: int) -> np.ndarray:
    return (mix(names.view(np.uint64) * ODD + np.uint64(turn)) >> np.uint64(63)) == 0


def end_to_end(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, string of each, bounds) of a list column."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(bounds)), bounds - bounds[0]


def composed(strings: DataFrame, turn: int) -> DataFrame:
    """(row, at, block, a, b): every run or pair of the round, by its place among the string's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, text, bounds = end_to_end(batch.column(2))
            first, second, of = parsed(names, text, turn)
            base = of[bounds[:-1][np.diff(bounds) > 0]]
            start = np.zeros(batch.num_rows, dtype=np.int64)
            start[np.diff(bounds) > 0] = base
            block = np.flatnonzero(second)
            at = text[first[block]]
            row, place = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array((block - start[at]).astype(np.int32)), pa.array(names[first[block]]), pa.array(second[block])],
                ["row", "at", "block", "a", "b"],
            )

    return strings.select("row", "at", f"s{turn}").mapInArrow(run, "row long, at int, block int, a long, b long")


def next_round(strings: DataFrame, turn: int) -> DataFrame:
    """``strings`` with column ``s{turn + 1}``: the symbols after this round."""
    each = composed(strings, turn)
    number = F.lit((turn + 1) << 57).cast("long") + F.monotonically_increasing_id()
    names = pin(each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("a", "b", number.alias("name")))
    named = each.join(names, ["a", "b"]).groupBy("row", "at").agg(F.collect_list(F.struct("block", "name")).alias("named"))
    kept = [c for c in strings.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, text, bounds = end_to_end(batch.column(f"s{turn}"))
            first, second, of = parsed(names, text, turn)
            after = np.where(second == 0, names[first], ALONE)
            start = np.zeros(batch.num_rows + 1, dtype=np.int64)
            start[1:] = np.cumsum(np.bincount(text[first], minlength=batch.num_rows))
            known = batch.column("named")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(known.offsets.to_numpy()))
            flat = known.flatten()
            after[flat.field("block").to_numpy(zero_copy_only=False) + start[owner]] = flat.field("name").to_numpy(zero_copy_only=False)
            column = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(after))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, f"s{turn + 1}"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in strings.schema.fields) + f", s{turn + 1} array<long>"
    out = pin(strings.join(named, ["row", "at"], "left").mapInArrow(run, kind))
    unpin(names)
    return out


def window_symbols(strings: DataFrame, window: int, rounds: int) -> DataFrame:
    """(row, place, w1, w2): two hashes of the symbols that each window is read as, for windows all of whose symbols stand twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, text, bounds = end_to_end(batch.column("s0"))
            n = max(0, len(words) - window + 1)
            start = np.flatnonzero(text[:n] == text[window - 1 :]) if n else np.zeros(0, dtype=np.int64)
            a, z = start.copy(), start + window
            w = [np.zeros(len(start), dtype=np.uint64), np.ones(len(start), dtype=np.uint64)]
            live = np.ones(len(start), dtype=bool)

            def read(values, where, tag, w=w):
                for k, factor in enumerate((ODD, MIX_1)):
                    w[k][where] = mix(w[k][where] * factor + values[where].astype(np.int64).view(np.uint64) * MIX_2 + np.uint64(tag))

            names, owner = words, text
            for turn in range(rounds):
                size = len(names)
                first, second, of = parsed(names, owner, turn)
                inside, last = np.minimum(a, size - 1), np.clip(z - 1, 0, size - 1)
                open_ = a < z
                if turn == 0:  # what stands on either side may go on the first and the last run
                    one = of[inside] == of[last]
                    end_a = np.where(one, z, first[np.minimum(of[inside] + 1, len(first) - 1)])
                    read(names[inside], open_, 1)
                    read(end_a - a, open_, 2)
                    begin_z = np.where(one, a, first[of[last]])
                    read(names[last], open_ & ~one, 3)
                    read(z - begin_z, open_ & ~one, 4)
                    a, z = of[inside] + 1, np.maximum(of[last], of[inside] + 1)
                else:  # a right symbol in front may be paired with what stands before, a left one at the end with what follows
                    left = left_symbols(names, turn)
                    pop_a = open_ & ~left[inside]
                    read(names[inside], pop_a, 4 * turn + 1)
                    a = a + pop_a
                    open_ = a < z
                    pop_z = open_ & left[last]
                    read(names[last], pop_z, 4 * turn + 3)
                    z = z - pop_z
                    ends = np.append(of, len(first))
                    a, z = ends[np.minimum(a, size)], ends[np.minimum(z, size)]
                names, owner, _ = end_to_end(batch.column(f"s{turn + 1}"))
                dead = np.concatenate([[0], np.cumsum(names == ALONE)])
                live &= dead[np.minimum(np.maximum(a, z), len(names))] == dead[np.minimum(a, len(names))]
            size = int((z - a).max()) if len(a) else 0
            for i in range(size):
                read(names[np.minimum(a + i, len(names) - 1)], a + i < z, 4 * rounds + 5)
            at, of_start = start[live], text[start[live]]
            rows, ats = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "at"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[of_start], pa.int64()), pa.array((at - bounds[of_start] + ats[of_start]).astype(np.int32)), *(long_column(x[live]) for x in w)],
                ["row", "place", "w1", "w2"],
            )

    return strings.mapInArrow(run, "row long, place int, w1 long, w2 long")


def repeated_windows(strings: DataFrame, window: int, rounds: int) -> DataFrame:
    """(row, place), pinned: windows of ``strings`` (row, at, s0) that stand twice among them."""
    level = strings
    for turn in range(rounds):
        above = next_round(level, turn)
        unpin(level)
        level = above
    windows = pin(window_symbols(level, window, rounds))
    unpin(level)
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("w1", "w2")
    found = pin(windows.join(twice, ["w1", "w2"], "left_semi").select("row", "place"))
    unpin(windows)
    return found


def cut_words(texts: DataFrame, window: int) -> DataFrame:
    """(row, gone, left_sha, left_text) of ``texts`` (row, text, starts, places): ranges and places of windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1):
            removed, digests, kept = [], [], []
            for raw, starts, places in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3)):
                words = split_words(raw)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                if starts.is_valid:
                    np.add.at(edge, starts.values.field("begin").to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, starts.values.field("end").to_numpy(zero_copy_only=False) + window - 1, -1)
                if places.is_valid:
                    at = places.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).digest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "gone", "left_sha", "left_text"],
            )

    return texts.mapInArrow(run, "row long, gone long, left_sha binary, left_text string")


def remove_repeats(
    docs: DataFrame, window: int = 35, rounds: int = ROUNDS, with_text: bool = False, named_rounds: int = 4
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for)."""
    profile = pin(word_profile(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), window, rounds))
    key = ["k1", "k2", "n_words"]
    groups = profile.groupBy(*key).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    found = found_marks(profile, groups.select(F.col("first").alias("row")), "marks")
    texts = profile.select("row", "text")
    marked = profile.select("row", "text", "marks", "begins").join(found, "row")
    regions = pin(stretch_strings(marked.select("row", "text", "found", "marks", "begins"), window))
    judged = pin(judged_stretches(regions))
    entered = judged.filter(F.exists("stretches", lambda s: s["enters"]))
    strings = pin(entering_strings(regions.drop("stretches").join(entered, ["row", "at"]), window))
    unpin(regions)
    places = repeated_windows(strings, window, named_rounds)
    both = equal_starts(judged).join(places.groupBy("row").agg(F.collect_list("place").alias("places")), "row", "full")
    cut = cut_words(texts.join(both, "row").select("row", "text", "starts", "places"), window)
    if not with_text:
        cut = cut.drop("left_text")
    ids = ["doc_id", *(["text"] if with_text else [])]
    whole_rows = profile.select("row", "sha", *key, *ids).join(groups, key).join(cut, "row", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    pick = lambda all_gone, part, none: F.when(whole, all_gone).when(F.col("gone").isNotNull(), part).otherwise(none)
    out = [
        F.col("doc_id"),
        F.col("n_words"),
        pick(F.col("n_words"), F.col("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(pick(F.unhex(F.sha2(F.lit(""), 256)), F.col("left_sha"), F.col("sha")))).alias("kept_sha256"),
    ]
    if with_text:
        words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), " ")
        out.append(pick(F.lit(""), F.col("left_text"), words).alias("kept_text"))
    return whole_rows.select(*out)
