"""Words are named from the bytes of a column; the names tell the same words apart as the words themselves."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm._tokens import WordNames, named_words
from tidemark.llm.near_join import shingles


def texts_of_many_kinds() -> list:
    r = random.Random(4)
    words = ["x" * k + end for k in range(80) for end in ("", "y", "\0", "\0\0", "é", "Z", "z")] + ["ÄB", "äb", "äB", " ", " a", "\x1c", "漢字" * 20]
    rows = [None, "", " ", "\t\n\r\x0b\x0c ", "end", "begin", "", "end ", " begin", None, "b", "B", "a b c d", "A B\nC\tD"]
    rows += ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t \r"]) for _ in range(r.randrange(1, 40))).strip(r.choice(["", " "])) for _ in range(300)]
    return rows


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
@pytest.mark.parametrize("start, count", [(0, None), (5, 100), (0, 1), (3, 1), (7, 0)])
def test_names_tell_words_apart(kind, start, count):
    rows = texts_of_many_kinds()
    column = pa.array(rows if kind != pa.binary() else [x and x.encode() for x in rows], kind).slice(start, count)
    want = [(x or "").encode().lower().split() for x in (rows[start:] if count is None else rows[start : start + count])]
    names, begin = named_words(column)
    assert list(np.diff(begin)) == [len(x) for x in want] and begin[0] == 0 and len(begin) == len(want) + 1
    flat = [w for x in want for w in x]
    assert len(names) == len(flat) and len(set(zip(names.tolist(), flat))) == len(set(names.tolist())) == len(set(flat))


def test_shingles_stay_within_rows():
    rows = texts_of_many_kinds()
    got = shingles(pa.array(rows), 3)
    alone = [shingles(pa.array([x], pa.string()), 3)[0] for x in rows]
    assert all(np.array_equal(x, y) for x, y in zip(got, alone)) and len(got) == len(rows)
    for x, tokens in zip(rows, got):
        n = len((x or "").encode().split())
        assert len(tokens) == (n - 2 if n >= 3 else min(n, 1))


def test_naming_costs_less_than_an_object_for_each_word():
    r = random.Random(5)
    rows = [" ".join(f"Word{r.randrange(10**6)}" for _ in range(500)) for _ in range(400)]
    column = pa.array(rows)

    def seconds(f) -> float:
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    def one_by_one():
        namer = WordNames()
        return [namer.of(x.lower().split()) for x in column.cast(pa.binary()).to_pylist()]

    assert 2 * seconds(lambda: named_words(column)) < seconds(one_by_one)
