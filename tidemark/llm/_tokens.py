"""Words as 64-bit names, and many texts in one array; used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words of more bytes than that are named one by one.
SHORT = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


class WordNames(dict):
    """Word -> 64-bit name, the same in every task. Holds at most ``limit`` words at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def named_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the words of all rows in order, A-Z in lower case, and where each row's words begin (and the last one's end).

    The names differ from those of ``WordNames``. They are made from the column's bytes, eight at a time, without an object for each word.
    """
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    none = np.zeros(0, dtype=np.uint64), np.zeros(len(raw) + 1, dtype=np.int64)
    if not len(raw):
        return none
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return none
    low = bytes(memoryview(raw.buffers()[2])[offsets[0] : offsets[-1]]).lower() + bytes(8)
    offsets = offsets - offsets[0]
    byte = np.frombuffer(low, dtype=np.uint8)[:size]
    inside = np.zeros(size + 2, dtype=bool)  # byte i at i + 1, and white space around
    inside[1:-1] = (byte != 32) & (byte - np.uint8(9) > 4)
    first = offsets[(offsets > 0) & (offsets < size)]
    cut = np.unique(first[inside[first] & inside[first + 1]])  # rows that end in a word before rows that begin with one
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if len(cut):
        edges = np.sort(np.concatenate([edges, cut, cut]))
    begin, end = edges[::2], edges[1::2]
    n = end - begin
    eight = np.ndarray(size + 1, dtype="<u8", buffer=low, strides=(1,))
    masks = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)
    names = mix((eight[begin] & masks[np.minimum(n, 8)]) + n.astype(np.uint64) * ODD)
    for k in range(8, SHORT, 8):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        names[more] = mix(names[more] * MIX_1 + eight[np.minimum(begin[more] + k, end[more] - 8)])
    for i in np.flatnonzero(n > SHORT):
        names[i] = xxhash.xxh3_64_intdigest(low[begin[i] : end[i]])
    return names, np.searchsorted(begin, offsets)


def window_names(names: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A 64-bit name for every run of ``width`` names (empty if there are fewer)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(int(ODD) * (2 * seed + 1) % 2**64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * base + names[i : i + n]
    return mix(out + np.uint64(seed))


def key_pair(raw: bytes) -> tuple[int, int]:
    """128 bits of a byte string, as two signed longs."""
    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def in_chunks(batches: Iterator[pa.RecordBatch], text: int, budget: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``budget`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0)
        start, held = 0, 0
        for i, size in enumerate(sizes.to_pylist()):
            if held and held + size > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array from one array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))
