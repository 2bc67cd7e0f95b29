"""SentencePiece encoding and decoding with N-best segmentation.

A piece's weight is the log of a Zipf law over its place in the model's merge
order, so a segmentation's weight is a sum over its pieces. The best segmentation
of a unit, and what its second best loses, come from a forward Viterbi pass over the
piece lattice; the N best of a unit from a backward A-star search from its end, for
which the forward scores are the exact cost of what is left, so hypotheses leave the
agenda in order of weight. Only units in which a text's N best can differ are searched.

No piece of the model crosses from a character into a following word-start mark,
nor holds a character outside the model's own; a text therefore falls into units
whose lattices are independent, and the N best of a text come from the N best of
its units. Every character without a piece is written as its UTF-8 bytes, so any
text survives a round trip; a word-start mark in the text itself is written as
bytes too.

The vocabulary (32,000 entries, bounded) is broadcast. A worker process keeps the units it
has solved for a job, at most ``2 * cache_size`` of up to ``LONG`` characters and an eighth of ``cache_size`` with all of
their segmentations, from task to task.

Defined results: a null text is the empty text and has no pieces, weight 0 and one
segmentation. Ties in weight are broken by the longer last piece first. A text of any length is
split, solved and decoded whole; texts are taken in chunks of about 1.5 MB, a longer one alone. Repeated
rows are encoded alike; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored by the operator and kept by none.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import uuid
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._tokens import in_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a word-start mark that is in the text itself; no unit is empty.
RAW = ""
#: Longer units are solved each time they come up, so a full cache has a bounded size.
LONG = 64


class Pieces:
    """The piece table, and the search on one unit."""

    def __init__(self, table: dict[str, int], byte_ids: list[int], weight: np.ndarray):
        self.table, self.byte_ids = table, byte_ids
        self.weight = weight.tolist()
        #: Trees of the pieces read forwards and backwards: character -> [weight and id of the piece that is whole there, or nothing; next characters].
        self.tree, self.ending = self._tree(False), self._tree(True)
        chars = set("".join(table)) - {MARK}
        inside = {piece[i : i + 2] for piece in table for i in range(len(piece) - 1)}
        if any(x != MARK and y == MARK for x, y in inside):
            raise ValueError("a piece crosses into a word-start mark; units would not be independent")
        letters = {c for c in chars if c.isalpha()}
        rest = chars - letters
        known, word, other = ("".join(re.escape(c) for c in sorted(x)) for x in (chars, letters, rest))
        if any(x in letters and y in rest for x, y in inside):
            units = f"{MARK}*[{known}]+|{MARK}+"
        else:  # no piece goes on from a letter to another character either
            units = f"{MARK}*[{other}]*[{word}]+|{MARK}*[{other}]+|{MARK}+"
        #: Known characters with the marks before them, marks alone, or unknown characters.
        self.unit = re.compile(f"{units}|[^{MARK}{known}]+")

    def _tree(self, backwards: bool) -> dict[str, list]:
        tree: dict[str, list] = {}
        for piece, i in self.table.items():
            below = tree
            for c in reversed(piece) if backwards else piece:
                node = below.setdefault(c, [None, {}])
                below = node[1]
            node[0] = (self.weight[i], (i,), packed((i,)))
        return tree

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        table, byte_ids = {}, [0] * 256
        weight = np.zeros(sp.get_piece_size())
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                table[sp.id_to_piece(i)] = i
        total = math.log(sum(1.0 / r for r in range(1, len(table) + 1)))
        for rank, piece in enumerate(sorted(table, key=table.get), 1):
            weight[table[piece]] = -math.log(rank) - total
        weight[byte_ids] = -math.log(len(table) + 1) - total
        return cls(table, byte_ids, weight)

    def as_bytes(self, character: str) -> tuple[float, tuple[int, ...], bytes]:
        ids = tuple([self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")])
        return sum([self.weight[i] for i in ids]), ids, packed(ids)

    def forward(self, units: list[str]) -> list[tuple[float, bytes, float | None]]:
        """The forward Viterbi pass alone: of each unit the weight and packed ids of the heaviest segmentation, and what the second loses.

        The two heaviest weights at each place suffice for the loss; which units of a text its N best can differ in follows from
        it, and only those go to ``solve``. A place depends on what stands before it, so units in order share the places of
        their common beginnings.
        """
        ending, nothing = self.ending, -math.inf
        first, second, came = [0.0], [nothing], [None]
        before, out = "", []
        for unit in units:
            size, same = len(unit), 0
            for x, y in zip(before, unit):
                if x != y:
                    break
                same += 1
            before = unit
            del first[same + 1 :], second[same + 1 :], came[same + 1 :]
            for at in range(same, size):
                character = unit[at]
                edge, below = ending.get(character) or (None, None)
                edge = edge or self.as_bytes(character)
                weight = edge[0]
                one, two, last = first[at] + weight, second[at] + weight, (at, edge)
                while below and at:
                    at -= 1
                    node = below.get(unit[at])
                    if node is None:
                        break
                    edge, below = node
                    if edge:
                        weight = edge[0]
                        total = first[at] + weight
                        if total >= one:
                            two = max(one, second[at] + weight)
                            one, last = total, (at, edge)
                        elif total > two:
                            two = total
                first.append(one)
                second.append(two)
                came.append(last)
            parts, at = [], size
            while at:
                at, edge = came[at]
                parts.append(edge[2])
            parts.reverse()
            out.append((first[size], b"".join(parts), first[size] - second[size] if second[size] > nothing else None))
        return out

    def solve(self, unit: str, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n_best`` segmentations of a unit, heaviest first."""
        size, tree = len(unit), self.tree
        ending: list[list] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-math.inf] * size
        for start, (character, reached) in enumerate(zip(unit, forward)):
            found, below = tree.get(character) or (None, {})
            for end, c in enumerate(unit[start + 1 :], start + 2):
                node = below.get(c)
                if node is None:
                    break
                edge, below = node
                if edge:
                    ending[end].append((start, edge))
                    total = reached + edge[0]
                    if total > forward[end]:
                        forward[end] = total
            edge = found or self.as_bytes(character)
            end = start + 1
            ending[end].append((start, edge))
            total = reached + edge[0]
            if total > forward[end]:
                forward[end] = total
        # A hypothesis stands for its heaviest completion, and no two for the same one,
        # so the agenda never needs more of them than results are still wanted.
        best: list = []
        agenda = [(-forward[size], 0, size, 0.0, None)]
        tick = 0
        while agenda and len(best) < n_best:
            _, _, at, so_far, path = agenda.pop(0)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                best.append((so_far, tuple(ids)))
                continue
            room = n_best - len(best)
            worst = math.inf if len(agenda) < room else agenda[-1][0]
            for start, (w, ids, _) in ending[at]:
                behind = w + so_far
                cost = -(forward[start] + behind)
                if cost < worst:
                    tick += 1
                    insort(agenda, (cost, tick, start, behind, (ids, path)))
                    if len(agenda) > room:
                        agenda.pop()
                    if len(agenda) == room:
                        worst = agenda[-1][0]
        return best


def packed(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def escape(text: str) -> str:
    """Spaces become marks, with one mark in front."""
    return MARK + text.replace(" ", MARK)


class Encoder:
    """Encodes and decodes whole texts; one per worker process and job."""

    def __init__(self, pieces: Pieces, n_best: int, cache_size: int):
        self.p, self.n, self.cache_size = pieces, n_best, cache_size
        #: Two generations of unit -> (weight, packed ids, loss of the second best); the older one is dropped.
        self.cache: dict[str, tuple[float, bytes, float | None]] = {}
        self.older: dict[str, tuple[float, bytes, float | None]] = {}
        #: Unit -> its segmentations after the best, for units that a text's N best differ in.
        self.others: dict[str, list[tuple[float, bytes]]] = {}
        mark = pieces.as_bytes(MARK)
        self.cache[RAW] = (mark[0], mark[2], None)
        by_id: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, i in pieces.table.items()}
        by_id.update({i: bytes([b]) for b, i in enumerate(pieces.byte_ids)})
        self.bytes_of = [by_id.get(i, b"") for i in range(len(pieces.weight))]

    def _units(self, text: str) -> list[str]:
        """The units of a text, ``RAW`` for a mark of its own."""
        if MARK not in text:
            return self.p.unit.findall(escape(text))
        units: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            if i:
                units.append(RAW)
            units += self.p.unit.findall(part.replace(" ", MARK) if i else escape(part))
        return units

    def _solve(self, units: set[str]) -> dict[str, tuple[float, bytes, float | None]]:
        """Units that the newer cache lacks, those seen for the first time solved in order."""
        older = self.older
        solved = {u: older[u] for u in units if u in older}
        new = sorted(units - solved.keys()) if solved else sorted(units)
        solved.update(zip(new, self.p.forward(new)))
        if len(self.cache) >= self.cache_size:
            self.older, self.cache = self.cache, {RAW: self.cache[RAW]}
        self.cache.update((u, e) for u, e in solved.items() if len(u) <= LONG)
        return solved

    def _others(self, unit: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of a unit's segmentations after the best."""
        out = self.others.get(unit)
        if out is None:
            found = self.p.solve(unit, self.n)
            out = [(max(0.0, found[0][0] - w), packed(ids)) for w, ids in found[1:]]
            if len(unit) <= LONG:
                if len(self.others) >= self.cache_size // 8:
                    self.others = {}
                self.others[unit] = out
        return out

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """The ``n_best`` segmentations of a text: (weight, little-endian 32-bit ids)."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[tuple[float, bytes]]]:
        """``encode`` of each text, with the new units of all of them solved in order."""
        get, held, missing = self.cache.get, [], set()
        for text in texts:
            units = self._units(text) if text else []
            entries = list(map(get, units))
            holes = [k for k, e in enumerate(entries) if e is None] if None in entries else []
            missing.update([units[k] for k in holes])
            held.append((units, entries, holes))
        solved = self._solve(missing)
        for units, entries, holes in held:
            for k in holes:
                entries[k] = solved[units[k]]
        return [self._n_best(units, entries) for units, entries, _ in held]

    def _n_best(self, units: list[str], entries: list[tuple[float, bytes, float | None]]) -> list[tuple[float, bytes]]:
        total = math.fsum([e[0] for e in entries])
        best = [e[1] for e in entries]
        out = [(total, b"".join(best))]
        if self.n > 1:
            # Only units whose second best loses least can differ in the N best.
            near = heapq.nsmallest(self.n - 1, [(e[2], k) for k, e in enumerate(entries) if e[2] is not None])
            combos: list[tuple[float, tuple]] = [(0.0, ())]
            for _, k in near:
                options = [(0.0, None), *self._others(units[k])]
                combos = heapq.nsmallest(
                    self.n,
                    [(a + loss, c if ids is None else (*c, (k, ids))) for a, c in combos for loss, ids in options],
                )
            for loss, changes in combos[1:]:
                swapped = best.copy()
                for k, ids in changes:
                    swapped[k] = ids
                out.append((total - loss, b"".join(swapped)))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        text = b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<i4").tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def _encoder(spark: SparkSession, model: str, n_best: int, cache_size: int):
    pieces = Pieces.load(model)
    sent = spark.sparkContext.broadcast((pieces.table, pieces.byte_ids, np.array(pieces.weight)))
    job = uuid.uuid4().hex
    return lambda: _held_encoder(job, sent, n_best, cache_size)


#: The encoder of the job that this worker process last worked for, with what it has solved.
_HELD: dict[str, Encoder] = {}


def _held_encoder(job: str, sent, n_best: int, cache_size: int) -> Encoder:
    """One encoder for all tasks of a job that a worker process runs."""
    if job not in _HELD:
        _HELD.clear()
        _HELD[job] = Encoder(Pieces(*sent.value), n_best, cache_size)
    return _HELD[job]


def encode_documents(
    docs: DataFrame, model: str = MODEL, n_best: int = 4, cache_size: int = 400_000
) -> DataFrame:
    """One row per document: doc_id, ids (best segmentation), weights and all_ids (of the N best), round_trip (of each of them)."""
    make = _encoder(docs.sparkSession, model, n_best, cache_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in in_chunks(batches, 1):
            ids, every, weights, same = [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, found in zip(texts, encoder.encode_all(texts)):
                every.append([np.frombuffer(x, dtype="<i4") for _, x in found])
                ids.append(every[-1][0])
                weights.append([w for w, _ in found])
                same.append(all([encoder.decode(x) == (text or "") for _, x in found]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(weights, pa.list_(pa.float64())),
                    pa.array(same, pa.bool_()),
                    pa.array(every, pa.list_(pa.list_(pa.int32()))),
                ],
                ["doc_id", "ids", "weights", "round_trip", "all_ids"],
            )

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, weights array<double>, round_trip boolean, all_ids array<array<int>>"
    return picked.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), the ids of one segmentation each: ``ids`` of ``encode_documents`` or one of its ``all_ids``.

    Null ids are no pieces. ValueError in a task for an id that the model does not have, or ids whose bytes are no UTF-8.
    """
    make = _encoder(encoded.sparkSession, model, 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = make()
        last = len(decoder.bytes_of)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if any(not 0 <= i < last for i in ids or ()):
                    raise ValueError("an id that the model does not have")
                texts.append(decoder.decode(packed(tuple(ids or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = encoded.select("doc_id", "ids")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")


def summarise(docs: DataFrame, model: str = MODEL, n_best: int = 4, cache_size: int = 400_000) -> DataFrame:
    """``encode_documents`` with the ids as digests: doc_id, n_pieces, ids_sha256, best, runner_up, n_found, round_trip, weights, all_sha256."""
    make = _encoder(docs.sparkSession, model, n_best, cache_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in in_chunks(batches, 1):
            rows = []
            texts = batch.column(1).to_pylist()
            for text, found in zip(texts, encoder.encode_all(texts)):
                digests = [hashlib.sha256(x).hexdigest() for _, x in found]
                rows.append(
                    (
                        len(found[0][1]) // 4,
                        digests[0],
                        round(found[0][0], 6),
                        round(found[1][0], 6) if len(found) > 1 else None,
                        len(found),
                        all([encoder.decode(x) == (text or "") for _, x in found]),
                        [round(w, 6) for w, _ in found],
                        digests,
                    )
                )
            kinds = (
                pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.string())
            )
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                ["doc_id", "n_pieces", "ids_sha256", "best", "runner_up", "n_found", "round_trip", "weights", "all_sha256"],
            )

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(
        run,
        f"doc_id {kind}, n_pieces long, ids_sha256 string, best double, runner_up double, n_found long, round_trip boolean, "
        "weights array<double>, all_sha256 array<string>",
    )
