"""Quality rules with a linear-chain conditional random field over lines.

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows. A text that passes them is read as a sequence of its lines with a word;
Viterbi decoding marks each as content or boilerplate, and the share of words in
content lines decides whether the text stays.

The field has one weight per line feature and state and a 2 x 2 transition table. It is trained on the driver by gradient ascent on the
conditional likelihood (forward-backward) over a bounded sample of labelled
documents: at most ``max_docs`` of them, at most ``max_lines`` lines of each; both are
parameters. Lines of good documents are content. Lines of bad documents
start as boilerplate, and after the first fit those that the model takes for content
are relabelled, but for the line most like boilerplate, and the model is fitted anew.

Decoding reads every whole text of every row in Arrow batches; nothing is shuffled.

Defined results: a null text has no words and fails the base rules; so does any text
of under 20 words. Without labels of both kinds the field marks every line content,
so the base rules alone decide. Repeated rows are judged alike; an empty table gives
an empty result; other columns are ignored (report) or passed through (filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

#: Byte classes: other, white space, lower case, upper case, digit, symbol, bang, stop, bar, later byte of a character.
OTHER, SPACE, LOW, UP, DIGIT, SYMBOL, BANG, STOP, BAR, LATER = range(10)
CLASSES = np.zeros(256, dtype=np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[97:123] = LOW
CLASSES[65:91] = UP
CLASSES[48:58] = DIGIT
CLASSES[list(b"#*$%&<>")] = SYMBOL
CLASSES[list(b"!?")] = BANG
CLASSES[list(b".,;:")] = STOP
CLASSES[list(b"|")] = BAR
CLASSES[0x80:0xC0] = LATER

FEATURES = (
    "one", "symbols>1%", "symbols>5%", "symbols>20%", "upper>20%", "upper>50%", "digits>10%", "digits>40%",
    "bars>=1", "bars>1%", "bars>5%", "bangs>2%", "bangs>10%", "stops=0", "letters<50%", "under 6 words",
    "under 3 words", "seen before in the text", "long words",
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more (a power of two)."""
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    span, distinct = 1, len(names)
    while span < window:
        if distinct == len(name):
            return 0
        pairs = name[:-span] * (distinct + 1) + name[span:]
        kinds, name = np.unique(pairs, return_inverse=True)
        span, distinct = span * 2, len(kinds)
    if distinct == len(name):
        return 0
    again = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def read_text(raw: bytes | None) -> tuple[tuple[int, int, int, int, int], list[int], np.ndarray]:
    """Base counts, and words and features of each line that has a word.

    The counts are n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
    """
    if not raw:
        return (0, 0, 0, 0, 0), [], np.zeros((0, len(FEATURES)))
    words = raw.split()
    kinds = CLASSES[np.frombuffer(raw, dtype=np.uint8)]
    lines = raw.split(b"\n")
    line_of = np.repeat(np.arange(len(lines)), [len(x) + 1 for x in lines])[:-1]
    counts = np.bincount(line_of * 10 + kinds, minlength=10 * len(lines)).reshape(-1, 10)
    total = counts.sum(axis=0)
    n_words = [len(x.split()) for x in lines]
    seen: set[bytes] = set()
    again = np.zeros(len(lines))
    for i, x in enumerate(lines):
        if n_words[i]:
            if x in seen:
                again[i] = 1
            else:
                seen.add(x)
    base = (
        len(words),
        int(total.sum() - total[LATER] - total[SPACE]),
        int(total[SYMBOL] + total[BAR]),
        int(again.sum()),
        repeated_words(words),
    )
    some = np.flatnonzero(n_words)
    of = np.array(n_words)[some]
    c = counts[some]
    size = np.maximum(1, c.sum(axis=1) - c[:, SPACE] - c[:, LATER])
    share = c / size[:, None]
    letters = share[:, LOW] + share[:, UP] + share[:, OTHER]
    x = np.stack(
        [
            np.ones(len(some)), share[:, SYMBOL] > 0.01, share[:, SYMBOL] > 0.05, share[:, SYMBOL] > 0.2,
            share[:, UP] > 0.2, share[:, UP] > 0.5, share[:, DIGIT] > 0.1, share[:, DIGIT] > 0.4,
            c[:, BAR] >= 1, share[:, BAR] > 0.01, share[:, BAR] > 0.05, share[:, BANG] > 0.02, share[:, BANG] > 0.1,
            c[:, STOP] == 0, letters < 0.5, of < 6, of < 3, again[some], size / of > 9,
        ],
        axis=1,
    ).astype(float)
    return base, of.tolist(), x


class LineField:
    """Weights of the field; states are 0 content and 1 boilerplate."""

    def __init__(self, weights: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start, step

    @classmethod
    def neutral(cls) -> LineField:
        return cls(np.zeros((len(FEATURES), 2)), np.array([1.0, 0.0]), np.zeros((2, 2)))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best state of each line; ties go to content."""
        if not len(x):
            return np.zeros(0, dtype=int)
        scores = (x @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for u, v in scores[1:]:
            from_a, from_b = b + s10 > a + s00, b + s11 > a + s01
            back.append((from_a, from_b))
            a, b = u + max(a + s00, b + s10), v + max(a + s01, b + s11)
        state = int(b > a)
        states = [state]
        for choice in reversed(back):
            state = int(choice[state])
            states.append(state)
        return np.array(states[::-1])


def fit(lines: list[np.ndarray], states: list[np.ndarray], rounds: int = 120, l2: float = 0.002, rate: float = 0.3) -> LineField:
    """Gradient ascent (Adam) on the conditional log likelihood of line states."""
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    groups = [order[i : i + 64] for i in range(0, len(order), 64)]
    packed = []
    for g in groups:
        long = max(len(lines[i]) for i in g)
        x, y, mask = np.zeros((len(g), long, len(FEATURES))), np.zeros((len(g), long), int), np.zeros((len(g), long))
        for k, i in enumerate(g):
            n = len(lines[i])
            x[k, :n], y[k, :n], mask[k, :n] = lines[i], states[i], 1
        packed.append((x, y, mask))
    total = sum(map(len, lines))
    p = {"w": np.zeros((len(FEATURES), 2)), "s": np.zeros(2), "t": np.zeros((2, 2))}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for turn in range(1, rounds + 1):
        grad = {k: -l2 * v for k, v in p.items()}
        for x, y, mask in packed:
            for k, v in _gradient(x, y, mask, p).items():
                grad[k] = grad[k] + v / total * 10
        grad["s"][:] = 0.0  # a text of one line says nothing about how texts begin
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v2[k] = 0.99 * v2[k] + 0.01 * grad[k] ** 2
            p[k] = p[k] + rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v2[k] / (1 - 0.99**turn)) + 1e-8)
    return LineField(p["w"], p["s"], p["t"])


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, p: dict) -> dict:
    """Observed less expected feature counts of a padded group of texts."""
    docs, long, _ = x.shape
    node = x @ p["w"]
    forward, backward = np.zeros((docs, long, 2)), np.zeros((docs, long, 2))
    forward[:, 0] = node[:, 0] + p["s"]
    for t in range(1, long):
        ahead = node[:, t] + _log_add(forward[:, t - 1, :, None] + p["t"], 1)
        forward[:, t] = np.where(mask[:, t, None] > 0, ahead, forward[:, t - 1])
    for t in range(long - 2, -1, -1):
        behind = _log_add(p["t"] + (node[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, behind, 0.0)
    norm = _log_add(forward[:, -1], 1)
    at = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
    told = np.eye(2)[y] * mask[..., None]
    out = {"w": np.einsum("dlf,dls->fs", x, told - at), "s": (told - at)[:, 0].sum(axis=0), "t": np.zeros((2, 2))}
    if long > 1:
        both = forward[:, :-1, :, None] + p["t"] + (node + backward)[:, 1:, None, :] - norm[:, None, None, None]
        pair = np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]
        seen = np.einsum("dls,dlr->sr", told[:, :-1] * mask[:, 1:, None], told[:, 1:])
        out["t"] = seen - pair.sum(axis=(0, 1))
    return out


def train(good: list[np.ndarray], bad: list[np.ndarray]) -> LineField:
    """Two fits: bad documents' lines all as boilerplate, then as the first fit sees them."""
    good, bad = [x for x in good if len(x)], [x for x in bad if len(x)]
    if not good or not bad:
        return LineField.neutral()
    content = [np.zeros(len(x), int) for x in good]
    first = fit(good + bad, content + [np.ones(len(x), int) for x in bad])
    again = []
    for x in bad:
        states = first.viterbi(x)
        lean = x @ first.weights
        states[int(np.argmax(lean[:, 1] - lean[:, 0]))] = 1
        again.append(states)
    return fit(good + bad, content + again)


def sample_lines(docs: DataFrame, labels: DataFrame, max_docs: int, max_lines: int, seed: int):
    """Line features of at most ``max_docs`` labelled documents, in the proportions of the labels."""
    known = labels.select(F.col("doc_id").alias("d"), F.col("quality").alias("q")).filter("d IS NOT NULL")
    picked = known.filter("q IN (0, 1)").orderBy(F.xxhash64("d", F.lit(seed)), "d", "q").limit(max_docs).collect()
    ids = {label: {r["d"] for r in picked if r["q"] == label} for label in (0, 1)}
    wanted = sorted(ids[0] ^ ids[1])
    if not ids[0] or not ids[1] or not wanted:
        return [], []

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_text(raw)[2][:max_lines].astype("float32") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (
        docs.filter(F.col("doc_id").isin(wanted))
        .select("doc_id", "text")
        .mapInArrow(lines, f"doc_id {kind}, x binary")
        .collect()
    )
    sets: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["x"]))):
        x = np.frombuffer(bytes(r["x"]), dtype="float32").reshape(-1, len(FEATURES)).astype(float)
        sets[0 if r["doc_id"] in ids[0] else 1].append(x)
    return sets[1], sets[0]


def _judge(field: LineField, min_content: float, raw: bytes | None) -> tuple:
    base, of, x = read_text(raw)
    failed = base[0] < MIN_WORDS or 100 * base[4] > 30 * base[0]
    states = field.viterbi(x)
    content = sum(n for n, s in zip(of, states.tolist()) if not s)
    share = content / base[0] if base[0] else 0.0
    return (*base, failed, not failed and share >= min_content, share, len(of), int(len(of) - states.sum()))


def train_field(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_lines: int = 200, seed: int = 11) -> LineField:
    return train(*sample_lines(docs, labels, max_docs, max_lines, seed))


OUTPUT = (
    ("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"), ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"), ("content_share", pa.float64(), "double"), ("n_lines", pa.int64(), "long"),
    ("n_content_lines", pa.int64(), "long"),
)


def quality_report(docs: DataFrame, labels: DataFrame, min_content: float = 0.5, **training) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and what the field found."""
    field = train_field(docs, labels, **training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_judge(field, min_content, raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(OUTPUT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(n for n, _, _ in OUTPUT)])

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, _, t in OUTPUT)]))


def keep_quality(docs: DataFrame, labels: DataFrame, min_content: float = 0.5, **training) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    field = train_field(docs, labels, **training)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([_judge(field, min_content, raw)[6] for raw in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
