"""Personal data: base patterns, then a skip-chain conditional random field.

Base patterns find emails, IP addresses, card and phone numbers. The field then
labels every token that holds a digit or an at-sign (tokens without either can only
be ordinary text). Its potentials are

* a node potential of the token's shape and its neighbours,
* a chain potential between tokens next to each other,
* a skip potential between repeated or similar tokens of the same text, however far
  apart: tokens with the same last seven digits, or the same mail name or host. The
  occurrences of a key are linked each to the next, and each to the nearest one
  before and after it that a base span holds, so links grow with the tokens.

Tokens under a base span are held at its kind, so their evidence comes to every
other occurrence over one link. Loopy sum-product message passing runs over all
links of all texts of an Arrow batch at once, for each text until its messages stop
changing; a token whose marginal for a kind reaches ``threshold`` becomes an added
span. So a number that a base pattern caught in one place is caught in the other
places, whatever its spelling.

Node, chain and skip weights are trained on the driver by pseudo-likelihood on
labelled sentences made by rule (``training_texts``; their number is a parameter).

Defined results: a null text is empty and has no spans; spans count code points, end
exclusive. Repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)  # the label of ordinary tokens

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
#: All bytes but those that a marked token must hold.
UNMARKED = bytes(b for b in range(256) if b not in b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the mail pattern; found from each at-sign, so long runs cost no second look."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        d = only_digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m[0])) <= 15:
            found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


FEATURES = (
    "one", "at", "at and stop", "plus first", "bracket", "three stops", "stop", "hyphen", "letter", "no letter",
    "digits 1-2", "digits 3", "digits 4", "digits 5-6", "digits 7", "digits 8-9", "digits 10-11", "digits 12-13",
    "digits 14-19", "digits 20+", "only digits", "card sum", "parts to 255", "says phone", "says mail", "says card",
    "says address", "says version", "neighbour marked", "colon", "equals or quote", "percent or money",
)
SAYS = {
    "says phone": ("phone", "tel", "call", "mobile", "fax"),
    "says mail": ("mail", "email", "e-mail", "contact"),
    "says card": ("card", "visa", "paid"),
    "says address": ("ip", "server", "host"),
    "says version": ("version", "v", "section", "page", "chapter", "license", "cc"),
}
PLACE = {name: i for i, name in enumerate(FEATURES)}
SAYING = {word: PLACE[name] for name, words in SAYS.items() for word in words}
EDGE = re.compile(r"^[^0-9A-Za-z+(@]+|[^0-9A-Za-z)]+$")


def shape(token: str, before: str, near: bool) -> list[int]:
    """Places of the features that hold for a token."""
    core = EDGE.sub("", token)
    digits = only_digits(core)
    n = len(digits)
    bare = core.replace(" ", "")
    found = [0]
    add = lambda name, yes: found.append(PLACE[name]) if yes else None
    at = core.find("@")
    letters = any(c.isalpha() for c in core)
    add("at", at >= 0)
    add("at and stop", at > 0 and "." in core[at:])
    add("plus first", core.startswith("+"))
    add("bracket", "(" in core or ")" in core)
    add("three stops", core.count(".") == 3 and not letters)
    add("stop", "." in core)
    add("hyphen", "-" in core)
    add("letter" if letters else "no letter", True)
    for name, low, high in (
        ("digits 1-2", 1, 2), ("digits 3", 3, 3), ("digits 4", 4, 4), ("digits 5-6", 5, 6), ("digits 7", 7, 7),
        ("digits 8-9", 8, 9), ("digits 10-11", 10, 11), ("digits 12-13", 12, 13), ("digits 14-19", 14, 19),
    ):
        add(name, low <= n <= high)
    add("digits 20+", n >= 20)
    add("only digits", bare.isdigit())
    add("card sum", 14 <= n <= 19 and luhn(digits))
    add("parts to 255", core.count(".") == 3 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in core.split(".")))
    said = SAYING.get(before.lower().strip(":.,"))
    if said is not None:
        found.append(said)
    add("neighbour marked", near)
    add("colon", ":" in core)
    add("equals or quote", "=" in token or '"' in token)
    add("percent or money", token[-1] in "%$" or token[0] in "$")
    return found


def keys(token: str) -> list[str]:
    """Tokens that share a key are linked."""
    core = EDGE.sub("", token).lower()
    digits = only_digits(core)
    found = []
    if len(digits) >= 7 and not any(c.isalpha() for c in core):
        found.append("d" + digits[-7:])
    if any(c.isalpha() for c in core):
        name, at, host = core.partition("@")
        if len(name) >= 5:
            found.append("n" + name)
        if at and len(host) >= 8:
            found.append("n" + host)
    return found


class Nodes:
    """Marked tokens of many texts, with their features, held labels and links."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # text number, start, end
        self.shapes: list[list[int]] = []
        self.held: list[int] = []  # a kind, or -1
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def read(self, number: int, text: str, base: list[tuple[int, int, int]]) -> None:
        holders: dict[str, list[int]] = {}
        before, before_node, b = "", -1, 0
        digits_before = False
        for m in TOKEN.finditer(text):
            token = m[0]
            if not MARKED.search(token):
                before, before_node, digits_before = token, -1, False
                continue
            start, end = m.span()
            while b < len(base) and base[b][1] <= start:
                b += 1
            held = -1
            for s in base[b : b + 4]:
                if s[0] < end and s[1] > start:
                    held = s[2]
                    break
            node = len(self.spans)
            self.spans.append((number, start, end))
            self.shapes.append(shape(token, before, digits_before))
            self.held.append(held)
            if before_node >= 0:
                self.chain.append((before_node, node))
            for key in keys(token):
                holders.setdefault(key, []).append(node)
            before, before_node, digits_before = token, node, True
        for nodes in holders.values():
            self.skip += zip(nodes, nodes[1:])
            for way in (nodes, nodes[::-1]):
                near = -1  # the last held node, where the next link does not come from it
                for previous, node in zip(way, way[1:]):
                    if self.held[previous] >= 0:
                        near = previous
                    if near >= 0 and near != previous and self.held[node] < 0:
                        self.skip.append((near, node))


class SkipChain:
    """Weights: node (features x labels), chain (labels x labels), skip (one for agreement per label)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def node_scores(self, shapes: list[list[int]], held: list[int]) -> np.ndarray:
        of = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
        at = np.fromiter((f for s in shapes for f in s), dtype=int, count=len(of))
        scores = np.zeros((len(shapes), NONE + 1))
        np.add.at(scores, of, self.node[at])
        for kind in range(NONE):
            rows = np.array(held) == kind
            scores[rows] = -30.0
            scores[rows, kind] = 0.0
        return scores

    def marginals(
        self, nodes: Nodes, rounds: int | None = None, damping: float = 0.3, settled: float = 1e-6
    ) -> np.ndarray:
        """Loopy sum-product over all links at once, for each text until no message changes by ``settled``.

        The damping of texts whose messages go on changing grows every 200 rounds, so every
        text ends, in rounds that do not grow with it. ``rounds`` stops earlier.
        """
        scores = self.node_scores(nodes.shapes, nodes.held)
        links = nodes.chain + nodes.skip
        if links:
            a, b = np.array(links).T
            table = np.concatenate(
                [np.repeat(self.chain[None], len(nodes.chain), 0), np.repeat(np.diag(self.skip)[None], len(nodes.skip), 0)]
            )
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            text = np.array([s[0] for s in nodes.spans])[source]
            done = np.zeros((2 * len(a), NONE + 1))
            live, messages, turn = np.arange(2 * len(a)), done.copy(), 0
            used, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
            while len(live) and turn != rounds:
                half = len(live) // 2  # the second half holds the same links the other way
                back = np.concatenate([np.arange(half) + half, np.arange(half)])
                belief = scores[used]
                np.add.at(belief, ends[2 * half :], messages)
                out = (belief[ends[: 2 * half]] - messages[back])[:, :, None] + table[live]
                top = out.max(axis=1, keepdims=True)
                fresh = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                fresh -= fresh.max(axis=1, keepdims=True)
                keep = 1 - (1 - damping) * 0.5 ** (turn // 200)
                fresh = keep * messages + (1 - keep) * fresh
                moved = np.zeros(nodes.spans[-1][0] + 1)
                np.maximum.at(moved, text[live], np.abs(fresh - messages).max(axis=1))
                messages, turn = fresh, turn + 1
                on = moved[text[live]] >= settled
                if not on.all():
                    done[live] = messages
                    live, messages = live[on], messages[on]
                    used, ends = np.unique(np.concatenate([source[live], target[live]]), return_inverse=True)
            done[live] = messages
            scores = scores.copy()
            np.add.at(scores, target, done)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def training_texts(count: int, seed: int = 23) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences made by rule: (text, true spans)."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in r.integers(0, 10, n))
    plain = ("the", "report", "was", "sent", "over", "river", "meeting", "about", "garden", "green", "music", "later")
    names = ("anna", "peter", "maria.lopez", "j.smith", "office", "sales", "k_meyer", "lena", "support", "tom")

    def card() -> str:
        d = pick("45") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def spellings(kind: int) -> list[str]:
        if kind == 0:
            name, host = pick(names) + num(2), f"mail{num(1)}.example.com"
            return [f"{name}@{host}", f"{name}(at){host}", name, f"{name} at {host}"]
        if kind == 1:
            ip = ".".join(str(int(x)) for x in r.integers(1, 255, 4))
            return [ip, f"{ip}:8080", f"{ip}/24"]
        if kind == 2:
            c = card()
            return [c, "-".join(c[i : i + 4] for i in range(0, 16, 4)), f"xx{c[4:]}", c]
        a, b, c = num(3), num(3), num(4)
        return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}{b}{c}"]

    def other() -> str:
        return pick(
            (
                f"version {num(1)}.{num(1)}", f"{num(4)}", f"{num(2)}%", f"${num(3)}", f"page {num(2)}", f"{num(1)}.{num(1)}.{num(1)}",
                hashlib.sha1(num(8).encode()).hexdigest(), f"v{num(1)}.{num(2)}.{num(3)}.x", f"{num(4)}-{num(2)}-{num(2)}",
                f"{num(2)}:{num(2)}", f"{num(6)}", f"item{num(3)}", f"{num(8)}", f"{num(12)}", f"@{pick(plain)}", f"order {num(9)}",
                f"password={hashlib.sha1(num(8).encode()).hexdigest()[: int(r.integers(8, 30))]}", f"key{num(16)}ab",
                hashlib.md5(num(8).encode()).hexdigest()[: int(r.integers(12, 30))], f'token = "{num(3)}a{num(9)}bc{num(7)}"',
            )
        )

    out = []
    for _ in range(count):
        words: list[tuple[str, int]] = []
        for _ in range(int(r.integers(1, 4))):
            kind = int(r.integers(0, 6))
            words += [(pick(plain), NONE) for _ in range(int(r.integers(2, 7)))]
            if kind >= NONE:
                words += [(other(), NONE)]
                continue
            ways = spellings(kind)
            cue = {0: "email", 1: "server", 2: "card", 3: "phone"}[kind]
            words += [(cue, NONE)] * int(r.random() < 0.3) + [(ways[0], kind)]
            if r.random() < 0.2:
                beside = int(r.integers(0, NONE))
                words.append((spellings(beside)[0], beside))
            if r.random() < 0.6:
                words += [(pick(plain), NONE) for _ in range(int(r.integers(2, 9)))] + [(pick(ways), kind)]
        text, spans = "", []
        for word, kind in words:
            if kind < NONE:
                spans.append((len(text), len(text) + len(word), kind))
            text += word + pick((" ", " ", " ", ", ", "\n"))
        out.append((text, spans))
    return out


def train(count: int = 600, rounds: int = 120, l2: float = 1e-3, rate: float = 0.2) -> SkipChain:
    """Pseudo-likelihood: each token's label given its neighbours' true labels."""
    nodes, truth = Nodes(), []
    for i, (text, spans) in enumerate(training_texts(count)):
        first = len(nodes.spans)
        nodes.read(i, text, [])
        for _, start, end in nodes.spans[first:]:
            truth.append(next((k for a, b, k in spans if a < end and b > start), NONE))
    y, n = np.array(truth), len(truth)
    of = np.repeat(np.arange(n), [len(s) for s in nodes.shapes])
    at = np.fromiter((f for s in nodes.shapes for f in s), dtype=int, count=len(of))
    chain, skip = np.array(nodes.chain), np.array(nodes.skip)
    p = [np.zeros((len(FEATURES), NONE + 1)), np.zeros((NONE + 1, NONE + 1)), np.zeros(NONE + 1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    eye = np.eye(NONE + 1)
    for turn in range(1, rounds + 1):
        scores = np.zeros((n, NONE + 1))
        np.add.at(scores, of, p[0][at])
        np.add.at(scores, chain[:, 1], p[1][y[chain[:, 0]]])
        np.add.at(scores, chain[:, 0], p[1].T[y[chain[:, 1]]])
        for a, b in (skip.T, skip.T[::-1]):
            np.add.at(scores, a, eye[y[b]] * p[2])
        q = np.exp(scores - scores.max(axis=1, keepdims=True))
        miss = eye[y] - q / q.sum(axis=1, keepdims=True)
        grad = [np.zeros_like(x) for x in p]
        np.add.at(grad[0], at, miss[of])
        np.add.at(grad[1], y[chain[:, 0]], miss[chain[:, 1]])
        np.add.at(grad[1].T, y[chain[:, 1]], miss[chain[:, 0]])
        for a, b in (skip.T, skip.T[::-1]):
            grad[2] += (miss[a] * eye[y[b]]).sum(axis=0)
        for i in range(3):
            g = grad[i] / n * 10 - l2 * p[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] + rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)
    p[2][NONE] = min(p[2][NONE], 0.0)
    return SkipChain(*p)


def added_spans(nodes: Nodes, chances: np.ndarray, threshold: float) -> dict[int, list[tuple[int, int, int]]]:
    """Tokens that no base span touches and whose chance for a kind reaches the threshold.

    Phone tokens next to each other make one span until one starts with a plus sign.
    """
    found: dict[int, list[tuple[int, int, int]]] = {}
    best = chances[:, :NONE].argmax(axis=1) if len(chances) else []
    follows = {b: a for a, b in nodes.chain}
    grown = -2
    for i, kind in enumerate(best):
        if nodes.held[i] >= 0 or chances[i, kind] < threshold:
            continue
        number, start, end = nodes.spans[i]
        spans = found.setdefault(number, [])
        plus = PLACE["plus first"] in nodes.shapes[i]
        if kind == 3 and grown == i - 1 and follows.get(i) == i - 1 and not plus:
            spans[-1] = (spans[-1][0], end, 3)
        else:
            spans.append((start, end, int(kind)))
        grown = i if kind == 3 else -2
    return found


def find_spans(texts: list[str], field: SkipChain, threshold: float) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    nodes, base = Nodes(), []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        base.append(spans)
        nodes.read(i, text, spans)
    added = added_spans(nodes, field.marginals(nodes), threshold) if nodes.spans else {}
    trimmed = []
    for i, text in enumerate(texts):
        extra = []
        for start, end, kind in added.get(i, []):
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
                end -= 1
            if start < end:
                extra.append((start, end, kind))
        trimmed.append((base[i], extra))
    return trimmed


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_personal_data(docs: DataFrame, threshold: float = 0.9, training: int = 600) -> DataFrame:
    """One row per document: doc_id, base counts by kind, base_sha256, spans, n_added."""
    field = docs.sparkSession.sparkContext.broadcast(train(training))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64()]
    empty = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [empty] * batch.num_rows
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            some = [i for i, x in enumerate(raw) if x and x.translate(None, UNMARKED)]
            found = find_spans([raw[i].decode("utf-8", "replace") for i in some], field.value, threshold)
            for i, (base, extra) in zip(some, found):
                counts = [sum(1 for s in base if s[2] == k) for k in range(NONE)]
                digest = hashlib.sha256(as_text(base).encode()).hexdigest()
                rows[i] = (*counts, digest, as_text(base + extra), len(extra))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return picked.mapInArrow(run, schema)
