"""Whole queries whose rows SQL cannot make, against plain Python over every row."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pii, quality, recompress
from tidemark.llm._tokens import WordNames
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed)


def checked_quality(rows, texts):
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(base_of(t))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_quality_query_equals_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op1_quality_rules"](spark, SF).collect()
    checked_quality(rows, texts)
    assert any(r.kept for r in rows) and any(r.base_failed for r in rows)


def test_quality_of_odd_texts(spark, docs):
    long = "A line of plain prose that says a little more each time.\n" * 20_000
    texts = [None, "", "\n\n \t\n", long, "w " * 19, "w " * 20, "é#*$ " * 30, "same text\r\nsame text\n" * 3, "tie " * 25, "tie " * 25]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_report(docs(texts, ids=ids), labels).collect()
    checked_quality(rows, list(zip(ids, texts)))
    assert len({r.kept for r in rows if r.doc_id == 8}) == 1


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    turned = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in turned) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def checked_spans(rows, texts):
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(base_spans(t))
    for r in rows:
        found = r.spans.split(",") if r.spans else []
        match = [b for b in want[r.doc_id] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256]
        assert match and set(match[0]) <= set(found)
        count = lambda kind: sum(s.startswith(f"{kind}:") for s in match[0])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count(k) for k, _ in PATTERNS)


def test_personal_data_query_equals_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    checked_spans(QUERIES["op2_personal_data"](spark, SF).collect(), texts)


def test_personal_data_of_odd_texts(spark, docs):
    texts = [
        None, "", "a@b.c, a@b.c! x..@y-.z.w", "1.2.3.4 999.1.1.1 1.2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (234) 567-8901. +12 3",
        "é😀 a@b.co " * 3000, "+" * 500 + "1" * 500, "a@b.c", "a@b.c",
    ]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    checked_spans(pii.find_personal_data(docs(texts, ids=ids).withColumn("spans", F.lit("x"))).collect(), list(zip(ids, texts)))


def test_marks_of_a_passage_are_the_same_wherever_it_stands():
    assert recompress.PLACE_BITS >= 32
    rng = np.random.default_rng(3)
    passage, *sides = ([b"%d" % k for k in rng.integers(lo, hi, n)] for lo, hi, n in ((1, 50, 100), (100, 10**6, 400), (100, 10**6, 400)))
    text = [*sides[0], *passage, *sides[1], *passage]
    start, mark, _ = recompress.marks(recompress.Strings([text], WordNames()), 35)
    of = dict(zip(start.tolist(), mark.tolist()))
    assert [of[400 + i] for i in range(66)] == [of[900 + i] for i in range(66)]
