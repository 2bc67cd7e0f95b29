"""Filter audit, sharding and spelling variants against brute force, with nulls, ties, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, sharding, spelling
from tidemark.llm._common import pin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# Audit ---------------------------------------------------------------------------------------------------------------


def some_texts():
    rng = random.Random(5)
    texts = [None, "", "  \t", "a", "A b $", "word " * 250, " ".join(f"w{i}" for i in range(300)), "X" * 90 + " " + " ".join(f"v{i}" for i in range(220))]
    for _ in range(150):
        words = [rng.choice(["tide", "mark", "Sea", "SHIP", "a|b", "$5", "é", "née"]) if rng.random() < 0.4 else f"u{rng.randrange(400)}" for _ in range(rng.choice([3, 150, 199, 200, 260]))]
        texts.append(" ".join(words))
    texts += rng.choices(texts, k=120)
    rng.shuffle(texts)
    return texts


def audit_by_hand(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    seen = []
    for d, t, source in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t],
        }
        seen.append((source or "", {f for f in fails if fails[f]}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {s[0] for s in seen}:
        mine = [s for s in seen if s[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [bool(s[1] & set(order[:k])) for s in mine]
                here = [s for s, g in zip(mine, gone) if not g and f in s[1]]
                out[part, order, k + 1] = [
                    sum(not g and f not in s[1] for s, g in zip(mine, gone)), len(here), sum(g and f in s[1] for s, g in zip(mine, gone)),
                    sum(s[1] == {f} for s in mine), sum(s[2] for s in here), sum(s[3] for s in here),
                ]
    removed = defaultdict(int)
    for (part, order, step), v in out.items():
        removed[part, order[step - 1]] += v[1]
    return {key: [*v, removed[key[0], key[1][key[2] - 1]]] for key, v in out.items()}


def audited(df):
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in rows(df)}


def test_audit_equals_brute_force(spark, docs):
    texts = some_texts()
    ids = [None if i % 41 == 0 else i // 2 if i % 17 == 0 else i for i in range(len(texts))]
    sources = [None if i % 7 == 0 else "" if i % 11 == 0 else f"s{i % 3}" for i in range(len(texts))]
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, len(texts), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("x"))
    got = audited(audit.audit_filters(docs(texts, sources, ids).withColumns({"mask": F.lit("x"), "good": F.lit("x")}), table))
    assert got == audit_by_hand(list(zip(ids, texts, sources)), labels)


def test_audit_of_nothing_and_of_one_long_text(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert rows(audit.audit_filters(docs(["x"]).limit(0), labels)) == []
    got = audited(audit.audit_filters(docs(["long " * 400_000]), labels.limit(0)))
    assert len(got) == 600
    assert got["a", "BACDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["a", "ABCDE", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_sums_invert_to_cells(spark):
    rng = random.Random(2)
    masks = [rng.randrange(32) for _ in range(500)]
    df = spark.createDataFrame([("p", m, m % 2 == 0, False) for m in masks], "part string, mask int, good boolean, toxic boolean")
    cells = audit.mask_cells(audit.parity_sums(df)).first()["cells"]
    count = Counter(masks)
    assert [(c["mask"], c["n"], c["good"]) for c in cells] == [(m, count[m], count[m] * (m % 2 == 0)) for m in range(32)]


# Shards --------------------------------------------------------------------------------------------------------------


def check_shards(got, texts, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert len(got) == len(texts)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for t in texts)
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    return total


@pytest.mark.parametrize("samples", [8, 1])
def test_shards_are_near_equal_and_keep_small_groups(spark, docs, samples):
    rng = random.Random(7)
    texts = ["copy of a third " * 3] * 4000 + ["x" * rng.randrange(1, 90) + str(i // 2) for i in range(8000)] + [None, "", ""]
    ids = [None if i % 97 == 0 else i for i in range(len(texts))]
    got = rows(sharding.shard_records(docs(texts, ids=ids).repartition(7), samples=samples))
    total = check_shards(got, texts, 40)
    mean = sum(total.values()) / 40
    assert len(total) == 40 and max(abs(v - mean) for v in total.values()) < 0.05 * mean
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    hot = homes.pop((zlib.crc32(texts[0].encode()), len(texts[0]) + 16))
    assert 10 <= len(hot) <= 25 and sum(len(h) > 1 for h in homes.values()) <= 10


def test_equal_rows_of_equal_ids_are_cut(spark, docs):
    texts = ["same"] * 6000
    total = check_shards(rows(sharding.shard_records(docs(texts, ids=[3] * 6000))), texts, 40)
    assert len(total) == 40 and max(total.values()) < 1.1 * 6000 * 20 / 40


def test_shards_of_few_long_and_no_texts(spark, docs):
    assert rows(sharding.shard_records(docs(["x"]).limit(0))) == []
    texts = ["a", "y" * 3_000_000, "b"]
    check_shards(rows(sharding.shard_records(docs(texts))), texts, 40)


def test_heavy_ranges_are_subdivided(spark, docs):
    records = sharding.light_records(docs([str(i) for i in range(3000)]).withColumn("row", F.monotonically_increasing_id()))
    total = records.agg(F.sum("size")).first()[0]
    # One sampled key a range leaves many ranges at more than twice their due.
    placed = sharding.in_ranges(records, total, 3000, 4, 8, 1_000_000, 32, 1)
    assert placed.filter("piece > 0").count() > 0
    assert placed.count() == 3000


def test_written_shards_read_back(spark, docs, tmp_path):
    texts = [f"text {i % 50}" for i in range(300)] + [None]
    df = docs(texts)
    got = rows(sharding.write_shards(df, f"file://{tmp_path}/shards", shards=5, files=8))
    assert Counter(r["doc"]["text"] for r in got) == Counter(texts)
    assert {r["shard"] for r in got} == set(range(5))
    assert set(got[0]["doc"].asDict()) == set(df.columns)


# Spelling ------------------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(docs, slip):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = [form[w], None, n[w], len(others), n[best] if form[w] else None]
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out[w][1] = end
    return out


def spelled(df):
    return {r["word"]: [r[c] for c in ("form", "root", "n", "n_near", "form_n")] for r in rows(df)}


def made_texts(seed, letters, words, docs_):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randrange(5, 10))) for _ in range(words)]
    weights = [6 ** rng.randrange(5) for _ in base]
    return [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, weights, k=rng.randrange(1, 300))) + rng.choice(["", " 12x", "-", "×÷ÿ"]) for _ in range(docs_)]


@pytest.mark.parametrize("most_words", [20_000, 40, 2])
def test_spelling_equals_brute_force(spark, docs, most_words):
    texts = made_texts(3, "abcé", 900, 120) + [None, "", "ab cd", "Größen größen" * 9]
    texts += ["ubbbbbbb"] * 400 + ["ubbbbbbbc"] * 50 + ["ubbbbbbbcc"] * 8
    ids = [None if i % 29 == 0 else i // 2 for i in range(len(texts))]
    got = spelled(spelling.spelling_variants(docs(texts, ids=ids), slip=7, most_words=most_words))
    want = spelling_by_hand(list(zip(ids, texts)), 7)
    assert got == want and any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())


def test_spelling_of_the_contract(spark, docs):
    texts = made_texts(4, "aeioustrn", 300, 200)
    got = spelled(spelling.spelling_variants(docs(texts)))
    assert got == spelling_by_hand(list(enumerate(texts)), 199)


def test_spelling_of_nothing_and_of_long_words(spark, docs):
    assert rows(spelling.spelling_variants(docs(["x"]).limit(0))) == []
    long = "a" * 30_000
    texts = [f"{long} {long[1:]} {long}b"] * 5
    got = spelled(spelling.spelling_variants(docs(texts), slip=1 << 40))
    assert {w[-2:] + str(len(w)): v[3] for w, v in got.items()} == {"aa30000": 2, "aa29999": 1, "ab30001": 1}


@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_trie_pairs_equal_brute_force(letters):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(250)})
    found = list(spelling.trie_pairs(words))
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if near(a, b)}
    assert list(spelling.trie_pairs([])) == [] and list(spelling.trie_pairs(["abcdef"])) == []


def test_pairs_part_above_or_below_the_cut_once(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(6, 9))) for _ in range(600)})
    df = pin(spark.createDataFrame(pd.DataFrame({"word": words})))
    found = [tuple(r) for r in spelling.near_pairs(df, most_words=15).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if near(a, b)}
