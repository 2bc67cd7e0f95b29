"""The text operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import near_join
from tidemark.llm.exact_dedup import drop_exact_copies, exact_dedup
from tidemark.llm.mixing import mix_sources, repeat_to_targets
from tidemark.llm.near_join import keep_one_of_each, level, level_groups, may_lack, near_duplicates, part_names
from tidemark.llm.recompress import remove_repeats
from tidemark.llm.suffixes import COVER, PERIOD, remove_repeated_bytes

WORDS = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(3000)]


def corpus(seed=1, n=60):
    """Texts with shared passages, near copies, copies, runs, periods, and odd ones."""
    r = random.Random(seed)
    some = lambda k: [r.choice(WORDS) for _ in range(k)]
    passage, texts = some(60), []
    for i in range(n):
        words = some(r.randint(5, 200))
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage[r.randint(0, 10) : r.randint(40, 60)]
        texts.append(" ".join(words))
    base = some(150)
    for i in range(50):  # a group of near copies larger than the limit for single tokens
        words = list(base)
        words[r.randrange(150)] = f"edit{i}"
        texts.append(" ".join(words).upper() if i % 7 == 0 else "\n".join(words))
    texts += [texts[0], texts[0].upper(), "one two", "One two", "x " * 400, "ab " * 120, "a b c " * 90, "no", "", None, None, " \n\t ", "z" * 900, "z" * 900]
    texts.append(" ".join(some(6000)) + " " + " ".join(base))
    return texts


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def cover(items, width):
    """For each list, the places under a run of ``width`` items that also starts elsewhere."""
    seen = Counter(tuple(x[i : i + width]) if isinstance(x, list) else x[i : i + width] for x in items for i in range(len(x) - width + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        for i in range(len(x) - width + 1):
            if seen[tuple(x[i : i + width]) if isinstance(x, list) else x[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def test_recompression_against_brute_force(docs):
    texts = corpus()
    lists = [words_of(t) for t in texts]
    want = {}
    for i, (ws, gone) in enumerate(zip(lists, cover(lists, 35))):
        left = " ".join(w for w, g in zip(ws, gone) if not g)
        want[i] = (len(ws), sum(gone), hashlib.sha256(left.encode()).hexdigest(), left)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in remove_repeats(docs(texts), with_text=True).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 3000
    assert remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("kinds, window, named_rounds", [(2, 9, 5), (3, 6, 1), (12, 4, 7)])
def test_recompression_of_few_different_words(docs, kinds, window, named_rounds):
    r = random.Random(kinds)
    texts = [" ".join(r.choice("abcdefghijklm"[:kinds]) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["a " * 30, "a " * 31 + "b"]
    lists = [words_of(t) for t in texts]
    want = {i: sum(gone) for i, gone in enumerate(cover(lists, window))}
    assert {x.doc_id: x.n_removed for x in remove_repeats(docs(texts), window, named_rounds=named_rounds).collect()} == want
    assert 0 < sum(want.values()) < sum(map(len, lists))


def test_suffixes_against_brute_force(docs):
    texts = corpus(2)
    raws = [(t or "").encode() for t in texts]
    want = {}
    for i, (raw, gone) in enumerate(zip(raws, cover(raws, 200))):
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        want[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    rows = remove_repeated_bytes(docs(texts), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) for r in rows} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    assert remove_repeated_bytes(docs([])).count() == 0


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("size, percent, frequent", [(4, 85, 32), (4, 85, 2), (5, 80, 2)])
def test_near_join_against_brute_force(docs, size, percent, frequent):
    texts = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(texts), size, percent, 500, frequent).collect()}
    assert got == components(texts, size, percent)


def test_near_join_by_parts_alone(docs):
    """Without pivot rounds all links come from the parts."""
    texts = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(texts), 4, 85, 500, 2, 0).collect()}
    assert got == components(texts, 4, 85)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for n in (*range(1, 60), 200, 900):
            a = rng.integers(1, 2**63, n).astype(np.uint64)
            for m in {n, max(1, n - 1), -(-percent * n // 100)}:  # b has m tokens, as few of them in a as may be
                shared = -(-percent * (n + m) // (100 + percent))
                if shared > min(n, m):
                    continue
                b = np.concatenate([a[:shared], rng.integers(1, 2**63, m - shared).astype(np.uint64)])
                assert np.intersect1d(part_names(np.sort(a), percent), part_names(np.sort(b), percent)).size


def test_near_join_of_texts_that_share_much_but_do_not_link(docs):
    """A crowd below the threshold whose common tokens every text holds, with near copies and shorter and longer texts among it."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(90)]
    texts = []
    for i in range(60):
        texts.append(" ".join(common[: 80 + i % 11] + [f"w{rng.randrange(10**9)}" for _ in range(14 + i % 7)]))
    for i in range(60, 100):
        words = texts[i % 60].split()
        words[-1 - i % 3 :] = [f"w{rng.randrange(10**9)}"] * (i % 5)
        texts.append(" ".join(words))
    for rounds in (0, 1):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(texts), 4, 85, 500, 2, rounds).collect()}
        assert got == components(texts, 4, 85)


def test_near_copies_of_one_text_meet_through_few_pairs(docs, monkeypatch):
    """Copies with one changed word link with each other, those with two only with the text itself, which comes last."""
    rng = random.Random(7)
    words, texts = [f"b{i}" for i in range(100)], []
    for i in range(240):
        copy = list(words)
        for at in rng.sample(range(5, 95), 2 if i < 80 else 1 if i < 239 else 0):
            copy[at] = f"w{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    compared, possible = [], near_join.possible

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return possible(pairs, *rest)

    monkeypatch.setattr(near_join, "possible", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(texts), 5, 80, 500, 2, 0).collect()}
    assert got == components(texts, 5, 80)
    assert sum(compared) < 4 * len(texts), compared


def test_near_join_edges(docs):
    assert near_duplicates(docs([])).count() == 0
    texts = ["a b c d e f g h", "a b c d e f g h", None]
    frame = docs(texts, ids=[5, 5, None])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in near_duplicates(frame).collect()) == [(-1, -1), (5, 5), (5, 5)]
    kept = keep_one_of_each(docs(corpus(3)))
    want = {c for _, c in components(corpus(3), 5, 80).values()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_linked_sizes_are_on_neighbouring_levels():
    for n in range(1, 400):
        for m in range(n, 100 * n // 85 + 1):
            assert level(m, 85) - level(n, 85) in (0, 1)
        assert may_lack(n, 85) <= n and level_groups(level(n, 85), 85) >= 1


def test_exact_dedup_edges(docs):
    texts = ["Ab", "aB", None, "", "É", "é"] + ["same"] * 500
    got = {r.doc_id: r for r in exact_dedup(docs(texts)).collect()}
    assert (got[0].keep_id, got[0].group_size, got[1].kept, got[0].kept) == (1, 2, True, False)
    assert got[2].keep_id == 3 and got[4].kept and got[5].kept and got[6].keep_id == 505
    assert got[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = drop_exact_copies(docs(texts))
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 505}
    assert drop_exact_copies(docs(["a", "a"], ids=[3, 3])).count() == 1
    assert exact_dedup(docs([])).count() == 0


def test_mixing_budgets(docs):
    r = random.Random(4)
    sources = [r.choice(["a", "a", "a", "b", None]) for _ in range(300)]
    texts = ["w " * r.randint(0, 60) if i % 11 else None for i in range(300)]
    rows = mix_sources(docs(texts, sources)).collect()
    by = defaultdict(list)
    for x in rows:
        by[x.source].append(x)
        assert 0 <= x.taken <= 2 * x.size and x.size == len(words_of(texts[x.doc_id]))
    assert all(sum(x.taken for x in xs) == int(xs[0].target + 1e-9) for xs in by.values())
    assert abs(sum(xs[0].target for xs in by.values()) - 1.5 * sum(x.size for x in rows)) < 1e-6 * 1e6
    again = {x.doc_id: x.taken for x in mix_sources(docs(texts, sources).repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in rows}
    times = Counter(x.doc_id for x in repeat_to_targets(docs(texts, sources)).collect())
    assert all(abs(times[x.doc_id] * x.size - x.taken) <= x.size / 2 for x in rows)
    assert mix_sources(docs([])).count() == 0
