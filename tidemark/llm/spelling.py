"""Spelling variants of a corpus: words at an edit distance of one, by a self-join of the vocabulary's trie.

The vocabulary is counted by Spark and is far smaller than the texts. It is the set of
leaves of a trie, and a trie node's active nodes are those whose prefixes are at most one
edit from its own. Active nodes are passed from a node to its children: the node itself, at
distance 0, yields the child (0), the node and the child's siblings and children (1); a node at
distance 1 has spent its edit and is followed by the same letter only. Two words that end
at an active pair are near.

The trie is partitioned by prefixes. Above a partition's root, Spark propagates: where two
words part at a depth above the cut, their edit is spent there, so all that is left to
follow is the same rest below the same node, and both meet under that (node, rest), which
at most one word for each letter shares. Below it a task joins its own partition with sets of
active nodes. A partition of too many words is cut again, twice as deep, and only its words
go on. So no task holds more than ``most_words`` words, and a pair is found once: where
its words part.

Defined results: a null text has no words and a null doc_id is written as nothing in the
hashed name. Rows of equal doc_id and text count as often as they are there. Of near words of
equal n the smaller in code-point order is the form. Texts are read whole, and words may be
of any length. An empty table gives an empty result; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import lower_ascii, pin, unpin

#: A word's run of letters; shorter runs can give no word.
LETTERS = r"A-Za-zÀ-ÿ"
FIRST_CUT = 3
#: Nodes whose children a task remembers.
KNOWN_NODES = 200_000


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): lower-cased runs of letters, one code point of each ``slip``-th gone by a hash of document and run."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    low = runs.select("name", lower_ascii(F.col("run")).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= least_n) & (F.char_length("word") >= least_length))


def parted_above(words: DataFrame, above: int, cut: int) -> DataFrame:
    """(word, near): pairs whose words part at a depth from ``above`` to under ``cut``; ``words`` agree on the first ``above`` letters of their group.

    A word meets others below each node on its way: with the letter after it skipped (a letter
    replaced, or one more than the other has) and with nothing skipped (one less).
    """
    depth = F.explode(F.sequence(F.lit(above), F.least(F.lit(cut - 1), F.char_length("word")))).alias("depth")
    on_way = words.select("word", depth)
    node, rest = F.expr("substring(word, 1, depth)"), lambda k: F.expr(f"substring(word, depth + {k})")
    letter = F.expr("substring(word, depth + 1, 1)")
    skipped = F.struct(rest(2).alias("rest"), letter.alias("letter"))
    whole = F.struct(rest(1).alias("rest"), F.lit(None).cast("string").alias("letter"))
    ways = F.array_compact(F.array(F.when(letter != "", skipped), whole))
    keys = on_way.select("word", node.alias("node"), F.explode(ways).alias("way")).select("word", "node", "way.rest", "way.letter")
    met = keys.groupBy("node", "rest").agg(F.collect_list(F.struct("word", "letter")).alias("met")).filter("size(met) > 1")
    # All words of a key differ: in the letter skipped, or one has none to skip.
    pairs = met.select("rest", F.explode("met").alias("a"), "met").select("rest", "a", F.explode("met").alias("b"))
    parts = (
        "a.letter IS NOT NULL AND b.letter IS NOT NULL AND a.letter != b.letter"
        " OR a.letter IS NOT NULL AND b.letter IS NULL AND a.letter != substring(rest, 1, 1)"
        " OR a.letter IS NULL AND b.letter IS NOT NULL AND b.letter != substring(rest, 1, 1)"
    )
    return pairs.filter(parts).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"))


Node = tuple[int, int, int]


def trie_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """(word, near) for all near pairs of ``words``, distinct and sorted, both ways round.

    A node is a range of the sorted words and the length of the prefix that they share. Nodes
    of one word have no branches left, so their active nodes are asked for the rest of that word at once.
    """
    places = {w: i for i, w in enumerate(words)}
    known: dict[Node, dict[str, Node]] = {}

    def children(node: Node) -> dict[str, Node]:
        lo, hi, depth = node
        if hi - lo == 1:
            return {words[lo][depth]: (lo, hi, depth + 1)} if depth < len(words[lo]) else {}
        if node not in known:
            if len(known) >= KNOWN_NODES:
                known.clear()
            lo += len(words[lo]) == depth
            found = {}
            while lo < hi:
                letter = words[lo][depth]
                end = hi if words[hi - 1][depth] == letter else bisect_left(words, words[lo][:depth] + chr(ord(letter) + 1), lo, hi)
                found[letter] = (lo, end, depth + 1)
                lo = end
            known[node] = found
        return known[node]

    ends = lambda node: len(words[node[0]]) == node[2]
    root = (0, len(words), 0)
    stack: list[tuple[Node, list[Node]]] = [(root, list(children(root).values()))] if words else []
    while stack:
        node, active = stack.pop()
        lo, hi, depth = node
        if hi - lo == 1:
            word, rest = words[lo], words[lo][depth:]
            for v in active:
                at = places.get(words[v[0]][: v[2]] + rest)
                if at is not None and at != lo and v[0] <= at < v[1]:
                    yield word, words[at]
            continue
        if ends(node):
            yield from ((words[lo], words[v[0]]) for v in active if ends(v))
        own = children(node)
        for letter, child in own.items():
            spent = {w for v in active if (w := children(v).get(letter))}
            spent.update(v for other, v in own.items() if other != letter)
            spent.update(children(child).values())
            spent.add(node)
            spent.discard(child)
            stack.append((child, list(spent)))


def joined_below(parts: pd.DataFrame) -> pd.DataFrame:
    """The near pairs of one partition of the trie."""
    return pd.DataFrame(trie_pairs(sorted(parts["word"])), columns=["word", "near"])


def near_pairs(words: DataFrame, most_words: int = 20_000, most_letters: int = 64_000_000) -> DataFrame:
    """(word, near), both ways round, of a pinned table of different words."""
    open_, above, cut, found = words.select("word"), 0, FIRST_CUT, []
    pair = "word string, near string"
    while True:
        found.append(parted_above(open_, above, cut))
        below = open_.filter(F.char_length("word") >= cut).withColumn("part", F.substring("word", 1, cut))
        sizes = below.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.sum(F.char_length("word").cast("long")).alias("letters"))
        sizes = pin(sizes.filter("words > 1"))
        over = (F.col("words") > most_words) | (F.col("letters") > most_letters) & (F.col("words") > 1)
        fitting = below.join(sizes.filter(~over).select("part"), "part", "left_semi")
        found.append(fitting.groupBy("part").applyInPandas(joined_below, pair))
        large = sizes.filter(over).select("part")
        if large.isEmpty():
            break
        open_ = pin(below.join(large, "part", "left_semi").select("word"))
        above, cut = cut, 2 * cut
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame, most_n: int, ratio: int) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps that are known. A step multiplies n by ``ratio`` at least."""
    steps = max(1, ceil(log(max(most_n, 2)) / log(ratio)))
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log(steps, 2)) if steps > 1 else 0):
        up = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, known = known, pin(known.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        if hasattr(before, "pinned_at"):
            unpin(before)
    return known


def spelling_variants(docs: DataFrame, ratio: int = 5, least_length: int = 6, least_n: int = 5, slip: int = 199, most_words: int = 20_000) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = pin(vocabulary(docs, least_length, least_n, slip))
    pairs = near_pairs(words, most_words)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    best_near = pairs.join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(best_near, "word", "left").withColumn("best_n", -F.col("best.less"))
    strong = F.col("best_n") >= ratio * F.col("n")
    formed = pin(
        known.select(
            "word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best_n")).alias("form_n"),
        )
    )
    most = formed.agg(F.max("form_n")).first()[0] or 0
    rooted = roots(formed.filter("form IS NOT NULL"), most, ratio)
    out = formed.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
