"""URL filters: host and path rules first, then logistic regression.

The model reads hashed character n-grams of host and path. It is trained on the
driver from a small labelled URL table (``labelled_urls``, or any table of url and
label given instead; ``max_rows`` bounds what is taken, by a hash). There are more benign
rows than others, so a url of which the model knows nothing is allowed. Scoring runs in tasks on
Arrow batches; the weight vector, ``2 ** bits`` doubles, is all that is broadcast.

Defined results: a null url, or one without ``://``, has empty host and path; no
rule fits it, and the model's verdict on it is allow. Repeated rows are judged
alike, and so are equal urls of different pages. Of rules of equal length the later one in
the table decides. Urls of any length are read whole. An empty table gives an empty result; extra columns are ignored. Without
labels of both kinds the model allows everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import LOWER, UPPER

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# What hosts and paths to block are made of, and benign words, many of which hold parts of the former.
BAD = (
    "casino", "poker", "poker-bonus", "strip-poker", "live-cams", "sex-shows", "roulette", "jackpot", "slots", "betting", "bets", "sportsbet", "lottery-win", "bingo-bonus", "porn", "porno", "xxx", "sex-cam",
    "sexchat", "sex-video", "hot-sex", "adult-video", "nude-girls", "naked-teens", "escorts", "escort-girls", "milf", "hookup", "viagra", "cialis", "cheap-pills",
    "pills-online", "no-prescription", "diet-pills", "weight-loss-miracle", "payday-loans", "fast-cash", "quick-loans", "get-rich", "bitcoin-doubler",
    "crypto-giveaway", "free-followers", "buy-likes", "click-farm", "link-farm", "spam-links", "replica-watches", "fake-rolex", "fake-diploma",
    "essay-mill", "keygen", "crack-serial", "warez", "torrent-cracks", "malware-download", "phishing-kit",
)
GOOD = (
    "library", "weather", "gardening", "history", "museum", "recipes", "university", "hospital", "railway", "cycling", "astronomy", "chemistry",
    "theatre", "orchestra", "market", "news", "baths", "station", "national-park", "translation", "weekly", "anthology", "mother", "action", "edition",
    "herald", "thursday", "bakery", "river-trust", "old-town", "school", "physics", "football", "council", "archive", "travel", "music", "film", "books",
    "science", "health", "garden", "photography", "architecture", "community", "parish", "village", "harbour", "mountain", "forest", "water", "energy",
    "transport", "police", "courts", "parliament", "statistics", "survey", "research", "institute", "software", "hardware", "python", "linux", "forum",
    "essex", "sussex", "wessex", "middlesex", "sextant", "sextet", "sexton", "sexual-health-clinic", "pharmacy", "pharmacology", "prescription-charges",
    "pill-box-fort", "slot-car-racing", "timeslots", "alphabets", "tibetan", "diabetes", "bethlehem", "casinore", "poker-face-lyrics", "crackle",
    "nutcracker", "crackdown", "farming", "farm-shop", "clickable-maps", "hyperlinks", "links-golf", "loans-office", "student-loans", "library-loans",
    "cashmere", "cashew", "encash", "adult-education", "adult-literacy", "young-adults", "watches-museum", "diploma-course", "girls-school", "girls-football",
    "lottery-fund", "bitcoin-research", "cryptography", "cryptic-crossword", "essay-prize", "serial-drama", "keyboard", "downloads-archive", "torrents-of-rain",
    "therapists", "analysis", "assessment", "scunthorpe", "penistone", "cockpit", "cockermouth", "arsenal", "classic", "grass", "bass-guitar", "document",
    "nudge-unit", "naked-mole-rat", "escorted-tours", "spamalot", "jackdaw", "jackpine", "bingo-hall-history", "replica-ships", "weight-training",
)
HOSTS = ("{}.com", "www.{}.example.net", "{}.example.com", "{}-online.org", "my{}.info", "best-{}.net", "{}.co", "the-{}.site", "{}24.example.org", "m.{}.biz")
PATHS = ("/", "/en/12", "/de/345/", "/fr/67.html", "/index.html", "/2023/04/page", "/news/article-99", "")
ELSEWHERE = ("http://files.example.net/{}/index.html", "https://example.com/tag/{}", "http://www.example.org/en/{}.html")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table, 1 for block: every name under six hosts and in three paths, benign names three times as many as others."""
    rows = []
    for label, names in ((1, BAD), (0, GOOD)):
        for i, name in enumerate(names):
            for j in range(6):
                host = HOSTS[(3 * i + 7 * j) % len(HOSTS)].format(name if j % 2 else name.replace("-", ""))
                rows.append((f"http://{host}{PATHS[(i + 3 * j) % len(PATHS)]}", label))
            rows += [(shape.format(name), label) for shape in ELSEWHERE]
    return rows


def sampled(rows: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """At most ``most`` rows of the table, drawn by a hash of the url, of both labels in their shares and at least one of each."""
    if len(rows) <= most:
        return rows
    of = {y: sorted((r for r in rows if r[1] == y), key=lambda r: zlib.crc32(r[0].encode("utf-8", "replace"))) for y in {y for _, y in rows}}
    return [r for held in of.values() for r in held[: max(1, most * len(held) // len(rows))]]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for decision, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, bits: int, sizes: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """Hashed n-gram places of ``^host$`` and of the path, each place once."""
    mask = (1 << bits) - 1
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", path)):
        raw = text.encode("utf-8", "replace")
        seed = zlib.crc32(kind.encode())
        for n in sizes:
            found.update(zlib.crc32(raw[i : i + n], seed) & mask for i in range(len(raw) - n + 1))
    return np.fromiter(found, dtype=np.int64, count=len(found))


def py_split(url: str | None) -> tuple[str, str]:
    """``split_url`` for one string, used on the training table."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in host), path


def train(rows: list[tuple[str, int]], bits: int = 14, l2: float = 1e-4, epochs: int = 60, rate: float = 0.5, seed: int = 5):
    """Logistic regression by AdaGrad over single rows: (weights, bias)."""
    weights, bias = np.zeros(1 << bits), 0.0
    if len({y for _, y in rows}) < 2:
        return weights, -1.0
    xs = [features(*py_split(u), bits) for u, _ in rows]
    ys = [y for _, y in rows]
    seen, seen_b = np.full(1 << bits, 1e-6), 1e-6
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, scale = xs[i], 1.0 / max(1.0, np.sqrt(len(xs[i])))
            p = 1.0 / (1.0 + np.exp(-(bias + scale * weights[x].sum())))
            g = (p - ys[i]) * scale
            grad = g + l2 * weights[x]
            seen[x] += grad * grad
            weights[x] -= rate * grad / np.sqrt(seen[x])
            seen_b += (p - ys[i]) ** 2
            bias -= 0.1 * rate * (p - ys[i]) / np.sqrt(seen_b)
    return weights, bias


def score(host: str, path: str, weights: np.ndarray, bias: float, bits: int) -> float:
    x = features(host, path, bits)
    return float(1.0 / (1.0 + np.exp(-(bias + weights[x].sum() / max(1.0, np.sqrt(len(x)))))))


def filter_urls(
    pages: DataFrame, labelled: list[tuple[str, int]] | None = None, rules=RULES, bits: int = 14, max_rows: int = 10_000
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score."""
    weights, bias = train(sampled(labelled_urls() if labelled is None else labelled, max_rows), bits)
    model = pages.sparkSession.sparkContext.broadcast((weights, bias))

    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, b = model.value
        for hosts, paths in batches:
            yield pd.Series([score(h, p, w, b, bits) for h, p in zip(hosts, paths)], dtype="float64")

    block_score = F.pandas_udf(scores, "double")
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    judged = split.withColumn("rule", rule).withColumn("decided", decided)
    judged = judged.withColumn("block_score", block_score("host", "path"))
    guess = F.when((F.col("host") != "") & (F.col("block_score") >= 0.5), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("decided", guess).alias("verdict"), "block_score"
    )
