"""Cases in which an operator once did less than the whole job."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_join, pieces, pii, suffixes
from tidemark.llm._common import pin
from tidemark.llm._stretches import judged_stretches
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.queries import ORACLE_SQL


def test_far_repeats_of_personal_data_are_found():
    field = pii.train()
    between = " words that say nothing of it and go on "
    for first, weak in (("+1 (212) 555-0100", "5550100"), ("anna.berg42@mail7.example.com", "anna.berg42")):
        for text in (first + (between + weak) * 50, (weak + between) * 50 + first):
            (base, added), = pii.find_spans([text], field, 0.9)
            assert len(base) == 1 and len(added) == 50 and {k for _, _, k in added} == {base[0][2]}


def test_texts_are_judged_alike_in_any_batch():
    field = pii.train(200, 40)
    texts = ["call 212-555-0100 12 4 and 2125550100", "5550100 or " * 40 + "+1 (212) 555-0100", "page 12 of 14"]
    assert pii.find_spans(texts, field, 0.9) == [pii.find_spans([t], field, 0.9)[0] for t in texts]


def test_exact_copies_are_dropped_by_row(spark, docs):
    # Three copies with null ids; an id on two texts, one of which is a copy of a larger id; an id on two other texts.
    texts = ["n", "N", "n", "x", "y", "X", "p", "q", "q"]
    ids = [None, None, None, 1, 1, 5, 7, 7, 7]
    table = docs(texts, ids=ids)
    kept = drop_exact_copies(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id or 0, r.text.lower()) for r in kept.collect()))
    best = {}
    for i, t in zip(ids, texts):
        best[t.lower()] = max(best.get(t.lower(), 0), i or 0)
    assert got == sorted((i, t) for t, i in best.items())


def test_exact_stage_of_the_pipeline_against_brute_force(spark, docs):
    import corpus_pipeline

    r = random.Random(5)
    texts = [r.choice("abcdefghijKLMN") * r.randint(1, 3) for _ in range(300)]
    ids = [r.choice([None, r.randint(0, 40)]) for _ in texts]
    stage = dict(corpus_pipeline.STAGES)["exact dedup"]
    best = {}
    for i, t in zip(ids, texts):
        best[t.lower()] = max(best.get(t.lower(), -1), -1 if i is None else i)
    got = [(-1 if x.doc_id is None else x.doc_id, x.text.lower()) for x in stage(spark, docs(texts, ids=ids), "").collect()]
    assert sorted(got) == sorted((i, t) for t, i in best.items())


def test_all_segmentations_are_returned_and_decoded(docs):
    texts = ["the cat sat on the mat", "naïve Ω▁x", None, "zzq  zz"]
    encoder = pieces.Encoder(pieces.Pieces.load(pieces.MODEL), 4, 1000)
    short = {r.doc_id: r for r in pieces.summarise(docs(texts)).collect()}
    long = {r.doc_id: r for r in pieces.encode_documents(docs(texts)).collect()}
    for i, text in enumerate(texts):
        found = encoder.encode(text)
        assert short[i].round_trip and long[i].round_trip
        assert short[i].all_sha256 == [hashlib.sha256(x).hexdigest() for _, x in found]
        assert short[i].weights == [round(w, 6) for w, _ in found] and len(found) == short[i].n_found
        assert [np.array(x, dtype="<i4").tobytes() for x in long[i].all_ids] == [x for _, x in found]


def test_mixing_of_null_and_repeated_ids_against_sql(spark, docs):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9))) for _ in range(900)]
    ids = [r.choice([None, 7, i, i]) for i in range(900)]
    sources = [r.choice(["a", "a", "b", None]) for _ in texts]
    table = docs(texts, sources, ids)
    documents = table.select("doc_id", "source", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(ORACLE_SQL["op5_source_mixing"]).fetchall()
    order = lambda rows: sorted([tuple(x) for x in rows], key=str)
    assert order(mixing.mix_sources(table).collect()) == order(want)
    sized = mixing.sized_rows(table.select("doc_id", "source", "text"), 17)
    in_parts = mixing._take(sized, (3, 1, 2), 1.5, 2.0, 10, crowd=20).drop("row")
    assert order(in_parts.collect()) == order(want)
    pieces_of, _ = mixing.in_pieces(sized, 10, crowd=20)
    assert pieces_of.groupBy("source", *mixing.PIECE).count().agg({"count": "max"}).first()[0] <= 60
    again = [Counter(x.text for x in mixing.repeat_to_targets(t).collect()) for t in (table, table.repartition(7))]
    assert again[0] == again[1]


def test_crowded_ranks_are_not_held_in_a_task(docs):
    r = random.Random(8)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = own(260)
    table = docs([own(r.randint(0, 50)) + passage + own(r.randint(0, 50)) for _ in range(400)])
    numbered = table.select(F.col("doc_id").alias("row"), "text")
    grams = suffixes.byte_profile(numbered, 200).select("row", F.col("grams").alias("found"))
    regions = pin(suffixes.stretch_strings(numbered.join(grams, "row").select("row", "text", "found"), 200))
    strings = pin(regions.drop("stretches").join(judged_stretches(regions), ["row", "at"]).select("row", "at", "bytes", "stretches"))
    named = pin(suffixes.named_triples(suffixes.sampled_triples(strings, 200)))
    assert suffixes.crowded_names(named, 50, 1).count() > 10
    plain, split = ({tuple(x) for x in suffixes.repeated_places(strings, 200, c, 1).collect()} for c in (10**9, 50))
    assert plain and plain == split
    plain, split = ({tuple(x) for x in suffixes.remove_repeated_bytes(table, 200, crowd=c).collect()} for c in (10**9, 64))
    assert plain == split and all(x[2] >= 260 for x in split)


def test_prefix_counts_against_counts(spark):
    r = random.Random(3)
    rows = [(i, [7] * (i % 3 == 0) + [8] * (i < 9) + r.sample(range(10, 4000), 20)) for i in range(3000)]
    rows += [(3000, []), (3001, [9])]
    times = Counter(t for _, tokens in rows for t in tokens)
    want = sorted((i, t, k, min(times[t], 9)) for i, tokens in rows for k, t in enumerate(tokens) if times[t] > 1)
    held = spark.createDataFrame(rows, "row long, prefix array<long>").repartition(5)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for batch in (10, 10_000):
            spark.conf.set(size, batch)
            assert sorted(map(tuple, near_join.prefix_counts(held, 8).collect())) == want
    finally:
        spark.conf.set(size, before)
