"""Score answers: a pluggable scorer over prompts, and the ordered rules that an answer must pass.

Stricter than loose JSON readers in three points: NaN, doubled keys and booleans in
place of numbers are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_query, json_span, type_in_name

#: Called with (system text, user text); returns the answer.
Scorer = Callable[[str, str], str]

SYSTEM = {
    "A1": "Score every hour of the track for a displaced position. Answer with JSON: T, anomaly_type, K, scores from 0 to 1.",
    "A2": "Score every hour of the track for an odd manoeuvre. Answer with JSON: T, anomaly_type, K, scores from 0 to 1.",
    "A3": "Score every hour of the track for a close approach. Answer with JSON: T, anomaly_type, scores from 0 to 1.",
}


def system_text(anomaly_type: str) -> str:
    if anomaly_type not in SYSTEM:
        raise ValueError(f"no such anomaly type: {anomaly_type}")
    return SYSTEM[anomaly_type]


def bound(values: list[Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a struct v0, v1, ... of ``values``, each made once, even where the optimizer moves the whole expression into a filter."""
    one = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(one), then), 1)


def refusal(payload: Column, expected_type: Column, expected_T: Column) -> Column:
    """The first rule that a VARIANT payload breaks, as text; null if it passes all of them."""
    return bound([payload, expected_type, expected_T], lambda x: _refusal(x["v0"], x["v1"], x["v2"]))


def _first_broken(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for broken, reason in reversed(rules):
        out = F.when(broken, F.lit(reason)).otherwise(out)
    return out


def _refusal(payload: Column, expected_type: Column, expected_T: Column) -> Column:
    kind = lambda path: F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    number = lambda path: F.try_variant_get(payload, path, "bigint")
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    is_object = F.schema_of_variant(payload).startswith("OBJECT")
    with_k, without = F.array(*map(F.lit, ("T", "anomaly_type", "K", "scores"))), F.array(*map(F.lit, ("T", "anomaly_type", "scores")))

    def by_keys(keys: Column) -> Column:
        same_keys = lambda want: (F.size(F.array_except(want, keys)) == 0) & (F.size(F.array_except(keys, want)) == 0)
        right_keys = (
            F.when(expected_type.isin("A1", "A2"), same_keys(with_k))
            .when(expected_type == "A3", same_keys(without))
            .otherwise(same_keys(with_k) | same_keys(without))
        )
        has_k = F.array_contains(keys, F.lit("K"))
        fields = [number("$.T"), number("$.K"), F.try_variant_get(payload, "$.anomaly_type", "string"), F.coalesce(expected_T, number("$.T"))]
        return _first_broken([(no(right_keys), "wrong keys")], bound(fields, lambda f: by_fields(has_k, f["v0"], f["v1"], f["v2"], f["v3"])))

    def by_fields(has_k: Column, T: Column, K: Column, given: Column, base: Column) -> Column:
        whole = lambda path: kind(path) == "BIGINT"
        allowed = F.array(*[(base * q / 4).cast("bigint") for q in (1, 2, 3)])
        scores = F.try_variant_get(payload, "$.scores", "array<variant>")
        rules = [
            (no(whole("$.T")), "T is not an integer"),
            (T <= 0, "T is not positive"),
            (expected_T.isNotNull() & (T != expected_T), "T is not the expected one"),
            (no(given.isin("A1", "A2", "A3")), "unknown anomaly_type"),
            (expected_type.isNotNull() & (given != expected_type), "anomaly_type is not the expected one"),
            (has_k & no(whole("$.K")), "K is not an integer"),
            (has_k & (base % 4 == 0) & ~F.array_contains(allowed, K), "K is not a quarter, half or three quarters of T"),
            (no(kind("$.scores").startswith("ARRAY")), "scores is not a list"),
        ]
        return _first_broken(rules, bound([scores], lambda s: by_scores(T, K, given, s["v0"])))

    def by_scores(T: Column, K: Column, given: Column, scores: Column) -> Column:
        is_number = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        rules = [(F.size(scores) != T, "scores has another length than T"), (no(F.forall(scores, is_number)), "a score is not a number")]
        return _first_broken(rules, bound([F.transform(scores, lambda v: F.try_variant_get(v, "$", "double"))], lambda s: by_values(T, K, given, s["v0"])))

    def by_values(T: Column, K: Column, given: Column, values: Column) -> Column:
        zeros = F.size(F.filter(values, lambda x: F.abs(x) < 1e-12))
        placed = given.isin("A1", "A2")
        rules = [
            (no(F.forall(values, lambda x: (x >= 0) & (x <= 1))), "a score is outside 0 to 1"),
            (placed & (F.array_max(values) - F.array_min(values) < 1e-9), "scores are all the same"),
            (placed & (zeros > T - K), "too many scores are zero"),
        ]
        return _first_broken(rules)

    return _first_broken([(no(is_object), "not an object")], bound([F.json_object_keys(F.to_json(payload))], lambda k: by_keys(k["v0"])))


def validated(answers: DataFrame) -> DataFrame:
    """``answers`` (answer, anomaly_type, T, ...) with reason (null if valid), K and scores."""
    parsed = answers.withColumn("_v", F.try_parse_json(json_span(F.col("answer"))))
    given = [F.col(c) for c in ("_v", "anomaly_type", "T")]
    reason = bound(given, lambda x: F.when(x["v0"].isNull(), F.lit("no JSON object")).otherwise(_refusal(x["v0"], x["v1"], x["v2"])))
    checked = parsed.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return checked.withColumns(
        {
            "K": F.when(good, F.try_variant_get("_v", "$.K", "int")),
            "scores": F.when(good, F.try_variant_get("_v", "$.scores", "array<double>")),
            "anomaly_type": F.coalesce(F.when(good, F.try_variant_get("_v", "$.anomaly_type", "string")), "anomaly_type"),
        }
    ).drop("_v")


def rule_scorer() -> Scorer:
    """A scorer without a model: hours with a larger change of speed and course score higher."""
    import json
    import re

    def scorer(system: str, text: str) -> str:
        change = [abs(float(a)) + abs(float(b)) / 10 for a, b in re.findall(r"ΔSOG: (\S+), ΔCOG: (\S+)", text)]
        kind = next(k for k, v in SYSTEM.items() if v == system)
        top = max(change, default=0.0) or 1.0
        out: dict = {"T": len(change), "anomaly_type": kind, "scores": [round(0.1 + 0.9 * c / top, 4) for c in change]}
        k = re.search(r"K = (\d+)", text)
        if k and kind != "A3":
            out["K"] = int(k[1])
        return json.dumps(out)

    return scorer


def review(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """Stored answers (source_name, answer) against the queries (stem, path, text, and T if it is known).

    ``status`` is ok, bad, or missing for a bad answer whose query is not there. Of queries with one stem the
    shortest path counts. The type comes from the source's name; the answer's own T is not held against the query.
    """
    first = queries.withColumn("_n", F.row_number().over(W.partitionBy("stem").orderBy(F.length("path"), "path"))).filter("_n = 1")
    asked = first.select(F.col("stem").alias("source_name"), F.col("path").alias("query_path"), F.col("text").alias("query"), *[F.col("T").alias("query_T")] * ("T" in queries.columns))
    typed = answers.withColumns({"anomaly_type": F.lit(None).cast("string"), "T": F.lit(None).cast("int")})
    judged = validated(typed).join(asked, "source_name", "left")
    status = F.when(F.col("reason").isNull(), "ok").when(F.col("query_path").isNull(), "missing").otherwise("bad")
    return judged.withColumn("status", status)


def to_fix(reviewed: DataFrame) -> DataFrame:
    """The queries of bad answers, once each, as prompts: those with a text and a type in their name."""
    kind = type_in_name(F.col("source_name"))
    k = F.nullif(F.regexp_extract("query", r"K = (\d+)", 1), F.lit("")).cast("int")
    T = F.col("query_T") if "query_T" in reviewed.columns else F.lit(None).cast("int")
    bad = reviewed.filter("status = 'bad'").select(
        F.col("source_name").alias("ROUTE_ID"), kind.alias("anomaly_type"), k.alias("K"), T.alias("T"), clean_query(F.col("query")).alias("prompt")
    )
    return bad.filter("prompt != '' AND anomaly_type IS NOT NULL").dropDuplicates(["ROUTE_ID", "anomaly_type"])


def review_summary(reviewed: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """One row: ok, bad (missing among them), missing and fixed answers; fixed counts every answer that was asked for again."""
    count = lambda *status: F.count_if(F.col("status").isin(*status))
    counts = reviewed.agg(count("ok").alias("ok"), count("bad", "missing").alias("bad"), count("missing").alias("missing"))
    again = F.lit(0).cast("long") if fixed is None else fixed.agg(F.count(F.lit(1)).alias("fixed")).scalar()
    return counts.withColumn("fixed", again)


def latest_valid(answers: DataFrame) -> DataFrame:
    """Of a source's checked answers (source_name, reason, scored_at, ...) the latest that is valid."""
    order = W.partitionBy("source_name").orderBy(F.desc_nulls_last("scored_at"), F.desc("answer"))
    return answers.filter("reason IS NULL").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
