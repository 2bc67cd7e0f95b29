"""Registered queries over the driver's tables. Positions come from ``events_as_ais``; scores and draws from arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo, scalars
from tidemark.operators import dataset, inject, prompts, scoring, strata, tracks
from tidemark.plans.oracles import ORACLE_SQL
from tidemark.sources.ais import events_as_ais
from tidemark.sources.kept import keep

T = 12


def six(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


def positions(spark: SparkSession, sf: str) -> DataFrame:
    points = events_as_ais(spark, sf)
    return points.withColumns({"COURSE_SIN": F.sin(F.radians("COURSE")), "COURSE_COS": F.cos(F.radians("COURSE"))})


def routes(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.cut_routes(positions(spark, sf), T, 12, 36)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    score = ((F.col("ROUTE_POINT_IDX") * 7 + F.col("SEG") * 13 + F.col("CRAFT_ID") * 5) % 101) / 100.0
    return routes(spark, sf).withColumns({"score": score, "K": (3 * (1 + F.col("SEG") % 3)).cast("int")})


def parity(*columns: str) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return F.when(total % 2 == 0, 1).otherwise(-1)


KEYS = ("ROUTE_ID", "ROUTE_POINT_IDX")


def flagship(spark, sf):
    return route_stats(spark, sf)


def ais_clean(spark, sf):
    raw = events_as_ais(spark, sf).withColumns({"TIMESTAMP": F.when(F.col("src_ord") % 10 != 0, F.col("TIMESTAMP").cast("string")).otherwise("no time")})
    return tracks.clean(raw).select("src_ord", "CRAFT_ID", "TRACK_ID", "TIMESTAMP", six("LON"), six("LAT"), six("COURSE_SIN"), six("COURSE_COS"))


def hour_round_even(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    half = F.expr("timestampadd(MINUTE, 30, date_trunc('HOUR', ts))").cast("timestamp_ntz")
    return events.select("event_id", scalars.nearest_hour(F.col("ts")).alias("HOUR"), scalars.nearest_hour(half).alias("HOUR_OF_HALF"))


def dedup_keep_first(spark, sf):
    return tracks.keep_first(positions(spark, sf)).select("TRACK_ID", "TIMESTAMP", "src_ord", six("LON"))


def course_sincos(spark, sf):
    return positions(spark, sf).select("src_ord", six("COURSE_SIN"), six("COURSE_COS"))


def hourly_interpolate(spark, sf):
    grid = tracks.hourly(tracks.keep_first(positions(spark, sf)))
    # Halves of hours give decimals that end on a tie; a small step puts them on one side in either engine.
    off_tie = lambda c: six(F.col(c) + 3e-8, c)
    return grid.select("TRACK_ID", "TIMESTAMP", "CRAFT_ID", *map(off_tie, ("LON", "LAT", "SPEED", "COURSE", "COURSE_SIN")))


def short_track_antijoin(spark, sf):
    points = positions(spark, sf)
    return tracks.long_enough(points, 66).select("TRACK_ID", "src_ord")


def route_slice(spark, sf):
    return routes(spark, sf).select(*KEYS, "TIMESTAMP", "CRAFT_ID", "TRACK_ID", six("LON"), six("LAT"), six("SPEED"))


def route_validate(spark, sf):
    broken = routes(spark, sf).filter(~((F.col("SEG") == 1) & (F.col("ROUTE_POINT_IDX") == 5)))
    return tracks.route_faults(broken, T).select("ROUTE_ID", "points", "in_time")


def route_stats(spark, sf):
    stats = strata.route_stats(routes(spark, sf))
    return stats.select("ROUTE_ID", six("avg_sog"), six("avg_dcog"), six("avg_dsog"), "vessel_type")


def stratum_bins(spark, sf):
    stats = keep(strata.route_stats(routes(spark, sf)))
    edges = strata.bin_edges(stats).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, strata.FEATURES)), F.array(*[f"{c}_edges" for c in strata.FEATURES]))).alias("feature", "edges"))
    return edges.select("feature", F.posexplode("edges").alias("place", "edge")).select("feature", "place", six("edge"))


def stratum_sample(spark, sf):
    placed = strata.stratify(strata.route_stats(routes(spark, sf)))
    picked = strata.nested_sample(placed, order=F.col("ROUTE_ID"))
    return picked.select("ROUTE_ID", "stratum_key", *[f"use_{p}pct" for p in (10, 5, 3, 1)])


def stratum_labels(spark, sf):
    return strata.stratify(strata.route_stats(routes(spark, sf)), label_key=True).select("ROUTE_ID", "stratum", "avg_sog_bin", "avg_dcog_bin", "avg_dsog_bin")


def k_round_robin(spark, sf):
    placed = strata.stratify(strata.route_stats(routes(spark, sf)))
    return strata.assign_k(placed, T, order=F.col("ROUTE_ID")).select("ROUTE_ID", "K")


def indices_by_mode(spark, sf):
    return strata.indices(strata.route_stats(routes(spark, sf)), T)


def prompt_stats(spark, sf):
    stats = prompts.prompt_stats(routes(spark, sf))
    spans = [F.array_max(F.transform("points", lambda p: F.abs(p[c]))) for c in ("D_SOG", "D_COG")]
    return stats.select("ROUTE_ID", six("avg_sog"), six("std_sog"), six("avg_cog"), six("std_cog"), six(spans[0], "most_d_sog"), six(spans[1], "most_d_cog"))


def prompt_text(spark, sf):
    r = routes(spark, sf)
    return prompts.prompts(r, strata.indices(strata.route_stats(r), T), T)


def json_extract(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.lit("Answer: "), "props", F.lit(" done"))
    span = scalars.json_span(text)
    v = F.try_parse_json(span)
    return events.select("event_id", span.alias("span"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object"))


def score_validate(spark, sf):
    return scoring.validated(answers_of(spark, sf)).select("id", "reason", "K")


def answers_of(spark, sf, *also):
    """An answer for each event, with the event's columns ``also``: the 18 below in turn, with scores that follow the event's value where they are good."""
    shapes = F.array(*[F.struct(F.lit(a).alias("answer"), F.lit(k).alias("anomaly_type"), F.lit(t).alias("T")) for _, a, k, t in ANSWERS])
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(F.pmod(F.col("value"), F.lit(1.0)) * 0.5, 3).alias("v"), *also)
    dealt = events.select("event_id", "v", *also, F.element_at(shapes, (F.col("event_id") % len(ANSWERS) + 1).cast("int")).alias("a"))
    first = F.concat(F.lit("["), F.col("v").cast("string"), F.lit(", 0.2, 0.3, 1]"))
    answer = F.replace(F.col("a.answer"), F.lit("[0.1, 0.2, 0.3, 1]"), first)
    return dealt.select(F.col("event_id").alias("id"), answer.alias("answer"), "a.anomaly_type", "a.T", *also)


# Answers that break each rule, in the order of the rules; the first two are good.
ANSWERS = [
    (1, 'Sure: {"T": 4, "anomaly_type": "A1", "K": 1, "scores": [0.1, 0.2, 0.3, 1]} .', "A1", 4),
    (2, '{"T": 4, "anomaly_type": "A3", "scores": [0, 0, 0, 0]}', "A3", 4),
    (3, "none", "A1", 4),
    (4, "[1]{", "A1", 4),
    (5, '{"T": 4, "anomaly_type": "A1", "scores": [0.1, 0.2, 0.3, 1]}', "A1", 4),
    (6, '{"T": 4.0, "anomaly_type": "A1", "K": 1, "scores": [0.1, 0.2, 0.3, 1]}', "A1", 4),
    (7, '{"T": 0, "anomaly_type": "A1", "K": 1, "scores": []}', "A1", 4),
    (8, '{"T": 5, "anomaly_type": "A1", "K": 1, "scores": [0.1, 0.2, 0.3, 1, 1]}', "A1", 4),
    (9, '{"T": 4, "anomaly_type": "B", "K": 1, "scores": [0.1, 0.2, 0.3, 1]}', "A1", 4),
    (10, '{"T": 4, "anomaly_type": "A2", "K": 1, "scores": [0.1, 0.2, 0.3, 1]}', "A1", 4),
    (11, '{"T": 4, "anomaly_type": "A1", "K": true, "scores": [0.1, 0.2, 0.3, 1]}', "A1", 4),
    (12, '{"T": 4, "anomaly_type": "A1", "K": 4, "scores": [0.1, 0.2, 0.3, 1]}', "A1", 4),
    (13, '{"T": 4, "anomaly_type": "A1", "K": 1, "scores": "x"}', "A1", 4),
    (14, '{"T": 4, "anomaly_type": "A1", "K": 1, "scores": [0.1, 0.2, 0.3]}', "A1", 4),
    (15, '{"T": 4, "anomaly_type": "A1", "K": 1, "scores": [0.1, "a", 0.3, 1]}', "A1", 4),
    (16, '{"T": 4, "anomaly_type": "A1", "K": 1, "scores": [0.1, 0.2, 0.3, 1.5]}', "A1", 4),
    (17, '{"T": 4, "anomaly_type": "A1", "K": 1, "scores": [0.5, 0.5, 0.5, 0.5]}', "A1", 4),
    (18, '{"T": 4, "anomaly_type": "A1", "K": 3, "scores": [0, 0, 0.5, 0.5]}', "A1", 4),
]


def prompt_name_parse(spark, sf):
    """File names made of each event's user, type and number, in six shapes."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("kind"))
    a = F.concat(F.lit("A"), (F.col("event_id") % 4).cast("string"))
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    shapes = F.array(
        F.concat(F.lit("route_"), user, F.lit("_"), "kind", F.lit("-"), number, F.lit("_"), a), F.concat("kind", F.lit("_"), a, F.lit("-b")),
        a, F.concat(F.lit("x"), a, "kind"), F.concat("kind", number), F.concat(F.lit("route_a_"), user, F.lit("-3_"), a, F.lit("_20240101-000000-000001")),
    )
    names = e.select("event_id", F.element_at(shapes, (F.col("event_id") % 6 + 1).cast("int")).alias("stem"))
    route, kind = scalars.plan_name(F.col("stem"))
    return names.select("event_id", "stem", scalars.type_in_name(F.col("stem")).alias("any_type"), route.alias("route"), kind.alias("plan_type"))


def stored_answers(spark, sf):
    """The answers as files of a scorer, each for a query of its own; a query is there for two events of three, for some of them twice."""
    answers = answers_of(spark, sf, "user_id", "ts").withColumnRenamed("id", "event_id")
    name = F.concat(F.lit("route_"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string"), F.lit("_A1"))
    at = F.expr("timestampadd(MICROSECOND, event_id, ts)").cast("timestamp_ntz")
    return answers.select("event_id", "user_id", name.alias("source_name"), at.alias("scored_at"), "answer")


def stored_queries(spark, sf):
    there = stored_answers(spark, sf).filter("event_id % 3 != 0")
    folders = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("longer/route_sliced_12"), F.lit("route_sliced_4"))).otherwise(F.array(F.lit("route_sliced_4")))
    path = F.concat("folder", F.lit("/user_query/"), "source_name", F.lit(".txt"))
    rows = there.select("event_id", "source_name", F.explode(folders).alias("folder")).withColumn("path", path)
    text = F.concat(F.lit(' """K = '), (F.col("event_id") % 3).cast("string"), F.lit(' hours""" '))
    return rows.select(F.col("source_name").alias("stem"), "path", text.alias("text"), scalars.length_in_path(F.col("path")).alias("T"))


def review_answers(spark, sf):
    return scoring.review(stored_answers(spark, sf), stored_queries(spark, sf)).select("source_name", "status", "query_path", "query_T")


def review_fix(spark, sf):
    reviewed = scoring.review(stored_answers(spark, sf), stored_queries(spark, sf))
    return scoring.to_fix(reviewed).select(F.col("ROUTE_ID").alias("source_name"), "anomaly_type", "K", "T", "prompt")


def review_counts(spark, sf):
    return scoring.review_summary(scoring.review(stored_answers(spark, sf), stored_queries(spark, sf)))


def answers_latest_valid(spark, sf):
    by_user = stored_answers(spark, sf).withColumns({"source_name": F.concat(F.lit("route_"), F.col("user_id").cast("string"), F.lit("_A1")), "anomaly_type": F.lit("A1"), "T": F.lit(4)})
    return scoring.latest_valid(scoring.validated(by_user)).select("source_name", "event_id")


def draws(spark, sf):
    """The draws that the injections make by default."""
    at = routes(spark, sf).select("ROUTE_ID", "ROUTE_POINT_IDX")
    route, point = F.col("ROUTE_ID"), F.col("ROUTE_POINT_IDX")
    return at.select(
        "ROUTE_ID", "ROUTE_POINT_IDX", scalars.coin(route, point, seed=3).alias("side"), scalars.coin(route, seed=3).alias("sign"),
        six(0.9 + 0.2 * scalars.uniform(route, F.lit("scale"), seed=3), "scale"), (scalars.uniform(route, F.lit("side"), seed=3) < 0.5).alias("left"),
    )


def allowed_a3(spark, sf):
    return dataset.allowed_routes(strata.indices(strata.route_stats(routes(spark, sf)), T), 5, "a3")


def tier_counts(spark, sf):
    index = strata.indices(strata.route_stats(routes(spark, sf)), T)
    return index.groupBy("mode").agg(*[F.count_if(f"use_{p}pct").alias(f"n_{p}pct") for p in (10, 5, 3, 1)])


def score_topk(spark, sf):
    picked = inject.top_k(scored(spark, sf)).withColumn("norm", inject.normal_score())
    return picked.select(*KEYS, "chosen", six("norm"))


def a2_window(spark, sf):
    found = inject.a2_windows(scored(spark, sf))
    return found.groupBy("ROUTE_ID").agg(F.min("start").alias("start"), F.min("k").alias("k"))


def score_array_stats(spark, sf):
    packed = scored(spark, sf).groupBy("ROUTE_ID").agg(F.array_sort(F.collect_list(F.struct("ROUTE_POINT_IDX", "score")))["score"].alias("s"))
    zeros = F.size(F.filter("s", lambda x: F.abs(x) < 1e-12))
    return packed.select("ROUTE_ID", six(F.array_min("s"), "low"), six(F.array_max("s"), "high"), zeros.alias("zeros"))


def a3_risk_window(spark, sf):
    found = inject.a3_anchor(scored(spark, sf), pick=F.col("ROUTE_POINT_IDX").cast("double"))
    return found.groupBy("ROUTE_ID").agg(F.min("ta").alias("ta"), F.min("s0").alias("s0"), F.min("s1").alias("s1"))


def _legs(spark, sf):
    return tracks.track_neighbours(routes(spark, sf))


def geo_haversine(spark, sf):
    return _legs(spark, sf).select(*KEYS, six(geo.haversine(*inject.at("PREV_"), *inject.at()), "metres"))


def geo_bearing(spark, sf):
    return _legs(spark, sf).select(*KEYS, six(geo.bearing(*inject.at("PREV_"), *inject.at()), "degrees"))


def geo_destination(spark, sf):
    cog = geo.course_over_ground(F.col("COURSE_SIN"), F.col("COURSE_COS"))
    lon, lat = geo.destination(*inject.at(), cog, F.col("SPEED") * geo.KNOT * geo.HOUR_S)
    return routes(spark, sf).select(*KEYS, six(lon, "to_lon"), six(lat, "to_lat"))


def geo_xtrack(spark, sf):
    far = geo.cross_track(inject.at("PREV_"), inject.at("NEXT_"), inject.at())
    side = geo.sideways(inject.at("PREV_"), inject.at("NEXT_"), -1)
    return _legs(spark, sf).select(*KEYS, six(far, "metres"), six(side, "across"))


def sed_local(spark, sf):
    return inject.local_sed(routes(spark, sf)).groupBy("ROUTE_ID").agg(six(F.min("sed_local"), "sed_local"))


def accel_local(spark, sf):
    return inject.local_motion(routes(spark, sf)).groupBy("ROUTE_ID").agg(F.round(F.min("accel_local") * 1e6, 6).alias("accel_local"))


def turn_local(spark, sf):
    return inject.local_motion(routes(spark, sf)).groupBy("ROUTE_ID").agg(six(F.min("turn_local"), "turn_local"))


def track_lag_lead(spark, sf):
    return _legs(spark, sf).select(*KEYS, six("PREV_LON"), six("NEXT_LON"))


OUT = (*KEYS, "T_INDEX", "ANOMALY", "ANOMALY_TYPE")


def a1_of(spark, sf):
    return inject.inject_a1(scored(spark, sf), side=parity("CRAFT_ID", "SEG", "ROUTE_POINT_IDX"))


def a2_of(spark, sf):
    return inject.inject_a2(scored(spark, sf), sign=parity("CRAFT_ID", "SEG"))


def a3_of(spark, sf):
    draws = {"scale": 0.905 + ((F.col("CRAFT_ID") + F.col("SEG")) % 20) / 100.0, "left": parity("CRAFT_ID", "SEG") == 1}
    return inject.inject_a3(scored(spark, sf), pick=F.col("ROUTE_POINT_IDX").cast("double"), **draws)


def inject_a1(spark, sf):
    return a1_of(spark, sf).select(*OUT, six("LON"), six("LAT"))


def inject_a2(spark, sf):
    return a2_of(spark, sf).select(*OUT, six("LON"), six("LAT"), six("SPEED"), six("COURSE_SIN"), six("COURSE_COS"))


def inject_a3(spark, sf):
    return a3_of(spark, sf).select(*OUT, six("LON"), six("LAT"), six("SPEED"), six("COURSE_SIN"), six("COURSE_COS"))


def plans_of(spark, sf):
    """An A1 plan for even crafts, an A2 plan where craft + segment divides by 3, an A3 plan where it divides by 4."""
    packed = scored(spark, sf).groupBy("ROUTE_ID", "CRAFT_ID", "SEG", "K").agg(
        F.array_sort(F.collect_list(F.struct("ROUTE_POINT_IDX", "score")))["score"].alias("scores")
    )
    both = F.col("CRAFT_ID") + F.col("SEG")
    kinds = F.array_compact(F.array(F.when(F.col("CRAFT_ID") % 2 == 0, "A1"), F.when(both % 3 == 0, "A2"), F.when(both % 4 == 0, "A3")))
    return packed.select("ROUTE_ID", F.explode(kinds).alias("anomaly_type"), F.lit(T).alias("T"), "K", "scores")


def plan_join_a2_wins(spark, sf):
    chosen = inject.one_plan_each(plans_of(spark, sf)).select("ROUTE_ID", "anomaly_type", "K")
    return routes(spark, sf).select("ROUTE_ID").distinct().join(chosen, "ROUTE_ID", "left")


def injected(spark, sf):
    return inject.apply_plans(routes(spark, sf), plans_of(spark, sf))


def inject_union_label(spark, sf):
    return injected(spark, sf).groupBy("ROUTE_ID", "ANOMALY_TYPE").agg(F.count(F.lit(1)).alias("points"), F.count_if("ANOMALY").alias("anomalous"))


def inject_counters(spark, sf):
    return inject.counters(injected(spark, sf))


def complete_routes(spark, sf):
    holed = routes(spark, sf).filter(~((F.col("SEG") == 1) & (F.col("ROUTE_POINT_IDX") == 11))).withColumn("T_INDEX", F.col("ROUTE_POINT_IDX"))
    return tracks.complete_routes(holed, T)


def _labelled(spark, sf):
    allowed = routes(spark, sf).filter("SEG < 2").select("ROUTE_ID").distinct()
    return dataset.labelled(a1_of(spark, sf), allowed, "a1", T)


def dataset_labels(spark, sf):
    return _labelled(spark, sf).groupBy("ROUTE_ID").agg(F.sum("y").alias("n_anomalous"))


def dataset_features(spark, sf):
    rows = dataset.packed(_labelled(spark, sf))
    return rows.select("route_id", F.posexplode("X").alias("place", "value")).select("route_id", "place", F.round(F.col("value").cast("double"), 3).alias("value"))


def dataset_split(spark, sf):
    rows = dataset.packed(_labelled(spark, sf))
    return dataset.split(rows, order=F.col("route_id")).select("route_id", "n_anomalous", "split")


def dataset_grid(spark, sf):
    index = strata.indices(strata.route_stats(routes(spark, sf)), T)
    return dataset.dataset_grid(injected(spark, sf), index, T).select("route_id", "mode", "pct", "seed", "n_anomalous", "split")


NAMES = """ais_clean hour_round_even dedup_keep_first course_sincos hourly_interpolate short_track_antijoin route_slice route_validate
route_stats stratum_bins stratum_sample stratum_labels k_round_robin indices_by_mode prompt_stats prompt_text json_extract score_validate
prompt_name_parse score_topk a2_window score_array_stats a3_risk_window geo_haversine geo_bearing geo_destination geo_xtrack sed_local
accel_local turn_local track_lag_lead inject_a1 inject_a2 inject_a3 plan_join_a2_wins inject_union_label inject_counters complete_routes
dataset_labels dataset_features dataset_split dataset_grid
review_answers review_fix review_counts answers_latest_valid draws allowed_a3 tier_counts""".split()

QUERIES = {name: globals()[name] for name in NAMES}
__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
