"""The three injections, on points in long form.

``points`` of every operator here are route points (TRACK_ID, SEG, ROUTE_POINT_IDX, ...)
with a ``score`` each; those of A1 and A2 also have their route's ``K``. Windows over
a route share the shuffle by TRACK_ID with windows over its track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.scalars import coin, uniform
from tidemark.operators.numpy_draws import with_numpy_draws
from tidemark.operators.tracks import track_neighbours
from tidemark.sources.kept import keep


def route():
    """Window of a route's points."""
    return W.partitionBy("TRACK_ID", "SEG")


def in_order():
    """The same, in order."""
    return route().orderBy("ROUTE_POINT_IDX")


def at(prefix: str = "") -> tuple[Column, Column]:
    return F.col(f"{prefix}LON"), F.col(f"{prefix}LAT")


def scored(points: DataFrame, plans: DataFrame) -> DataFrame:
    """Points of the planned routes with score and K. A plan whose scores are not one a point is left out."""
    size = points.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("TRACK_ID", "SEG")))
    both = size.join(plans.select("ROUTE_ID", "scores", "K"), "ROUTE_ID").filter("size(scores) = _n")
    return both.withColumn("score", F.expr("get(scores, ROUTE_POINT_IDX)")).drop("scores", "_n")


def normal_score() -> Column:
    low, high = F.min("score").over(route()), F.max("score").over(route())
    return F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.0))


def top_k(points: DataFrame) -> DataFrame:
    """``chosen``: the K points with the highest scores; of equal scores the later point. K = 0 chooses all."""
    rank = F.row_number().over(route().orderBy(F.desc("score"), F.desc("ROUTE_POINT_IDX")))
    return points.withColumn("chosen", (rank <= F.col("K")) | (F.col("K") == 0))


def local_sed(points: DataFrame) -> DataFrame:
    """``sed_local``: mean distance of a route's inner points from the way between their neighbours."""
    before = (F.lag("LON").over(in_order()), F.lag("LAT").over(in_order()))
    after = (F.lead("LON").over(in_order()), F.lead("LAT").over(in_order()))
    named = points.withColumns({"_bx": before[0], "_by": before[1], "_ax": after[0], "_ay": after[1]})
    sed = geo.cross_track((F.col("_bx"), F.col("_by")), (F.col("_ax"), F.col("_ay")), at())
    inner = F.when(F.col("_bx").isNotNull() & F.col("_ax").isNotNull(), sed)
    out = named.withColumn("_sed", inner).withColumn("sed_local", F.coalesce(F.avg("_sed").over(route()), F.lit(0.0)))
    return out.drop("_bx", "_by", "_ax", "_ay", "_sed")


def local_motion(points: DataFrame) -> DataFrame:
    """``v_in`` (speed of the leg to a point, from the track), ``accel_local`` and ``turn_local`` of its route."""
    legs = track_neighbours(points, ("LON", "LAT", "COURSE_SIN", "COURSE_COS"))
    legs = legs.withColumn("v_in", geo.haversine(*at("PREV_"), *at()) / geo.HOUR_S)
    inside = F.when(F.col("ROUTE_POINT_IDX") > 0, F.col("v_in"))
    head = geo.heading(F.col("COURSE_SIN"), F.col("COURSE_COS"))
    legs = legs.withColumns({"_v": inside, "heading": head})
    steps = legs.withColumns(
        {
            "_a": F.abs(F.col("_v") - F.lag("_v").over(in_order())) / geo.HOUR_S,
            "_w": F.abs(geo.wrap(F.col("heading") - F.lag("heading").over(in_order()))),
        }
    )
    means = {"accel_local": F.coalesce(F.avg("_a").over(route()), F.lit(0.0)), "turn_local": F.coalesce(F.avg("_w").over(route()), F.lit(0.0))}
    return steps.withColumns(means).drop("_v", "_a", "_w")


def inject_a1(
    points: DataFrame,
    theta_g: float = 3.0,
    side: Column | None = None,
    seed: int = 0,
    least_m: float = 100.0,
    most_m: float = 7039.479574,
) -> DataFrame:
    """Displaces the K top-scored points across their way. Every point is worked out from the original route.

    A route's first point needs a point before it on its track, else it stays; after the
    last point of a track the point itself ends the way. Routes under three points stay.
    """
    side = coin(F.col("ROUTE_ID"), F.col("ROUTE_POINT_IDX"), seed=seed) if side is None else side
    known = local_sed(top_k(track_neighbours(points))).withColumns({"_s": normal_score(), "_n": F.count(F.lit(1)).over(route()), "_side": side})
    known = known.withColumns({"NEXT_LON": F.coalesce("NEXT_LON", "LON"), "NEXT_LAT": F.coalesce("NEXT_LAT", "LAT")})
    before, after = at("PREV_"), at("NEXT_")
    off = lambda s: geo.cross_track(before, after, geo.destination(*at(), geo.sideways(before, after, s), 10.0))
    known = known.withColumns(
        {
            "_goal": theta_g * (1 + F.col("_s")) * F.greatest(F.col("sed_local"), F.lit(geo.LEAST_SED)),
            "_now": geo.cross_track(before, after, at()),
            "_grows": F.when(off(1) > off(-1), 1).otherwise(-1),
        }
    )
    raw = F.when(F.col("_side") == F.col("_grows"), F.col("_goal") - F.col("_now")).otherwise(F.col("_goal") + F.col("_now"))
    metres = F.least(F.greatest(raw, F.lit(least_m)), F.lit(most_m))
    lon, lat = geo.destination(*at(), geo.sideways(before, after, F.col("_side")), metres)
    moved = F.col("chosen") & F.col("PREV_LON").isNotNull() & (F.col("_n") >= 3)
    return _written(known, points, F.coalesce(moved, F.lit(False)), {"LON": lon, "LAT": lat}, "A1")


def _written(known: DataFrame, points: DataFrame, moved: Column, values: dict[str, Column], kind: str) -> DataFrame:
    """The columns of ``points`` with new values where ``moved``, labelled."""
    marked = known.withColumn("_moved", moved)
    fresh = {f"_new_{c}": v for c, v in values.items()}
    keep = [c for c in points.columns if c not in ("ANOMALY", "ANOMALY_TYPE", "T_INDEX", *values)]
    return marked.withColumns(fresh).select(
        *keep,
        *[F.when(F.col("_moved"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        (F.col("ANOMALY") | F.col("_moved")).alias("ANOMALY"),
        F.col("ROUTE_POINT_IDX").alias("T_INDEX"),
        F.when(F.col("_moved"), F.lit(kind)).otherwise(F.lit("")).alias("ANOMALY_TYPE"),
    )


def a2_windows(points: DataFrame) -> DataFrame:
    """``start`` and ``k`` of the K points in a row about the first highest score, moved into the route."""
    n = F.count(F.lit(1)).over(route())
    best = F.min(F.when(F.col("score") == F.col("_top"), F.col("ROUTE_POINT_IDX"))).over(route())
    known = points.withColumns({"_top": F.max("score").over(route()), "_n": n}).withColumns({"k": F.least("K", "_n"), "_best": best})
    start = F.greatest(F.lit(0), F.least(F.col("_best") - F.floor((F.col("k") - 1) / 2), F.col("_n") - F.col("k"))).cast("int")
    return known.withColumn("start", start).drop("_top", "_best", "_n")


def inject_a2(points: DataFrame, theta_v: float = 2.0, sign: Column | None = None, seed: int = 0) -> DataFrame:
    """Speeds up and turns over two thirds of a window, then leads back to the track.

    A point depends on the one before it, so a route's points are packed and folded in
    order: at most K steps a route.
    """
    sign = coin(F.col("ROUTE_ID"), seed=seed) if sign is None else sign
    known = a2_windows(local_motion(points)).withColumns({"_s": normal_score(), "_sign": sign})
    one = F.struct(
        F.col("ROUTE_POINT_IDX").alias("i"), F.col("LON").alias("x"), F.col("LAT").alias("y"), F.col("v_in").alias("v"),
        F.col("heading").alias("h"), F.col("_s").alias("s"),
    )
    before = F.struct(
        F.col("ROUTE_POINT_IDX").alias("i"), F.col("PREV_LON").alias("x"), F.col("PREV_LAT").alias("y"),
        geo.heading(F.col("PREV_COURSE_SIN"), F.col("PREV_COURSE_COS")).alias("h"),
    )
    packed = known.filter("k > 0").groupBy("TRACK_ID", "SEG").agg(
        F.array_sort(F.collect_list(one)).alias("p"), F.min(before).alias("b"), F.first("start").alias("start"), F.first("k").alias("k"),
        F.first("_sign").alias("sign"), F.first("accel_local").alias("a"), F.first("turn_local").alias("w"),
    )
    packed = packed.filter("size(p) >= 3").withColumns(
        {
            "push": F.expr("greatest(1, int(2 * k div 3))"),
            "a": F.greatest(F.col("a"), F.lit(geo.LEAST_ACCEL)),
            "w": F.greatest(F.col("w"), F.lit(geo.LEAST_TURN)),
        }
    )
    packed = packed.withColumns(
        {
            "goal": F.expr("get(p, int(least(start + k, size(p) - 1)))"),
            "weights": F.expr("transform(slice(p, start + push + 1, greatest(0, k - push)), q -> 1e0 + q.s)"),
        }
    )
    packed = packed.withColumn("total", F.expr("aggregate(weights, 1e0, (t, x) -> t + x)"))
    step = "struct<i:int,x:double,y:double,v:double,h:double>"
    # Where the window starts at a track's first point, that point stays and counts as the one before.
    first = F.expr("if(start > 0, named_struct('x', get(p, start - 1).x, 'y', get(p, start - 1).y, 'h', get(p, start - 1).h), named_struct('x', b.x, 'y', b.y, 'h', b.h))")
    begin = F.struct(
        first["x"].alias("x"), first["y"].alias("y"), first["h"].alias("h"), F.lit(0.0).alias("ex"), F.lit(0.0).alias("ey"),
        F.lit(0.0).alias("f"), F.array().cast(f"array<{step}>").alias("out"),
    )

    def fold(acc: Column, pos: Column) -> Column:
        # Terms used more than once are bound as elements of one-element arrays.
        here = F.get("p", (F.col("start") + pos).cast("int"))
        skip = (F.col("start") + pos == 0) & acc["x"].isNull()
        leg = geo.haversine(acc["x"], acc["y"], here["x"], here["y"]) / geo.HOUR_S
        v_in = F.when((F.col("start") == 0) & (pos == 1), leg).otherwise(here["v"])
        pushing = pos < F.col("push")
        much = theta_v * (1 + here["s"])
        share = acc["f"] + F.when(pushing, F.lit(0.0)).otherwise((1 + here["s"]) / F.col("total"))
        goal = F.col("goal")
        aim = geo.wrap(geo.bearing(acc["x"], acc["y"], goal["x"], goal["y"]) - acc["h"])
        h = geo.wrap(acc["h"] + F.when(pushing, F.col("sign") * much * F.col("w")).otherwise(aim * share))
        left = geo.haversine(acc["x"], acc["y"], goal["x"], goal["y"])
        steps_left = F.greatest(F.lit(1), F.col("k") - pos)
        fast = F.greatest(F.lit(0.1), v_in + much * F.col("a") * geo.HOUR_S)
        back = F.greatest(v_in, F.lit(0.1), 0.7 * v_in + 0.3 * left / (steps_left * geo.HOUR_S))
        v = F.when(pushing, fast).otherwise(back)
        bound = F.struct(h.alias("h"), v.alias("v"), share.alias("f"))

        def place(t: Column) -> Column:
            x1, y1 = geo.destination(acc["x"], acc["y"], F.pmod(t["h"], F.lit(360.0)), t["v"] * geo.HOUR_S)
            x2, y2 = acc["ex"] + (goal["x"] - acc["ex"]) * t["f"], acc["ey"] + (goal["y"] - acc["ey"]) * t["f"]
            return F.struct(t["h"].alias("h"), t["v"].alias("v"), t["f"].alias("f"), F.when(pushing, x1).otherwise(x2).alias("x"), F.when(pushing, y1).otherwise(y2).alias("y"))

        def grow(t: Column) -> Column:
            i = (F.col("start") + pos).cast("int").alias("i")
            added = F.array(F.struct(i, t["x"].alias("x"), t["y"].alias("y"), t["v"].alias("v"), t["h"].alias("h"))).cast(f"array<{step}>")
            stay = F.struct(
                here["x"].alias("x"), here["y"].alias("y"), here["h"].alias("h"), here["x"].alias("ex"), here["y"].alias("ey"),
                acc["f"].alias("f"), acc["out"].alias("out"),
            )
            go = F.struct(
                t["x"].alias("x"), t["y"].alias("y"), t["h"].alias("h"), F.when(pushing, t["x"]).otherwise(acc["ex"]).alias("ex"),
                F.when(pushing, t["y"]).otherwise(acc["ey"]).alias("ey"), t["f"].alias("f"), F.concat(acc["out"], added).alias("out"),
            )
            return F.when(skip, stay).otherwise(go)

        placed = F.transform(F.array(bound), place)
        return F.element_at(F.transform(placed, grow), 1)

    steps = packed.withColumn("_steps", F.aggregate(F.expr("sequence(0, greatest(0, int(k) - 1))"), begin, fold)["out"])
    moved = steps.select("TRACK_ID", "SEG", F.inline("_steps"))
    moved = moved.select("TRACK_ID", "SEG", F.col("i").alias("ROUTE_POINT_IDX"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("_v"), F.col("h").alias("_h"))
    both = points.join(moved, ["TRACK_ID", "SEG", "ROUTE_POINT_IDX"], "left")
    values = {
        "LON": F.col("_x"), "LAT": F.col("_y"), "SPEED": F.col("_v") / geo.KNOT,
        "COURSE_SIN": F.sin(F.radians("_h")), "COURSE_COS": F.cos(F.radians("_h")),
    }
    return _written(both, points, F.col("_x").isNotNull(), values, "A2")


def a3_anchor(points: DataFrame, pick: Column | None = None, seed: int = 0) -> DataFrame:
    """``ta``, a point with the highest score, and the three points ``s0`` to ``s1`` about it that score most together.

    Of equally high points one is drawn by ``pick`` (its least value; by default a hash).
    """
    pick = uniform(F.col("ROUTE_ID"), F.col("ROUTE_POINT_IDX"), seed=seed) if pick is None else pick
    i, n = F.col("ROUTE_POINT_IDX"), F.col("_n")
    known = points.withColumns({"_n": F.count(F.lit(1)).over(route()), "_s": normal_score()})
    known = known.withColumn("_top", F.max("_s").over(route()))
    drawn = F.when(F.col("_top") - F.col("_s") <= 1e-12, F.struct(pick.alias("draw"), i.alias("i")))
    known = known.withColumn("ta", F.min(drawn).over(route())["i"])
    three = F.col("_s") + F.lead("_s", 1).over(in_order()) + F.lead("_s", 2).over(in_order())
    can = (i >= F.greatest(F.lit(0), F.col("ta") - 2)) & (i <= F.least(F.col("ta"), n - 3))
    known = known.withColumn("_sum", F.when(can, three))
    first = F.max(F.when(F.col("_sum").isNotNull(), F.struct(F.col("_sum").alias("sum"), (-i).alias("back")))).over(route())
    return known.withColumn("s0", -first["back"]).withColumn("s1", F.col("s0") + 2).drop("_top", "_sum")


def inject_a3(
    points: DataFrame, scale: Column | None = None, left: Column | None = None, pick: Column | None = None, seed: int = 0
) -> DataFrame:
    """The virtual vessels: a track each that passes its host most closely at the anchor. Host rows are not returned.

    Everything is a closed form of a point's place in its route. Routes under three points have none.
    """
    scale = 0.9 + 0.2 * uniform(F.col("ROUTE_ID"), F.lit("scale"), seed=seed) if scale is None else scale
    left = uniform(F.col("ROUTE_ID"), F.lit("side"), seed=seed) < 0.5 if left is None else left
    known = a3_anchor(points, pick, seed).filter("_n >= 3")
    anchor = lambda c: F.max(F.when(F.col("ROUTE_POINT_IDX") == F.col("ta"), c)).over(route())
    i, ta, s0, s1, n = (F.col(c) for c in ("ROUTE_POINT_IDX", "ta", "s0", "s1", "_n"))
    inside = (i >= s0) & (i <= s1)
    score = F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0))
    known = known.withColumns(
        {
            "lon0": anchor(F.col("LON")), "lat0": anchor(F.col("LAT")), "sog0": anchor(F.col("SPEED")),
            "cog0": anchor(geo.heading(F.col("COURSE_SIN"), F.col("COURSE_COS"))),
            "sev": F.least(F.lit(1.0), 0.6 * F.avg(F.when(inside, score)).over(route()) + 0.4 * anchor(score)),
            "turn": F.when(left, F.lit(1.0)).otherwise(F.lit(-1.0)), "scale": scale,
        }
    )
    ve, vn = geo.velocity(F.col("cog0"), F.col("sog0"))
    known = known.withColumns({"ve": ve, "vn": vn})
    known = known.withColumns({"ue": (F.col("scale") - 1) * F.col("ve"), "un": (F.col("scale") - 1) * F.col("vn")})
    size = F.hypot("ue", "un")
    slow = size <= 1e-6
    e1, n1 = geo.left_unit(F.when(slow, F.col("ve")).otherwise(F.col("ue")), F.when(slow, F.col("vn")).otherwise(F.col("un")))
    near = (0.3 - 0.2 * F.col("sev")) * geo.MILE
    known = known.withColumns({"pe": F.col("turn") * e1, "pn": F.col("turn") * n1, "near": near, "u": F.greatest(size, F.lit(0.05))})
    profile = F.sqrt(F.pow("near", 2) + F.pow(F.col("u") * geo.HOUR_S * (i - ta), 2))
    edge = F.least(F.lit(2 * geo.MILE), F.greatest(2 * F.col("near"), F.col("near") + 0.2 * geo.MILE))
    away = F.when(i < s0, s0 - i).otherwise(i - s1)
    far = 3 * F.greatest(profile, edge + away * 0.8 * geo.MILE)
    distance = F.when(i == ta, F.col("near")).when(inside, F.greatest(profile, F.col("near") + 5)).otherwise(far)
    taper = F.greatest(F.lit(0.0), 1 - F.abs(i - ta) / F.greatest(F.lit(2), F.floor(n / 6)))
    known = known.withColumns({"d": distance, "theta": (15 + 55 * F.col("sev")) * taper * F.col("turn")})
    re, rn = geo.rotate(F.col("pe"), F.col("pn"), F.col("theta"))
    oe, on = geo.to_local(F.col("LON"), F.col("LAT"), F.col("lon0"), F.col("lat0"))
    known = known.withColumns({"x": oe + F.col("d") * re, "y": on + F.col("d") * rn})
    step = {"dx": F.lead("x").over(in_order()) - F.col("x"), "dy": F.lead("y").over(in_order()) - F.col("y")}
    known = known.withColumns(step)
    known = known.withColumns({c: F.coalesce(F.col(c), F.lag(c).over(in_order())) for c in ("dx", "dy")})
    lon, lat = geo.from_local(F.col("x"), F.col("y"), F.col("lon0"), F.col("lat0"))
    course = F.atan2("dx", "dy")
    fresh = {
        "LON": lon, "LAT": lat, "SPEED": F.hypot("dx", "dy") / geo.HOUR_S / geo.KNOT,
        "COURSE_SIN": F.sin(course), "COURSE_COS": F.cos(course),
    }
    keep = [c for c in points.columns if c not in ("ROUTE_ID", "ANOMALY", "ANOMALY_TYPE", "T_INDEX", *fresh)]
    return known.withColumns({f"_new_{c}": v for c, v in fresh.items()}).select(
        F.concat(F.lit("A3_"), "ROUTE_ID").alias("ROUTE_ID"),
        *keep,
        *[F.col(f"_new_{c}").alias(c) for c in fresh],
        inside.alias("ANOMALY"),
        i.alias("T_INDEX"),
        F.when(inside, F.lit("A3")).otherwise(F.lit("")).alias("ANOMALY_TYPE"),
    )


def mark_hosts(host: DataFrame, virtual: DataFrame) -> DataFrame:
    """Host rows become A3 where the virtual vessel is anomalous and they have no type of their own."""
    close = virtual.filter("ANOMALY").select(F.substring("ROUTE_ID", 4, 1_000_000).alias("ROUTE_ID"), "ROUTE_POINT_IDX", F.lit(True).alias("_near"))
    both = host.join(close, ["ROUTE_ID", "ROUTE_POINT_IDX"], "left")
    turned = F.col("_near").isNotNull() & (F.col("ANOMALY_TYPE") == "")
    return both.withColumns(
        {"ANOMALY": F.col("ANOMALY") | turned, "ANOMALY_TYPE": F.when(turned, F.lit("A3")).otherwise(F.col("ANOMALY_TYPE"))}
    ).drop("_near")


def latest_plans(plans: DataFrame) -> DataFrame:
    """Of each route's plans of a type the latest by ``scored_at``, then by ``path`` if there is one; without either the one of the largest scores."""
    by = [F.desc_nulls_last(c) for c in ("scored_at", "path") if c in plans.columns]
    last = W.partitionBy("ROUTE_ID", "anomaly_type").orderBy(*by, F.desc("scores"))
    return plans.withColumn("_l", F.row_number().over(last)).filter("_l = 1").drop("_l")


def one_plan_each(plans: DataFrame, conflict: str = "a2_wins") -> DataFrame:
    """Of a route's A1 and A2 plans the one that counts; of several of a type the latest."""
    order = F.desc("anomaly_type") if conflict == "a2_wins" else F.asc("anomaly_type")
    rank = F.row_number().over(W.partitionBy("ROUTE_ID").orderBy(order))
    return latest_plans(plans.filter("anomaly_type IN ('A1', 'A2')")).withColumn("_n", rank).filter("_n = 1").drop("_n")


def apply_plans(
    points: DataFrame, plans: DataFrame, seed: int = 0, theta_g: float = 3.0, theta_v: float = 2.0, conflict: str = "a2_wins", rng: str = "hash"
) -> DataFrame:
    """All points, perturbed as planned, and the virtual vessels. Virtual rows share their host's track and times.

    ``rng`` is hash, or numpy for virtual vessels drawn by NumPy's generator (``numpy_draws``).
    Neighbours on the track are taken from all points, so points without a plan go through
    the injections with nothing chosen.
    """
    single = one_plan_each(plans, conflict).select("ROUTE_ID", "anomaly_type", "scores", "K")
    size = points.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("TRACK_ID", "SEG")))
    both = size.join(single, "ROUTE_ID", "left")
    usable = F.size("scores") == F.col("_n")
    both = both.withColumns(
        {"score": F.when(usable, F.expr("get(scores, ROUTE_POINT_IDX)")), "kind": F.when(usable, F.col("anomaly_type"))}
    ).drop("scores", "_n", "anomaly_type")
    k_of = lambda kind: F.when(F.col("kind") == kind, F.col("K")).otherwise(F.lit(-1))
    a1 = inject_a1(both.withColumn("K", k_of("A1")), theta_g, seed=seed)
    a2 = inject_a2(both.withColumn("K", k_of("A2")), theta_v, seed=seed)
    out = points.columns + ["T_INDEX", "ANOMALY_TYPE"]
    host = a1.filter("kind IS NULL OR kind = 'A1'").select(out).unionByName(a2.filter("kind = 'A2'").select(out))
    a3 = scored(points, latest_plans(plans.filter("anomaly_type = 'A3'")).withColumn("K", F.lit(0)))
    if rng == "numpy":
        a3 = with_numpy_draws(a3, seed)
        draws = {"scale": F.col("draw_scale"), "left": F.col("draw_left"), "pick": F.col("draw_pick")}
    elif rng == "hash":
        draws = {}
    else:
        raise ValueError(f"rng is hash or numpy, not {rng}")
    virtual = keep(inject_a3(a3, seed=seed, **draws).select(out))
    return mark_hosts(host, virtual).select(out).unionByName(virtual)


def counters(injected: DataFrame) -> DataFrame:
    """One row of counts."""
    host = ~F.col("ROUTE_ID").startswith("A3_")
    routes = lambda kind: F.countDistinct(F.when(host & (F.col("ANOMALY_TYPE") == kind), F.col("ROUTE_ID")))
    return injected.agg(
        F.countDistinct(F.when(host, F.col("ROUTE_ID"))).alias("routes_total"),
        routes("A1").alias("a1_routes"), routes("A2").alias("a2_routes"),
        F.countDistinct(F.when(~host, F.col("ROUTE_ID"))).alias("a3_routes"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("ANOMALY")).alias("anomalous_rows"),
    )
