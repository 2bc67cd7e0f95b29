"""The catalogue's queries as DuckDB SQL, each a chain of common table expressions ending in ``q``."""

from __future__ import annotations

_AIS = """
h AS (SELECT *, date_trunc('hour', ts) AS h0, epoch_us(ts) - epoch_us(date_trunc('hour', ts)) AS past FROM events),
e AS (SELECT *, CASE WHEN past < 1800000000 OR (past = 1800000000 AND hour(ts) % 2 = 0) THEN h0 ELSE h0 + INTERVAL 1 HOUR END AS at_h FROM h),
ais AS (
  SELECT event_id AS src_ord, user_id AS CRAFT_ID, CAST(user_id AS VARCHAR) AS TRACK_ID, at_h AS "TIMESTAMP",
    112e0 + date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', at_h) * 1e-2 + (event_id % 100) / 1e4 AS LON,
    -30e0 + ((user_id * 13) % 100) / 1e2 + (event_id % 37) / 1e4 AS LAT,
    CAST((event_id * 7919) % 360 AS DOUBLE) AS COURSE, value / 20e0 AS SPEED,
    sin(radians(CAST((event_id * 7919) % 360 AS DOUBLE))) AS COURSE_SIN, cos(radians(CAST((event_id * 7919) % 360 AS DOUBLE))) AS COURSE_COS
  FROM e)"""
_FIRST = _AIS + """,
f AS (SELECT * FROM ais QUALIFY row_number() OVER (PARTITION BY TRACK_ID, "TIMESTAMP" ORDER BY src_ord) = 1)"""
_ROUTES = _FIRST + """,
n AS (SELECT *, count(*) OVER (PARTITION BY TRACK_ID) AS n, row_number() OVER (PARTITION BY TRACK_ID ORDER BY "TIMESTAMP") - 13 AS i FROM f),
r AS (
  SELECT *, CAST(i // 12 AS INTEGER) AS SEG, CAST(i % 12 AS INTEGER) AS ROUTE_POINT_IDX, TRACK_ID || '-' || CAST(i // 12 AS VARCHAR) AS ROUTE_ID
  FROM n WHERE n >= 36 AND i >= 0 AND i < (n - 24) // 12 * 12)"""
_STATS = _ROUTES + """,
g AS (SELECT *, (degrees(atan2(COURSE_SIN, COURSE_COS)) + 360e0) % 360e0 AS cog FROM r),
d AS (
  SELECT *, abs(cog - lag(cog) OVER w) AS dc, abs(SPEED - lag(SPEED) OVER w) AS ds FROM g
  WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
s AS (
  SELECT ROUTE_ID, avg(SPEED) AS avg_sog, coalesce(avg(least(dc, 360 - dc)), 0) AS avg_dcog, coalesce(avg(ds), 0) AS avg_dsog, 'Cargo' AS vessel_type
  FROM d GROUP BY ROUTE_ID)"""
_Q = "[0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]"
_STRATA = _STATS + f""",
b AS (SELECT quantile_cont(avg_sog, {_Q}) AS e1, quantile_cont(avg_dcog, {_Q}) AS e2, quantile_cont(avg_dsog, {_Q}) AS e3 FROM s),
k AS (
  SELECT s.*, greatest(1, len(list_filter(e1, lambda v: v < avg_sog))) AS b1, greatest(1, len(list_filter(e2, lambda v: v < avg_dcog))) AS b2,
    greatest(1, len(list_filter(e3, lambda v: v < avg_dsog))) AS b3
  FROM s, b),
z AS (SELECT *, vessel_type || '/' || b1 || '/' || b2 || '/' || b3 AS stratum_key FROM k)"""
_SCORED = _ROUTES + """,
p AS (SELECT *, ((ROUTE_POINT_IDX * 7 + SEG * 13 + CRAFT_ID * 5) % 101) / 1e2 AS score, CAST(3 * (1 + SEG % 3) AS INTEGER) AS K FROM r)"""
_NEAR = """,
l AS (
  SELECT *, lag(LON) OVER w AS px, lag(LAT) OVER w AS py, lead(LON) OVER w AS nx, lead(LAT) OVER w AS ny FROM {of}
  WINDOW w AS (PARTITION BY TRACK_ID ORDER BY "TIMESTAMP"))"""


def _dist(x1, y1, x2, y2):
    return f"(2 * 6371000e0 * asin(sqrt(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2))))"


def _bear(x1, y1, x2, y2):
    turn = f"(radians({x2}) - radians({x1}))"
    east = f"sin({turn}) * cos(radians({y2}))"
    north = f"cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos({turn})"
    return f"((degrees(atan2({east}, {north})) + 360e0) % 360e0)"


def _cross(ax, ay, bx, by, cx, cy):
    to_c = _dist(ax, ay, cx, cy)
    off = f"(radians({_bear(ax, ay, cx, cy)}) - radians({_bear(ax, ay, bx, by)}))"
    return f"(CASE WHEN {_dist(ax, ay, bx, by)} < 1e-10 THEN {to_c} ELSE abs(asin(sin({to_c} / 6371000e0) * sin({off}))) * 6371000e0 END)"


def _lat(y, c, m):
    return f"degrees(asin(sin(radians({y})) * cos({m} / 6371000e0) + cos(radians({y})) * sin({m} / 6371000e0) * cos(radians({c}))))"


def _lon(x, y, c, m):
    end = f"sin(radians({_lat(y, c, m)}))"
    return (
        f"degrees(radians({x}) + atan2(sin(radians({c})) * sin({m} / 6371000e0) * cos(radians({y})), "
        f"cos({m} / 6371000e0) - sin(radians({y})) * {end}))"
    )


def _with(ctes: str, query: str) -> str:
    return f"WITH {ctes.strip()}\n{query.strip()}"


_NORM = "CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 0 END"
_A1 = (
    _SCORED
    + _NEAR.format(of="p")
    + f""",
sd AS (
  SELECT ROUTE_ID, coalesce(avg(CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN {_cross('a', 'b', 'c', 'd2', 'LON', 'LAT')} END), 0) AS sed
  FROM (SELECT ROUTE_ID, LON, LAT, lag(LON) OVER w AS a, lag(LAT) OVER w AS b, lead(LON) OVER w AS c, lead(LAT) OVER w AS d2 FROM p
    WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)) GROUP BY ROUTE_ID),
m AS (
  SELECT l.*, coalesce(nx, LON) AS ex, coalesce(ny, LAT) AS ey, sed, {_NORM} AS s, row_number() OVER (PARTITION BY l.ROUTE_ID ORDER BY score DESC, ROUTE_POINT_IDX DESC) <= K AS chosen,
    CASE WHEN (CRAFT_ID + SEG + ROUTE_POINT_IDX) % 2 = 0 THEN 1 ELSE -1 END AS side
  FROM l JOIN sd ON l.ROUTE_ID = sd.ROUTE_ID WINDOW q AS (PARTITION BY l.ROUTE_ID)),
m2 AS (
  SELECT *, 3e0 * (1 + s) * greatest(sed, 110.494501e0) AS goal, {_cross('px', 'py', 'ex', 'ey', 'LON', 'LAT')} AS now_at,
    ({_bear('px', 'py', 'ex', 'ey')} + 90e0) % 360e0 AS go_l, ({_bear('px', 'py', 'ex', 'ey')} + 270e0) % 360e0 AS go_r
  FROM m),
m3 AS (
  SELECT *, {_lon('LON', 'LAT', 'go_l', '10e0')} AS lx, {_lat('LAT', 'go_l', '10e0')} AS ly, {_lon('LON', 'LAT', 'go_r', '10e0')} AS rx, {_lat('LAT', 'go_r', '10e0')} AS ry
  FROM m2),
m4 AS (
  SELECT *, CASE WHEN {_cross('px', 'py', 'ex', 'ey', 'lx', 'ly')} > {_cross('px', 'py', 'ex', 'ey', 'rx', 'ry')} THEN 1 ELSE -1 END AS grows,
    CASE WHEN side = 1 THEN go_l ELSE go_r END AS go FROM m3),
m5 AS (
  SELECT *, least(greatest(CASE WHEN side = grows THEN goal - now_at ELSE goal + now_at END, 100e0), 7039.479574e0) AS dist, chosen AND px IS NOT NULL AS hit FROM m4),
a1 AS (
  SELECT *, hit AS ANOMALY, CASE WHEN hit THEN {_lon('LON', 'LAT', 'go', 'dist')} ELSE LON END AS to_x, CASE WHEN hit THEN {_lat('LAT', 'go', 'dist')} ELSE LAT END AS to_y,
    CASE WHEN hit THEN 'A1' ELSE '' END AS ANOMALY_TYPE
  FROM m5)"""
)
_LABELLED = _A1 + """,
y AS (SELECT *, CASE WHEN ANOMALY AND SEG < 2 THEN 1 ELSE 0 END AS y FROM a1)"""
_ANCHOR = _SCORED + f""",
t1 AS (SELECT *, {_NORM} AS s FROM p WINDOW q AS (PARTITION BY ROUTE_ID)),
t2 AS (SELECT *, max(s) OVER q AS top FROM t1 WINDOW q AS (PARTITION BY ROUTE_ID)),
t3 AS (SELECT *, min(CASE WHEN top - s <= 1e-12 THEN ROUTE_POINT_IDX END) OVER (PARTITION BY ROUTE_ID) AS ta,
  s + lead(s, 1) OVER w + lead(s, 2) OVER w AS three FROM t2 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
t4 AS (SELECT *, CASE WHEN ROUTE_POINT_IDX >= greatest(0, ta - 2) AND ROUTE_POINT_IDX <= least(ta, 9) THEN three END AS can FROM t3),
t5 AS (SELECT ROUTE_ID, arg_max(ROUTE_POINT_IDX, (can, -ROUTE_POINT_IDX)) AS s0 FROM t4 WHERE can IS NOT NULL GROUP BY ROUTE_ID),
an AS (SELECT t4.*, CAST(s0 AS INTEGER) AS s0, CAST(s0 + 2 AS INTEGER) AS s1, ROUTE_POINT_IDX BETWEEN s0 AND s0 + 2 AS ins FROM t4 JOIN t5 USING (ROUTE_ID))"""
_A3 = _ANCHOR + f""",
c1 AS (
  SELECT *, max(CASE WHEN ROUTE_POINT_IDX = ta THEN LON END) OVER q AS lon0, max(CASE WHEN ROUTE_POINT_IDX = ta THEN LAT END) OVER q AS lat0,
    max(CASE WHEN ROUTE_POINT_IDX = ta THEN SPEED END) OVER q AS sog0, max(CASE WHEN ROUTE_POINT_IDX = ta THEN degrees(atan2(COURSE_SIN, COURSE_COS)) END) OVER q AS cog0,
    least(1e0, 0.6e0 * avg(CASE WHEN ins THEN s END) OVER q + 0.4e0 * max(CASE WHEN ROUTE_POINT_IDX = ta THEN s END) OVER q) AS sev,
    CASE WHEN (CRAFT_ID + SEG) % 2 = 0 THEN 1e0 ELSE -1e0 END AS turn, 0.905e0 + ((CRAFT_ID + SEG) % 20) / 1e2 AS scale
  FROM an WINDOW q AS (PARTITION BY ROUTE_ID)),
c2 AS (SELECT *, greatest(sog0, 0.2e0) * 0.514444e0 * sin(radians(cog0)) AS ve, greatest(sog0, 0.2e0) * 0.514444e0 * cos(radians(cog0)) AS vn FROM c1),
c3 AS (SELECT *, (scale - 1) * ve AS ue, (scale - 1) * vn AS un, (0.3e0 - 0.2e0 * sev) * 1852e0 AS near FROM c2),
c4 AS (
  SELECT *, sqrt(ue * ue + un * un) AS us, turn * -(un / sqrt(ue * ue + un * un)) AS pe, turn * (ue / sqrt(ue * ue + un * un)) AS pn,
    sqrt(pow(near, 2) + pow(greatest(sqrt(ue * ue + un * un), 0.05e0) * 3600e0 * (ROUTE_POINT_IDX - ta), 2)) AS prof,
    least(3704e0, greatest(2 * near, near + 370.4e0)) AS edge FROM c3),
c5 AS (
  SELECT *, CASE WHEN ROUTE_POINT_IDX = ta THEN near WHEN ins THEN greatest(prof, near + 5)
      ELSE 3 * greatest(prof, edge + (CASE WHEN ROUTE_POINT_IDX < s0 THEN s0 - ROUTE_POINT_IDX ELSE ROUTE_POINT_IDX - s1 END) * 1481.6e0) END AS d,
    radians((15 + 55 * sev) * greatest(0e0, 1 - abs(ROUTE_POINT_IDX - ta) / 2e0) * turn) AS th FROM c4),
c6 AS (
  SELECT *, (radians(LON) - radians(lon0)) * cos(radians(lat0)) * 6371000e0 + d * (cos(th) * pe - sin(th) * pn) AS x,
    (radians(LAT) - radians(lat0)) * 6371000e0 + d * (sin(th) * pe + cos(th) * pn) AS y FROM c5),
c7 AS (SELECT *, lead(x) OVER w - x AS dx0, lead(y) OVER w - y AS dy0 FROM c6 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
a3 AS (SELECT *, coalesce(dx0, lag(dx0) OVER w) AS dx, coalesce(dy0, lag(dy0) OVER w) AS dy FROM c7 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX))"""
_DRAW = lambda name: f"CAST('0x' || substr(md5({name}), 1, 15) AS BIGINT)"
_INDEX = _STRATA + f""",
i1 AS (
  SELECT *, count(*) OVER (PARTITION BY stratum_key) AS nn, row_number() OVER (PARTITION BY stratum_key ORDER BY {_DRAW("ROUTE_ID || ':0'")}, ROUTE_ID) AS rk,
    row_number() OVER (PARTITION BY stratum_key ORDER BY {_DRAW("ROUTE_ID || ':7'")}, ROUTE_ID) AS rk7
  FROM z)"""
# Which points each plan touches; where they go does not matter here. A1 and A2 as planned, A2 first; A3 rows precede nothing.
_TOUCHED = _SCORED + _NEAR.format(of="p") + f""",
u1 AS (
  SELECT *, CASE WHEN (CRAFT_ID + SEG) % 3 = 0 THEN 'A2' WHEN CRAFT_ID % 2 = 0 THEN 'A1' END AS kind, (CRAFT_ID + SEG) % 4 = 0 AS has_a3, {_NORM} AS s,
    row_number() OVER (PARTITION BY ROUTE_ID ORDER BY score DESC, ROUTE_POINT_IDX DESC) AS top, arg_max(ROUTE_POINT_IDX, (score, -ROUTE_POINT_IDX)) OVER q AS best
  FROM l WINDOW q AS (PARTITION BY ROUTE_ID)),
u2 AS (
  SELECT *, greatest(0, least(best - (K - 1) // 2, 12 - K)) AS start, max(s) OVER q AS most,
    s + lead(s, 1) OVER w + lead(s, 2) OVER w AS three
  FROM u1 WINDOW q AS (PARTITION BY ROUTE_ID), w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
u3 AS (
  SELECT *, arg_min(ROUTE_POINT_IDX, CASE WHEN most - s <= 1e-12 THEN {_DRAW("ROUTE_ID || ':' || ROUTE_POINT_IDX || ':0'")} END)
    OVER (PARTITION BY ROUTE_ID) AS ta FROM u2),
u4 AS (SELECT *, CASE WHEN ROUTE_POINT_IDX >= greatest(0, ta - 2) AND ROUTE_POINT_IDX <= least(ta, 9) THEN three END AS can FROM u3),
u5 AS (SELECT ROUTE_ID AS rid, arg_max(ROUTE_POINT_IDX, (can, -ROUTE_POINT_IDX)) AS s0 FROM u4 WHERE can IS NOT NULL GROUP BY ROUTE_ID),
u6 AS (
  SELECT u4.*, has_a3 AND ROUTE_POINT_IDX BETWEEN s0 AND s0 + 2 AS close_by,
    CASE WHEN kind = 'A1' AND top <= K AND px IS NOT NULL THEN 'A1'
      WHEN kind = 'A2' AND ROUTE_POINT_IDX BETWEEN start AND start + K - 1 AND (ROUTE_POINT_IDX > 0 OR px IS NOT NULL) THEN 'A2' ELSE '' END AS own
  FROM u4 JOIN u5 ON ROUTE_ID = rid),
u7 AS (
  SELECT ROUTE_ID, ROUTE_POINT_IDX, CASE WHEN own = '' AND close_by THEN 'A3' ELSE own END AS ANOMALY_TYPE FROM u6
  UNION ALL SELECT 'A3_' || ROUTE_ID, ROUTE_POINT_IDX, CASE WHEN close_by THEN 'A3' ELSE '' END FROM u6 WHERE has_a3)"""
_FLAGS = ", ".join(f"rk <= greatest(1, floor(nn * {p} / 100e0)) AS use_{p}pct" for p in (10, 5, 3, 1))
_THREE = "printf('%.3f', round({0}, 3))"
_LABEL = lambda e, b: f"'(' || printf('%.3f', round({e}[{b}] - CASE WHEN {b} = 1 THEN 0.001 ELSE 0 END, 3)) || ', ' || printf('%.3f', round({e}[{b} + 1], 3)) || ']'"
_SIX = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)

_WRAP = lambda a: f"(CASE WHEN {a} > 180 THEN {a} - 360 * ceil(({a} - 180) / 360) WHEN {a} < -180 THEN {a} + 360 * ceil((-180 - {a}) / 360) ELSE {a} END)"
# A2 point by point: each step starts from where the last one led.
_A2 = (
    "WITH RECURSIVE "
    + (
        _SCORED
        + _NEAR.format(of="p")
        + f""",
q1 AS (
  SELECT l.*, lag(COURSE_SIN) OVER w AS psin, lag(COURSE_COS) OVER w AS pcos, {_dist('px', 'py', 'LON', 'LAT')} / 3600e0 AS v, degrees(atan2(COURSE_SIN, COURSE_COS)) AS hd, {_NORM} AS s,
    arg_max(ROUTE_POINT_IDX, (score, -ROUTE_POINT_IDX)) OVER q AS best
  FROM l WINDOW w AS (PARTITION BY TRACK_ID ORDER BY "TIMESTAMP"), q AS (PARTITION BY ROUTE_ID)),
q2 AS (
  SELECT *, CASE WHEN ROUTE_POINT_IDX > 0 THEN v END AS vin, hd - lag(hd) OVER w AS turn FROM q1 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
q3 AS (SELECT *, abs(vin - lag(vin) OVER w) / 3600e0 AS acc FROM q2 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
q4 AS (
  SELECT ROUTE_ID AS rid, max(K) AS k, greatest(0, least(max(best) - (max(K) - 1) // 2, 12 - max(K))) AS start, greatest(1, 2 * max(K) // 3) AS push,
    greatest(coalesce(avg(acc), 0), 0.0001e0) AS a, greatest(coalesce(avg(abs({_WRAP('turn')})), 0), 3e0) AS w, CASE WHEN (max(CRAFT_ID) + max(SEG)) % 2 = 0 THEN 1 ELSE -1 END AS sign,
    list(LON ORDER BY ROUTE_POINT_IDX) AS xs, list(LAT ORDER BY ROUTE_POINT_IDX) AS ys, list(v ORDER BY ROUTE_POINT_IDX) AS vs, list(hd ORDER BY ROUTE_POINT_IDX) AS hs,
    list(s ORDER BY ROUTE_POINT_IDX) AS ss, max(px) FILTER (ROUTE_POINT_IDX = 0) AS bx, max(py) FILTER (ROUTE_POINT_IDX = 0) AS by0,
    max(degrees(atan2(psin, pcos))) FILTER (ROUTE_POINT_IDX = 0) AS bh
  FROM q3 GROUP BY ROUTE_ID),
q5 AS (
  SELECT *, 1 + list_sum([1 + z for z in ss[start + push + 1 : start + k]] || [0e0]) AS total, xs[least(start + k, 11) + 1] AS gx, ys[least(start + k, 11) + 1] AS gy FROM q4),
walk AS (
  SELECT rid, CAST(-1 AS BIGINT) AS pos, CASE WHEN start > 0 THEN xs[start] ELSE bx END AS x, CASE WHEN start > 0 THEN ys[start] ELSE by0 END AS y,
    CASE WHEN start > 0 THEN hs[start] ELSE bh END AS h, 0e0 AS ex, 0e0 AS ey, 0e0 AS f, 0e0 AS vv, false AS moved FROM q5
  UNION ALL
  SELECT rid, pos, CASE WHEN skip THEN hx ELSE nx END, CASE WHEN skip THEN hy ELSE ny END, CASE WHEN skip THEN hh ELSE nh END,
    CASE WHEN skip THEN hx WHEN pushing THEN nx ELSE ex END, CASE WHEN skip THEN hy WHEN pushing THEN ny ELSE ey END, CASE WHEN skip THEN f ELSE share END, nv, NOT skip
  FROM (
    SELECT *, CASE WHEN pushing THEN {_lon('x', 'y', 'go', 'nv * 3600e0')} ELSE ex + (gx - ex) * share END AS nx,
      CASE WHEN pushing THEN {_lat('y', 'go', 'nv * 3600e0')} ELSE ey + (gy - ey) * share END AS ny
    FROM (
      SELECT *, (nh + 360e0) % 360e0 AS go, CASE WHEN pushing THEN greatest(0.1e0, v0 + much * a * 3600e0)
          ELSE greatest(v0, 0.1e0, 0.7e0 * v0 + 0.3e0 * rest / (greatest(1, k - pos) * 3600e0)) END AS nv
      FROM (
        SELECT *, CASE WHEN pushing THEN {_WRAP('(h + sign * much * w)')} ELSE {_WRAP('(h + aim * share)')} END AS nh
        FROM (
          SELECT *, CASE WHEN pushing THEN 0 ELSE {_WRAP('(bear - h)')} END AS aim
          FROM (
            SELECT n.*, w0.x, w0.y, w0.h, w0.ex, w0.ey, w0.f, w0.pos + 1 AS pos, w0.pos + 1 < push AS pushing, start + w0.pos + 1 = 0 AND w0.x IS NULL AS skip,
              xs[start + w0.pos + 2] AS hx, ys[start + w0.pos + 2] AS hy, hs[start + w0.pos + 2] AS hh, 2e0 * (1 + ss[start + w0.pos + 2]) AS much,
              w0.f + CASE WHEN w0.pos + 1 < push THEN 0 ELSE (1 + ss[start + w0.pos + 2]) / total END AS share, {_bear('w0.x', 'w0.y', 'gx', 'gy')} AS bear, {_dist('w0.x', 'w0.y', 'gx', 'gy')} AS rest,
              CASE WHEN start = 0 AND w0.pos + 1 = 1 THEN {_dist('w0.x', 'w0.y', 'xs[start + w0.pos + 2]', 'ys[start + w0.pos + 2]')} / 3600e0 ELSE vs[start + w0.pos + 2] END AS v0
            FROM walk w0 JOIN q5 n ON w0.rid = n.rid WHERE w0.pos + 1 < k)))))),
moves AS (SELECT walk.rid, start + pos AS spot, x, y, h, vv FROM walk JOIN q5 ON walk.rid = q5.rid WHERE moved)
SELECT ROUTE_ID, ROUTE_POINT_IDX, ROUTE_POINT_IDX AS T_INDEX, spot IS NOT NULL AS ANOMALY, CASE WHEN spot IS NULL THEN '' ELSE 'A2' END AS ANOMALY_TYPE,
  round(coalesce(x, LON), 6) AS LON, round(coalesce(y, LAT), 6) AS LAT, round(coalesce(vv / 0.514444e0, SPEED), 6) AS SPEED,
  round(coalesce(sin(radians(h)), COURSE_SIN), 6) AS COURSE_SIN, round(coalesce(cos(radians(h)), COURSE_COS), 6) AS COURSE_COS
FROM p LEFT JOIN moves ON ROUTE_ID = rid AND ROUTE_POINT_IDX = spot"""
    ).strip()
)

# Answers 1, 2, 5, 8 and 10 of 18 pass where no type and no length are expected.
_REVIEW = """
v AS (
  SELECT event_id, 'route_' || user_id || '-' || event_id || '_A1' AS source_name, event_id % 18 IN (0, 1, 4, 7, 9) AS good, event_id % 3 <> 0 AS there FROM events),
w AS (
  SELECT *, CASE WHEN good THEN 'ok' WHEN there THEN 'bad' ELSE 'missing' END AS status,
    CASE WHEN there THEN 'route_sliced_4/user_query/' || source_name || '.txt' END AS query_path, CAST(CASE WHEN there THEN 4 END AS INTEGER) AS query_T
  FROM v)"""

ORACLE_SQL: dict[str, str] = {
    "ais_clean": _with(_AIS, f'SELECT src_ord, CRAFT_ID, TRACK_ID, "TIMESTAMP", {_SIX("LON", "LAT", "COURSE_SIN", "COURSE_COS")} FROM ais WHERE src_ord % 10 <> 0'),
    "hour_round_even": _with(_AIS, "SELECT event_id, at_h AS HOUR, CASE WHEN hour(ts) % 2 = 0 THEN h0 ELSE h0 + INTERVAL 1 HOUR END AS HOUR_OF_HALF FROM e"),
    "dedup_keep_first": _with(_FIRST, 'SELECT TRACK_ID, "TIMESTAMP", src_ord, round(LON, 6) AS LON FROM f'),
    "course_sincos": _with(_AIS, f"SELECT src_ord, {_SIX('COURSE_SIN', 'COURSE_COS')} FROM ais"),
    "hourly_interpolate": _with(
        _FIRST
        + """,
o AS (SELECT *, lead("TIMESTAMP") OVER w AS nt, lead(LON) OVER w AS nlon, lead(LAT) OVER w AS nlat, lead(SPEED) OVER w AS nsp, lead(COURSE) OVER w AS nco,
  lead(COURSE_SIN) OVER w AS nsi FROM f WINDOW w AS (PARTITION BY TRACK_ID ORDER BY "TIMESTAMP")),
o2 AS (SELECT *, coalesce(date_diff('hour', "TIMESTAMP", nt), 1) AS gap FROM o),
o3 AS (SELECT *, unnest(range(0, gap)) AS k FROM o2),
o4 AS (SELECT *, count(*) OVER (PARTITION BY TRACK_ID) AS n FROM o3)""",
        """
SELECT TRACK_ID, "TIMESTAMP" + to_hours(CAST(k AS INTEGER)) AS "TIMESTAMP", CRAFT_ID,
  """
        + ", ".join(f"round(CASE WHEN k = 0 THEN {c} ELSE {c} + ({n} - {c}) * (k / gap) END + 3e-8, 6) AS {c}" for c, n in (("LON", "nlon"), ("LAT", "nlat"), ("SPEED", "nsp"), ("COURSE", "nco"), ("COURSE_SIN", "nsi")))
        + " FROM o4 WHERE n >= 10",
    ),
    "short_track_antijoin": _with(_AIS, "SELECT TRACK_ID, src_ord FROM ais ANTI JOIN (SELECT TRACK_ID FROM ais GROUP BY 1 HAVING count(*) < 66) x USING (TRACK_ID)"),
    "route_slice": _with(_ROUTES, f'SELECT ROUTE_ID, ROUTE_POINT_IDX, "TIMESTAMP", CRAFT_ID, TRACK_ID, {_SIX("LON", "LAT", "SPEED")} FROM r'),
    "route_validate": _with(_ROUTES, "SELECT ROUTE_ID, count(*) AS points, true AS in_time FROM r WHERE NOT (SEG = 1 AND ROUTE_POINT_IDX = 5) GROUP BY ROUTE_ID HAVING count(*) <> 12"),
    "route_stats": _with(_STATS, f"SELECT ROUTE_ID, {_SIX('avg_sog', 'avg_dcog', 'avg_dsog')}, vessel_type FROM s"),
    "stratum_bins": _with(
        _STRATA,
        "SELECT feature, CAST(place AS INTEGER) AS place, round(edge, 6) AS edge FROM ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, unnest(range(0, len({e}))) AS place, unnest({e}) AS edge FROM b" for f, e in (("avg_sog", "e1"), ("avg_dcog", "e2"), ("avg_dsog", "e3")))
        + ")",
    ),
    "stratum_sample": _with(
        _STRATA + ", v AS (SELECT *, count(*) OVER (PARTITION BY stratum_key) AS nn, row_number() OVER (PARTITION BY stratum_key ORDER BY ROUTE_ID) AS rk FROM z)",
        f"SELECT ROUTE_ID, stratum_key, {_FLAGS} FROM v",
    ),
    "stratum_labels": _with(
        _STRATA,
        f"SELECT ROUTE_ID, vessel_type || '|sog=' || {_LABEL('e1', 'b1')} || '|dcog=' || {_LABEL('e2', 'b2')} || '|dsog=' || {_LABEL('e3', 'b3')} AS stratum, "
        "CAST(b1 AS INTEGER) AS avg_sog_bin, CAST(b2 AS INTEGER) AS avg_dcog_bin, CAST(b3 AS INTEGER) AS avg_dsog_bin FROM z, b",
    ),
    "k_round_robin": _with(_STRATA, "SELECT ROUTE_ID, CAST([3, 6, 9][(row_number() OVER (PARTITION BY stratum_key ORDER BY ROUTE_ID) - 1) % 3 + 1] AS INTEGER) AS K FROM z"),
    "prompt_stats": _with(
        _STATS
        + """,
c AS (SELECT *, coalesce(SPEED - lag(SPEED) OVER w, 0) AS vs, coalesce(cog - lag(cog) OVER w, 0) AS vc0 FROM g WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
c2 AS (SELECT *, CASE WHEN vc0 > 180 THEN vc0 - 360 WHEN vc0 < -180 THEN vc0 + 360 ELSE vc0 END AS vc FROM c)""",
        "SELECT ROUTE_ID, round(avg(SPEED), 6) AS avg_sog, round(stddev_samp(SPEED), 6) AS std_sog, round(avg(cog), 6) AS avg_cog, round(stddev_samp(cog), 6) AS std_cog, "
        "round(max(abs(vs)), 6) AS most_d_sog, round(max(abs(vc)), 6) AS most_d_cog FROM c2 GROUP BY ROUTE_ID",
    ),
    "json_extract": r"SELECT event_id, regexp_extract('Answer: ' || props || ' done', '(?s)\{.*\}', 0) AS span, json_type(props) = 'OBJECT' AS is_object FROM events",
    "score_topk": _with(
        _SCORED,
        f"SELECT ROUTE_ID, ROUTE_POINT_IDX, row_number() OVER (PARTITION BY ROUTE_ID ORDER BY score DESC, ROUTE_POINT_IDX DESC) <= K AS chosen, round({_NORM}, 6) AS norm FROM p WINDOW q AS (PARTITION BY ROUTE_ID)",
    ),
    "a2_window": _with(
        _SCORED + ", o AS (SELECT ROUTE_ID, K, arg_max(ROUTE_POINT_IDX, (score, -ROUTE_POINT_IDX)) AS best FROM p GROUP BY ROUTE_ID, K)",
        "SELECT ROUTE_ID, CAST(greatest(0, least(best - (K - 1) // 2, 12 - K)) AS INTEGER) AS start, K AS k FROM o",
    ),
    "score_array_stats": _with(_SCORED, "SELECT ROUTE_ID, round(min(score), 6) AS low, round(max(score), 6) AS high, CAST(count(*) FILTER (abs(score) < 1e-12) AS INTEGER) AS zeros FROM p GROUP BY ROUTE_ID"),
    "a3_risk_window": _with(_ANCHOR, "SELECT ROUTE_ID, min(ta) AS ta, min(s0) AS s0, min(s1) AS s1 FROM an GROUP BY ROUTE_ID"),
    "geo_haversine": _with(_ROUTES + _NEAR.format(of="r"), f"SELECT ROUTE_ID, ROUTE_POINT_IDX, round({_dist('px', 'py', 'LON', 'LAT')}, 6) AS metres FROM l"),
    "geo_bearing": _with(_ROUTES + _NEAR.format(of="r"), f"SELECT ROUTE_ID, ROUTE_POINT_IDX, round({_bear('px', 'py', 'LON', 'LAT')}, 6) AS degrees FROM l"),
    "geo_destination": _with(
        _STATS + ", o AS (SELECT *, SPEED * 0.514444e0 * 3600e0 AS m FROM g)",
        f"SELECT ROUTE_ID, ROUTE_POINT_IDX, round({_lon('LON', 'LAT', 'cog', 'm')}, 6) AS to_lon, round({_lat('LAT', 'cog', 'm')}, 6) AS to_lat FROM o",
    ),
    "geo_xtrack": _with(
        _ROUTES + _NEAR.format(of="r"),
        f"SELECT ROUTE_ID, ROUTE_POINT_IDX, round({_cross('px', 'py', 'nx', 'ny', 'LON', 'LAT')}, 6) AS metres, round(({_bear('px', 'py', 'nx', 'ny')} + 270e0) % 360e0, 6) AS across FROM l",
    ),
    "sed_local": _with(_A1, "SELECT ROUTE_ID, round(sed, 6) AS sed_local FROM sd"),
    "accel_local": _with(
        _ROUTES
        + f""",
v AS (SELECT *, lag(LON) OVER w AS a, lag(LAT) OVER w AS b FROM r WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
v2 AS (SELECT *, {_dist('a', 'b', 'LON', 'LAT')} / 3600e0 AS v FROM v),
v3 AS (SELECT *, abs(v - lag(v) OVER w) / 3600e0 AS c FROM v2 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX))""",
        "SELECT ROUTE_ID, round(coalesce(avg(c), 0) * 1e6, 6) AS accel_local FROM v3 GROUP BY ROUTE_ID",
    ),
    "turn_local": _with(
        _ROUTES
        + """,
w1 AS (SELECT *, degrees(atan2(COURSE_SIN, COURSE_COS)) AS hd FROM r),
w2 AS (SELECT *, hd - lag(hd) OVER w AS t FROM w1 WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX))""",
        "SELECT ROUTE_ID, round(coalesce(avg(abs(CASE WHEN t > 180 THEN t - 360 WHEN t < -180 THEN t + 360 ELSE t END)), 0), 6) AS turn_local FROM w2 GROUP BY ROUTE_ID",
    ),
    "track_lag_lead": _with(_ROUTES + _NEAR.format(of="r"), "SELECT ROUTE_ID, ROUTE_POINT_IDX, round(px, 6) AS PREV_LON, round(nx, 6) AS NEXT_LON FROM l"),
    "inject_a1": _with(_A1, "SELECT ROUTE_ID, ROUTE_POINT_IDX, ROUTE_POINT_IDX AS T_INDEX, coalesce(ANOMALY, false) AS ANOMALY, ANOMALY_TYPE, round(to_x, 6) AS LON, round(to_y, 6) AS LAT FROM a1"),
    "inject_a3": _with(
        _A3,
        "SELECT 'A3_' || ROUTE_ID AS ROUTE_ID, ROUTE_POINT_IDX, ROUTE_POINT_IDX AS T_INDEX, ins AS ANOMALY, CASE WHEN ins THEN 'A3' ELSE '' END AS ANOMALY_TYPE, "
        "round(degrees(radians(lon0) + x / (6371000e0 * cos(radians(lat0)))), 6) AS LON, round(degrees(radians(lat0) + y / 6371000e0), 6) AS LAT, "
        "round(sqrt(dx * dx + dy * dy) / 3600e0 / 0.514444e0, 6) AS SPEED, round(sin(atan2(dx, dy)), 6) AS COURSE_SIN, round(cos(atan2(dx, dy)), 6) AS COURSE_COS FROM a3",
    ),
    "plan_join_a2_wins": _with(
        _SCORED,
        "SELECT DISTINCT ROUTE_ID, CASE WHEN (CRAFT_ID + SEG) % 3 = 0 THEN 'A2' WHEN CRAFT_ID % 2 = 0 THEN 'A1' END AS anomaly_type, "
        "CASE WHEN (CRAFT_ID + SEG) % 3 = 0 OR CRAFT_ID % 2 = 0 THEN K END AS K FROM p",
    ),
    "complete_routes": _with(
        _ROUTES,
        "SELECT ROUTE_ID, count(*) AS points, count(DISTINCT ROUTE_POINT_IDX) AS distinct_points, min(ROUTE_POINT_IDX) AS first_point, max(ROUTE_POINT_IDX) AS last_point "
        "FROM r WHERE NOT (SEG = 1 AND ROUTE_POINT_IDX = 11) GROUP BY ROUTE_ID HAVING count(*) = 12 AND count(DISTINCT ROUTE_POINT_IDX) = 12 AND min(ROUTE_POINT_IDX) = 0 AND max(ROUTE_POINT_IDX) = 11",
    ),
    "dataset_labels": _with(_LABELLED, "SELECT ROUTE_ID, CAST(sum(y) AS BIGINT) AS n_anomalous FROM y GROUP BY ROUTE_ID"),
    "dataset_features": _with(
        _LABELLED,
        "SELECT ROUTE_ID AS route_id, CAST(ROUTE_POINT_IDX * 5 + o AS INTEGER) AS place, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 3) AS value "
        "FROM (SELECT ROUTE_ID, ROUTE_POINT_IDX, unnest([0, 1, 2, 3, 4]) AS o, unnest([SPEED, COURSE_SIN, COURSE_COS, to_x, to_y]) AS v FROM y)",
    ),
    "dataset_split": _with(
        _LABELLED
        + """,
x1 AS (SELECT ROUTE_ID AS route_id, CAST(sum(y) AS INTEGER) AS n_anomalous FROM y GROUP BY ROUTE_ID),
x2 AS (SELECT *, count(*) OVER (PARTITION BY n_anomalous) AS nn, row_number() OVER (PARTITION BY n_anomalous ORDER BY route_id) AS rk FROM x1),
x3 AS (SELECT *, round_even(nn * 0.7e0, 0) AS tr, round_even(nn * 0.15e0, 0) AS va FROM x2)""",
        "SELECT route_id, n_anomalous, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + least(va, nn - tr) THEN 'valid' ELSE 'test' END AS split FROM x3",
    ),
    "indices_by_mode": _with(
        _INDEX,
        f"SELECT ROUTE_ID, 12 AS T, vessel_type || '|sog=' || {_LABEL('e1', 'b1')} || '|dcog=' || {_LABEL('e2', 'b2')} || '|dsog=' || {_LABEL('e3', 'b3')} AS stratum, {_FLAGS}, "
        "CAST(CASE WHEN mode <> 'a3' THEN [3, 6, 9][(rk7 - 1) % 3 + 1] END AS INTEGER) AS K, mode FROM i1, b, (SELECT unnest(['a1', 'a2', 'a3']) AS mode)",
    ),
    "inject_union_label": _with(
        _TOUCHED, "SELECT ROUTE_ID, ANOMALY_TYPE, count(*) AS points, count(*) FILTER (ANOMALY_TYPE <> '') AS anomalous FROM u7 GROUP BY ALL"
    ),
    "inject_counters": _with(
        _TOUCHED,
        "SELECT count(DISTINCT ROUTE_ID) FILTER (host) AS routes_total, count(DISTINCT ROUTE_ID) FILTER (host AND ANOMALY_TYPE = 'A1') AS a1_routes, "
        "count(DISTINCT ROUTE_ID) FILTER (host AND ANOMALY_TYPE = 'A2') AS a2_routes, count(DISTINCT ROUTE_ID) FILTER (NOT host) AS a3_routes, count(*) AS rows, "
        "count(*) FILTER (ANOMALY_TYPE <> '') AS anomalous_rows FROM (SELECT *, NOT starts_with(ROUTE_ID, 'A3_') AS host FROM u7)",
    ),
    "dataset_grid": _with(
        _TOUCHED
        + _INDEX[len(_ROUTES) :]
        + f""",
d1 AS (SELECT ROUTE_ID, mode, pct, take FROM (
    SELECT ROUTE_ID, unnest([10, 5, 3, 1]) AS pct, unnest([{", ".join(f"rk <= greatest(1, floor(nn * {p} / 100e0))" for p in (10, 5, 3, 1))}]) AS take FROM i1), (SELECT unnest(['a1', 'a2', 'a3']) AS mode)),
d2 AS (SELECT ROUTE_ID, mode, pct, take FROM d1 UNION ALL SELECT 'A3_' || ROUTE_ID, mode, pct, take FROM d1 WHERE mode = 'a3'),
d3 AS (
  SELECT u7.ROUTE_ID AS route_id, mode, pct, CAST(count(*) FILTER (take AND ANOMALY_TYPE = upper(mode)) AS INTEGER) AS n_anomalous
  FROM u7 JOIN d2 ON u7.ROUTE_ID = d2.ROUTE_ID GROUP BY ALL),
d4 AS (SELECT *, unnest([2, 12, 32, 42, 52]) AS seed FROM d3),
d5 AS (
  SELECT *, count(*) OVER q AS n, row_number() OVER (q ORDER BY {_DRAW("route_id || ':' || seed")}, route_id) AS r
  FROM d4 WINDOW q AS (PARTITION BY mode, pct, seed, n_anomalous)),
d6 AS (SELECT *, round_even(n * 0.7e0, 0) AS tr, round_even(n * 0.15e0, 0) AS va FROM d5)""",
        "SELECT route_id, mode, CAST(pct AS INTEGER) AS pct, CAST(seed AS INTEGER) AS seed, n_anomalous, "
        "CASE WHEN r <= tr THEN 'train' WHEN r <= tr + least(va, n - tr) THEN 'valid' ELSE 'test' END AS split FROM d6",
    ),
    "prompt_name_parse": r"""
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS kind, CAST(event_id AS VARCHAR) AS n, 'A' || (event_id % 4) AS a FROM events),
s AS (
  SELECT event_id, ['route_' || u || '_' || kind || '-' || n || '_' || a, kind || '_' || a || '-b', a, 'x' || a || kind, kind || n,
    'route_a_' || u || '-3_' || a || '_20240101-000000-000001'][event_id % 6 + 1] AS stem FROM e)
SELECT event_id, stem, coalesce(nullif(regexp_extract(stem, '(^|[_-])(A[123])($|[_-])', 2), ''), nullif(regexp_extract(stem, '(A[123])', 1), '')) AS any_type,
  nullif(regexp_extract(stem, '^route_(.+)_(A[123])($|[_-])', 1), '') AS route, nullif(regexp_extract(stem, '^route_(.+)_(A[123])($|[_-])', 2), '') AS plan_type
FROM s
""",
    "score_validate": """
SELECT event_id AS id, [NULL, NULL, 'no JSON object', 'no JSON object', 'wrong keys', 'T is not an integer', 'T is not positive', 'T is not the expected one',
    'unknown anomaly_type', 'anomaly_type is not the expected one', 'K is not an integer', 'K is not a quarter, half or three quarters of T', 'scores is not a list',
    'scores has another length than T', 'a score is not a number', 'a score is outside 0 to 1', 'scores are all the same', 'too many scores are zero'][event_id % 18 + 1] AS reason,
  CAST(CASE WHEN event_id % 18 = 0 THEN 1 END AS INTEGER) AS K
FROM events
""",
    "review_answers": _with(_REVIEW, "SELECT source_name, status, query_path, query_T FROM w"),
    "review_fix": _with(
        _REVIEW,
        "SELECT source_name, 'A1' AS anomaly_type, CAST(event_id % 3 AS INTEGER) AS K, query_T AS T, 'K = ' || (event_id % 3) || ' hours' AS prompt FROM w WHERE status = 'bad'",
    ),
    "review_counts": _with(
        _REVIEW,
        "SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS bad, count(*) FILTER (status = 'missing') AS missing, CAST(0 AS BIGINT) AS fixed FROM w",
    ),
    "answers_latest_valid": """
SELECT 'route_' || user_id || '_A1' AS source_name, event_id FROM events WHERE event_id % 18 = 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts + to_microseconds(event_id) DESC) = 1
""",
    "draws": _with(
        _ROUTES,
        f"SELECT ROUTE_ID, ROUTE_POINT_IDX, CASE WHEN {_DRAW("ROUTE_ID || ':' || ROUTE_POINT_IDX || ':3'")} % 2 = 0 THEN 1 ELSE -1 END AS side, "
        f"CASE WHEN {_DRAW("ROUTE_ID || ':3'")} % 2 = 0 THEN 1 ELSE -1 END AS sign, round(0.9e0 + 0.2e0 * ({_DRAW("ROUTE_ID || ':scale:3'")} / 1152921504606846976e0), 6) AS scale, "
        f"{_DRAW("ROUTE_ID || ':side:3'")} / 1152921504606846976e0 < 0.5 AS \"left\" FROM r",
    ),
    "allowed_a3": _with(
        _INDEX, "SELECT unnest([ROUTE_ID, 'A3_' || ROUTE_ID]) AS ROUTE_ID FROM i1 WHERE rk <= greatest(1, floor(nn * 5 / 100e0))"
    ),
    "tier_counts": _with(
        _INDEX + f", t AS (SELECT {_FLAGS} FROM i1)",
        "SELECT mode, " + ", ".join(f"count(*) FILTER (use_{p}pct) AS n_{p}pct" for p in (10, 5, 3, 1)) + " FROM t, (SELECT unnest(['a1', 'a2', 'a3']) AS mode) GROUP BY mode",
    ),
    "prompt_text": _with(
        _INDEX
        + """,
c AS (
  SELECT *, coalesce(SPEED - lag(SPEED) OVER w, 0) AS vs, coalesce(cog - lag(cog) OVER w, 0) AS vc0 FROM g
  WINDOW w AS (PARTITION BY ROUTE_ID ORDER BY ROUTE_POINT_IDX)),
c2 AS (SELECT *, CASE WHEN vc0 > 180 THEN vc0 - 360 WHEN vc0 < -180 THEN vc0 + 360 ELSE vc0 END AS vc FROM c),
c3 AS (
  SELECT ROUTE_ID, printf('%.3f', avg(SPEED)) AS a, printf('%.3f', stddev_samp(SPEED)) AS b, printf('%.3f', avg(cog)) AS c, printf('%.3f', stddev_samp(cog)) AS d,
    string_agg(printf(E't=%d: [\n  Lat: %.6f, Lon: %.6f,\n  SOG: %.3f, COG: %.1f,\n  ΔSOG: %+.3f, ΔCOG: %+.1f\n]', ROUTE_POINT_IDX + 1, LAT, LON, SPEED, cog, vs, vc),
      E'\n\n' ORDER BY ROUTE_POINT_IDX) AS points
  FROM c2 GROUP BY ROUTE_ID),
x AS (
  SELECT ROUTE_ID, upper(mode) AS anomaly_type, CAST(CASE WHEN mode <> 'a3' THEN [3, 6, 9][(rk7 - 1) % 3 + 1] END AS INTEGER) AS K
  FROM i1, (SELECT unnest(['a1', 'a2', 'a3']) AS mode) WHERE rk <= greatest(1, floor(nn * 10 / 100e0)))""",
        r"""SELECT ROUTE_ID, anomaly_type, K, 12 AS T,
  E'[Input Trajectory Segment]\n\n- **Metadata:** { "VesselType": "Cargo", "Duration": "12 hours" }\n- **Statistics:** { "Avg_SOG": ' || a || ' knots, "Std_SOG": ' || b
  || ', "Avg_COG": ' || c || ', "Std_COG": ' || d || ' }' || coalesce(E'\n- **Anomaly Config:** K = ' || K, '') || E'\n- **Time Series (T=12h)**\n\n' || points AS prompt
FROM x JOIN c3 USING (ROUTE_ID)""",
    ),
    "inject_a2": _A2,
}
