"""Queries on places and routes: GEO, FLT-05 to 08 and 10, JN-11, JN-12, SRT-07 to 11, SNK-03."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waystone.functions import geo as G
from waystone.operators import search as S
from waystone.operators import tracks as K
from waystone.plans.columns import AS_OF
from waystone.plans.feeds import _LIVE
from waystone.plans.registry import query


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bear(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def plane(a: str, b: str, c: str, d: str) -> str:
    return f"((degrees(atan2(({d} - {b}) * {G.KM_PER_DEGREE!r} * cos(radians(({a} + {c}) / 2)), ({c} - {a}) * {G.KM_PER_DEGREE!r})) + 360) % 360)"


def diff(a: str, b: str) -> str:
    return f"abs(({a} - {b} + 540) % 360 - 180)"


def unit(*x: str) -> str:
    return f"(('0x' || substring(md5(concat_ws('|', {', '.join(x)})), 1, 8))::BIGINT / 4294967296.0)"


_D = hav("r.lat", "r.lng", "s.lat", "s.lng")
_B = bear("r.lat", "r.lng", "s.lat", "s.lng")
_PAIRS = f"SELECT r.request_id, r.km, r.tol, r.bearing, r.lat AS rlat, r.lng AS rlng, s.id, s.name, s.lat, s.lng, {_D} AS distance FROM requests r, stations s"

#: GEO-01 and GEO-02: every station around each request.
_AROUND = 100.0
query("GEO-01", f"SELECT request_id, id, round({_D}, 6) AS km FROM requests r JOIN stations s ON abs(r.lat - s.lat) < 1 AND {_D} <= {_AROUND}")(
    lambda v: S.within(v.requests, v.stations, F.lit(_AROUND)).select(F.col("req_request_id").alias("request_id"), "id", F.round("distance", 6).alias("km"))
)
_H = f"((degrees(atan2((s.lng - r.lng) * {G.KM_PER_DEGREE!r} * cos(radians((r.lat + s.lat) / 2)), (s.lat - r.lat) * {G.KM_PER_DEGREE!r})) + 360) % 360)"
query("GEO-02", f"SELECT request_id, id, round({_B}, 6) AS bearing_deg, round({_H}, 6) AS heading_deg FROM requests r JOIN stations s ON abs(r.lat - s.lat) < 1 AND {_D} <= {_AROUND}")(
    lambda v: S.spread(
        S.within(S.by_position(v.requests, "request_id", "lat", "lng"), S.by_position(v.stations, "id", "lat", "lng"), F.lit(_AROUND)).select(
            F.col("req_request_ids").alias("request_ids"), "ids", *[F.round(f(F.col("req_lat"), F.col("req_lng"), F.col("lat"), F.col("lng")), 6).alias(n) for f, n in ((G.bearing, "bearing_deg"), (G.heading, "heading_deg"))]
        ),
        "id",
        "request_id",
    )
)
query("GEO-03", f"SELECT id, round({diff('lng * 7 % 360', 'lat * 11')}, 6) AS angle, CAST(floor(lng * 7 % 360 / 45 + 0.5) % 8 AS INT) AS c8, CAST(floor(lng * 7 % 360 / 22.5 + 0.5) % 16 AS INT) AS c16 FROM stations")(
    lambda v: v.stations.select("id", F.round(G.difference(F.col("lng") * 7 % 360, F.col("lat") * 11), 6).alias("angle"), G.compass(F.col("lng") * 7 % 360).alias("c8"), G.compass(F.col("lng") * 7 % 360, 16).alias("c16"))
)
_KM = repr(G.KM_PER_DEGREE)
query("GEO-04", f"SELECT id, round((lng - 135) * {_KM} * cos(radians((35 + lat) / 2)), 6) AS east, round((lat - 35) * {_KM}, 6) AS north FROM stations")(
    lambda v: v.stations.select("id", *[F.round(c, 6).alias(n) for c, n in zip(G.offset(F.lit(35), F.lit(135), F.col("lat"), F.col("lng")), ("east", "north"), strict=True)])
)
_GLAT = "degrees(asin(sin(radians(lat)) * cos(km / 6371.0) + cos(radians(lat)) * sin(km / 6371.0) * cos(radians(bearing))))"
_GLNG = "((lng + degrees(atan2(sin(radians(bearing)) * sin(km / 6371.0) * cos(radians(lat)), cos(km / 6371.0) - sin(radians(lat)) * (sin(radians(lat)) * cos(km / 6371.0) + cos(radians(lat)) * sin(km / 6371.0) * cos(radians(bearing))))) + 540) % 360 - 180)"
query("GEO-05", f"SELECT request_id, round({_GLAT}, 6) AS goal_lat, round({_GLNG}, 6) AS goal_lng FROM requests")(lambda v: S.with_goal(v.requests).select("request_id", F.round("goal_lat", 6).alias("goal_lat"), F.round("goal_lng", 6).alias("goal_lng")))
query("GEO-06", "SELECT id, round(t, 6) AS t, round(sqrt(power(lng - 125 - t * 18, 2) + power(lat - 26 - t * 14, 2)), 6) AS away FROM (SELECT id, lat, lng, greatest(0.0, least(1.0, ((lng - 125) * 18 + (lat - 26) * 14) / (18 * 18 + 14 * 14))) AS t FROM stations)")(
    lambda v: v.stations.select("id", *[F.round(c, 6).alias(n) for c, n in zip(G.segment(F.col("lng"), F.col("lat"), F.lit(125.0), F.lit(26.0), F.lit(143.0), F.lit(40.0)), ("t", "away"), strict=True)])
)
_TRACK = "SELECT user_id, event_id, rn, lat, lng, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM (SELECT user_id, visit_id AS event_id, lat, lng, row_number() OVER (PARTITION BY user_id ORDER BY ts, visit_id) AS rn FROM visits) WINDOW w AS (PARTITION BY user_id ORDER BY rn)"
_SEGS = f"SELECT user_id, rn, lat, lng, lat2, lng2, sqrt(power(lat2 - lat, 2) + power(lng2 - lng, 2)) AS len FROM ({_TRACK}) WHERE lat2 IS NOT NULL"


def _segments(v):
    # few bytes, much work: a number of partitions that is named is not merged
    return K.segments(v.visits.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "user_id"), "user_id", "ts", "visit_id")


def _progress(v):
    return K.progress(_segments(v), "user_id", F.lit(35.0), F.lit(135.0)).select("user_id", F.round("progress", 6).alias("progress"))


_S7 = f"SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, sum(len) OVER (PARTITION BY user_id) AS total FROM ({_SEGS})"
_T7 = "((135.0 - lng) * (lng2 - lng) + (35.0 - lat) * (lat2 - lat)) / greatest(len * len, 1e-12)"
query(
    "GEO-07",
    f"WITH s AS ({_S7}), t AS (SELECT *, {_T7} AS raw, greatest(0.0, least(1.0, {_T7})) AS t FROM s), o AS (SELECT *, round(sqrt(power(135.0 - lng - t * (lng2 - lng), 2) + power(35.0 - lat - t * (lat2 - lat), 2)) + CASE WHEN raw BETWEEN 0 AND 1 THEN 0 ELSE 20 END, 9) AS off FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off, rn) AS k FROM o) SELECT user_id, round((before + t * len) / total, 6) AS progress FROM b WHERE k = 1",
)(_progress)
_P7 = "((p.lng - s.lng) * (lng2 - s.lng) + (p.lat - s.lat) * (lat2 - s.lat)) / greatest(len * len, 1e-12)"
_NEAR7 = f"""WITH s AS ({_S7}), t AS (SELECT s.*, p.id, p.lat AS plat, p.lng AS plng, {_P7} AS raw, greatest(0.0, least(1.0, {_P7})) AS t FROM s, stations p WHERE p.lat BETWEEN least(s.lat, lat2) - 0.1 AND greatest(s.lat, lat2) + 0.1 AND p.lng BETWEEN least(s.lng, lng2) - 0.1 AND greatest(s.lng, lng2) + 0.1),
a AS (SELECT *, sqrt(power(plng - lng - t * (lng2 - lng), 2) + power(plat - lat - t * (lat2 - lat), 2)) AS away FROM t), o AS (SELECT *, round(away + CASE WHEN raw BETWEEN 0 AND 1 THEN 0 ELSE 20 END, 9) AS off FROM a WHERE away <= 0.1), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY off, rn) AS k FROM o)"""
query("GEO-07-places", f"{_NEAR7} SELECT user_id, id, round((before + t * len) / total, 6) AS progress, round(away, 6) AS away FROM b WHERE k = 1")(
    # rounded before the places of a position become rows
    lambda v: K.positions_along(_segments(v), "user_id", v.stations, reach=0.1).select("user_id", "ids", F.round("progress", 6).alias("progress"), F.round("away", 6).alias("away")).select("user_id", F.explode("ids").alias("id"), "progress", "away")
)
# detours are the stations near a track, stops are its own points
query(
    "GEO-08",
    f"{_NEAR7}, d AS (SELECT user_id, concat('d', id) AS place, round((before + t * len) / total, 9) AS progress, id AS ord, 0 AS original FROM b WHERE k = 1), own AS (SELECT user_id, concat('o', rn), round(before / total, 9), rn, 1 FROM s) SELECT user_id, string_agg(place, ',' ORDER BY progress, original, ord) AS stops FROM (SELECT * FROM own UNION ALL SELECT * FROM d) x(user_id, place, progress, ord, original) GROUP BY user_id",
)(lambda v: K.stops_along(_segments(v), "user_id", v.stations, reach=0.1))


query(
    "GEO-09",
    f"WITH s AS ({_S7}), p AS (SELECT *, (user_id % 10) / 10.0 * total AS want FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS n FROM p WHERE before + len >= want) SELECT user_id, round(lat + (want - before) / greatest(len, 1e-12) * (lat2 - lat), 6) AS at_lat, round(lng + (want - before) / greatest(len, 1e-12) * (lng2 - lng), 6) AS at_lng FROM k WHERE n = 1",
)(lambda v: _along(v))


def _along(v):
    at = K.points_at(_segments(v), "user_id", F.col("user_id") % 10 / 10)
    return at.select("user_id", F.round("at_lat", 6).alias("at_lat"), F.round("at_lng", 6).alias("at_lng"))


_GX, _GY = f"(glng - rlng) * {_KM} * cos(radians((rlat + glat) / 2))", f"(glat - rlat) * {_KM}"
_PX, _PY = f"(lng - rlng) * {_KM} * cos(radians((rlat + lat) / 2))", f"(lat - rlat) * {_KM}"
_COR = f"""SELECT request_id, id, lat, lng, along, direct, rlat, rlng, glat, glng FROM (SELECT *, (px * gx + py * gy) / d AS along, abs(px * gy - py * gx) / d AS side FROM (SELECT *, sqrt(gx * gx + gy * gy) AS d FROM (SELECT *, {_GX} AS gx, {_GY} AS gy, {_PX} AS px, {_PY} AS py,
 {hav('rlat', 'rlng', 'glat', 'glng')} AS direct, {diff(plane('rlat', 'rlng', 'lat', 'lng'), plane('rlat', 'rlng', 'glat', 'glng'))} AS ang FROM (SELECT r.request_id, r.lat AS rlat, r.lng AS rlng, r.glat, r.glng, s.id, s.lat, s.lng FROM (SELECT *, {_GLAT} AS glat, {_GLNG} AS glng FROM requests) r, stations s))))
 WHERE along > greatest(1.0, 0.04 * d) AND along < d - greatest(1.0, 0.04 * d) AND side <= least(35.0, greatest(6.0, 0.2 * direct)) AND side <= 2 + 0.85 * least(along, d - along) AND ang <= 45"""
query("GEO-10", f"SELECT request_id, id, round(along, 6) AS along FROM ({_COR})")(lambda v: S.corridor(S.with_goal(v.requests), v.stations).select(F.col("req_request_id").alias("request_id"), "id", F.round("along", 6).alias("along")))
query("GEO-11", f"WITH p AS (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY id) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM ({_PAIRS}) WHERE distance BETWEEN greatest(0.0, km - greatest(10.0, km * 0.12)) AND km + greatest(10.0, km * 0.12)) SELECT request_id, id, n FROM p WHERE rn = floor({unit('CAST(request_id AS VARCHAR)', chr(39) + '1' + chr(39))} * n) + 1")(
    lambda v: S.drawn_goals(v.requests, v.stations).withColumnRenamed("req_request_id", "request_id")
)
def _routes(v, stops):
    return S.routes(S.with_goal(v.requests), v.stations, stops).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


query("GEO-12")(lambda v: _routes(v, 5))
# the same with at most two stops, which SQL can enumerate
_AB, _A0, _AG, _BG = hav("a.lat", "a.lng", "b.lat", "b.lng"), hav("a.rlat", "a.rlng", "a.lat", "a.lng"), hav("a.lat", "a.lng", "a.glat", "a.glng"), hav("b.lat", "b.lng", "b.glat", "b.glng")
_PEN = "0.25 * a.direct * abs({0}.along / a.direct - {1})"
query(
    "GEO-12-two",
    f"""WITH c AS (SELECT request_id, id, lat, lng, round(along, 9) AS along, direct, rlat, rlng, glat, glng FROM ({_COR})),
two AS (SELECT a.request_id, 2 AS stops, concat(a.id, ',', b.id) AS path, {_A0} + {_AB} + {_BG} AS length, {_A0} + {_PEN.format('a', '1 / 3.0')} + {_AB} + {_PEN.format('b', '2 / 3.0')} + {_BG} AS score, a.direct
  FROM c a JOIN c b ON a.request_id = b.request_id AND b.along - a.along >= greatest(1.0, 0.025 * a.direct) AND {_A0} <= 1.3 * a.direct AND {_A0} + {_AB} <= 1.3 * a.direct),
one AS (SELECT a.request_id, 1 AS stops, CAST(a.id AS VARCHAR) AS path, {_A0} + {_AG} AS length, {_A0} + {_PEN.format('a', '0.5')} + {_AG} AS score, a.direct FROM c a WHERE {_A0} <= 1.3 * a.direct),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stops DESC, score) AS k FROM (SELECT * FROM two UNION ALL SELECT * FROM one) WHERE length <= 1.3 * direct + 1e-6)
SELECT request_id, CAST(coalesce(stops, 0) AS INT) AS stops, round(coalesce(score, d), 6) AS score, coalesce(path, '') AS path, round(coalesce(length, d), 6) AS length
FROM (SELECT request_id, {hav('lat', 'lng', 'glat', 'glng')} AS d FROM (SELECT *, {_GLAT} AS glat, {_GLNG} AS glng FROM requests)) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (request_id)""",
)(lambda v: _routes(v, 2))

query("FLT-05", f"SELECT request_id, id, round(distance, 6) AS distance FROM ({_PAIRS}) WHERE distance BETWEEN greatest(0.0, km - tol) AND km + tol")(
    lambda v: S.spread(
        S.annulus(S.by_position(v.requests, "request_id", "lat", "lng", "km", "tol"), S.by_position(v.stations, "id", "lat", "lng")).select(F.col("req_request_ids").alias("request_ids"), "ids", F.round("distance", 6).alias("distance")),
        "id",
        "request_id",
    )
)
_SECT = f"SELECT *, {diff(bear('rlat', 'rlng', 'lat', 'lng'), 'bearing')} AS angle FROM ({_PAIRS})"
query("FLT-06", f"SELECT request_id, id, round(angle, 6) AS angle FROM ({_SECT}) WHERE distance BETWEEN greatest(0.0, km - tol) AND km + tol AND angle <= 33.75")(
    lambda v: S.in_sector(S.annulus(v.requests, v.stations), 33.75).select(F.col("req_request_id").alias("request_id"), "id", F.round("angle", 6).alias("angle"))
)
query("FLT-07", "SELECT request_id, CAST(CASE CAST(km AS INT) WHEN 30 THEN 8 WHEN 50 THEN 10 WHEN 100 THEN 15 WHEN 200 THEN 30 ELSE greatest(5, CAST(round(km * 0.15) AS INT)) END AS INT) AS tolerance FROM requests")(lambda v: v.requests.select("request_id", S.tolerance(F.col("km")).alias("tolerance")))
query("FLT-08", "SELECT id FROM landmarks WHERE lat BETWEEN 24 AND 40 AND level = 'A' AND category NOT LIKE 'PROMO%'")(lambda v: v.landmarks.filter(F.col("lat").between(24, 40) & (F.col("level") == "A") & ~F.col("category").startswith("PROMO")).select("id"))
query("FLT-10", "SELECT id FROM stations WHERE prefecture = 'NATION_3' AND category = 'BUILDING' AND contains(name, '7')")(lambda v: v.stations.filter((F.col("prefecture") == "NATION_3") & (F.col("category") == "BUILDING") & F.contains(F.col("name"), F.lit("7"))).select("id"))
query("SRT-07", f"SELECT request_id AS req_request_id, id, round(distance, 6) AS distance, round(abs(distance - km), 6) AS off FROM ({_SECT}) WHERE distance BETWEEN greatest(0.0, km - tol) AND km + tol AND angle <= 33.75 AND name IN (SELECT road_name FROM events_pub WHERE {_LIVE})")(
    lambda v: S.goal_candidates(v.requests, v.stations, v.events_pub, AS_OF)
)
query(
    "SRT-08",
    f"WITH p AS (SELECT request_id, id, round(abs(distance - km) + angle / 10 + {unit('CAST(request_id AS VARCHAR)', 'CAST(id AS VARCHAR)', chr(39) + '1' + chr(39))} * 4, 6) AS score FROM ({_SECT}) WHERE distance BETWEEN greatest(0.0, km - tol) AND km + tol AND angle <= 45), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, id) AS rn FROM p), t AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM k WHERE rn <= 24) SELECT request_id AS req_request_id, id, score, n FROM t WHERE rn = floor({unit('CAST(request_id AS VARCHAR)', chr(39) + '1' + chr(39))} * n) + 1",
)(lambda v: S.scored_pick(v.requests, v.stations))
query(
    "SRT-09",
    f"WITH p AS (SELECT request_id, id, distance, abs(distance - km) <= 10 AS inside FROM ({_PAIRS}) WHERE distance <= km + 10), m AS (SELECT *, max(inside) OVER (PARTITION BY request_id) AS has FROM p) SELECT request_id AS req_request_id, id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(distance, 6), id) AS INT) AS rn FROM m WHERE inside OR NOT has",
)(lambda v: S.nearest_n(v.requests, v.stations, None, 10.0, None))
query("SRT-10", f"SELECT e.event_id, name, start_date, CAST(CASE WHEN start_date <= DATE '{AS_OF}' THEN 0 WHEN isodow(start_date) >= 6 AND start_date <= DATE '{AS_OF}' + CAST(7 - isodow(DATE '{AS_OF}') AS INT) THEN 1 ELSE 2 END AS INT) AS bucket FROM events_pub e JOIN stations s ON e.road_name = s.name WHERE {_LIVE}")(lambda v: _event_list(v))


def _event_list(v):
    from waystone.functions.dates import weekend_bucket
    from waystone.operators.coverage import live_at_station
    from waystone.operators.reconcile import live

    rows = live_at_station(v.stations, v.events_pub.filter(live(AS_OF)))
    return S.sorted_events(rows, "weekend", AS_OF).select("event_id", "name", "start_date", weekend_bucket(F.col("start_date"), F.lit(AS_OF).cast("date")).alias("bucket"))


_BUCK = f"WITH c AS ({_COR}), b AS (SELECT *, CAST(floor(along / direct * 3) AS INT) AS bucket FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY request_id, bucket ORDER BY abs(round(along / direct * 3 - bucket - 0.5, 6)), id) AS rn, least(10, count(*) OVER (PARTITION BY request_id, bucket)) AS n FROM b) SELECT request_id, bucket, id FROM k WHERE rn = floor({unit('CAST(request_id AS VARCHAR)', 'CAST(bucket AS VARCHAR)')} * n) + 1"
query("SRT-11", _BUCK)(lambda v: _bucketed(v))


def _bucketed(v):
    """SRT-11: progress in three buckets; one stop of each, drawn among the ten nearest to its middle."""
    c = S.corridor(S.with_goal(v.requests), v.stations).withColumn("p", F.col("along") / F.col("req_direct") * 3)
    c = c.withColumn("bucket", F.floor("p").cast("int")).withColumnRenamed("req_request_id", "request_id")
    w = Window.partitionBy("request_id", "bucket")
    k = c.withColumn("rn", F.row_number().over(w.orderBy(F.abs(F.round(F.col("p") - F.col("bucket") - 0.5, 6)), "id"))).withColumn("n", F.least(F.lit(10), F.count("*").over(w)))
    return k.filter(F.col("rn") == F.floor(G.unit(F.col("request_id").cast("string"), F.col("bucket").cast("string")) * F.col("n")) + 1).select("request_id", "bucket", "id")


query("JN-11", f"WITH p AS (SELECT v.visit_id, s.id, {hav('v.lat', 'v.lng', 's.lat', 's.lng')} AS d FROM visits v JOIN stations s ON abs(v.lat - s.lat) < 0.01 AND abs(v.lng - s.lng) < 0.01), b AS (SELECT visit_id, min({{'d': round(d, 9), 'id': id}}) AS b FROM p WHERE d <= 0.3 GROUP BY visit_id) SELECT v.visit_id, b.id AS place_id, round(b.d, 6) AS distance FROM visits v LEFT JOIN b USING (visit_id)")(
    lambda v: S.nearest(v.visits, v.stations, "visit_id", 0.3, 0.05).select("visit_id", "place_id", "distance")
)
_N = hav("a.lat", "a.lng", "b.lat", "b.lng")
query("JN-12", f"SELECT a.id AS req_id, b.id, round({_N}, 6) AS distance FROM stations a JOIN stations b ON a.id <> b.id AND abs(a.lat - b.lat) < 1 AND {_N} <= 30")(
    lambda v: S.within(v.stations.select("id", "lat", "lng"), v.stations.select("id", "lat", "lng"), F.lit(30.0), 0.5).filter("req_id <> id").select("req_id", "id", F.round("distance", 6).alias("distance"))
)
query("SNK-03", "WITH t AS (SELECT request_id, printf(',\"%s\",%.7f,%.7f', replace(name, '\"', '\"\"'), s.lat, s.lng) AS line, row_number() OVER (PARTITION BY request_id ORDER BY s.id) AS rn FROM requests r JOIN stations s ON s.id % 100 = request_id % 100), u AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM t WHERE rn <= 2 + request_id % 7) SELECT request_id, concat('ROUTE/1', chr(10), string_agg(concat(CASE WHEN rn = 1 THEN 'START' WHEN rn = n THEN 'GOAL' ELSE 'VIA' END, line), chr(10) ORDER BY rn)) AS route FROM u GROUP BY request_id")(
    lambda v: _route_text(v)
)


def _route_text(v):
    """Routes of two to eight places."""
    from waystone.sources.files import route_text

    # all requests of a remainder meet the same stations, and use the first eight at most
    w = Window.partitionBy("_part").orderBy("id")
    first = v.stations.withColumn("_part", F.col("id") % 100).withColumn("rn", F.row_number().over(w)).filter("rn <= 8")
    r = v.requests.select("request_id", (F.col("request_id") % 100).alias("_part"))
    t = r.join(first, "_part").filter(F.col("rn") <= 2 + F.col("request_id") % 7)
    return route_text(t, "request_id", "rn")
