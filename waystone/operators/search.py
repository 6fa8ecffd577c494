"""Searches around points: annulus, sector, radius, nearest, corridors, goals and routes (GEO, SRT-07 to 11, JN-11, JN-12)."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from waystone.functions import geo as G
from waystone.functions import text as T
from waystone.operators import around as A
from waystone.operators import reconcile as R

#: Degrees of a grid cell. A search touches about (2 km / (111 size))**2 cells, so wide searches take wide cells.
CELL = 1.0


def within(requests: DataFrame, places: DataFrame, reach: Column, size: float = CELL, *, least: Column | None = None, keep=None) -> DataFrame:
    """JN-12: pairs of a request and the places within `reach` km (and no nearer than `least`), with `distance`.

    An equi-join on grid cells, a bound by the cosine of the angle, which takes no function of the pair, and then the exact
    distance: no pairs outside the touched cells are made. Cells that no wanted place can lie in are left out by the
    distance of their middle and by `keep` (see `geo.cells`). Request columns are named req_*.
    """
    low = F.lit(0.0) if least is None else least
    r = requests.withColumns({"_reach": reach, "_least": low})

    def reached(y: Column, x: Column, cell: float, flat: Column) -> Column:
        d, more = G.haversine(F.col("lat"), F.col("lng"), y, x), G.half_cell(cell)
        near = (d <= F.col("_reach") + more) & (d + more >= F.col("_least"))
        return near if keep is None else near & keep(y, x, cell, flat)

    cosine = lambda km: F.cos(F.least(F.lit(20_015.0), F.greatest(F.lit(0.0), km)) / 6371)
    # 1e-12 is far more than both sides are rounded by; the exact distance decides
    bounds = {"_low": cosine(F.col("_reach")) - 1e-12, "_high": cosine(F.col("_least")) + 1e-12}
    u, v = (dict(zip(names, G.direction(F.col("lat"), F.col("lng")), strict=True)) for names in (("_ux", "_uy", "_uz"), ("_vx", "_vy", "_vz")))
    used = [*u, *bounds, "_reach", "_least"]
    # the exchange spreads the requests and holds what was computed: no function of a request is taken again for a cell or a pair
    r = r.withColumns(u | bounds).repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = r.select(*[F.col(c).alias(f"req_{c}") for c in requests.columns], *used, F.explode(G.cells(F.col("lat"), F.col("lng"), F.col("_reach"), size, reached)).alias("_cell"))
    key = lambda y, x: (y.cast("bigint") * (1 << 24) + x).alias("_c")
    r = r.select("*", key(F.col("_cell.cell_y"), F.col("_cell.cell_x"))).drop("_cell")
    p = places.select("*", *[c.alias(name) for name, c in v.items()], key(*G.cell_of(F.col("lat"), F.col("lng"), size)))
    cos = F.col("_ux") * F.col("_vx") + F.col("_uy") * F.col("_vy") + F.col("_uz") * F.col("_vz")
    # sizes of files say nothing of the exploded requests: a broadcast join would run in the few tasks that read the places
    got = r.join(p.hint("merge"), "_c").filter((cos >= F.col("_low")) & (cos <= F.col("_high")))
    # conditions do not move past one that depends on the row's number; Spark would test later ones before the bound
    got = got.filter(F.monotonically_increasing_id() >= 0)
    got = got.withColumn("distance", G.haversine(F.col("req_lat"), F.col("req_lng"), F.col("lat"), F.col("lng")))
    exact = F.col("distance") <= F.col("_reach")
    return got.filter(exact if least is None else exact & (F.col("distance") >= F.col("_least"))).drop("_c", *used, *v)


def by_position(rows: DataFrame, key: str, *same: str) -> DataFrame:
    """Rows that are alike in `same` as one row with `<key>s`, the list of their keys: pairs are made once for all of them."""
    # a list of rows keeps null keys
    return rows.groupBy(*same).agg(F.transform(F.collect_list(F.struct(key)), lambda x: x[key]).alias(f"{key}s"))


def spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """The pairs of each key of `by_position`, from the lists `<key>s`. Compute columns before: they are the same for all."""
    for key in keys:
        pairs = pairs.select(F.explode(f"{key}s").alias(key), *[c for c in pairs.columns if c != f"{key}s"])
    return pairs


def annulus(requests: DataFrame, places: DataFrame, size: float = CELL / 2) -> DataFrame:
    """FLT-05: places between max(0, km - tol) and km + tol, both included."""
    return within(requests, places, F.col("km") + F.col("tol"), size, least=F.greatest(F.lit(0.0), F.col("km") - F.col("tol")))


def in_sector(pairs: DataFrame, half: float) -> DataFrame:
    """FLT-06: pairs whose bearing is within `half` degrees of the wished one."""
    angle = G.difference(G.bearing(F.col("req_lat"), F.col("req_lng"), F.col("lat"), F.col("lng")), F.col("req_bearing"))
    return pairs.withColumn("angle", angle).filter(F.col("angle") <= half)


def tolerance(km: Column) -> Column:
    """FLT-07: the tolerance of a nominal distance: fixed ones for 30, 50, 100 and 200 km, else 15 % but at least 5."""
    table = F.create_map(*[x for k, v in ((30, 8), (50, 10), (100, 15), (200, 30)) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, km.cast("int")), F.greatest(F.lit(5), F.round(km * 0.15).cast("int")))


def goal_candidates(requests: DataFrame, stations: DataFrame, events: DataFrame, as_of: str, sector: float | None = 33.75) -> DataFrame:
    """The flagship: stations in the annulus (and sector) with live events, nearest to the wished distance first (SRT-07).

    Stations without live events go first, so pairs are neither made nor moved for them.
    """
    live = events.filter(R.live(as_of)).select(T.station_key(F.col("road_name")).alias("_key"))
    open_ones = stations.withColumn("_key", T.station_key(F.col("name"))).join(live, "_key", "left_semi").drop("_key")
    pairs = annulus(requests, open_ones)
    if sector is not None:
        pairs = in_sector(pairs, sector)
    return pairs.select("req_request_id", "id", F.round("distance", 6).alias("distance"), F.round(F.abs(F.col("distance") - F.col("req_km")), 6).alias("off")).orderBy("req_request_id", "off", "id")


def nearest(points: DataFrame, places: DataFrame, key: str, most_km: float, size: float = 0.25) -> DataFrame:
    """JN-11: the nearest place of each point within `most_km`; points without one stay, with nulls. Ties: smallest id."""
    near = within(points, places.select("id", "lat", "lng"), F.lit(most_km), size)
    best = near.groupBy(F.col(f"req_{key}").alias(key)).agg(F.min(F.struct(F.round("distance", 9).alias("d"), "id")).alias("b"))
    return points.join(best, key, "left").select(*points.columns, F.col("b.id").alias("place_id"), F.round("b.d", 6).alias("distance"))


def nearest_any(points: DataFrame, places: DataFrame, key: str, first_km: float) -> DataFrame:
    """JN-11 without a limit: rings four times as wide each time, in cells that grow with them, so a ring touches some
    dozens of cells; a point leaves once its ring holds a place. The last ring is the globe."""
    left, found, km = points, None, first_km
    while True:
        got = nearest(left, places, key, km, max(0.25, km / 222))
        if km > 20_100:
            return got if found is None else found.unionByName(got)
        hit = got.filter("place_id is not null")
        found = hit if found is None else found.unionByName(hit)
        left = got.filter("place_id is null").select(*points.columns)
        km = km * 4 if km < 5000 else 20_200


def _chosen(requests: DataFrame, places: DataFrame, columns: list[str], seed: str, choose, *more: Y.StructField) -> DataFrame:
    """(req_request_id, id, *more): the place that `choose(places, asks, key as text, share)` draws for each request, as (number, *values),
    by a share from 0 to 1 that the request's key and the seed give. A request's pairs stay in its task (see `around`)."""
    rows = A.dealt(requests, "request_id", *columns).withColumns({"_key": F.col("request_id").cast("string"), "_share": G.unit(F.col("request_id").cast("string"), F.lit(seed))})
    sent = A.sent(places)
    schema = Y.StructType([Y.StructField("req_request_id", requests.schema["request_id"].dataType), places.schema["id"], *more])

    def run(batches):
        at = sent.value
        chooser = choose(at)
        for batch in batches:
            asks = zip(A.asked(batch), batch["_key"].to_pylist(), batch["_share"].to_pylist(), strict=True)
            got = [(k, *c) for k, x in enumerate(asks) if (c := chooser(*x)) is not None]
            if got:
                keys, rows, *values = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch["request_id"].take(pa.array(keys)), at.ids.take(pa.array(rows)), *[pa.array(v) for v in values]], schema.names)

    return rows.mapInArrow(run, schema)


def _drawn(share: float, n: int) -> int:
    return int(np.floor(share * n))


def scored_pick(requests: DataFrame, places: DataFrame, top: int = 24, seed: str = "1") -> DataFrame:
    """SRT-08: by distance from the wish, a tenth of the angle and seeded noise; of the best `top` one is drawn.

    Noise is never below 0: places are scored in the order of the rest, until that is behind the `top`th score so far.
    """

    def choose(at: A.Places):
        @A.remembered
        def search(ask: np.ndarray):
            lat, lng, wish, tol, way = ask
            i, d = at.ring(lat, lng, max(0.0, wish - tol), wish + tol)
            angle = A.difference(A.bearing(lat, lng, at.lat[i], at.lng[i]), way)
            ahead = angle <= 45
            return i[ahead], np.abs(d[ahead] - wish) + angle[ahead] / 10

        def pick(asks: list, key: str | None, share: float):
            i, base = (np.concatenate(x) for x in zip(*map(search, asks), strict=True))
            if not len(i):
                return None
            order = np.argsort(base, kind="stable")
            i, base = i[order], base[order]
            ends, done, upto = np.cumsum(at.counts(i)), 0, 2 * top
            ids, score = np.zeros(0, np.int64), np.zeros(0)
            # what is nearer without noise is scored first, until no other place can be among the best
            while done < len(i) and (len(ids) < top or base[done] <= score[-1] + 1e-5):
                now = slice(done, done := max(done + 1, int(np.searchsorted(ends, upto))))
                more = at.members(i[now])
                words = at.ids.take(pa.array(more)).cast(pa.string()).to_pylist()
                noise = np.array([int(md5("|".join([x for x in (key, word, seed) if x is not None]).encode()).hexdigest()[:8], 16) for word in words]) / 4294967296.0
                ids, score = np.append(ids, more), np.append(score, A.rounded(np.repeat(base[now], at.counts(i[now])) + noise * 4, 6))
                best = np.lexsort((ids, score))[:top]
                ids, score, upto = ids[best], score[best], 2 * upto
            k = _drawn(share, len(ids))
            return int(ids[k]), float(score[k]), len(ids)

        return pick

    return _chosen(requests, places, ["lat", "lng", "km", "tol", "bearing"], seed, choose, Y.StructField("score", Y.DoubleType()), Y.StructField("n", Y.LongType()))


def nearest_n(requests: DataFrame, places: DataFrame, n: int | None, band: float, fallback: int | None) -> DataFrame:
    """SRT-09: the places within `band` km of the wished distance, ranked by distance and id; where there are none all up to
    the end of the band. At most `n` and `fallback` of them, all without these.

    A request is ranked in its task (see `around`), so pairs are neither shuffled nor sorted with those of others.
    """
    rows = A.dealt(requests.select("request_id", "lat", "lng", "km"), "request_id", "lat", "lng", "km")
    sent = A.sent(places)
    schema = Y.StructType([Y.StructField("req_request_id", requests.schema["request_id"].dataType), Y.StructField("ids", Y.ArrayType(places.schema["id"].dataType))])

    def run(batches):
        at = sent.value

        @A.remembered
        def search(ask: np.ndarray):
            lat, lng, wish = ask
            i, d = at.ring(lat, lng, wish - band - 1e-6, wish + band)
            near = np.abs(d - wish) <= band
            return i[near], d[near]

        def ranked(asks, get, most):
            found = [get(ask) for ask in asks]
            i, d = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = at.members(i)
            return ids[np.lexsort((ids, np.repeat(A.rounded(d, 6), at.counts(i))))][:most]

        def lists():
            for batch in batches:
                for k, asks in enumerate(A.asked(batch)):
                    got = ranked(asks, search, n)
                    if not len(got):
                        got = ranked(asks, lambda ask: at.ring(ask[0], ask[1], 0.0, ask[2] + band), fallback)
                    if len(got):
                        yield batch["request_id"].slice(k, 1), got

        yield from A.packed(lists(), at, ["req_request_id", "ids"])

    found = rows.mapInArrow(run, schema)
    return found.select("req_request_id", F.posexplode("ids").alias("_at", "id")).select("req_request_id", "id", (F.col("_at") + 1).alias("rn"))


def sorted_events(pairs: DataFrame, mode: str, as_of: str) -> DataFrame:
    """SRT-10: by distance, weekend bucket or date, then by name."""
    from waystone.functions.dates import weekend_bucket

    first = {"distance": [F.col("distance")], "weekend": [weekend_bucket(F.col("start_date"), F.lit(as_of).cast("date")), F.col("start_date")], "date": [F.col("start_date")]}[mode]
    return pairs.orderBy(*first, "name", "event_id")


def with_goal(requests: DataFrame) -> DataFrame:
    """Adds goal_lat and goal_lng: the point at the request's distance and bearing (GEO-05)."""
    lat, lng = G.destination(F.col("lat"), F.col("lng"), F.col("km"), F.col("bearing"))
    return requests.withColumns({"goal_lat": lat, "goal_lng": lng})


def _ahead(y: Column, x: Column, size: float, flat: Column) -> Column:
    """Cells with a place in the corridor: none of their places is farther from the middle, on the plane, than `more`."""
    gx, gy, d, half = F.col("_gx"), F.col("_gy"), F.col("_d"), size / 2
    px, py = G.offset(F.col("lat"), F.col("lng"), y, x)
    # the east offset also changes with the latitude of the place, by which its scale is taken
    more = G.KM_PER_DEGREE * (half * 1.5 + (F.abs(x - F.col("lng")) + half) * F.radians(F.lit(half)) / 2) + 1
    along, side = (px * gx + py * gy) / d, F.abs(px * gy - py * gx) / d
    return ~flat | ((side <= 35 + more) & (along >= -more) & (along <= d + more))


def corridor(requests: DataFrame, places: DataFrame) -> DataFrame:
    """GEO-10: places ahead on the way to the goal: within 45 degrees on the plane, past the margins, inside the corridor.

    corridor = min(35, max(6, 0.2 d)); along in (m, d - m) with m = max(1, 0.04 d) on the plane; sideways no more than
    the corridor and than 2 + 0.85 min(along, rest).
    """
    here, goal = (F.col("lat"), F.col("lng")), (F.col("goal_lat"), F.col("goal_lng"))
    gx, gy = G.offset(*here, *goal)
    r = requests.withColumns({"direct": G.haversine(*here, *goal), "_gx": gx, "_gy": gy, "_d": F.sqrt(gx * gx + gy * gy), "_to": G.heading(*here, *goal)})
    near = within(r, places, F.col("direct") + 1.0, CELL / 2, keep=_ahead)
    gx, gy, d = F.col("req__gx"), F.col("req__gy"), F.col("req__d")
    px, py = G.offset(F.col("req_lat"), F.col("req_lng"), F.col("lat"), F.col("lng"))
    got = near.withColumns({"along": (px * gx + py * gy) / d, "side": F.abs(px * gy - py * gx) / d})
    wide = F.least(F.lit(35.0), F.greatest(F.lit(6.0), 0.2 * F.col("req_direct")))
    m = F.greatest(F.lit(1.0), 0.04 * d)
    angle = G.difference(G.heading(F.col("req_lat"), F.col("req_lng"), F.col("lat"), F.col("lng")), F.col("req__to"))
    ok = (F.col("side") <= wide) & (F.col("along") > m) & (F.col("along") < d - m) & (F.col("side") <= 2 + 0.85 * F.least(F.col("along"), d - F.col("along"))) & (angle <= 45)
    return got.filter(ok).drop("req__gx", "req__gy", "req__d", "req__to")


def drawn_goals(requests: DataFrame, places: DataFrame, seed: str = "1") -> DataFrame:
    """GEO-11: one place, drawn by a seed, among those within max(10, 12 %) of the wished distance."""

    def choose(at: A.Places):
        @A.remembered
        def search(ask: np.ndarray) -> np.ndarray:
            lat, lng, wish = ask
            tol = max(10.0, wish * 0.12)
            return at.members(at.ring(lat, lng, max(0.0, wish - tol), wish + tol)[0])

        def pick(asks: list, key: str | None, share: float):
            ids = np.concatenate([search(ask) for ask in asks])
            if not len(ids):
                return None
            k = _drawn(share, len(ids))
            return int(np.partition(ids, k)[k]), len(ids)

        return pick

    return _chosen(requests, places, ["lat", "lng", "km"], seed, choose, Y.StructField("n", Y.LongType()))


ROUTE = "stops int, score double, path array<bigint>, length double"


#: Pairs of places that a task holds at once.
PAIRS = 1 << 20


def _best_route(stops: int, most_ratio: float):
    """The best path through one request's corridor, layer by layer over arrays: pairs of a corridor never become rows, and
    only places within a growing bound of the score are paired, `PAIRS` at a time. Places come in the order of `along` and their ids."""

    def run(d: float, along: np.ndarray, here: np.ndarray, origin: np.ndarray, goal: np.ndarray) -> tuple[int, float, list[int], float] | None:
        if not len(along):
            return None
        here, origin, goal = (np.radians(x) for x in (here, origin[None, :], goal[None, :]))

        def km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2
            return 12742.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

        first, last = km(origin, here)[0], km(here, goal)[:, 0]
        apart = max(1.0, 0.025 * d)
        penalty = lambda step, count: 0.25 * d * np.abs(along / d - step / (count + 1))

        def best(count: int, most: float) -> tuple | None:
            """The best path of `count` stops through the places that a path of a score up to `most` can use at each step."""
            paths, before = [], np.zeros(0, np.int64)
            for step in range(1, count + 1):
                # no path through a place is shorter than the ways to it and on to the goal
                now = np.flatnonzero(first + last + penalty(step, count) <= most + 1e-5)
                if not len(now):
                    return None
                if step == 1:
                    score, length = first[now], first[now]
                else:
                    least, by, way = np.full(len(now), np.inf), np.zeros(len(now), np.int64), np.full(len(now), np.inf)
                    step_size = max(1, PAIRS // len(now))
                    for k in range(0, len(before), step_size):
                        part = slice(k, k + step_size)
                        leg = km(here[before[part]], here[now])
                        total = length[part, None] + leg
                        ahead = along[None, now] - along[before[part], None] >= apart
                        cost = np.where(ahead & (total <= most_ratio * d), np.round(score[part, None] + leg, 9), np.inf)
                        own = cost.argmin(0)
                        value = cost[own, np.arange(len(now))]
                        less = value < least
                        least[less], by[less], way[less] = value[less], k + own[less], total[own, np.arange(len(now))][less]
                    paths.append((by, before))
                    score, length = least, way
                score = score + penalty(step, count)[now]
                score[length > most_ratio * d] = np.inf
                before = now
            total, score = length + last[before], np.round(score + last[before], 6)
            score[total > most_ratio * d + 1e-6] = np.inf
            at = int(score.argmin())
            if not np.isfinite(score[at]):
                return None
            path, k = [int(before[at])], at
            for by, places_before in reversed(paths):
                k = int(by[k])
                path.append(int(places_before[k]))
            return float(score[at]), path[::-1], float(total[at])

        top = float((first + last).max() + 0.25 * d) + 1
        for count in range(stops, 0, -1):
            # a path as good as the bound is the best of all: what the bound leaves out only makes worse ones
            most = d + max(0.2, 0.005 * d)
            while True:
                got = best(count, most)
                if got and got[0] <= most or most > most_ratio * d + 0.25 * d * count + top:
                    break
                most = d + 2 * (most - d)
            if got:
                return count, got[0], got[1], round(got[2], 6)
        return None

    return run


def routes(requests: DataFrame, places: DataFrame, stops: int = 5, most_ratio: float = 1.30) -> DataFrame:
    """GEO-12: of each request the best forward route of `stops` stops in its corridor; fewer where there is none, and the
    direct way (no stops, score = length) where there is no route at all.

    A path moves on by 2.5 % of the way and 1 km or more; its score grows by the leg and by the spread penalty
    0.25 d |along / d - step / (stops + 1)|; one best path is kept for each place, and no path gets longer than
    `most_ratio` of the direct way. Ties go to the place that comes first.
    """
    here, goal = (F.col("lat"), F.col("lng")), (F.col("goal_lat"), F.col("goal_lng"))
    rows = requests.select("request_id", G.haversine(*here, *goal).alias("_direct"), *here, *goal)
    # few bytes, much work: a number of partitions that is named is not merged
    rows = rows.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), *here, *goal).sortWithinPartitions(*here, *goal)
    sent = A.sent(places.withColumn("id", F.col("id").cast("bigint")))
    schema = Y.StructType([*rows.schema.fields[:2], *Y.StructType.fromDDL(ROUTE).fields])

    def run(batches):
        at, best = sent.value, _best_route(stops, most_ratio)

        @A.remembered
        def search(ask: np.ndarray):
            if not np.isfinite(ask).all():
                return None
            direct, *ends = ask
            i, along = _way(at, direct, *ends)
            # of places at one position the first comes before the others in all ties
            order = np.lexsort((first := at.rows[at.starts[i]], along))
            i, first = i[order], first[order]
            got = best(direct, along[order], np.stack([at.lat[i], at.lng[i]], 1), ask[1:3], ask[3:5])
            return got and (got[0], got[1], at.ids.take(pa.array(first[got[2]])).to_pylist(), got[3])

        for batch in batches:
            asks = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in range(1, 6)], 1).astype(np.float64)
            got = [search(ask) or (None,) * 4 for ask in asks]
            values = [pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.float64()), strict=True)] if got else []
            if got:
                yield pa.RecordBatch.from_arrays([batch[0], batch[1], *values], schema.names)

    direct = F.round("_direct", 6)
    return rows.mapInArrow(run, schema).select("request_id", F.coalesce("stops", F.lit(0)).alias("stops"), F.coalesce("score", direct).alias("score"), F.coalesce("path", F.array().cast("array<bigint>")).alias("path"), F.coalesce("length", direct).alias("length"))


def _way(at: A.Places, direct: float, lat: float, lng: float, goal_lat: float, goal_lng: float) -> tuple[np.ndarray, np.ndarray]:
    """`corridor` of one request on arrays: the positions in it and how far along each lies."""
    i, _ = at.ring(lat, lng, 0.0, direct + 1.0)
    gx, gy = A.offset(lat, lng, goal_lat, goal_lng)
    d = np.sqrt(gx * gx + gy * gy)
    if not d:
        return i[:0], np.zeros(0)
    px, py = A.offset(lat, lng, at.lat[i], at.lng[i])
    along, side = (px * gx + py * gy) / d, np.abs(px * gy - py * gx) / d
    wide, m = min(35.0, max(6.0, 0.2 * direct)), max(1.0, 0.04 * d)
    angle = A.difference(A.heading(lat, lng, at.lat[i], at.lng[i]), A.heading(lat, lng, goal_lat, goal_lng))
    ok = (side <= wide) & (along > m) & (along < d - m) & (side <= 2 + 0.85 * np.minimum(along, d - along)) & (angle <= 45)
    return i[ok], A.rounded(along[ok], 9)
