"""Tracks as polylines: segments, progress of places along them, points at a share of the way, detours in order (GEO-06 to GEO-09).

Coordinates are taken as a plane, in degrees. A track's windows are bounded by the track. Places meet a track in the task
that has it (see `around`): pairs of tracks and places are made for one track at a time and are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from waystone.functions import geo as G
from waystone.operators import around as A

#: A place beside an end of a segment counts as this much farther away.
OUTSIDE = 20


def segments(points: DataFrame, track: str, *order: str) -> DataFrame:
    """(track, rn, lat, lng, lat2, lng2, len, before, total): the segments between the points (lat, lng) of each track.
    A track of one point has none."""
    w = Window.partitionBy(track)
    t = points.select(track, *order, "lat", "lng").withColumn("rn", F.row_number().over(w.orderBy(*order)))
    t = t.withColumns({"lat2": F.lead("lat").over(w.orderBy("rn")), "lng2": F.lead("lng").over(w.orderBy("rn"))}).filter("lat2 is not null")
    t = t.withColumn("len", F.sqrt(F.pow(F.col("lat2") - F.col("lat"), 2) + F.pow(F.col("lng2") - F.col("lng"), 2)))
    t = t.withColumns({"before": F.coalesce(F.sum("len").over(w.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("len").over(w)})
    return t.select(track, "rn", "lat", "lng", "lat2", "lng2", "len", "before", "total")


def _placed(rows: DataFrame, lat: Column, lng: Column) -> DataFrame:
    """Adds t (0 to 1), away (the distance) and off (the distance, more outside the ends) of a point to rows of segments."""
    raw = ((lng - F.col("lng")) * (F.col("lng2") - F.col("lng")) + (lat - F.col("lat")) * (F.col("lat2") - F.col("lat"))) / F.greatest(F.col("len") * F.col("len"), F.lit(1e-12))
    t, away = G.segment(lng, lat, F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"))
    return rows.withColumns({"t": t, "away": away, "off": F.round(away + F.when(raw.between(0, 1), 0).otherwise(OUTSIDE), 9)})


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.min(F.struct("off", "rn", "t", "before", "len", "total", "away")).alias("b"))
    return best.select(*keys, F.when(F.col("b.total") > 0, (F.col("b.before") + F.col("b.t") * F.col("b.len")) / F.col("b.total")).alias("progress"), F.col("b.away").alias("away"))


def progress(segs: DataFrame, track: str, lat: Column, lng: Column) -> DataFrame:
    """GEO-07: (track, progress, away) of one point along each track: that of the nearest segment."""
    return _best(_placed(segs, lat, lng), track)


def _beside(at: A.Places, seg: dict[str, np.ndarray], reach: float, best: dict[str, np.ndarray]) -> np.ndarray:
    """The positions within `reach` of a track. `best` has, for each of them, the nearest segment, `t`, `away` and `off`; its
    `off` must be infinite before."""
    found = []
    for k in np.flatnonzero(np.isfinite(seg["lat"] + seg["lng"] + seg["lat2"] + seg["lng2"])):
        y1, x1, y2, x2, size = (float(seg[c][k]) for c in ("lat", "lng", "lat2", "lng2", "len"))
        dy, dx = y2 - y1, x2 - x1
        band = at.bands(min(y1, y2) - reach - 1e-9, max(y1, y2) + reach + 1e-9)
        if not len(band):
            continue
        # within a band only the stretch of the segment that can be reached from it counts
        if abs(dy) < 1e-9:
            ends = np.broadcast_to([[0.0], [1.0]], (2, len(band)))
        else:
            ends = np.clip(np.stack([(band * at.size - reach - 1e-9 - y1) / dy, ((band + 1) * at.size + reach + 1e-9 - y1) / dy]), 0, 1)
        x = x1 + ends * dx
        i = at.between(band, x.min(0) - reach, x.max(0) + reach)
        px, py = at.lng[i] - x1, at.lat[i] - y1
        dot, square = px * dx + py * dy, dx * dx + dy * dy
        t = np.clip(dot / square, 0.0, 1.0) if square else np.zeros(len(i))
        away = np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
        near = away <= reach
        i, t, away = i[near], t[near], away[near]
        raw = dot[near] / max(size * size, 1e-12)
        off = A.rounded(away + np.where((raw >= 0) & (raw <= 1), 0, OUTSIDE), 9)
        was = best["off"][i]
        found.append(i[was == np.inf])
        less = off < was
        i = i[less]
        for name, value in (("off", off[less]), ("segment", k), ("t", t[less]), ("away", away[less])):
            best[name][i] = value
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _each_track(segs: DataFrame, track: str, places: DataFrame, reach: float, schema: Y.StructType, work) -> DataFrame:
    """The rows that `work` makes of each track: of the places, the track's rows by rn and their columns, the numbers of the
    places within `reach`, how many of them share each position, and the progress and distance of each position. Of the
    positions of one id the best counts."""
    sent = A.sent(places, max(A.BAND, reach), globe=False, distinct=True)
    held: dict = {}

    def run(table: pa.Table) -> pa.Table:
        at = sent.value
        if not held:
            held.update(off=np.full(len(at.lat), np.inf), segment=np.zeros(len(at.lat), np.int64), t=np.zeros(len(at.lat)), away=np.zeros(len(at.lat)))
        table = table.sort_by("rn")
        seg = {c: table[c].to_numpy().astype(np.float64) for c in table.column_names if c in ("rn", "lat", "lng", "lat2", "lng2", "len", "before", "total")}
        hit = _beside(at, seg, reach, held)
        best = {c: held[c][hit] for c in ("off", "segment", "t", "away")}
        held["off"][hit] = np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            part = (seg["before"][best["segment"]] + best["t"] * seg["len"][best["segment"]]) / seg["total"][best["segment"]]
        progress = np.where(seg["total"][best["segment"]] > 0, part, np.nan)
        count = at.counts(hit)
        rows = at.members(hit)
        if at.repeated:
            of = np.repeat(np.arange(len(hit)), count)
            order = np.lexsort((best["away"][of], best["t"][of], best["segment"][of], best["off"][of], at.rank[rows]))
            order = order[np.append(True, np.diff(at.rank[rows[order]]) != 0)] if len(order) else order
            rows, of = rows[order], of[order]
            return work(at, table, seg, rows, np.ones(len(rows), np.int64), progress[of], best["away"][of])
        return work(at, table, seg, rows, count, progress, best["away"])

    return segs.groupBy(track).applyInArrow(run, schema)


def places_along(segs: DataFrame, track: str, places: DataFrame, *, reach: float) -> DataFrame:
    """GEO-07: (track, id, progress, away) of every place (id, lat, lng) with every track within `reach` of it."""
    near = positions_along(segs, track, places, reach=reach)
    return near.select(track, F.explode("ids").alias("id"), "progress", "away")


def positions_along(segs: DataFrame, track: str, places: DataFrame, *, reach: float) -> DataFrame:
    """GEO-07: (track, ids, progress, away): as `places_along`, with a row for the places that share a position."""
    kind = places.schema["id"].dataType
    schema = Y.StructType([segs.schema[track], Y.StructField("ids", Y.ArrayType(kind)), Y.StructField("progress", Y.DoubleType()), Y.StructField("away", Y.DoubleType())])

    def work(at, table, seg, rows, count, progress, away):
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), at.ids.take(pa.array(rows)))
        tracks = table[track].combine_chunks().take(pa.array(np.zeros(len(count), np.int64)))
        return pa.table([tracks, ids, pa.array(progress, mask=np.isnan(progress)), pa.array(away)], names=[track, "ids", "progress", "away"])

    return _each_track(segs, track, places, reach, schema, work)


def stops_along(segs: DataFrame, track: str, places: DataFrame, *, reach: float, sep: str = ",") -> DataFrame:
    """GEO-08: (track, stops): the starts of a track's segments (o and their number) and all places within `reach` of it (d
    and their id) in the order of progress, as text. On ties places come first, by id."""
    schema = Y.StructType([segs.schema[track], Y.StructField("stops", Y.StringType())])
    labels: list[pa.Array] = []

    def labelled(at: A.Places, most: int) -> pa.Array:
        """The labels of all places, then those of the numbers from 0 to `most` or more."""
        if not labels or len(labels[0]) <= len(at.ids) + most:
            d, o = at.ids.cast(pa.string()), pa.array(np.arange(2 * most + 1)).cast(pa.string())
            labels[:] = [pa.concat_arrays([pc.binary_join_element_wise(x, y, "") for x, y in (("d", d), ("o", o))])]
        return labels[0]

    def work(at, table, seg, rows, count, progress, away):
        rn, n = seg["rn"].astype(np.int64), len(progress)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = seg["before"] / seg["total"]
        # one number has the order of (progress, place or start, id or number of the start)
        _, step = np.unique(np.nan_to_num(A.rounded(np.append(progress, own), 9)), return_inverse=True)
        step = step.astype(np.int64) << 33
        order = np.sort(np.append(np.repeat(step[:n], count) + rows, step[n:] + len(at.ids) + rn))
        words = labelled(at, int(rn.max())).take(pa.array(order & ((1 << 33) - 1))).drop_null()
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), sep)
        return pa.table([table[track].combine_chunks().slice(0, 1), text], names=[track, "stops"])

    return _each_track(segs, track, places, reach, schema, work)


def points_at(segs: DataFrame, track: str, share: Column) -> DataFrame:
    """GEO-09: (track, at_lat, at_lng): the point at a share of each track's length."""
    s = segs.withColumn("want", share * F.col("total")).filter("before + len >= want")
    b = s.groupBy(track).agg(F.min(F.struct("rn", "lat", "lng", "lat2", "lng2", "before", "len", "want")).alias("b")).select(track, "b.*")
    f = (F.col("want") - F.col("before")) / F.greatest(F.col("len"), F.lit(1e-12))
    return b.select(track, (F.col("lat") + f * (F.col("lat2") - F.col("lat"))).alias("at_lat"), (F.col("lng") + f * (F.col("lng2") - F.col("lng"))).alias("at_lng"))


def with_detours(stops: DataFrame, detours: DataFrame, track: str) -> DataFrame:
    """GEO-08: (track, stops): places (place, progress, ord) of a track in the order of progress, detours before original
    stops on ties."""
    columns = (track, "place", "progress", "ord")
    both = stops.select(*columns, F.lit(1).alias("original")).unionByName(detours.select(*columns, F.lit(0).alias("original")))
    rows = F.array_sort(F.collect_list(F.struct("progress", "original", "ord", "place")))
    return both.groupBy(track).agg(F.transform(rows, lambda x: x["place"]).alias("stops"))
