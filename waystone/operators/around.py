"""Places as sorted arrays, for searches whose pairs are far more than their results (GEO-07, GEO-08, GEO-11, GEO-12, SRT-08, SRT-09).

Requests and tracks stay in their tasks and all places are sent to each: 8 bytes a place and 24 a position. A task makes the
pairs of one request or track at a time, so pairs are neither shuffled nor spilled, and places of one position are
computed once. Arrays give rows in the order of the places' ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6371.0
#: Degrees of latitude of a band of places.
BAND = 0.1


class Places:
    """Positions in bands of latitude, by longitude within a band, each with the numbers of its places in the order of ids."""

    def __init__(self, table: pa.Table, size: float, globe: bool) -> None:
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_start"))
        self.ids = ids = table["id"].combine_chunks()
        # equal ids have one rank
        self.rank = np.zeros(len(ids), np.int64)
        if len(ids) > 1:
            a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
            new = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
            self.rank[1:] = np.cumsum(new)
        self.repeated = len(ids) > 0 and self.rank[-1] + 1 < len(ids)
        if not self.repeated:
            self.rank = None
        lat, lng = (table[c].to_numpy().astype(np.float64) for c in ("lat", "lng"))
        self.size, self.globe = size, globe
        x = np.mod(lng + 180, 360) if globe else lng
        band = np.floor(lat / size).astype(np.int64)
        rows = np.lexsort((np.arange(len(lat)), lng, lat, x, band))
        lat, lng, x, band = lat[rows], lng[rows], x[rows], band[rows]
        first = np.ones(len(rows), bool)
        first[1:] = (np.diff(lat) != 0) | (np.diff(x) != 0) | (np.diff(lng) != 0)
        self.starts = np.append(np.flatnonzero(first), len(rows))
        self.rows, self.lat, self.lng = rows, lat[first], lng[first]
        self.left, self.low, self.high = (x.min(), band.min(), band.max()) if len(x) else (0.0, 0, -1)
        self.wide = (x.max() - self.left if len(x) else 0.0) + 1
        self.key = (band[first] - self.low) * self.wide + x[first] - self.left

    def bands(self, low: float, high: float) -> np.ndarray:
        """The bands that hold places between two latitudes."""
        return np.arange(max(self.low, int(np.floor(max(low, -1e9) / self.size))), min(self.high, int(np.floor(min(high, 1e9) / self.size))) + 1)

    def between(self, band: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Positions of each band from `low` to `high`."""
        edge = lambda x: (band - self.low) * self.wide + np.clip(x - self.left, -0.25, self.wide - 0.75)
        a, b = np.searchsorted(self.key, edge(low - 1e-7)), np.searchsorted(self.key, edge(high + 1e-7), "right")
        n = np.maximum(b - a, 0)
        return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())

    def counts(self, at: np.ndarray) -> np.ndarray:
        """How many places each position has."""
        return self.starts[at + 1] - self.starts[at]

    def members(self, at: np.ndarray) -> np.ndarray:
        """The places of the positions, one position after the other."""
        n = self.counts(at)
        return self.rows[np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def ring(self, lat: float, lng: float, least: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions from `least` to `reach` kilometres around a point, with their distances."""
        if not (np.isfinite([lat, lng, reach]).all() and reach >= 0):
            return np.zeros(0, np.int64), np.zeros(0)
        p, r = np.radians(lat), (reach + 1e-6) / EARTH
        dy = np.degrees(r)
        band = self.bands(lat - dy, lat + dy)
        edges = np.radians(np.clip(np.stack([band, band + 1]) * self.size, -90, 90))
        sines, cosines = np.sin(p) * np.sin(edges), np.maximum(np.cos(p) * np.cos(edges), 1e-15)
        # half the width of a circle at both edges of each band
        half = lambda angle: np.arccos(np.clip((np.cos(min(np.pi, angle)) - sines) / cosines, -1, 1))
        wide = half(r).max(0)
        if r >= np.pi / 2:
            wide[:] = np.pi
        elif abs(np.sin(p)) < np.cos(r):
            # where the circle is widest
            top = np.arcsin(np.sin(p) / np.cos(r))
            wide[(edges[0] <= top + 1e-9) & (edges[1] >= top - 1e-9)] = np.arcsin(min(1.0, np.sin(r) / np.cos(p)))
        wide = np.degrees(wide) + 1e-6
        x = np.mod(lng + 180, 360)
        if least > 1e-3:
            hole = np.degrees(half((least - 1e-6) / EARTH).min(0)) - 1e-6
            hole[hole < 1e-5] = 0
            parts = [(band, x - wide, x - hole), (band[hole > 0], x + hole[hole > 0], x + wide[hole > 0])]
            parts[0][2][hole <= 0] = (x + wide)[hole <= 0]
        else:
            parts = [(band, x - wide, x + wide)]
        found = []
        for b, low, high in parts:
            for turn in (0, -360, 360):
                if turn == 0 or (low < 0).any() or (high >= 360).any():
                    # a part that goes beyond the end of the scale is looked up at its other end
                    use = np.ones(len(b), bool) if turn == 0 else (low < 0) if turn == 360 else (high >= 360)
                    found.append(self.between(b[use], np.clip(low[use] + turn, -1, 361), np.clip(high[use] + turn, -1, 361)))
        at = np.concatenate(found)
        if (wide >= 179.9).any():
            # parts may meet on the other side
            at = np.unique(at)
        d = km(lat, lng, self.lat[at], self.lng[at])
        near = (d <= reach) & (d >= least)
        return at[near], d[near]


def km(lat1, lng1, lat2, lng2):
    """`geo.haversine` on arrays."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 12742.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def bearing(lat1, lng1, lat2, lng2):
    """`geo.bearing` on arrays."""
    d, p, q = np.radians(lng2 - lng1), np.radians(lat1), np.radians(lat2)
    return np.mod(np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))) + 360, 360.0)


def heading(lat1, lng1, lat2, lng2):
    """`geo.heading` on arrays."""
    east, north = offset(lat1, lng1, lat2, lng2)
    return np.mod(np.degrees(np.arctan2(east, north)) + 360, 360.0)


def offset(lat1, lng1, lat2, lng2):
    """`geo.offset` on arrays."""
    from waystone.functions.geo import KM_PER_DEGREE

    return (lng2 - lng1) * KM_PER_DEGREE * np.cos(np.radians((lat1 + lat2) / 2)), (lat2 - lat1) * KM_PER_DEGREE


def difference(a, b):
    """`geo.difference` on arrays."""
    return np.abs(np.mod(a - b + 540, 360.0) - 180)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def sent(places: DataFrame, size: float = BAND, globe: bool = True, distinct: bool = False):
    """A broadcast variable with the `Places` of (id, lat, lng); places without a position are left out."""
    rows = places.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).filter("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")
    return places.sparkSession.sparkContext.broadcast(Places((rows.distinct() if distinct else rows).toArrow(), size, globe))


def packed(lists, at: Places, names: list[str], most: int = 1 << 20):
    """Record batches of (key, list of ids) from keys and the numbers of their places, about `most` places in each."""
    keys, rows = [], []

    def batch() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, rows)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at.ids.take(pa.array(np.concatenate(rows))))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), ids], names)

    size = 0
    for key, found in lists:
        keys.append(key)
        rows.append(found)
        size += len(found)
        if size >= most:
            yield batch()
            keys, rows, size = [], [], 0
    if rows:
        yield batch()


def dealt(requests: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """(key, asks): a row for each request with the rows it has (one, unless its key repeats). Requests that ask the same lie
    next to each other. Few bytes, much work: a number of partitions that is named is not merged."""
    asks = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("asks"))
    return asks.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "asks").sortWithinPartitions("asks")


def asked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The asks of each row of `dealt`, an array of (asks, columns) for each."""
    asks = batch["asks"]
    flat = asks.flatten()
    values = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(flat.type.num_fields)], 1)
    ends = np.cumsum(pc.list_value_length(asks).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1].astype(np.int64))


def remembered(search):
    """`search` of an ask, which is not made again for the next one if that asks the same."""
    last: list = [None, None]

    def get(ask: np.ndarray):
        if last[0] != (key := ask.tobytes()):
            last[:] = key, search(ask)
        return last[1]

    return get
