"""Covers: sorted ranges of leaf ids that hold a box, a circle (from literals, on the driver) or shapes (a batch of rows at once).

From the coarsest cells down, a cell is bounded by a cap around its centre. A cap apart from the region drops the cell, a
cap within it takes the cell whole, and the others are cut further while the number of cells allows it. A cover is never
too small, so the exact test after it gives the exact result.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import cells
from terrane.functions.geodesy import RADIUS
from terrane.functions.shapes import box_is_null

#: Cells at the border that are still cut; ranges of a cover.
MOST_CELLS, MOST_RANGES = 400, 48
#: Caps reach so much farther than the sampled border of a cell.
_MARGIN = 1.25


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def _caps(cell: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centres (unit vectors, latitudes, longitudes) and radii (radians) of caps around cells."""
    u, v, side = cells.cell_square(cell, depth)
    lat, lon = cells.globe_point(u + side / 2, v + side / 2)
    centre = _unit(lat, lon)
    step = np.linspace(0, 1, 9)
    ring = np.concatenate([np.stack([step, np.zeros(9)], 1), np.stack([step, np.ones(9)], 1), np.stack([np.zeros(9), step], 1), np.stack([np.ones(9), step], 1)])
    edge = _unit(*cells.globe_point(np.clip(u[:, None] + side * ring[:, 0], 0, 1 - 1e-12), np.clip(v[:, None] + side * ring[:, 1], 0, 1 - 1e-12)))
    far = np.arccos(np.clip((edge * centre[:, None, :]).sum(-1), -1, 1)).max(axis=1)
    return centre, lat, lon, far * _MARGIN + 1e-9


def merge_ranges(ranges: list[tuple[int, int]], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Sorted, adjacent ones joined, and the narrowest gaps closed until `most` are left."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    if len(out) > most:
        gaps = np.array([b[0] - a[1] for a, b in zip(out, out[1:], strict=False)])
        keep = set(np.argsort(-gaps, kind="stable")[: most - 1].tolist())
        joined = [out[0]]
        for i, r in enumerate(out[1:]):
            if i in keep:
                joined.append(r)
            else:
                joined[-1][1] = r[1]
        out = joined
    return [(a, b) for a, b in out]


def _extent(lat: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far caps reach in latitude and longitude, and whether they hold a pole."""
    reach = np.degrees(radius)
    polar = np.abs(lat) + reach >= 90
    wide = np.where(polar, 180.0, np.degrees(np.arcsin(np.clip(np.sin(radius) / np.maximum(1e-12, np.cos(np.radians(lat))), 0, 1))))
    return reach, wide, polar


@lru_cache(maxsize=1024)
def _children(parent: int, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The 256 cells of one depth below a parent and their caps."""
    cell = parent + (np.arange(256, dtype=np.int64) << 8 * (cells.LEVELS - depth))
    return cell, _caps(cell, depth)


def _cover(judge, most_cells: int) -> list[tuple[int, int]]:
    """Ranges of cells within and in part. judge gives for caps: 0 apart, 1 in part, 2 within.

    Cells in part are cut further while they are at most most_cells.
    """
    whole, part, parents = [], [], [0]
    for depth in range(1, cells.LEVELS + 1):
        below = [_children(int(p), depth) for p in parents]
        cell, caps = np.concatenate([c for c, _ in below]), [np.concatenate(x) for x in zip(*[k for _, k in below], strict=True)]
        verdict = judge(*caps)
        whole += [cells.id_range(int(c), depth) for c in cell[verdict == 2]]
        parents = cell[verdict == 1]
        if depth == cells.LEVELS or not 0 < len(parents) <= most_cells:
            part = [cells.id_range(int(c), depth) for c in parents]
            break
    return merge_ranges(whole + part)


def in_ranges(cell: Column, ranges: list[tuple[int, int]]) -> Column:
    """A stored cell column is in one of the ranges: few comparisons that a scan can prune by."""
    return reduce(lambda a, b: a | b, [cell.between(lo, hi) for lo, hi in ranges], F.lit(False))


def cover_circle(lat: float, lon: float, metres: float, most_cells: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Ranges that hold all points within so many metres."""
    centre, reach = _unit(np.array(lat), np.array(lon)), max(0.0, metres) / RADIUS + 1e-9

    def judge(at, _lat, _lon, radius):
        away = np.arccos(np.clip(at @ centre, -1, 1))
        return np.where(away > reach + radius, 0, np.where(away + radius <= reach, 2, 1))

    return _cover(judge, most_cells)


def cover_box(min_lat: float, min_lon: float, max_lat: float, max_lon: float, most_cells: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Ranges that hold a box; none for a null one. With min_lon over max_lon the box goes over the antimeridian."""
    if box_is_null(min_lat, min_lon, max_lat, max_lon):
        return []
    if min_lon > max_lon:
        return merge_ranges(cover_box(min_lat, min_lon, max_lat, 180.0, most_cells) + cover_box(min_lat, -180.0, max_lat, max_lon, most_cells))
    middle, half = (min_lon + max_lon) / 2, (max_lon - min_lon) / 2

    def judge(_at, lat, lon, radius):
        reach, wide, polar = _extent(lat, radius)
        apart = (lat + reach < min_lat) | (lat - reach > max_lat)
        away = np.abs((lon - middle + 180) % 360 - 180)
        apart |= away > half + wide
        within = (lat - reach >= min_lat) & (lat + reach <= max_lat) & (away + wide <= half) & ~polar
        return np.where(apart, 0, np.where(within, 2, 1))

    return _cover(judge, most_cells)


#: Parents that are cut at once; pairs of a cell and an edge that are compared at once.
_PARENTS, _PAIRS = 1 << 10, 1 << 19


@lru_cache(maxsize=1024)
def _boxes(parent: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the 256 cells of one depth below a parent: rows of least and greatest latitude and longitude and the centre; and
    which are over a pole or the antimeridian."""
    _, (_at, lat, lon, radius) = _children(parent, depth)
    reach, wide, polar = _extent(lat, radius)
    box = np.stack([lat - reach - 1e-9, lon - wide - 1e-9, lat + reach + 1e-9, lon + wide + 1e-9, lat, lon])
    return box, polar | (box[1] < -180) | (box[3] > 180)


def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place within it of each of so many parts."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


class _Edges:
    """The edges of many shapes, straight in latitude and longitude: those of a ring in turn, rings of a shape in turn.

    A point is an edge to itself. first and count are places of a shape's rings; no ring is empty.
    """

    def __init__(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray, roles: np.ndarray, area: np.ndarray):
        ring, i = spread(np.maximum(size - 1, 1))
        self.p, self.q = points[start[ring] + i], points[start[ring] + np.minimum(i + 1, size[ring] - 1)]
        self.low, self.high = np.minimum(self.p, self.q), np.maximum(self.p, self.q)
        self.role, self.ring_first, self.ring_count = roles, first, count
        at = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 1))])
        self.ring_at, self.ring_size = at[:-1], np.diff(at)
        self.ring_low, self.ring_high = np.fmin.reduceat(self.low, self.ring_at), np.fmax.reduceat(self.high, self.ring_at)
        self.count = at[first + count] - at[first]
        same = (points[start] == points[start + size - 1]).all(1)
        self.closed, self.area = np.logical_and.reduceat(same, first), area
        self.least, self.most = np.minimum.reduceat(points, start[first]) - 1e-9, np.maximum.reduceat(points, start[first]) + 1e-9
        self.least[area & ~self.closed, 1] = -np.inf  # the even-odd rule then holds points west of the gap

    def met(self, shape: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Whether an edge of a shape meets a box (a column of box): the parts of the edge within each axis' span must overlap."""
        pair, j = spread(self.ring_count[shape])
        ring = self.ring_first[shape][pair] + j
        near = self._near(self.ring_low, self.ring_high, ring, box, pair)
        pair, ring = pair[near], ring[near]
        one, i = spread(self.ring_size[ring])
        pair, edge = pair[one], self.ring_at[ring][one] + i
        near = self._near(self.low, self.high, edge, box, pair)
        pair, edge = pair[near], edge[near]
        start, end = 0.0, 1.0
        for axis in (0, 1):
            p, d = self.p[edge, axis], self.q[edge, axis] - self.p[edge, axis]
            flat = np.abs(d) <= 1e-12
            safe = np.where(flat, 1.0, d)
            t, u = (box[axis][pair] - p) / safe, (box[2 + axis][pair] - p) / safe
            held = (t <= 0) & (u >= 0)
            start = np.maximum(start, np.where(flat, np.where(held, 0.0, 2.0), np.minimum(t, u)))
            end = np.minimum(end, np.where(flat, np.where(held, 1.0, -1.0), np.maximum(t, u)))
        out = np.zeros(len(shape), bool)
        out[pair[start <= end]] = True
        return out

    @staticmethod
    def _near(low: np.ndarray, high: np.ndarray, of: np.ndarray, box: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Places where a ring's or an edge's own box meets that of its pair."""
        kept = np.flatnonzero((low[of, 0] <= box[2][pair]) & (high[of, 0] >= box[0][pair]))
        of, pair = of[kept], pair[kept]
        return kept[(low[of, 1] <= box[3][pair]) & (high[of, 1] >= box[1][pair])]

    def held(self, shape: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Whether an area of closed rings holds a point by the even-odd rule: in an exterior ring and in no interior one."""
        owner, j = spread(self.ring_count[shape])
        ring = self.ring_first[shape][owner] + j
        one, i = spread(self.ring_size[ring])
        edge, at = self.ring_at[ring][one] + i, owner[one]
        spans = np.flatnonzero((self.p[edge, 0] > lat[at]) != (self.q[edge, 0] > lat[at]))
        p, q, at, one = self.p[edge[spans]], self.q[edge[spans]], at[spans], one[spans]
        west = lon[at] < p[:, 1] + (lat[at] - p[:, 0]) * (q[:, 1] - p[:, 1]) / (q[:, 0] - p[:, 0])
        odd = np.bincount(one[west], minlength=len(ring)) % 2 == 1
        within = [np.zeros(len(shape), bool), np.zeros(len(shape), bool)]
        for role in (0, 1):
            within[role][owner[odd & (self.role[ring] == role)]] = True
        return within[0] & ~within[1]

    def judged(self, shape: np.ndarray, box: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of cells not apart from a shape's box: 0 apart, 1 in part, 2 within."""
        out = np.ones(len(shape), np.int8)
        rest = np.flatnonzero(~around & (self.closed | ~self.area)[shape])
        cuts = np.searchsorted(np.cumsum(self.count[shape[rest]]), np.arange(_PAIRS, int(self.count[shape[rest]].sum()), _PAIRS))
        for at in np.split(rest, np.unique(cuts)):
            left = at[~self.met(shape[at], box[:, at])]
            out[left] = 0
            left = left[self.area[shape[left]]]
            out[left[self.held(shape[left], box[4, left], box[5, left])]] = 2
        return out

    def below(self, shape: np.ndarray, parent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shape, cell and verdict of the cells of one depth below shapes' parents that aren't apart from their shape."""
        found = []
        for i in range(0, len(shape), _PARENTS):
            own = shape[i : i + _PARENTS, None]
            some, which = np.unique(parent[i : i + _PARENTS], return_inverse=True)
            boxes = [_boxes(int(p), depth) for p in some]
            box, around = np.stack([b for b, _ in boxes], 1), np.stack([a for _, a in boxes])
            apart = (box[2][which] < self.least[own, 0]) | (box[0][which] > self.most[own, 0])
            apart |= ~around[which] & ((box[3][which] < self.least[own, 1]) | (box[1][which] > self.most[own, 1]))
            row, child = np.nonzero(~apart)
            verdict = self.judged(own[row, 0], box[:, which[row], child], around[which[row], child])
            kept = np.flatnonzero(verdict)
            found.append((own[row[kept], 0], some[which[row[kept]]] + (child[kept] << 8 * (cells.LEVELS - depth)), verdict[kept]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cover_shapes(points: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray, roles: np.ndarray, area: np.ndarray, most_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """shape, lo, hi and whether within: sorted ranges of the cells within areas and of those that shapes have a part of.

    points are rows of (lat, lon); a ring is size points from start on, a shape count rings from first on, none empty and
    all in turn. Cells over a pole or the antimeridian and areas with an open ring are never within. A shape's cells in part
    are cut further while they are at most most_cells, those of the first level always. All shapes go down together.
    """
    edges, found = _Edges(points, start, size, first, count, roles, area), []
    shape, parent = np.arange(len(first)), np.zeros(len(first), np.int64)
    for depth in range(1, cells.LEVELS + 1):
        if not len(shape):
            break
        shape, cell, verdict = edges.below(shape, parent, depth)
        n = np.bincount(shape[verdict == 1], minlength=len(first))
        further = (verdict == 1) & (depth < cells.LEVELS) & (n <= (max(most_cells, 256) if depth == 1 else most_cells))[shape]
        found.append((shape[~further], cell[~further], cell[~further] + ((1 << 8 * (cells.LEVELS - depth)) - 1), verdict[~further] == 2))
        shape, parent = shape[further], cell[further]
    shape, lo, hi, whole = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    order = np.lexsort((lo, ~whole, shape))
    shape, lo, hi, whole = shape[order], lo[order], hi[order], whole[order]
    begins = np.ones(len(lo), bool)
    begins[1:] = (shape[1:] != shape[:-1]) | (whole[1:] != whole[:-1]) | (lo[1:] != hi[:-1] + 1)
    ends = np.append(begins[1:], True)[: len(lo)]
    return shape[begins], lo[begins], hi[ends], whole[begins]
