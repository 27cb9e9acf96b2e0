"""Outlines of unions: edges are split where they meet, cell by cell, those with the union on one side are kept and chained into rings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from .graph import components, cut

#: Corners are whole multiples of this length, so that the same corner from two cells is the same number.
SNAP = 1e-6
#: Cells begin off round coordinates, so that their corners are not on anyone's edges.
SHIFT = 0.3819660113
#: Rows of a chunk of groups that a Python call handles.
ROWS = 100_000
#: Edges of a cell above which it is quartered, and how often at most.
CROWDED, DEPTH = 256, 16
#: (point, edge) tests at once.
TESTS = 1 << 20
_RING = "g {g}, xs array<bigint>, ys array<bigint>"


def polygon_edges(df: DataFrame, group: str, polygon: str, rings: str) -> DataFrame:
    """(g, p, x1, y1, x2, y2): the edges of all rings of each polygon, closed whether or not the last corner repeats the first."""
    ring = F.explode(F.col(rings)).alias("ring")
    pairs = F.transform("ring", lambda a, i: F.struct(a.alias("a"), F.get("ring", F.pmod(i + 1, F.size("ring"))).alias("b")))
    flat = df.select(F.col(group).alias("g"), F.col(polygon).alias("p"), ring).select("g", "p", F.explode(pairs).alias("e"))
    xy = [F.col(f"e.{end}.{axis}").cast("double").alias(f"{axis}{i}") for i, end in ((1, "a"), (2, "b")) for axis in "xy"]
    return flat.select("g", "p", *xy).where("x1 <> x2 or y1 <> y2")


def scan_spans(edges: DataFrame, step: float, shift: float, *keys: str) -> DataFrame:
    """Even-odd filling: (keys, row, x_from, x_to), x_from <= x < x_to inside, for the lines y = (row + shift) * step that cross the edges."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = (F.ceil(y / step - shift).cast("long") for y in (low, high))
    crossed = edges.where(last > first).withColumn("row", F.explode(F.sequence(first, last - 1)))
    y = (F.col("row") + F.lit(shift)) * step
    x = F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    rows = crossed.select(*keys, "row", x.alias("x")).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("x_from"), F.get("xs", 2 * i + 1).alias("x_to")))
    return rows.where(F.size("xs") >= 2).select(*keys, "row", F.explode(pairs).alias("s")).select(*keys, "row", "s.x_from", "s.x_to")


def _cells(edges: DataFrame, size: float) -> DataFrame:
    """Each edge in every cell that it runs through, column by column; p at corner = 1 rows say that the polygon holds a cell's lower left corner."""
    at = lambda v: F.floor(v / size - F.lit(SHIFT)).cast("long")
    columns = edges.withColumn("cx", F.explode(F.sequence(at(F.least("x1", "x2") - SNAP), at(F.greatest("x1", "x2") + SNAP))))
    left = (F.col("cx") + F.lit(SHIFT)) * size
    slope = F.when(F.col("x1") != F.col("x2"), (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    y_at = lambda x: F.col("y1") + (F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x)) - F.col("x1")) * slope
    ends = [F.coalesce(y_at(left), F.col("y1")), F.coalesce(y_at(left + size), F.col("y2"))]
    own = columns.withColumn("cy", F.explode(F.sequence(at(F.least(*ends) - SNAP), at(F.greatest(*ends) + SNAP))))
    own = own.select("g", "cx", "cy", "p", "x1", "y1", "x2", "y2", F.lit(False).alias("corner"))
    spans = scan_spans(edges, size, SHIFT, "g", "p")
    first, last = (F.ceil(F.col(c) / size - F.lit(SHIFT)).cast("long") for c in ("x_from", "x_to"))
    held = spans.where(last > first).select("g", F.explode(F.sequence(first, last - 1)).alias("cx"), F.col("row").alias("cy"), "p")
    return own.unionByName(held.select("*", *[F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(True).alias("corner")))


def _covered(x: np.ndarray, y: np.ndarray, e: np.ndarray, starts: np.ndarray, held: np.ndarray, x0: float, y0: float) -> np.ndarray:
    """Whether each point is in any polygon: from the cell's corner along the floor and up, each edge crossed changes sides. e is sorted by
    polygon, starts are where each begins, held says which have the corner."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), max(1, TESTS // len(e))):
        px, py = x[at : at + max(1, TESTS // len(e)), None], y[at : at + max(1, TESTS // len(e)), None]
        x1, y1, x2, y2 = e.T
        with np.errstate(divide="ignore", invalid="ignore"):
            across = ((y1 > y0) != (y2 > y0)) & ((fx := x1 + (y0 - y1) * (x2 - x1) / (y2 - y1)) > x0) & (fx <= px)
            up = ((x1 > px) != (x2 > px)) & ((fy := y1 + (px - x1) * (y2 - y1) / (x2 - x1)) > y0) & (fy <= py)
        odd = np.logical_xor.reduceat(across ^ up, starts, axis=1)
        out[at : at + len(px)] = (odd ^ held).any(1)
    return out


def _splits(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> tuple[np.ndarray, ...]:
    """(edge, t, x, y) of where edges are to be split, in whole steps of SNAP: their ends, the box's sides, and where edges cross or touch; a
    point that two edges share is worked out once."""
    d = e[:, 2:] - e[:, :2]
    n = len(e)
    found = [(np.arange(n), np.zeros(n), e[:, 0], e[:, 1]), (np.arange(n), np.ones(n), e[:, 2], e[:, 3])]
    for axis, side in ((0, x0), (0, x1), (1, y0), (1, y1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (side - e[:, axis]) / d[:, axis]
        at = np.flatnonzero((t > 0) & (t < 1))
        point = e[at, :2] + t[at, None] * d[at]
        point[:, axis] = side
        found.append((at, t[at], point[:, 0], point[:, 1]))
    length = np.hypot(d[:, 0], d[:, 1])
    order = np.argsort(np.minimum(e[:, 0], e[:, 2]), kind="stable")
    lows, highs = np.minimum(e[:, 0], e[:, 2])[order], np.maximum(e[:, 0], e[:, 2])[order]
    ends = np.searchsorted(lows, highs + SNAP, "right")  # partners whose spans of x begin before this one's ends
    counts = ends - np.arange(n) - 1
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), TESTS, "right")) + at)
        i = np.repeat(np.arange(at, stop), counts[at:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts[at:stop]) - counts[at:stop], counts[at:stop])
        i, j = order[i], order[j]
        near = (np.minimum(e[i, 1], e[i, 3]) <= np.maximum(e[j, 1], e[j, 3]) + SNAP) & (np.minimum(e[j, 1], e[j, 3]) <= np.maximum(e[i, 1], e[i, 3]) + SNAP)
        i, j = np.minimum(i[near], j[near]), np.maximum(i[near], j[near])
        for a, b in ((i, j), (j, i)):  # ends of b that are on a
            for end in (0, 2):
                w = e[b, end : end + 2] - e[a, :2]
                off = np.abs(d[a, 0] * w[:, 1] - d[a, 1] * w[:, 0]) / length[a]
                t = (w * d[a]).sum(1) / length[a] ** 2
                on = (off <= SNAP) & (t > 0) & (t < 1)
                found.append((a[on], t[on], e[b[on], end], e[b[on], end + 1]))
        det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        w = e[j, :2] - e[i, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / det, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / det
        on = (np.abs(det) > 1e-12 * length[i] * length[j]) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        point = e[i[on], :2] + t[on, None] * d[i[on]]
        for edge, along in ((i[on], t[on]), (j[on], u[on])):
            found.append((edge, along, point[:, 0], point[:, 1]))
        at = stop
    edge, t, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return edge, t, np.rint(x / SNAP).astype(np.int64), np.rint(y / SNAP).astype(np.int64)


def _arranged(p: np.ndarray, e: np.ndarray, corners: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The parts of the edges in a box that have the union on one side, which is their left."""
    none = np.empty((0, 4), np.int64)
    names, of = np.unique(p, return_inverse=True)
    if len(corners) and not np.isin(corners, names).all():  # a polygon covers the whole cell
        return none
    order = np.argsort(of, kind="stable")
    e, starts, held = e[order], np.searchsorted(of[order], np.arange(len(names))), np.isin(names, corners)
    edge, t, x, y = _splits(e, x0, y0, x1, y1)
    by = np.lexsort((t, edge))
    edge, x, y = edge[by], x[by], y[by]
    step = (edge[1:] == edge[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    a, b = np.stack([x[:-1], y[:-1]], 1)[step], np.stack([x[1:], y[1:]], 1)[step]
    middle = (a + b) * (SNAP / 2)
    inside = (middle[:, 0] >= x0) & (middle[:, 0] < x1) & (middle[:, 1] >= y0) & (middle[:, 1] < y1)
    a, b = a[inside], b[inside]
    if not len(a):
        return none
    turn = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    parts = np.unique(np.where(turn[:, None], np.hstack([b, a]), np.hstack([a, b])), axis=0)
    d = (parts[:, 2:] - parts[:, :2]).astype(float)
    middle = (parts[:, :2] + parts[:, 2:]) * (SNAP / 2)
    normal = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None] * (8 * SNAP)
    left, right = (_covered(middle[:, 0] + s * normal[:, 0], middle[:, 1] + s * normal[:, 1], e, starts, held, x0, y0) for s in (1, -1))
    return np.vstack([parts[left & ~right], parts[right & ~left][:, [2, 3, 0, 1]]])


def _different(p: np.ndarray, e: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p and e without the edges of polygons that have the same edges here, and the corner or not, as another: they cover the same."""
    order = np.argsort(p, kind="stable")
    p, e = p[order], e[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    mixed = np.full(len(p), 0x9E3779B97F4A7C15, np.uint64)
    for axis in range(4):
        mixed = (mixed ^ (e[:, axis] + 0.0).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    sums = np.stack([np.add.reduceat(mixed, starts), np.add.reduceat(mixed * mixed, starts), np.isin(p[starts], corners).astype(np.uint64)], 1)
    first = np.unique(sums, axis=0, return_index=True)[1]
    kept = np.isin(p, p[starts[first]])
    return p[kept], e[kept]


def _quarters(p: np.ndarray, e: np.ndarray, corners: np.ndarray, x0: float, y0: float, x1: float, y1: float, depth: int = 0) -> Iterator[np.ndarray]:
    """_arranged() of a box, quarter by quarter while it has over CROWDED edges. A quarter that a polygon covers ends there, so of many polygons
    that lie over one another only what is near the outline is worked out."""
    if len(corners) and not np.isin(corners, p).all():  # a polygon covers all of it
        return
    if len(e) > CROWDED:
        p, e = _different(p, e, corners)
        corners = corners[np.isin(corners, p)]
    if not len(e):
        return
    if len(e) <= CROWDED or depth == DEPTH or min(x1 - x0, y1 - y0) < 1000 * SNAP:
        yield _arranged(p, e, corners, x0, y0, x1, y1)
        return
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    order = np.argsort(p, kind="stable")
    p, e = p[order], e[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    names = p[starts]
    held = np.isin(names, corners)
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    for left, right, floor, top in ((x0, xm, y0, ym), (xm, x1, y0, ym), (x0, xm, ym, y1), (xm, x1, ym, y1)):
        own = names[_held_at(left, floor, e, starts, held, x0, y0)]
        here = (low[:, 0] <= right + SNAP) & (high[:, 0] >= left - SNAP) & (low[:, 1] <= top + SNAP) & (high[:, 1] >= floor - SNAP)
        yield from _quarters(p[here], e[here], own, left, floor, right, top, depth + 1)


def _held_at(px: float, py: float, e: np.ndarray, starts: np.ndarray, held: np.ndarray, x0: float, y0: float) -> np.ndarray:
    """Which polygons hold a point, from those that hold the corner, see _covered()."""
    a1, b1, a2, b2 = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        across = ((b1 > y0) != (b2 > y0)) & ((fx := a1 + (y0 - b1) * (a2 - a1) / (b2 - b1)) > x0) & (fx <= px)
        up = ((a1 > px) != (a2 > px)) & ((fy := b1 + (px - a1) * (b2 - b1) / (a2 - a1)) > y0) & (fy <= py)
    return np.logical_xor.reduceat(across ^ up, starts) ^ held


def _chunks(df: DataFrame, *keys: str) -> DataFrame:
    """df with a column of chunks of about ROWS rows; rows that are equal in the keys share a chunk."""
    return df.withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.lit(max(1, math.ceil(df.count() / ROWS)))))


def _kind(df: DataFrame) -> str:
    return df.schema["g"].dataType.simpleString()


def union_edges(edges: DataFrame, size: float) -> DataFrame:
    """(g, p, x1, y1, x2, y2) -> (g, x1, y1, x2, y2 in steps of SNAP): the outline of the union of each group's polygons, the union on its left. Each cell
    of the given size is worked on by itself, whatever the group's extent; it has the edges that run through it and which polygons hold
    its corner, which says of every point in it whether it is inside."""
    celled = cut(_cells(edges, size))

    def arrange(frame: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(frame["g"], use_na_sentinel=False)[0]
        corner, p = frame["corner"].to_numpy(bool), pd.factorize(frame["p"], use_na_sentinel=False)[0]
        cx, cy, e = frame["cx"].to_numpy(np.int64), frame["cy"].to_numpy(np.int64), frame[["x1", "y1", "x2", "y2"]].to_numpy(float)
        order = np.lexsort((corner, cy, cx, code))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(code[order]) != 0) | (np.diff(cx[order]) != 0) | (np.diff(cy[order]) != 0)]))
        found, at = [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)]
        for own in np.split(order, new[1:]):
            n = int((~corner[own]).sum())  # edges stand before corners
            if n:
                x0, y0, x1, y1 = (float((c + SHIFT) * size) for c in (cx[own[0]], cy[own[0]], cx[own[0]] + 1, cy[own[0]] + 1))
                for part in _quarters(p[own[:n]], e[own[:n]], p[own[n:]], x0, y0, x1, y1):
                    found.append(part)
                    at.append(np.full(len(part), own[0]))
        out = pd.DataFrame(np.vstack(found), columns=["x1", "y1", "x2", "y2"])
        out.insert(0, "g", frame["g"].iloc[np.concatenate(at)].to_numpy())
        return out

    return _chunks(celled, "g", "cx", "cy").groupBy("_chunk").applyInPandas(arrange, f"g {_kind(edges)}, x1 long, y1 long, x2 long, y2 long")


# rings -------------------------------------------------------------------------------------------------------------------


def _followers(frame: pd.DataFrame, join: bool) -> tuple[np.ndarray, np.ndarray]:
    """(after, stubs): for each row the row of the edge that goes on from its end, -1 if it isn't here. Where several edges leave a corner, the
    one next to the edge that comes in: clockwise, so that what only touches there is kept apart, or with `join` the other way."""
    own = frame["own"].to_numpy(bool)
    g = pd.factorize(frame["g"], use_na_sentinel=False)[0]
    x1, y1, x2, y2 = (frame[c].to_numpy(np.int64) for c in ("x1", "y1", "x2", "y2"))
    xs, ys = np.unique(np.concatenate([x1, x2])), np.unique(np.concatenate([y1, y2]))
    code = lambda x, y: (g * len(xs) + np.searchsorted(xs, x)) * len(ys) + np.searchsorted(ys, y)
    start, end = code(x1, y1), code(x2, y2)
    out = np.flatnonzero(own)
    out = out[np.argsort(start[out], kind="stable")]
    low, high = np.searchsorted(start[out], end), np.searchsorted(start[out], end, "right")
    after = np.where(high > low, out[np.minimum(low, len(out) - 1)] if len(out) else -1, -1)
    for row in np.flatnonzero(high - low > 1):
        back = math.atan2(y1[row] - y2[row], x1[row] - x2[row])
        leaving = out[low[row] : high[row]]
        turns = [(back - a if not join else a - back) % (2 * math.pi) or 2 * math.pi for a in (math.atan2(y2[k] - y1[k], x2[k] - x1[k]) for k in leaving)]
        after[row] = leaving[int(np.argmin(turns))]
    return after, own


def _chained(frame: pd.DataFrame, join: bool) -> Iterator[tuple]:
    """(g, kind, head, tail, xs, ys) of one chunk's edges: whole rings, paths that go on elsewhere, and which path goes on from an edge elsewhere."""
    here = set(frame.loc[frame["own"], "id"])
    frame = frame[frame["own"] | ~frame["id"].isin(here)].reset_index(drop=True)
    after, own = _followers(frame, join)
    g, ids = frame["g"].to_numpy(), frame["id"].to_numpy(np.int64)
    x, y = frame["x1"].to_numpy(np.int64), frame["y1"].to_numpy(np.int64)
    for row in np.flatnonzero(~own & (after >= 0)):
        yield g[row], "link", int(ids[after[row]]), int(ids[row]), None, None
    entered = np.zeros(len(frame), bool)
    entered[after[own & (after >= 0)]] = True
    done = ~own
    for first in [*np.flatnonzero(own & ~entered), *np.flatnonzero(own)]:
        if not done[first]:
            path, row = [], first
            while row >= 0 and not done[row]:
                done[row] = True
                path.append(row)
                row = after[row]
            closed = entered[first] and row == first
            yield g[first], "ring" if closed else "path", int(ids[first]), int(ids[path[-1]]), x[path], y[path]


def _tidy(x: np.ndarray, y: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """A ring without corners that are no more than `slack` off the line between their neighbours, from its lowest, leftmost corner."""
    while len(x) > 3:
        ax, ay, bx, by = np.roll(x, 1) - x, np.roll(y, 1) - y, np.roll(x, -1) - x, np.roll(y, -1) - y
        chord = np.hypot((bx - ax).astype(float), (by - ay).astype(float))
        off = np.abs(ax.astype(float) * by - ay.astype(float) * bx) / np.maximum(chord, 1e-300)
        flat = (off <= slack) & (ax.astype(float) * bx + ay.astype(float) * by < 0)
        if slack:  # of neighbours only every other, as each is held against the corners that stay
            flat &= ~(np.roll(flat, 1) & (np.arange(len(x)) % 2 == 1)) | (np.arange(len(x)) % 2 == 0)
            flat &= ~np.roll(flat, 1)
        if not flat.any() or len(x) - flat.sum() < 3:
            break
        x, y = x[~flat], y[~flat]
    first = np.lexsort((x, y))[0]
    return np.roll(x, -first), np.roll(y, -first)


def stitch_rings(edges: DataFrame, tile: int, join: bool = False, slack: float = 0.0) -> DataFrame:
    """(g, x1, y1, x2, y2 long) -> (g, xs, ys): directed edges that form closed outlines, chained into rings, each a row from its lowest, leftmost corner;
    corners on a straight line are left out. With `join` what touches in a corner is one ring, else it is kept apart.

    Edges are chained within tiles; a tile also gets the edges that end in it, so it settles every corner in it. Paths that leave their tile
    are joined through components of paths, so only these are compared between tasks. A ring is a row and so one task's."""
    kind = _kind(edges)
    numbered = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    at = lambda n: [F.floor(F.col(f"{axis}{n}") / tile - F.lit(SHIFT)).alias(f"t{axis}") for axis in "xy"]
    columns = ["g", "id", "x1", "y1", "x2", "y2"]
    own = numbered.select(*columns, F.lit(True).alias("own"), *at(1))
    stubs = numbered.select(*columns, F.lit(False).alias("own"), *at(2), *[c.alias(f"_{n}") for n, c in zip("xy", at(1), strict=True)]).where("tx <> _x or ty <> _y").drop("_x", "_y")
    tiled = _chunks(own.union(stubs), "g", "tx", "ty")
    names = ["g", "kind", "head", "tail", "xs", "ys"]

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(*r[:4], *_tidy(r[4], r[5], slack)) if r[1] == "ring" else r for r in _chained(frame, join)]
        return pd.DataFrame(rows, columns=names)

    chained = cut(tiled.groupBy("_chunk").applyInPandas(chain, f"g {kind}, kind string, head long, tail long, xs array<bigint>, ys array<bigint>"))
    rings = chained.where("kind = 'ring'").select("g", "xs", "ys")
    paths = chained.where("kind = 'path'").drop("kind")
    if paths.isEmpty():
        return rings
    links = chained.where("kind = 'link'").select(F.col("tail").alias("_tail"), F.col("head").alias("next"))
    onward = cut(paths.join(links, F.col("tail") == F.col("_tail")).drop("_tail"))
    groups = components(onward.select(F.col("head").alias("node")), onward.select(F.col("head").alias("a"), F.col("next").alias("b")))

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        rows = {r.head: r for r in frame.itertuples()}
        found = []
        while rows:
            head, xs, ys = next(iter(rows)), [], []
            while head in rows:
                r = rows.pop(head)
                xs.append(r.xs)
                ys.append(r.ys)
                head = r.next
            found.append((r.g, *_tidy(np.concatenate(xs), np.concatenate(ys), slack)))
        return pd.DataFrame(found, columns=["g", "xs", "ys"])

    joined = onward.join(groups, F.col("head") == F.col("node")).groupBy("component").applyInPandas(close, _RING.format(g=kind))
    return rings.union(joined)


def ring_points(scale: float = 1.0) -> Column:
    """xs and ys as an array of struct(x, y)."""
    return F.zip_with("xs", "ys", lambda x, y: F.struct((x * F.lit(scale)).alias("x"), (y * F.lit(scale)).alias("y")))


def signed_area(ring: Column) -> Column:
    """Positive for rings that have what they bound on their left, as x goes right and y up. Corners are taken relative to the first."""
    a = ring[0]
    cross = F.transform(ring, lambda p, i: (p["x"] - a["x"]) * (F.get(ring, F.pmod(i + 1, F.size(ring)))["y"] - a["y"]) - (F.get(ring, F.pmod(i + 1, F.size(ring)))["x"] - a["x"]) * (p["y"] - a["y"]))
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def parts(rings: DataFrame, size: float) -> DataFrame:
    """(g, ring) of struct(x, y) -> (g, rings, area): a row for each outer ring with the holes that it is the smallest to hold. Holes meet the outer rings
    in cells of the given size: the hole in that of its first corner, outer rings in all that their bounds cover."""
    signed = cut(rings.withColumn("signed", signed_area(F.col("ring"))).withColumn("id", F.monotonically_increasing_id()))
    outer, holes = signed.where("signed > 0"), signed.where("signed < 0")
    at = lambda v: F.floor(v / size).cast("long")
    box = G.bounds(F.col("ring"))
    covers = outer.withColumn("box", box).withColumn("cx", F.explode(F.sequence(at(F.col("box.xmin")), at(F.col("box.xmax"))))).withColumn("cy", F.explode(F.sequence(at(F.col("box.ymin")), at(F.col("box.ymax")))))
    covers = covers.select(F.col("g").alias("_g"), "cx", "cy", F.col("id").alias("outer_id"), F.col("ring").alias("outer"), F.col("signed").alias("outer_area"), "box")
    # a point just off the hole's first corner, within the hole: on the line that halves the angle there
    a, b, c = F.col("ring")[0], F.col("ring")[1], F.element_at("ring", -1)
    length = lambda p: F.sqrt(F.pow(p["x"] - a["x"], F.lit(2)) + F.pow(p["y"] - a["y"], F.lit(2)))
    off = lambda k: a[k] + ((b[k] - a[k]) / length(b) + (c[k] - a[k]) / length(c)) * F.lit(4 * SNAP)
    inner = holes.withColumn("spot", F.struct(off("x").alias("x"), off("y").alias("y"))).withColumn("cx", at(F.col("spot.x"))).withColumn("cy", at(F.col("spot.y")))
    within = (F.col("spot.x").between(F.col("box.xmin"), F.col("box.xmax"))) & (F.col("spot.y").between(F.col("box.ymin"), F.col("box.ymax")))
    held = inner.join(covers, (F.col("g").eqNullSafe(F.col("_g"))) & (inner.cx == covers.cx) & (inner.cy == covers.cy) & within).where(G.point_in_ring(F.col("spot"), F.col("outer")))
    chosen = held.groupBy("id").agg(F.min_by("outer_id", F.struct("outer_area", "outer_id")).alias("outer_id"), F.first("ring").alias("ring"), F.first("signed").alias("signed"))
    by_outer = chosen.groupBy(F.col("outer_id").alias("_id")).agg(F.array_sort(F.collect_list("ring")).alias("holes"), F.sum("signed").alias("less"))
    whole = outer.join(by_outer, F.col("id") == F.col("_id"), "left")
    return whole.select("g", F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(whole.schema["holes"].dataType))).alias("rings"), (F.col("signed") + F.coalesce("less", F.lit(0.0))).alias("area"))


def dissolve(polygons: DataFrame, group: str, polygon: str, rings: str, size: float) -> DataFrame:
    """The union of each group's polygons, part by part: (g, rings, area). size: of the cells that are worked on one by one, some edges each; parts
    that touch in a corner stay apart. A group may be the whole table: no task holds one, only its cells."""
    return dissolve_edges(polygon_edges(polygons, group, polygon, rings), size)


def dissolve_edges(edges: DataFrame, size: float) -> DataFrame:
    outline = union_edges(edges, size)
    rings = stitch_rings(outline, max(1, int(size / SNAP)) * 8, slack=2.0)
    return parts(rings.select("g", ring_points(SNAP).alias("ring")), size * 8)


# buffers -----------------------------------------------------------------------------------------------------------------


def _offset_pieces(rings: list, radius: float, segments: int) -> Iterator[np.ndarray]:
    """Polygons whose union with the polygon itself is what is within the radius of it: a rectangle outwards of every edge and a fan of a
    right angle's `segments` parts at every corner that points outwards."""
    for k, ring in enumerate(rings):
        pts = np.array([(p["x"], p["y"]) for p in ring], float)
        pts = pts[np.concatenate([[True], (pts[1:] != pts[:-1]).any(1)])]
        if len(pts) > 1 and (pts[0] == pts[-1]).all():
            pts = pts[:-1]
        if len(pts) < 3:
            continue
        after = np.roll(pts, -1, 0)
        twice = (pts[:, 0] * after[:, 1] - after[:, 0] * pts[:, 1]).sum()
        if (twice < 0) == (k == 0):  # outer rings run with the inside on the left, and so do holes the other way
            pts = pts[::-1]
            after = np.roll(pts, -1, 0)
        d = after - pts
        out = np.stack([d[:, 1], -d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None] * radius
        for a, b, o in zip(pts, after, out, strict=True):
            yield np.array([a, a + o, b + o, b])
        before = np.roll(out, 1, 0)
        for a, o1, o2 in zip(pts, before, out, strict=True):
            angle = math.atan2(o1[0] * o2[1] - o1[1] * o2[0], o1 @ o2)
            if angle > 1e-12:
                n = max(1, int(angle / (math.pi / 2 / segments) + 0.5))
                turns = math.atan2(o1[1], o1[0]) + angle * np.arange(1, n) / n
                arc = np.stack([np.cos(turns), np.sin(turns)], 1) * radius
                yield np.vstack([a, a + o1, a + arc, a + o2])


def buffered(polygons: DataFrame, key: str, rings: str, radius: float, size: float, segments: int = 16) -> DataFrame:
    """(g, rings, area): each polygon grown by the radius with round corners, as polygons; concave corners, holes and parts that close up come out
    right, as a buffer is the union of simple pieces. The key must tell polygons apart. Polygons of equal rings are grown once."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, row, part = [np.empty((0, 4))], [], []
            for at, own in enumerate(batch["rings"]):
                for p, piece in enumerate(_offset_pieces(list(own) if own is not None else [], radius, segments), 1):
                    found.append(np.hstack([piece, np.roll(piece, -1, 0)]))
                    row += [at] * len(piece)
                    part += [p] * len(piece)
            out = pd.DataFrame(np.vstack(found), columns=["x1", "y1", "x2", "y2"])
            out.insert(0, "p", part)
            out.insert(0, "g", batch["g"].iloc[row].to_numpy())
            yield out

    spark = polygons.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = polygons.select(F.col(key).alias("g"), F.col(rings).alias("rings"))
    named = cut(each.where(F.col("rings").isNotNull()).groupBy("rings").agg(F.count(F.lit(1)).alias("_n")).select(F.monotonically_increasing_id().alias("g"), "rings"))
    shapes = named.select(F.col("g").alias("_shape"), F.col("rings").alias("_rings"))
    named = named.repartition(tasks, "g")  # each grows a hundredfold
    around = named.mapInPandas(edges, f"g {_kind(named)}, p long, x1 double, y1 double, x2 double, y2 double").where("x1 <> x2 or y1 <> y2")
    grown = dissolve_edges(polygon_edges(named.withColumn("p", F.lit(0).cast("long")), "g", "p", "rings").union(around), size)
    grown = cut(shapes.join(grown.withColumnRenamed("g", "_of"), F.col("_shape") == F.col("_of")).select("_rings", F.col("rings").alias("_grown"), "area"))
    return each.join(grown, F.col("rings") == F.col("_rings")).select("g", F.col("_grown").alias("rings"), "area")


def point_buffer(point: Column, radius: float, segments: int = 16, square: bool = False) -> Column:
    """The ring around a point: a polygon of 4 * segments corners, or a square with sides along the axes."""
    if square:
        return G.box_ring(point["x"] - radius, point["y"] - radius, point["x"] + radius, point["y"] + radius)
    turn = lambda i: F.pmod(i, F.lit(4 * segments)) * F.lit(math.pi / (2 * segments))
    return F.transform(F.sequence(F.lit(0), F.lit(4 * segments)), lambda i: F.struct((point["x"] + F.cos(turn(i)) * radius).alias("x"), (point["y"] + F.sin(turn(i)) * radius).alias("y")))


def points_within(points: DataFrame, key: str, point: str, edges: DataFrame, size: float) -> DataFrame:
    """(g, p, key) of the points in each polygon of edges (g, p, x1, y1, x2, y2), even-odd, whatever the polygons' extent: a point meets the edges of its
    cell alone, and whether the polygon holds the cell's corner; each edge crossed from there changes sides."""
    at = lambda axis: F.floor(F.col(f"{point}.{axis}") / size - F.lit(SHIFT)).cast("long")
    own = points.select(F.col(key).alias("_key"), F.col(f"{point}.x").alias("_x"), F.col(f"{point}.y").alias("_y"), at("x").alias("cx"), at("y").alias("cy"))
    x0, y0 = ((F.col(c) + F.lit(SHIFT)) * size for c in ("cx", "cy"))
    met = own.join(_cells(edges, size), ["cx", "cy"])
    fx = F.col("x1") + (y0 - F.col("y1")) * ((F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    fy = F.col("y1") + (F.col("_x") - F.col("x1")) * ((F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    across = ((F.col("y1") > y0) != (F.col("y2") > y0)) & (fx > x0) & (fx <= F.col("_x"))
    up = ((F.col("x1") > F.col("_x")) != (F.col("x2") > F.col("_x"))) & (fy > y0) & (fy <= F.col("_y"))
    turns = F.when(F.col("corner"), 1).otherwise(F.coalesce(across.cast("int"), F.lit(0)) + F.coalesce(up.cast("int"), F.lit(0)))
    return met.groupBy("g", "p", F.col("_key").alias(key)).agg(F.sum(turns).alias("turns")).where("turns % 2 = 1").drop("turns")
