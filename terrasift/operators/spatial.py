"""Joins by distance, as equi-joins over grid cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance
from .graph import components, cut


#: Rows of a key that meet in one task on either side, and right points of a cell in the first ring of a nearest search.
BLOCK, CROWD = 2_000, 16
#: Rows of either side that a task holds as arrays.
ARRAY_BLOCK = 20_000


def _dealt(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], block: int) -> tuple[DataFrame, DataFrame]:
    """left with _00 and _01, right with _10 and _11: rows of equal keys meet once where _00 = _10 and _01 = _11. A key with over `block` rows on a side is dealt
    out in blocks on both, each two of which meet by themselves. What is broadcast is a row a crowded key, no more than rows / block."""
    size = lambda df, side: df.groupBy(*[F.col(k[side]).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(f"_n{side}"))
    blocks = lambda side: F.ceil(F.col(f"_n{side}") / block).cast("int").alias(f"_b{side}")
    names = [f"_k{i}" for i in range(len(keys))]
    crowded = size(left, 0).join(size(right, 1), names).where((F.col("_n0") > block) | (F.col("_n1") > block)).select(*names, blocks(0), blocks(1))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.coalesce(f"_b{1 - side}", F.lit(1)) - 1))
        own = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"_b{side}", F.lit(1))).cast("int")
        met = df.join(F.broadcast(crowded), _all([F.col(k[side]) == F.col(n) for k, n in zip(keys, names, strict=True)]), "left")
        return met.select(*df.columns, own.alias(f"_{side}{side}"), other.alias(f"_{side}{1 - side}"))

    return dealt(left, 0), dealt(right, 1)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], on: Column | None = None) -> DataFrame:
    """left and right, whose columns differ, joined where every (left, right) pair of keys is equal and `on` holds.

    For joins that make many pairs of few bytes, which Spark would put in one task by their size. Crowded keys are dealt out in blocks of BLOCK rows, so
    no task's part grows with one key."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near, there = (df.repartition(parts, *[k[side] for k in keys], f"_{side}0", f"_{side}1") for side, df in enumerate(_dealt(left, right, keys, BLOCK)))
    same = _all([F.col(a) == F.col(b) for a, b in keys] + [F.col("_00") == F.col("_10"), F.col("_01") == F.col("_11")])
    return near.join(there, same if on is None else same & on).drop("_00", "_01", "_10", "_11")


def met_in_blocks(left: DataFrame, right: DataFrame, radius: float, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What meet(left rows, right rows) gives for blocks of points (x, y, ...) such that each two of them no farther apart than radius are in one call and one only.

    For what is said of all pairs where the pairs themselves are not asked for: a task works them off as arrays, and holds ARRAY_BLOCK rows a side. Points
    without a coordinate meet nothing."""
    at = lambda df: df.where("x is not null and y is not null").select("*", F.struct("x", "y").alias("_p"))
    near, there = _in_cell(at(left), "_p", radius, "_l").drop("_p"), _in_nine(at(right), "_p", radius, "_r").drop("_p")
    a, b = _dealt(near, there, [("_lx", "_rx"), ("_ly", "_ry")], ARRAY_BLOCK)
    names = [f"_key{i}" for i in range(4)]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = lambda df, *keys: df.withColumnsRenamed(dict(zip(keys, names, strict=True))).repartition(parts, *names).groupBy(*names)
    return grouped(a, "_lx", "_ly", "_00", "_01").cogroup(grouped(b, "_rx", "_ry", "_10", "_11")).applyInArrow(meet, schema)


def chunks(x: np.ndarray, y: np.ndarray, size: int = 128) -> Iterator[np.ndarray]:
    """Places of points, those of a chunk near each other."""
    if len(x):
        rows = max(1, int(np.sqrt(len(x) / size)))
        low, high = y.min(), y.max()
        strip = np.minimum((y - low) * (rows / (high - low)), rows - 1).astype(int) if high > low else np.zeros(len(y), int)
        order = np.lexsort((x, strip))
        yield from (order[i : i + size] for i in range(0, len(order), size))


def within_bounds(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
    """Places of the points (x, y) that may be no farther than reach from one of the points (px, py)."""
    dx, dy = (np.maximum(0.0, np.maximum(p.min() - v, v - p.max())) for p, v in ((px, x), (py, y)))
    return np.flatnonzero(np.maximum(dx, dy) <= reach)


def _all(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole & c
    return whole


def _in_cell(df: DataFrame, point: str, size: float | Column, prefix: str) -> DataFrame:
    return df.withColumn(f"{prefix}x", F.floor(F.col(point)["x"] / size)).withColumn(f"{prefix}y", F.floor(F.col(point)["y"] / size))


def _in_nine(df: DataFrame, point: str, size: float | Column, prefix: str) -> DataFrame:
    """A row for each of the 9 cells around."""
    around = lambda c: F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.col(f"{prefix}{c}") + d))
    return _in_cell(df, point, size, prefix).withColumn(f"{prefix}x", around("x")).withColumn(f"{prefix}y", around("y"))


def distance_join(left: DataFrame, right: DataFrame, radius: float, left_point: str = "point", right_point: str = "other_point", how: Column | None = None) -> DataFrame:
    """All pairs no farther apart than radius, with distance_m. Columns of the sides must differ.

    The left goes to its 9 neighbouring cells of the radius, the right to its own, so a pair meets once; crowded cells are dealt out."""
    away = distance(F.col(left_point), F.col(right_point))
    near, there = _in_nine(left, left_point, radius, "_l"), _in_cell(right, right_point, radius, "_r")
    on = away <= radius if how is None else (away <= radius) & how
    return dealt_join(near, there, [("_lx", "_rx"), ("_ly", "_ry")], on).withColumn("distance_m", away).drop("_lx", "_ly", "_rx", "_ry")


def near_components(points: DataFrame, key: str, point: str, radius: float) -> DataFrame:
    """(node, component) of the points that chains of steps no longer than the radius join, as components() of all pairs within it, which are not made.

    Points of one cell, whose diagonal is below the radius, are one group. Cells up to two apart are linked if any two of their outermost points are near; only
    those that are in different groups even then are looked at point by point, and of these only points near the other cell's bounds."""
    size = radius * 0.7
    spots = cut(_in_cell(points.select(F.col(key).alias("node"), F.struct((F.col(point)["x"]).alias("x"), (F.col(point)["y"]).alias("y")).alias("p")), "p", size, "c"))
    x, y = F.col("p.x"), F.col("p.y")
    outermost = [f("p", by) for by in (x, y, x + y, x - y) for f in (F.min_by, F.max_by)]
    cells = spots.where("cx is not null and cy is not null").groupBy("cx", "cy").agg(F.min("node").alias("rep"), F.array_distinct(F.array(*outermost)).alias("out"), F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
    cells = cut(cells)
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if i or j > 0]
    a = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns], F.explode(F.array(*steps)).alias("s"))
    b = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns])
    pairs = cut(a.join(b, (F.col("a_cx") + F.col("s.i") == F.col("b_cx")) & (F.col("a_cy") + F.col("s.j") == F.col("b_cy"))).drop("s"))
    near = F.exists("a_out", lambda p: F.exists("b_out", lambda q: distance(p, q) <= radius))
    groups = components(cells.select(F.col("rep").alias("node")), pairs.where(near).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    of = lambda side: groups.select(F.col("node").alias(f"{side}_rep"), F.col("component").alias(f"{side}_g"))
    apart = cut(pairs.join(of("a"), "a_rep").join(of("b"), "b_rep").where("a_g <> b_g").drop("a_out", "b_out"))
    if not apart.isEmpty():
        keys = ["a_cx", "a_cy", "b_cx", "b_cy"]

        def side(own: str, other: str) -> DataFrame:
            met = apart.select(*[F.col(k).alias(f"{own}{k}") for k in keys], F.col(f"{own}_g").alias(f"g{own}"), *[F.col(f"{other}_{c}").alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
            met = spots.join(met, (F.col("cx") == F.col(f"{own}{own}_cx")) & (F.col("cy") == F.col(f"{own}{own}_cy")))
            dx, dy = (F.greatest(F.lit(0.0), F.col(f"_{axis}min") - F.col(f"p.{axis}"), F.col(f"p.{axis}") - F.col(f"_{axis}max")) for axis in "xy")
            return met.where(F.sqrt(dx * dx + dy * dy) <= radius * (1 + 1e-9)).select(*[f"{own}{k}" for k in keys], f"g{own}", F.col("p").alias(f"p{own}"))

        links = dealt_join(side("a", "b"), side("b", "a"), [(f"a{k}", f"b{k}") for k in keys], distance(F.col("pa"), F.col("pb")) <= radius)
        more = components(groups.select(F.col("component").alias("node")), links.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
        groups = groups.join(more.select(F.col("node").alias("_g"), F.col("component").alias("_c")), F.col("component") == F.col("_g")).select("node", F.col("_c").alias("component"))
    known = cells.select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "rep").join(groups.select(F.col("node").alias("rep"), "component"), "rep").drop("rep")
    labelled = spots.join(known, (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")), "left")
    return cut(labelled.select("node", F.coalesce("component", "node").alias("component")).distinct())


def k_nearest(left: DataFrame, right: DataFrame, key: str, other_key: str, k: int, first_radius: float, last_radius: float, grow: float = 4.0) -> DataFrame:
    """(key, other_key, distance_m, rank): the k nearest right points of every left point no farther than last_radius, ties by smallest other_key.

    Equal points of a side are one. Rings grow from a radius at which no cell holds over CROWD right points, at most first_radius; only points that found
    fewer than k take part in the next one, for any point outside the radius is farther, so what is looked at doesn't grow with the density. A table of the
    largest number of points in a cell for each of 8 radii reaches the driver."""
    at = lambda df, point: df.where(F.col(point).isNotNull()).select((F.col(point)["x"] + 0.0).alias("x"), (F.col(point)["y"] + 0.0).alias("y"), *[c for c in (key, other_key) if c in df.columns])
    by_point = Window.partitionBy("x", "y").orderBy(other_key)
    few = at(right, "other_point").distinct().withColumn("_n", F.row_number().over(by_point)).where(F.col("_n") <= k)
    places = cut(few.groupBy("x", "y").agg(F.array_sort(F.collect_list(other_key)).alias("_others")).select(F.struct("x", "y").alias("other_point"), "_others"))
    mine = at(left, "point")
    open_ = cut(mine.select(F.struct("x", "y").alias("point")).distinct())
    radii = [first_radius / grow**i for i in range(8)]
    per_cell = places.withColumn("_r", F.explode(F.array(*[F.lit(r) for r in radii])))
    per_cell = _in_cell(per_cell, "other_point", F.col("_r"), "_c").groupBy("_r", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).groupBy("_r").agg(F.max("_n").alias("_n")).collect()
    radius = max([r["_r"] for r in per_cell if r["_n"] <= CROWD], default=radii[-1])
    found = None
    while per_cell:
        radius = min(radius, last_radius)
        hits = distance_join(open_, places, radius).select("point", "distance_m", F.explode("_others").alias(other_key))
        best = cut(rank_by_distance(hits, "point", other_key, k))
        done = best.where(F.col("rank") == k).select("point") if radius < last_radius else open_
        ended = best if radius >= last_radius else best.join(done, "point", "left_semi")
        found = ended if found is None else found.union(ended)
        if radius >= last_radius:
            break
        open_ = cut(open_.join(done, "point", "left_anti"))
        if open_.isEmpty():
            break
        radius *= grow
    if found is None:
        return left.crossJoin(right.select(other_key)).select(key, other_key, F.lit(0.0).alias("distance_m"), F.lit(1).alias("rank")).where(F.lit(False))  # the right has no point
    return mine.select(key, F.struct("x", "y").alias("point")).join(found, "point").select(key, other_key, "distance_m", "rank")


def nearest(left: DataFrame, right: DataFrame, key: str, other_key: str, first_radius: float, max_rounds: int = 12) -> DataFrame:
    """The nearest right point of every left point (ties: smallest other_key): other_key and distance_m, null if right is empty.

    A point farther than the last ring from everything (first_radius * 4 ** (max_rounds - 1)) stays without a neighbour."""
    found = k_nearest(left, right, key, other_key, 1, first_radius, first_radius * 4.0 ** (max_rounds - 1))
    return left.join(found.select(key, other_key, "distance_m").distinct(), key, "left")


def within_unit_radius(units: DataFrame, items: DataFrame, zone: str, radius: str) -> DataFrame:
    """Items of the unit's zone no farther from it than the unit's own radius.

    A unit goes to the 9 cells around it of the least power of two that is no less than its radius, an item to its cell of each of the powers that occur:
    these are broadcast, and there are no more than a double has exponents."""
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(radius), F.lit(1e-6)))))
    away = distance(F.col("point"), F.col("other_point"))
    sized = units.where(F.col(radius) >= 0).withColumn("_size", size)
    near = _in_nine(sized, "point", F.col("_size"), "_l")
    there = _in_cell(items.withColumnRenamed(zone, "_zone").join(F.broadcast(sized.select(F.col("_size").alias("_of")).distinct())), "other_point", F.col("_of"), "_r")
    pairs = dealt_join(near, there, [(zone, "_zone"), ("_size", "_of"), ("_lx", "_rx"), ("_ly", "_ry")], away <= F.col(radius))
    return pairs.withColumn("distance_m", away).drop("_zone", "_size", "_of", "_lx", "_ly", "_rx", "_ry")


def box_meetings(left: DataFrame, right: DataFrame, size: float, reach: float = 0.0, on: Column | None = None) -> DataFrame:
    """Pairs (a, b) of a box of the left and one of the right whose bounds, grown by reach, meet and for which `on` holds: struct columns with all columns of each.

    A box goes to all cells that it covers; a pair is made in the cell of the lower left corner of what they share."""

    def cells(boxes: DataFrame, n: str) -> DataFrame:
        grown = F.struct(*[(F.col(f"box.{s}") + d * reach / 2).alias(s) for s, d in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))])
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"g{n}.{low}") / size), F.floor(F.col(f"g{n}.{high}") / size)))
        return boxes.select(F.struct(*boxes.columns).alias(n), grown.alias(f"g{n}")).withColumn(f"cx{n}", span("xmin", "xmax")).withColumn(f"cy{n}", span("ymin", "ymax"))

    x, y = F.greatest("ga.xmin", "gb.xmin"), F.greatest("ga.ymin", "gb.ymin")
    meet = (F.least("ga.xmax", "gb.xmax") >= x) & (F.least("ga.ymax", "gb.ymax") >= y)
    here = meet & (F.floor(x / size) == F.col("cxa")) & (F.floor(y / size) == F.col("cya"))
    return dealt_join(cells(left, "a"), cells(right, "b"), [("cxa", "cxb"), ("cya", "cyb")], here if on is None else here & on).select("a", "b")


def box_pairs(boxes: DataFrame, key: str, size: float, reach: float = 0.0) -> DataFrame:
    """Pairs (a, b) of different boxes whose bounds, grown by reach, meet: struct columns a and b with all columns of boxes."""
    return box_meetings(boxes, boxes, size, reach, F.col(f"a.{key}") != F.col(f"b.{key}"))


def rank_by_distance(pairs: DataFrame, key: str, other_key: str, k: int) -> DataFrame:
    """The k nearest of each key."""
    order = Window.partitionBy(key).orderBy("distance_m", other_key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
