"""Rasters and image stacks as tables of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, cut
from .overlay import ring_points, scan_spans, signed_area, stitch_rings

# Scene classes that hide the ground.
BAD_SCENE_CLASSES = (0, 1, 3, 8, 9, 10, 11)


def median_composite(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Exact median over time of each band."""
    return pixels.groupBy(*keys).agg(*[F.percentile(b, F.lit(0.5)).alias(b) for b in bands])


def argmax(bands: list[Column]) -> Column:
    """Place of the greatest band, the first of equals; null if all are null."""
    values = F.array(*bands)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def qa_clear(bits: Column, *positions: int) -> Column:
    out = F.lit(True)
    for p in positions:
        out = out & (bits.bitwiseAND(F.lit(1 << p)) == 0)
    return out


def first_valid(values: Column, order: Column, valid: Column) -> Column:
    """Mosaic: the value of the first item that is valid."""
    return F.min_by(values, F.when(valid, order))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """0 to 255 between two quantiles."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0)))) * 255).cast("int")


def bilinear(fx: Column, fy: Column, v00: Column, v10: Column, v01: Column, v11: Column) -> Column:
    return v00 * (1 - fx) * (1 - fy) + v10 * fx * (1 - fy) + v01 * (1 - fx) * fy + v11 * fx * fy


def label_regions(cells: DataFrame, unit: str, row: str = "row", col: str = "col") -> DataFrame:
    """8-connected regions of the cells of each unit: region is the smallest row * 2**32 + col in it.

    One unit's mask is bounded by its window, so each is labelled in one task."""

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        cell = frame[row].to_numpy(np.int64) * (1 << 32) + frame[col].to_numpy(np.int64)
        ids, place = np.unique(cell, return_inverse=True)
        root = np.arange(len(ids))
        steps = [dy * (1 << 32) + dx for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
        pairs = []
        for s in steps:
            at = np.searchsorted(ids, ids + s)
            hit = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == ids + s)
            pairs.append((np.flatnonzero(hit), at[hit]))
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return frame.assign(region=ids[root][place])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema) + ", region long"
    return cells.groupBy(unit).applyInPandas(label, schema)


def label_mask(cells: DataFrame, tile: int = 512) -> DataFrame:
    """8-connected regions of one mask of any extent: region is the smallest row * 2**32 + col in it. Each tile is labelled in a task; labels of cells
    that touch across tiles are joined by components, so only cells on the edges of tiles are compared between tasks."""
    tiled = cells.withColumns({"_ty": F.floor(F.col("row") / tile).cast("long"), "_tx": F.floor(F.col("col") / tile).cast("long")})
    labelled = cut(label_regions(tiled.withColumn("_tile", F.col("_ty") * (1 << 32) + F.col("_tx")), "_tile").drop("_ty", "_tx"))
    edge = (F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    border = labelled.where(edge).select("row", "col", "_tile", "region")
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    asked = border.select("_tile", F.col("region").alias("a"), (F.col("row")).alias("r"), F.col("col").alias("c"), steps.alias("s")).select("_tile", "a", (F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"))
    there = border.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("_tile").alias("_other"), F.col("region").alias("b"))
    touching = cut(asked.join(there, ["r", "c"]).where("_tile <> _other").select("a", "b").distinct())
    nodes = touching.select(F.col("a").alias("node")).union(touching.select("b")).distinct()
    joined = components(nodes, touching).select(F.col("node").alias("region"), "component")
    return labelled.join(joined, "region", "left").withColumn("region", F.coalesce("component", "region")).drop("component", "_tile")


def boundary_edges(cells: DataFrame) -> DataFrame:
    """(g, x1, y1, x2, y2): the sides of cells (region, row, col) that border on no cell of the same region, x along columns and y along rows, the
    region on the left. Each cell gives its four sides; a side that two cells of a region give in opposite directions cancels out."""
    x, y = F.col("col").cast("long"), F.col("row").cast("long")
    side = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    sides = F.array(side(x, y, x + 1, y), side(x + 1, y, x + 1, y + 1), side(x + 1, y + 1, x, y + 1), side(x, y + 1, x, y))
    flat = cells.select(F.col("region").alias("g"), F.explode(sides).alias("s")).select("g", "s.*")
    ends = [F.least("x1", "x2").alias("_x"), F.least("y1", "y2").alias("_y"), (F.col("x1") == F.col("x2")).alias("_up")]
    first = [F.first(c).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return flat.groupBy("g", *ends).agg(F.count(F.lit(1)).alias("n"), *first).where("n = 1").select("g", "x1", "y1", "x2", "y2")


def region_rings(cells: DataFrame, tile: int = 512) -> DataFrame:
    """(region, hole, ring, area) of labelled cells (region, row, col), a row a ring: its corners as struct(x, y), x along columns and y along rows, from the
    uppermost, leftmost one on, outer rings with positive area. Cells that touch in a corner are joined, so an 8-connected region has one outer
    ring, which may touch itself, and a hole for each 4-connected part that it shuts in."""
    rings = stitch_rings(boundary_edges(cells), tile, join=True)
    ring = rings.select(F.col("g").alias("region"), ring_points().alias("ring"))
    return ring.withColumn("area", signed_area(F.col("ring"))).select("region", (F.col("area") < 0).alias("hole"), "ring", F.abs("area").alias("area"))


def region_polygons(cells: DataFrame, tile: int = 512) -> DataFrame:
    """(region, rings, area) of 8-connected regions: the outer ring first, then its holes from top to bottom."""
    rings = region_rings(cells, tile)
    placed = F.struct("hole", F.col("ring")[0]["y"].alias("y"), F.col("ring")[0]["x"].alias("x"), "ring")
    signed = F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area")))
    return rings.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda r: r["ring"]).alias("rings"), signed.alias("area"))


def zonal_cells(pixels: DataFrame, edges: DataFrame, block: int = 256) -> DataFrame:
    """(g, row, col, ...) of the pixels (row, col, ...) whose centre is in zone g, given the edges (g, x1, y1, x2, y2) of the zones' rings, holes included,
    in columns along x and rows along y.

    Zones are filled line by line: for each row of pixels the places where its middle line enters and leaves a zone. Spans then meet pixels by
    row and block of columns, a plain equi-join that holds a zone in no task, and each pixel is looked for in the spans of its own block."""
    spans = scan_spans(edges, 1.0, 0.5, "g")
    first, last = (F.ceil(F.col(c) - 0.5).cast("long") for c in ("x_from", "x_to"))
    spans = spans.select("g", F.col("row").alias("_row"), first.alias("_from"), (last - 1).alias("_to")).where("_to >= _from")
    blocked = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))))
    own = (F.col("row") == F.col("_row")) & (F.floor(F.col("col") / block) == F.col("_block")) & F.col("col").between(F.col("_from"), F.col("_to"))
    return pixels.join(blocked, own).drop("_row", "_from", "_to", "_block")
