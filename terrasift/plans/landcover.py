"""Land-cover and raster queries over the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.numeric import rounded
from ..operators import landcover as L
from ..operators import overlay
from ..operators import raster as R
from ..operators.quantiles import exact_quantiles
from .base import Tables, lat, lat_sql, lon, lon_sql, query, r_sql

# Order priorities stand in for classes; the first two for development.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _annual(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 25).alias("unit"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("klass"), F.col("o_totalprice").alias("area"))


def _shares(t: Tables) -> DataFrame:
    return L.class_shares(_annual(t), ["unit", "year"], "klass", "area")


def _signals(t: Tables) -> DataFrame:
    wide = L.pivot_classes(_shares(t), ["unit", "year"], "klass", "share", PRIORITIES)
    return wide.select("unit", "year", (F.coalesce(F.col("1-URGENT"), F.lit(0.0)) + F.coalesce(F.col("2-HIGH"), F.lit(0.0))).alias("signal"))


def _breakpoints(t: Tables) -> DataFrame:
    return L.breakpoints(_signals(t), "unit", "year", "signal")


SHARE_SQL = """annual AS (
  SELECT o_custkey % 25 AS unit, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS klass, sum(o_totalprice) AS area FROM orders GROUP BY ALL
), shares AS (
  SELECT *, 100.0::DOUBLE * area / nullif(sum(area) OVER (PARTITION BY unit, year), 0) AS share FROM annual
)"""
BREAK_SQL = f"""{SHARE_SQL}, signals AS (
  SELECT unit, year, sum(CASE WHEN klass IN ('1-URGENT', '2-HIGH') THEN share ELSE 0 END) AS s FROM shares GROUP BY ALL
), rises AS (SELECT *, s - lag(s) OVER (PARTITION BY unit ORDER BY year) AS rise FROM signals),
found AS (
  SELECT unit, count(*) AS n_years, arg_min(s, year) AS first_signal, max(rise) AS max_rise,
    (list(year ORDER BY coalesce(rise, -999) DESC, year))[1] AS max_year FROM rises GROUP BY unit
), breaks AS (
  SELECT *, CASE WHEN first_signal >= 40 AND max_rise < 15 THEN 'mature_before_archive' WHEN max_rise >= 15 THEN 'candidate_breakpoint' ELSE 'no_clear_breakpoint' END AS result FROM found
)"""


@query("lc_breakpoint", f"WITH {BREAK_SQL} SELECT unit, n_years, {r_sql('first_signal')} AS first_signal, {r_sql('max_rise')} AS max_rise, max_year, CASE WHEN result = 'candidate_breakpoint' THEN max_year - 1 END AS interval_start, result FROM breaks")
def breakpoint_screening(t: Tables) -> DataFrame:
    """Shares, signals, rises over the year before, the greatest of them, and what it means."""
    found = _breakpoints(t)
    start = F.when(F.col("result") == "candidate_breakpoint", F.col("max_year") - 1)
    return found.select("unit", "n_years", rounded(F.col("first_signal")).alias("first_signal"), rounded(F.col("max_rise")).alias("max_rise"), "max_year", start.alias("interval_start"), "result")


@query("lc_class_share", f"WITH {SHARE_SQL} SELECT unit, year, klass, {r_sql('area', 2)} AS area, {r_sql('share')} AS share FROM shares")
def class_share(t: Tables) -> DataFrame:
    """Area and share of each class by unit and year."""
    return _shares(t).select("unit", "year", "klass", rounded(F.col("area"), 2).alias("area"), rounded(F.col("share")).alias("share"))


@query(
    "lc_review_priority",
    f"""WITH {BREAK_SQL}, flags AS (SELECT c_custkey % 25 AS unit, bool_or(c_acctbal > 9900) AS overlap, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS builders FROM customer GROUP BY ALL)
SELECT unit, result, CASE WHEN unit = 7 THEN 'completed_reference' WHEN result = 'mature_before_archive' THEN 'historical_imagery_required' WHEN coalesce(overlap, false) THEN 'high_neighbor_overlap' ELSE 'standard' END AS priority, coalesce(builders, 0) AS builders
FROM breaks LEFT JOIN flags USING (unit)""",
)
def review_priority(t: Tables) -> DataFrame:
    """Breakpoints with unit facts; labels overwrite each other in order."""
    flags = t.customer.groupBy((F.col("c_custkey") % 25).alias("unit")).agg(F.bool_or(F.col("c_acctbal") > 9900).alias("overlap"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("builders"))
    joined = _breakpoints(t).join(flags, "unit", "left")
    label = L.review_priority(
        (F.coalesce("overlap", F.lit(False)), "high_neighbor_overlap"),
        (F.col("result") == "mature_before_archive", "historical_imagery_required"),
        (F.col("unit") == 7, "completed_reference"),
    )
    return joined.select("unit", "result", label.alias("priority"), F.coalesce("builders", F.lit(0)).alias("builders"))


@query("lc_baseline_delta", f"WITH {SHARE_SQL} SELECT klass, {r_sql('avg(share) FILTER (WHERE year = 2000) - avg(share) FILTER (WHERE year = 1996)')} AS delta FROM shares GROUP BY klass")
def baseline_delta(t: Tables) -> DataFrame:
    """Mean share of each class, 2000 against 1996."""
    at = lambda y: F.avg(F.when(F.col("year") == y, F.col("share")))
    return _shares(t).groupBy("klass").agg(rounded(at(2000) - at(1996)).alias("delta"))


@query("lc_filtered_sum", f"SELECT l_suppkey % 25 AS unit, CAST(year(l_shipdate) AS INT) AS year, {r_sql('sum(l_extendedprice)', 2)} AS area FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def filtered_sum(t: Tables) -> DataFrame:
    """Sum over two classes by unit and year."""
    kept = t.lineitem.where(F.col("l_returnflag").isin("A", "R"))
    return kept.groupBy((F.col("l_suppkey") % 25).alias("unit"), F.year("l_shipdate").alias("year")).agg(rounded(F.sum("l_extendedprice"), 2).alias("area"))


@query("lc_region_stats", f"SELECT l_returnflag AS region, {r_sql('avg(l_quantity)')} AS mean, {r_sql('sum(l_quantity)', 2)} AS total, count(*) AS n, {r_sql('avg(CASE WHEN l_linenumber = 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS vote FROM lineitem GROUP BY ALL")
def region_stats(t: Tables) -> DataFrame:
    """Mean, sum and count of a region, and the share of votes for one label."""
    vote = F.avg((F.col("l_linenumber") == 6).cast("double"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("region")).agg(rounded(F.avg("l_quantity")).alias("mean"), rounded(F.sum("l_quantity"), 2).alias("total"), F.count(F.lit(1)).alias("n"), rounded(vote).alias("vote"))


@query("lc_polygon_summary", f"SELECT p_brand AS site, p_type AS product, count(*) AS polygons, count(*) FILTER (WHERE p_name LIKE 'red%') AS supporting, {r_sql('sum(p_size)', 2)} AS area FROM part GROUP BY ALL")
def polygon_summary(t: Tables) -> DataFrame:
    """Polygons of a site and product, and how many have a label with a prefix."""
    return t.part.groupBy(F.col("p_brand").alias("site"), F.col("p_type").alias("product")).agg(
        F.count(F.lit(1)).alias("polygons"), F.count_if(F.col("p_name").startswith("red")).alias("supporting"), rounded(F.sum("p_size"), 2).alias("area")
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_BANDS_SQL = ", ".join(f"quantile_cont(value, 0.5) FILTER (WHERE event_type = '{e}') AS {e}" for e in EVENT_TYPES)
_ARGMAX_SQL = "CASE " + " ".join(f"WHEN {e} = greatest({', '.join(EVENT_TYPES)}) THEN {i}" for i, e in enumerate(EVENT_TYPES)) + " END"


@query("pix_median_argmax", f"WITH m AS (SELECT user_id, {_BANDS_SQL} FROM events GROUP BY user_id) SELECT user_id, {_ARGMAX_SQL} AS klass, {r_sql('click')} AS click, {r_sql('view')} AS view FROM m")
def median_argmax(t: Tables) -> DataFrame:
    """Median of each band over time, then the greatest band (A15 G-Q)."""
    bands = t.events.select("user_id", *[F.when(F.col("event_type") == e, F.col("value")).alias(e) for e in EVENT_TYPES])
    m = R.median_composite(bands, ["user_id"], EVENT_TYPES)
    return m.select("user_id", R.argmax([F.col(e) for e in EVENT_TYPES]).alias("klass"), rounded(F.col("click")).alias("click"), rounded(F.col("view")).alias("view"))


def _groups_sql(code: str, groups: dict) -> str:
    cases = [" OR ".join(f"{code} BETWEEN {a} AND {b}" for a, b in ranges) for ranges in groups.values()]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in zip(groups, cases, strict=True)) + " END"


@query("pix_code_groups", f"SELECT {_groups_sql('p_size * 2', L.NLCD_GROUPS)} AS nlcd, {_groups_sql('p_size * 5', L.CDL_GROUPS)} AS cdl, count(*) AS n FROM part GROUP BY ALL")
def code_groups(t: Tables) -> DataFrame:
    """Codes of two products in their groups (Q11)."""
    return t.part.groupBy(L.code_group(F.col("p_size") * 2, L.NLCD_GROUPS).alias("nlcd"), L.code_group(F.col("p_size") * 5, L.CDL_GROUPS).alias("cdl")).agg(F.count(F.lit(1)).alias("n"))


@query("pix_bitmask", "SELECT count(*) AS clear, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE (o_orderkey & 1024) = 0 AND (o_orderkey & 2048) = 0 AND o_orderkey % 12 NOT IN (0, 1, 3, 8, 9, 10, 11)")
def bitmask(t: Tables) -> DataFrame:
    """Pixels whose quality bits are clear and whose scene class shows the ground (Q09 Q10)."""
    clear = t.orders.where(R.qa_clear(F.col("o_orderkey"), 10, 11) & ~(F.col("o_orderkey") % 12).isin(*R.BAD_SCENE_CLASSES))
    return clear.agg(F.count(F.lit(1)).alias("clear"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("pix_mosaic_first_valid", "SELECT user_id, CAST(hour(ts) AS INT) AS hr, arg_min(value, event_id) FILTER (WHERE value > 10) AS value FROM events GROUP BY ALL")
def mosaic_first_valid(t: Tables) -> DataFrame:
    """Per pixel the value of the first valid item."""
    return t.events.groupBy("user_id", F.hour("ts").alias("hr")).agg(R.first_valid(F.col("value"), F.col("event_id"), F.col("value") > 10).alias("value"))


@query("pix_stretch", "WITH q AS (SELECT event_type, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY ALL) SELECT event_id, CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - lo) / nullif(hi - lo, 0))) * 255) AS INT) AS level FROM events JOIN q USING (event_type)")
def contrast_stretch(t: Tables) -> DataFrame:
    """2 to 98 percent stretch of each band."""
    q = exact_quantiles(t.events, ["event_type"], "value", [0.02, 0.98]).withColumnRenamed("event_type", "_type")
    return t.events.join(q, F.col("event_type").eqNullSafe(F.col("_type"))).select("event_id", R.stretch(F.col("value"), F.col("q")[0], F.col("q")[1]).alias("level"))


@query(
    "pix_scan_filter",
    f"SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' AND {lon_sql('user_id')} BETWEEN -88.25 AND -88.15 AND {lat_sql('user_id')} BETWEEN 41.72 AND 41.85 AND value >= 30 AND event_type = 'click'",
)
def scan_filter(t: Tables) -> DataFrame:
    """Observations of a region in a half-open time range with class and probability."""
    inside = lon(F.col("user_id")).between(-88.25, -88.15) & lat(F.col("user_id")).between(41.72, 41.85)
    time = (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return t.events.where(time & inside & (F.col("value") >= 30) & (F.col("event_type") == "click")).select("event_id", "event_type", "value")


_GRID = "SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, CAST(p_size AS DOUBLE) AS v FROM part"


def _grid(t: Tables) -> DataFrame:
    return t.part.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_size").cast("double").alias("v"))


@query(
    "pix_warp_grid",
    f"""WITH g AS ({_GRID}), target AS (SELECT r AS trow, c AS tcol, r * 1.5::DOUBLE + 0.25 AS y, c * 1.25::DOUBLE + 0.5 AS x FROM (SELECT unnest(range((SELECT max(row) FROM g) * 2 // 3 + 1)) AS r) a, range(32) b(c))
SELECT trow, tcol, n.v AS nearest, {r_sql('a.v * (1 - fx) * (1 - fy) + b.v * fx * (1 - fy) + c.v * (1 - fx) * fy + d.v * fx * fy')} AS bilinear
FROM (SELECT *, x - floor(x) AS fx, y - floor(y) AS fy, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0, CAST(floor(x + 0.5) AS BIGINT) AS xn, CAST(floor(y + 0.5) AS BIGINT) AS yn FROM target)
JOIN g n ON n.row = yn AND n.col = xn JOIN g a ON a.row = y0 AND a.col = x0 JOIN g b ON b.row = y0 AND b.col = x0 + 1 JOIN g c ON c.row = y0 + 1 AND c.col = x0 JOIN g d ON d.row = y0 + 1 AND d.col = x0 + 1""",
)
def warp_grid(t: Tables) -> DataFrame:
    """A raster on another grid, by nearest neighbour and bilinear weights, as joins on row and column."""
    rows = t.part.agg(F.floor(F.max("p_partkey") / 40).cast("long")).first()[0] or 0  # the target covers all of the grid
    target = t.spark.range((rows * 2 // 3 + 1) * 32).select(F.floor(F.col("id") / 32).cast("long").alias("trow"), (F.col("id") % 32).alias("tcol"))
    target = target.withColumn("y", F.col("trow") * 1.5 + 0.25).withColumn("x", F.col("tcol") * 1.25 + 0.5)
    g = _grid(t)

    def at(df: DataFrame, row: Column, col: Column, name: str) -> DataFrame:
        other = g.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias(name))
        return df.join(other, (row == F.col("_r")) & (col == F.col("_c"))).drop("_r", "_c")

    x0, y0 = F.floor("x").cast("long"), F.floor("y").cast("long")
    df = at(target, F.floor(F.col("y") + 0.5).cast("long"), F.floor(F.col("x") + 0.5).cast("long"), "nearest")
    for dy in (0, 1):
        for dx in (0, 1):
            df = at(df, y0 + dy, x0 + dx, f"v{dx}{dy}")
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    return df.select("trow", "tcol", "nearest", rounded(R.bilinear(fx, fy, F.col("v00"), F.col("v10"), F.col("v01"), F.col("v11"))).alias("bilinear"))


@query("pix_area_stack", "SELECT p_brand AS unit, " + ", ".join(f"CAST(sum(CASE WHEN p_size % 9 = {i} THEN 100 ELSE 0 END) AS BIGINT) AS {c}" for i, c in enumerate(L.CLASSES)) + " FROM part GROUP BY p_brand")
def area_stack(t: Tables) -> DataFrame:
    """Pixel area of each class (G-R)."""
    return t.part.groupBy(F.col("p_brand").alias("unit")).agg(*[F.sum(F.when(F.col("p_size") % 9 == i, 100).otherwise(0)).cast("long").alias(c) for i, c in enumerate(L.CLASSES)])


_CELLS = "SELECT c_custkey % 40 AS col, c_custkey // 40 AS row, c_acctbal FROM customer WHERE c_nationkey % 3 = 0"
_REGIONS = f"""WITH RECURSIVE c AS ({_CELLS}), e AS (SELECT a.row * 4294967296 + a.col AS u, b.row * 4294967296 + b.col AS v FROM c a JOIN c b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1),
reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), lab AS (SELECT u, min(v) AS region FROM reach GROUP BY u),
full_ AS (SELECT region, row, col, c_acctbal FROM c JOIN lab ON u = row * 4294967296 + col)"""


def _regions(t: Tables) -> DataFrame:
    cells = t.customer.where("c_nationkey % 3 = 0").select(F.floor(F.col("c_custkey") / 40).cast("long").alias("row"), (F.col("c_custkey") % 40).alias("col"), "c_acctbal")
    return R.label_mask(cells)


@query("pix_components", f"{_REGIONS} SELECT CAST(region AS BIGINT) AS region, count(*) AS pixels, count(*) * 100 AS area_m2, min(row) AS top_row, min(col) AS left_col FROM full_ GROUP BY region")
def pixel_components(t: Tables) -> DataFrame:
    """8-connected regions of a mask (G-O)."""
    return _regions(t).groupBy("region").agg(F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) * 100).alias("area_m2"), F.min("row").alias("top_row"), F.min("col").alias("left_col"))


@query("pix_zonal_mean", f"{_REGIONS} SELECT CAST(region AS BIGINT) AS region, {r_sql('avg(c_acctbal)')} AS mean FROM full_ GROUP BY region HAVING count(*) >= 2")
def zonal_mean(t: Tables) -> DataFrame:
    """Mean over each region of two pixels or more (G-P)."""
    return _regions(t).groupBy("region").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("c_acctbal")).alias("mean")).where("n >= 2").select("region", "mean")


# The outline of each region: every side of a cell with no neighbour of the region beyond, and the side that goes on from its end: to the right of
# its direction if there is one, so that cells that touch in a corner stay joined.
_OUTLINE = f"""{_REGIONS}, d(d, dx, dy, ox, oy, nr, nc) AS (VALUES (0, 1, 0, 0, 0, -1, 0), (1, 0, 1, 1, 0, 0, 1), (2, -1, 0, 1, 1, 1, 0), (3, 0, -1, 0, 1, 0, -1)),
side AS (SELECT f.region, d.d, f.col + ox AS x, f.row + oy AS y, f.col + ox + dx AS ex, f.row + oy + dy AS ey, ((f.row + oy) * 4294967296 + f.col + ox) * 4 + d.d AS e FROM full_ f, d
  WHERE NOT EXISTS (SELECT 1 FROM full_ g WHERE g.row = f.row + nr AND g.col = f.col + nc)),
onward AS (SELECT a.e, arg_min(b.e, (b.d - a.d + 5) % 4) AS nxt FROM side a JOIN side b ON b.region = a.region AND b.x = a.ex AND b.y = a.ey GROUP BY a.e),
walk AS (SELECT e AS s, nxt AS cur FROM onward UNION SELECT w.s, o.nxt FROM walk w JOIN onward o ON o.e = w.cur),
ringed AS (SELECT s AS e, min(cur) AS ring FROM walk GROUP BY s),
turned AS (SELECT ring AS ring_id, 0 AS i, ring AS e FROM (SELECT DISTINCT ring FROM ringed) UNION ALL SELECT t.ring_id, t.i + 1, o.nxt FROM turned t JOIN onward o ON o.e = t.e WHERE o.nxt <> t.ring_id),
corner AS (SELECT t.ring_id, t.i, s.* FROM turned t JOIN side s USING (e) JOIN onward o ON o.nxt = s.e JOIN side before ON before.e = o.e WHERE before.d <> s.d),
ring AS (SELECT region, ring_id, count(*) AS corners, string_agg(x || ' ' || y, ',' ORDER BY i) AS ring FROM corner GROUP BY ALL),
sized AS (SELECT ring_id, CAST(sum(x * ey - ex * y) // 2 AS BIGINT) AS signed, count(*) AS sides FROM turned JOIN side USING (e) GROUP BY ring_id)"""


def _sides(ring: Column) -> Column:
    after = lambda p, i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    return F.aggregate(F.transform(ring, lambda p, i: F.abs(after(p, i)["x"] - p["x"]) + F.abs(after(p, i)["y"] - p["y"])), F.lit(0.0), lambda s, v: s + v).cast("long")


@query("pix_rings", f"{_OUTLINE} SELECT CAST(region AS BIGINT) AS region, signed < 0 AS hole, CAST(corners AS INT) AS corners, CAST(sides AS BIGINT) AS sides, abs(signed) AS area, ring FROM ring JOIN sized USING (ring_id)")
def pixel_rings(t: Tables) -> DataFrame:
    """The rings around 8-connected regions of a mask, corner by corner (G-O)."""
    rings = R.region_rings(_regions(t))
    text = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ",")
    return rings.select("region", "hole", F.size("ring").alias("corners"), _sides(F.col("ring")).alias("sides"), F.col("area").cast("long").alias("area"), text.alias("ring"))


@query(
    "pix_polygons",
    f"""{_REGIONS}, quad AS (SELECT region, (hits = 1)::INT - (hits = 3)::INT - 2 * (hits = 2 AND diagonal)::INT AS q FROM (
  SELECT region, r, c, count(*) AS hits, count(*) = 2 AND min(dr) <> max(dr) AND min(dc) <> max(dc) AS diagonal
  FROM (SELECT region, row + dr AS r, col + dc AS c, 1 - dr AS dr, 1 - dc AS dc FROM full_, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)) GROUP BY region, r, c)),
euler AS (SELECT region, sum(q) // 4 AS euler FROM quad GROUP BY region)
SELECT CAST(region AS BIGINT) AS region, CAST(1 - euler AS BIGINT) AS holes, count(*) * 100 AS area_m2, min(col) * 10 AS xmin, min(row) * 10 AS ymin, (max(col) + 1) * 10 AS xmax, (max(row) + 1) * 10 AS ymax
FROM full_ JOIN euler USING (region) GROUP BY region, euler""",
)
def pixel_polygons(t: Tables) -> DataFrame:
    """Regions as polygons of 10 m cells with their holes, area and bounds (G-O); the SQL counts cells, and holes by Euler's number."""
    found = R.region_polygons(_regions(t)).select("region", "rings", "area", G.bounds(F.col("rings")[0]).alias("b"))
    bounds = [(F.col(f"b.{c}") * 10).cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return found.select("region", (F.size("rings") - 1).cast("long").alias("holes"), (F.col("area") * 100).cast("long").alias("area_m2"), *bounds)


# Zones: a kite around a place of the grid of parts with a triangle cut out, one for each supplier.
_KITE = [(0.0, -6.3), (5.2, 0.4), (0.3, 6.1), (-5.4, -0.2)]
_HOLE = [(-1.6, -1.3), (2.1, -0.9), (0.2, 2.3)]


def _zone_at(key):
    return key * 13 % 34 + 3.25, key / 2 + 0.125


def _zone_edges(t: Tables) -> DataFrame:
    cx, cy = _zone_at(F.col("s_suppkey"))
    point = lambda p: F.struct((cx + p[0]).cast("double").alias("x"), (cy + p[1]).cast("double").alias("y"))
    zones = t.supplier.select("s_suppkey", F.lit(0).alias("p"), F.array(*[F.array(*[point(p) for p in ring]) for ring in (_KITE, _HOLE)]).alias("rings"))
    return overlay.polygon_edges(zones, "s_suppkey", "p", "rings")


_SIDES_SQL = ", ".join(f"({ax!r}::DOUBLE, {ay!r}::DOUBLE, {bx!r}::DOUBLE, {by!r}::DOUBLE)" for ring in (_KITE, _HOLE) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))


@query(
    "pix_polygon_mean",
    f"""WITH g AS ({_GRID}), z AS (SELECT s_suppkey, s_suppkey * 13 % 34 + 3.25::DOUBLE AS cx, s_suppkey / 2.0::DOUBLE + 0.125::DOUBLE AS cy FROM supplier), side(x1, y1, x2, y2) AS (VALUES {_SIDES_SQL}),
hit AS (SELECT s_suppkey, row, col, v, count(*) AS n FROM g JOIN z ON abs(col + 0.5 - cx) <= 7 AND abs(row + 0.5 - cy) <= 7 JOIN side ON (cy + y1 > row + 0.5) <> (cy + y2 > row + 0.5) AND col + 0.5 < cx + x1 + (row + 0.5 - cy - y1) * ((x2 - x1) / (y2 - y1)) GROUP BY ALL)
SELECT s_suppkey, count(*) AS pixels, {r_sql('avg(v)')} AS mean, min(v) AS low, max(v) AS high FROM hit WHERE n % 2 = 1 GROUP BY s_suppkey""",
)
def polygon_mean(t: Tables) -> DataFrame:
    """Mean over polygons with a hole of the pixels whose centre they hold (G-P); the SQL tests every point against every ring."""
    inside = R.zonal_cells(_grid(t), _zone_edges(t)).withColumnRenamed("g", "s_suppkey")
    return inside.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("pixels"), rounded(F.avg("v")).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("lc_running_rank", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {r_sql('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 2)} AS running FROM events")
def running_rank(t: Tables) -> DataFrame:
    """Numbers within a group and running sums."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    running = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("n"), rounded(running, 2).alias("running"))
