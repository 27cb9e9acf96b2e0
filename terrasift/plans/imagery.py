"""Imagery availability and choice, with events as catalogue items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Tables, lat, lat_sql, lon, lon_sql, query

TYPES = ["click", "error", "purchase", "signup", "view"]


def _availability(t: Tables) -> DataFrame:
    e = t.events.select((F.col("user_id") % 13).alias("zone"), F.col("event_type").alias("source"), F.dayofmonth("ts").alias("year"), "ts", "value")
    return e.groupBy("zone", "source", "year").agg(F.count(F.lit(1)).alias("items"), F.countDistinct(F.to_date("ts"), F.hour("ts")).alias("times"), F.min("value").alias("least_cloud"), F.max("value").alias("most_cloud"))


AVAIL = "a AS (SELECT user_id % 13 AS zone, event_type AS source, CAST(day(ts) AS INT) AS year, count(*) AS items, count(DISTINCT date_trunc('hour', ts)) AS times, min(value) AS least_cloud, max(value) AS most_cloud FROM events GROUP BY ALL)"


@query("img_availability", f"WITH {AVAIL} SELECT * FROM a")
def availability(t: Tables) -> DataFrame:
    """Items of each zone, source and year."""
    return _availability(t)


@query(
    "img_readiness",
    f"WITH {AVAIL}, w AS (SELECT zone, " + ", ".join(f"array_to_string(list_sort(list(year) FILTER (WHERE source = '{s}')), '|') AS {s}_years, min(year) FILTER (WHERE source = '{s}') AS {s}_first, coalesce(CAST(sum(items) FILTER (WHERE source = '{s}') AS BIGINT), 0) AS {s}_items" for s in TYPES[:2]) + " FROM a GROUP BY zone) SELECT c_custkey, w.* FROM customer LEFT JOIN w ON zone = c_custkey % 14",
)
def readiness(t: Tables) -> DataFrame:
    """Years, first year and items of each source as columns, for every unit of the zone."""
    a = _availability(t)
    pick = lambda s, c: F.when(F.col("source") == s, F.col(c))
    years = lambda s: F.nullif(F.array_join(F.array_sort(F.collect_list(pick(s, "year"))), "|"), F.lit(""))
    columns = [c for s in TYPES[:2] for c in (years(s).alias(f"{s}_years"), F.min(pick(s, "year")).alias(f"{s}_first"), F.coalesce(F.sum(pick(s, "items")), F.lit(0)).alias(f"{s}_items"))]
    wide = a.groupBy("zone").agg(*columns)
    return t.customer.select("c_custkey").join(wide, F.col("zone") == F.col("c_custkey") % 14, "left")


@query("img_choose_best", "WITH r AS (SELECT user_id, event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS clear, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events WHERE quarter(ts) = 1 AND value < 45) SELECT user_id, event_id, clear FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY clear DESC, value, event_id) AS m FROM r WHERE n <= 3) WHERE m = 1")
def choose_best(t: Tables) -> DataFrame:
    """The three least cloudy items, then the clearest of them."""
    items = t.events.where((F.quarter("ts") == 1) & (F.col("value") < 45))
    few = items.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))).where("n <= 3")
    clear = F.get_json_object("props", "$.k").cast("int")
    best = F.min_by(F.struct("event_id", clear.alias("clear")), F.struct((-clear).alias("c"), "value", "event_id"))
    return few.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.clear")


YEARS = [1994, 1996, 1998, 1999, 2000]


@query("img_asof_baseline", f"SELECT o_orderkey, coalesce((SELECT max(y) FROM (VALUES {', '.join(f'({y})' for y in YEARS)}) v(y) WHERE y < year(o_orderdate)), 2011) AS baseline FROM orders")
def asof_baseline(t: Tables) -> DataFrame:
    """Newest image year strictly before the start; a default if there is none."""
    from ..functions.text import year_prefix

    start = year_prefix(F.date_format("o_orderdate", "yyyy-MM"))
    years = F.array(*[F.lit(y) for y in YEARS])
    return t.orders.select("o_orderkey", F.coalesce(F.array_max(F.filter(years, lambda y: y < start)), F.lit(2011)).alias("baseline"))


@query("img_asof_table", "SELECT o.o_orderkey, max(e.d) AS image_day FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders) o LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F') e ON e.o_custkey = o.o_custkey AND e.d < o.day GROUP BY o.o_orderkey")
def asof_table(t: Tables) -> DataFrame:
    """Strict as-of join to a table: one union and one ordered window, no pairs."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.lit(1).alias("asks"), F.lit(None).cast("date").alias("seen"))
    images = t.orders.where("o_orderstatus = 'F'").select(F.lit(None).cast("long"), "o_custkey", F.col("o_orderdate").cast("date"), F.lit(2), F.col("o_orderdate").cast("date"))
    # at one day askers stand before images, so that an image of the day itself is not seen
    before = Window.partitionBy("o_custkey").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.union(images).withColumn("image_day", F.last("seen", ignorenulls=True).over(before))
    return both.where("asks = 1").select("o_orderkey", "image_day")


@query("img_stac_search", f"SELECT event_id, value FROM events WHERE event_type IN ('view', 'click') AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND value < 40 AND {lon_sql('user_id')} + 0.01 >= -88.25 AND {lon_sql('user_id')} <= -88.15 AND {lat_sql('user_id')} + 0.01 >= 41.72 AND {lat_sql('user_id')} <= 41.85 ORDER BY value, event_id LIMIT 50")
def stac_search(t: Tables) -> DataFrame:
    """Catalogue search by collection, time, cloud and bounds, so many items at most."""
    meets = (lon(F.col("user_id")) + 0.01 >= -88.25) & (lon(F.col("user_id")) <= -88.15) & (lat(F.col("user_id")) + 0.01 >= 41.72) & (lat(F.col("user_id")) <= 41.85)
    time = F.col("ts").between(F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return t.events.where(F.col("event_type").isin("view", "click") & time & (F.col("value") < 40) & meets).orderBy("value", "event_id").limit(50).select("event_id", "value")


@query("img_role_pivot", "SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS baseline, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS change, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS current FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 3")
def role_pivot(t: Tables) -> DataFrame:
    """One row a unit with its three images."""
    wide = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["O", "P", "F"]).agg(F.max("o_orderkey"))
    return wide.dropna().select("o_custkey", F.col("O").alias("baseline"), F.col("P").alias("change"), F.col("F").alias("current"))


@query("img_first_item", "SELECT event_type, arg_min(event_id, event_id) AS first_item FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-07' GROUP BY event_type")
def first_item(t: Tables) -> DataFrame:
    """First item of a calendar day by class."""
    return t.events.where(F.to_date("ts") == F.lit("2024-01-07").cast("date")).groupBy("event_type").agg(F.min("event_id").alias("first_item"))
