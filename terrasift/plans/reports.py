"""Rollups, shares, timelines, catalogues and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import clip, rounded
from ..operators import rollup
from ..operators.landcover import review_priority
from ..operators.order import global_rank
from .base import Tables, query, r_sql


@query("wb_facility_rollup", f"WITH m AS (SELECT DISTINCT o_orderkey, trim(x) AS member FROM (SELECT o_orderkey, 'c' || o_custkey % 50 || '; c' || o_custkey % 7 || ';' AS ids FROM orders), unnest(string_split(ids, ';')) u(x) WHERE trim(x) <> '') SELECT member AS facility, count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'F') AS permits, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, {r_sql('sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END)', 2)} AS capacity FROM m JOIN orders USING (o_orderkey) GROUP BY member")
def facility_rollup(t: Tables) -> DataFrame:
    """Members of delimited lists with conditional counts and sums."""
    ids = F.concat(F.lit("c"), F.col("o_custkey") % 50, F.lit("; c"), F.col("o_custkey") % 7, F.lit(";"))
    m = rollup.list_members(t.orders.withColumn("ids", ids), "ids").dropDuplicates(["o_orderkey", "member"])
    known = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return m.groupBy(F.col("member").alias("facility")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("o_orderstatus") == "F").alias("permits"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), rounded(F.sum(F.coalesce(known, F.lit(0.0))), 2).alias("capacity")
    )


def _capacity(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("agency")).agg(
        F.sum("l_quantity").cast("long").alias("units"), F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("l_partkey") % 6 != 0, F.col("l_quantity") * F.col("l_linenumber"))).alias("kw")
    )


CAP = "cap AS (SELECT l_suppkey AS agency, CAST(sum(l_quantity) AS BIGINT) AS units, count(*) AS groups, sum(CASE WHEN l_partkey % 6 <> 0 THEN l_quantity * l_linenumber END) AS kw FROM lineitem GROUP BY l_suppkey)"


@query("rpt_top_capacity", f"WITH {CAP} SELECT agency, units, groups, {r_sql('coalesce(kw, 0) / 1000')} AS mw, rank FROM (SELECT *, row_number() OVER (ORDER BY coalesce(kw, 0) DESC, agency) AS rank FROM cap) WHERE rank <= 10")
def top_capacity(t: Tables) -> DataFrame:
    """The ten agencies of most capacity."""
    cap = _capacity(t).withColumn("kw", F.coalesce("kw", F.lit(0.0)))
    return rollup.top(cap, 10, F.col("kw").desc(), F.col("agency")).select("agency", "units", "groups", rounded(F.col("kw") / 1000).alias("mw"), F.col("rank").cast("long").alias("rank"))


@query("rpt_kpis", f"WITH {CAP}, r AS (SELECT *, row_number() OVER (ORDER BY coalesce(kw, 0) DESC, agency) AS n FROM cap) SELECT CAST(sum(units) AS BIGINT) AS units, {r_sql('sum(coalesce(kw, 0)) / 1000')} AS mw, {r_sql('sum(CASE WHEN n <= 5 THEN coalesce(kw, 0) END) / sum(coalesce(kw, 0))')} AS top5_share, (SELECT count(*) FROM lineitem WHERE l_partkey % 6 <> 0 AND l_quantity * l_linenumber >= 250) AS large FROM r")
def kpis(t: Tables) -> DataFrame:
    """Totals and the share of the top five."""
    cap = _capacity(t).withColumn("kw", F.coalesce("kw", F.lit(0.0)))
    top5 = rollup.top(cap, 5, F.col("kw").desc(), F.col("agency")).agg(F.sum("kw").alias("top5"))
    total = cap.agg(F.sum("units").alias("units"), F.sum("kw").alias("kw"))
    large = t.lineitem.agg(F.count_if((F.col("l_partkey") % 6 != 0) & (F.col("l_quantity") * F.col("l_linenumber") >= 250)).alias("large"))
    return total.crossJoin(top5).crossJoin(large).select("units", rounded(F.col("kw") / 1000).alias("mw"), rounded(F.col("top5") / F.col("kw")).alias("top5_share"), "large")  # one row each


@query("rpt_subset_share", f"WITH {CAP} SELECT {r_sql('sum(CASE WHEN s_nationkey % 4 = 0 THEN kw END)', 2)} AS subset_kw, {r_sql('sum(CASE WHEN s_nationkey % 4 = 0 THEN kw END) / sum(kw)')} AS share FROM cap JOIN supplier ON s_suppkey = agency")
def subset_share(t: Tables) -> DataFrame:
    """A subset's part of the total, each member once."""
    members = t.supplier.where("s_nationkey % 4 = 0").select(F.col("s_suppkey").alias("agency"))
    known = _capacity(t).join(t.supplier.select(F.col("s_suppkey").alias("agency")), "agency", "left_semi")
    part = known.join(members, "agency", "left_semi").agg(F.sum("kw").alias("p"))
    return known.agg(F.sum("kw").alias("w")).crossJoin(part).select(rounded(F.col("p"), 2).alias("subset_kw"), rounded(F.col("p") / F.col("w")).alias("share"))  # one row each


@query("rpt_timeline", "WITH c AS (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS month_no, count(*) AS n FROM orders WHERE month(o_orderdate) <> 3 GROUP BY ALL) SELECT CAST(g AS INT) AS month_no, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(month_no) FROM c), (SELECT max(month_no) + 1 FROM c))) AS g) LEFT JOIN c ON month_no = g")
def timeline(t: Tables) -> DataFrame:
    """Months from first to last, empty ones as 0."""
    month_no = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    counts = t.orders.where(F.month("o_orderdate") != 3).groupBy(month_no.alias("month_no")).agg(F.count(F.lit(1)).alias("n"))
    return rollup.gap_filled(counts, "month_no", "n")


@query("rpt_recent_agencies", "SELECT count(*) AS agencies, count(*) FILTER (WHERE y >= 2001) AS recent FROM (SELECT o_custkey, max(year(o_orderdate)) AS y FROM orders GROUP BY ALL)")
def recent_agencies(t: Tables) -> DataFrame:
    """Agencies whose newest document is of the last year."""
    newest = t.orders.groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("y"))
    return newest.agg(F.count(F.lit(1)).alias("agencies"), F.count_if(F.col("y") >= 2001).alias("recent"))


@query("rpt_crosstab", "SELECT c_mktsegment AS segment, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def crosstab(t: Tables) -> DataFrame:
    """Counts of two labels."""
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    wide = j.groupBy(F.col("c_mktsegment").alias("segment")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("rpt_ratio", f"SELECT l_returnflag, l_linestatus, {r_sql('sum(l_extendedprice * l_discount) / sum(l_extendedprice)')} AS ratio FROM lineitem GROUP BY ALL")
def ratio(t: Tables) -> DataFrame:
    """Ratio of sums."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(rounded(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("ratio"))


@query("rpt_buckets", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'Unknown' WHEN year(o_orderdate) <= 1996 THEN 'to 1996' WHEN year(o_orderdate) <= 1998 THEN '1997 to 1998' ELSE 'later' END AS period, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'pressing' WHEN o_orderpriority LIKE '3%' THEN 'middle' ELSE 'other' END AS origin, count(*) AS n FROM orders GROUP BY ALL")
def buckets(t: Tables) -> DataFrame:
    """Periods of partial dates and tiers of name prefixes."""
    year = T.year_prefix(F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM")))
    period = F.when(year.isNull(), "Unknown").when(year <= 1996, "to 1996").when(year <= 1998, "1997 to 1998").otherwise("later")
    p = F.col("o_orderpriority")
    origin = F.when(p.startswith("1") | p.startswith("2"), "pressing").when(p.startswith("3"), "middle").otherwise("other")
    return t.orders.groupBy(period.alias("period"), origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query("ev_catalog", "WITH e AS (SELECT n_name AS unit, 'documentary' AS kind, i AS k FROM nation, range(1, 4) r(i) WHERE i <= n_nationkey % 4 UNION ALL SELECT n_name, 'satellite', 0 FROM nation UNION ALL SELECT r_name, 'region', 0 FROM region) SELECT unit, kind, CAST(k AS INT) AS k, 'ev_' || lpad(CAST(row_number() OVER (ORDER BY unit, kind, k) AS VARCHAR), 4, '0') AS evidence_id FROM e")
def evidence_catalog(t: Tables) -> DataFrame:
    """Typed fragments in one catalogue with serial ids."""
    docs = t.nation.where("n_nationkey % 4 > 0").select(F.col("n_name").alias("unit"), F.lit("documentary").alias("kind"), F.explode(F.sequence(F.lit(1), F.col("n_nationkey") % 4)).alias("k"))
    sat = t.nation.select(F.col("n_name").alias("unit"), F.lit("satellite").alias("kind"), F.lit(0).alias("k"))
    region = t.region.select(F.col("r_name").alias("unit"), F.lit("region").alias("kind"), F.lit(0).alias("k"))
    every = docs.unionByName(sat).unionByName(region)
    ranked = global_rank(every, "serial", "unit", "kind", "k")
    return ranked.withColumn("evidence_id", F.concat(F.lit("ev_"), F.lpad(F.col("serial").cast("string"), 4, "0"))).drop("serial")


@query("qa_checks", "SELECT 'nation_count' AS check_name, (SELECT count(*) = 25 FROM nation) AS passed UNION ALL SELECT 'order_key_unique', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) UNION ALL SELECT 'line_orders_known', (SELECT count(*) = 0 FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey) UNION ALL SELECT 'regions_covered', (SELECT count(*) = 0 FROM region ANTI JOIN nation ON n_regionkey = r_regionkey)")
def qa_checks(t: Tables) -> DataFrame:
    """Counts, uniqueness and coverage."""
    none = lambda df: df.agg((F.count(F.lit(1)) == 0).alias("p"))
    return rollup.checks(
        ("nation_count", t.nation.agg((F.count(F.lit(1)) == 25).alias("p"))),
        ("order_key_unique", t.orders.agg((F.count(F.lit(1)) == F.countDistinct("o_orderkey")).alias("p"))),
        ("line_orders_known", none(t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"))),
        ("regions_covered", none(t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"))),
    )


@query("rpt_value_counts", "SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) AS place FROM orders GROUP BY ALL")
def value_counts(t: Tables) -> DataFrame:
    """Values by count, equals by first appearance."""
    c = rollup.value_counts(t.orders, "o_orderpriority", "o_orderkey")
    return c.select(F.col("o_orderpriority").alias("value"), "n", "first_seen", F.row_number().over(Window.orderBy(F.col("n").desc(), "first_seen")).cast("long").alias("place"))


@query("rpt_labels", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Low-cost line' ELSE replace(lower(p_type), '_', ' ') END AS label, CASE WHEN p_size % 9 = 0 THEN 'Not yet resolved' ELSE p_size || ' units' END AS shown FROM part")
def labels(t: Tables) -> DataFrame:
    """Display labels with overrides, and text for what is missing."""
    override = F.element_at(F.create_map(F.lit("ECONOMY"), F.lit("Low-cost line")), F.col("p_type"))
    size = F.when(F.col("p_size") % 9 != 0, F.col("p_size"))
    return t.part.select("p_partkey", F.coalesce(override, F.replace(F.lower("p_type"), F.lit("_"), F.lit(" "))).alias("label"), F.coalesce(F.concat(size, F.lit(" units")), F.lit("Not yet resolved")).alias("shown"))


@query("rpt_rounding", f"SELECT p_partkey, {r_sql('p_retailprice / 7', 2)} AS r2, {r_sql('p_retailprice / 7', 0)} AS r0, {r_sql('greatest(0.0::DOUBLE, least(1.0::DOUBLE, p_size / 40.0::DOUBLE))')} AS clipped FROM part")
def rounding(t: Tables) -> DataFrame:
    """Rounding that every engine does alike, and clipping."""
    x = F.col("p_retailprice") / 7
    return t.part.select("p_partkey", rounded(x, 2).alias("r2"), rounded(x, 0).alias("r0"), rounded(clip(F.col("p_size") / F.lit(40.0), 0.0, 1.0)).alias("clipped"))


@query("top_n", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def top_n(t: Tables) -> DataFrame:
    """First rows of an order."""
    return t.lineitem.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(25).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("rpt_override_order", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'c' WHEN p_size > 30 THEN 'b' WHEN p_size > 20 THEN 'a' ELSE 'standard' END AS label FROM part")
def override_order(t: Tables) -> DataFrame:
    """The last assignment that holds wins."""
    s = F.col("p_size")
    return t.part.select("p_partkey", review_priority((s > 20, "a"), (s > 30, "b"), (s > 40, "c")).alias("label"))


@query("meta_nested_sources", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS datasets, max(ts) AS newest, array_to_string(list_transform(list_slice(list_sort(list_distinct(list(event_id))), 1, 3), lambda x: CAST(x AS VARCHAR)), '|') AS first_ids FROM events GROUP BY user_id")
def nested_sources(t: Tables) -> DataFrame:
    """Distinct datasets, newest update and ids of a nested list."""
    nested = t.events.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "ts", "event_id")).alias("s"))
    each = lambda c: F.array_sort(F.array_distinct(F.transform("s", lambda x: x[c])))
    return nested.select("user_id", F.array_join(each("event_type"), "|").alias("datasets"), F.array_max(each("ts")).alias("newest"), F.array_join(F.transform(F.slice(each("event_id"), 1, 3), lambda x: x.cast("string")), "|").alias("first_ids"))


@query("meta_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS kind FROM events")
def meta_json(t: Tables) -> DataFrame:
    """JSON columns written with sorted keys and read again."""
    packed = t.events.select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("kind"))).alias("j"))
    return packed.select("event_id", F.from_json("j", "k int, kind string").alias("p")).select("event_id", "p.k", "p.kind")
