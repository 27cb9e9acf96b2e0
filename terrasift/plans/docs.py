"""Document queries: texts are built from the star tables where the real documents hold nothing of the kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import rounded
from ..operators import docs as D
from ..operators import equipment as E
from ..operators.survive import first_wins
from .base import Tables, query, r_sql


def _paged(body: Column | str = "text") -> Column:
    """Two pages around a document's text."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("This permit is to operate the source", "CAAPP PERMIT", "Construction permit, revised", "letter")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return F.concat(F.lit("scan\n===== PAGE 1 =====\n"), kind, F.lit("\nSubject :  Unit "), F.col("doc_id"), F.lit(" ; \n===== PAGE 2 =====\n"), body)


PAGED_SQL = "('scan' || chr(10) || '===== PAGE 1 =====' || chr(10) || (['This permit is to operate the source', 'CAAPP PERMIT', 'Construction permit, revised', 'letter'])[doc_id % 4 + 1] || chr(10) || 'Subject :  Unit ' || doc_id || ' ; ' || chr(10) || '===== PAGE 2 =====' || chr(10) || text)"
PAGES_SQL = f"(regexp_split_to_array({PAGED_SQL}, '===== PAGE [0-9]+ =====\\n?'))[2:]"


@query("doc_pages", f"SELECT doc_id, CAST(i AS BIGINT) AS page, length(p[i]) AS chars, md5(p[i]) AS digest FROM (SELECT doc_id, {PAGES_SQL} AS p FROM documents), range(1, 3) r(i) WHERE i <= len(p)")
def pages(t: Tables) -> DataFrame:
    """Pages between marks, numbered from 1."""
    p = t.documents.select("doc_id", F.posexplode(T.split_pages(_paged())).alias("i", "body"))
    return p.select("doc_id", (F.col("i") + 1).cast("long").alias("page"), F.length("body").cast("long").alias("chars"), F.md5("body").alias("digest"))


@query("doc_subject", "SELECT doc_id, 'Unit ' || doc_id AS subject, 1 AS page FROM documents")
def subject(t: Tables) -> DataFrame:
    """First stated subject of five pages."""
    return t.documents.select("doc_id", T.subject(_paged()).alias("s")).select("doc_id", "s.subject", "s.page")


@query("doc_permit_type", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'FESOP / operating permit' WHEN 1 THEN 'CAAPP operating permit' WHEN 2 THEN 'Construction permit' ELSE 'Air permit / application record' END AS kind, CASE WHEN doc_id % 4 = 2 THEN 'Revised' ELSE 'Initial or unspecified' END AS action FROM documents")
def permit_type(t: Tables) -> DataFrame:
    """Kind and action of a permit."""
    return t.documents.select("doc_id", T.permit_type(_paged()).alias("kind"), T.permit_action(_paged()).alias("action"))


def _equipment_text() -> Column:
    """A counted rating in kW, a spelt count, a counted rating in HP, an inventory, and a heading with a rating alone."""
    size = F.col("p_size").cast("string")
    shapes = [
        ("One (", size, ") diesel engine rated at 2,", F.lpad((F.col("p_size") * 10).cast("string"), 3, "0"), " kW (3,200 HP) emergency generators, units G-1 to G-9, each Caterpillar with SCR."),
        ("Permit for two 1,", (F.col("p_size") + 100).cast("string"), " kW standby generators, Generator #4."),
        ("The source has (", size, ") 1,500 HP backup gensets with a DPF."),
        ("A plant consisting of (", size, ") 2,000 kW emergency generators by Cummins Model QSK60, pursuant to rule 9. Elsewhere (7) 900 kW emergency generators."),
        ("Description of emission units to be operated: 1,250 kW engine of an emergency generator G-", size, ", (3) 800 kW pumps"),
    ]
    parts = [F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in shape]) for shape in shapes]
    return F.concat(F.lit("===== PAGE 1 =====\n"), F.element_at(F.array(*parts), (F.col("p_partkey") % len(parts) + 1).cast("int")))


@query(
    "doc_equipment",
    """SELECT p_partkey, 1 AS page, (CASE p_partkey % 5 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE p_size END)::INT AS quantity,
  (CASE p_partkey % 5 WHEN 0 THEN 2000 + p_size * 10 WHEN 1 THEN 1100 + p_size WHEN 3 THEN 2000 WHEN 4 THEN 1250 END)::INT AS kw, CASE p_partkey % 5 WHEN 0 THEN 3200 WHEN 2 THEN 1500 END AS hp,
  CASE p_partkey % 5 WHEN 0 THEN 'G-1 to G-9' WHEN 1 THEN 'Generator #4' WHEN 4 THEN 'G-' || p_size END AS unit_ids,
  CASE p_partkey % 5 WHEN 0 THEN 'Selective catalytic reduction' WHEN 2 THEN 'Diesel particulate filter' END AS control, CASE p_partkey % 5 WHEN 0 THEN 'Caterpillar' WHEN 3 THEN 'Cummins' END AS maker,
  CASE p_partkey % 5 WHEN 0 THEN 'Caterpillar with' WHEN 3 THEN 'Cummins Model QSK60' END AS maker_model, p_partkey % 5 <> 4 AS stated, CASE p_partkey % 5 WHEN 3 THEN 'High' ELSE 'Medium' END AS confidence FROM part""",
)
def equipment(t: Tables) -> DataFrame:
    """Generator groups found in text, in five shapes."""
    rows = E.equipment(t.part.select("p_partkey", _equipment_text().alias("body")), "p_partkey", "body")
    return rows.select("p_partkey", *[F.col(c).cast("int").alias(c) for c in ("page", "quantity", "kw", "hp")], "unit_ids", "control", "maker", "maker_model", "stated", "confidence")


@query(
    "doc_runtime_limits",
    """SELECT p_partkey, page, l AS limit_type, CASE WHEN page = 3 AND v = 0 THEN 1000 + p_size ELSE v END AS value, u AS unit, a AS averaging_period FROM part,
(VALUES (2, 'Runtime - individual', 500::BIGINT, 'hours/year per generator', 'Annual'), (2, 'Runtime - aggregate', 8760::BIGINT, 'hours/year total', 'Annual'),
  (3, 'Diesel fuel consumption', 0::BIGINT, 'gallons/month', 'Monthly'), (3, 'Diesel fuel consumption', 12000::BIGINT, 'gallons/year', 'Annual')) x(page, l, v, u, a)
WHERE (page = 2 AND (p_partkey % 3 <> 2 OR l = 'Runtime - individual')) OR (page = 3 AND p_partkey % 2 = 0)""",
)
def runtime_limits(t: Tables) -> DataFrame:
    """Hour limits around a line and fuel limits, page by page."""
    total = F.when(F.col("p_partkey") % 3 == 2, " each").otherwise(" each and 8,760 hours/year in all")
    fuel = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Total diesel fuel burned shall not exceed 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" gallons/month and 12,000 gallons/year."))).otherwise("No fuel limit, 10 hours/year")
    body = F.concat(F.lit("===== PAGE 1 =====\n9 hours/year\n===== PAGE 2 =====\nHours of Operation\n500 hours/year"), total, F.lit("\n===== PAGE 3 =====\n"), fuel)
    return E.permit_limits(t.part.select("p_partkey", body.alias("body")), "p_partkey", "body")


@query("doc_group_context", "SELECT p_partkey, '(' || p_size || ') engine, 2,' || lpad(CAST(p_size * 10 AS VARCHAR), 3, '0') || ' kW generator' AS context FROM part")
def group_context(t: Tables) -> DataFrame:
    """Last equipment group in the 900 characters before a place."""
    body = F.concat(F.lit("Two (2) engines, 1,000 kW generator; then ("), F.col("p_size"), F.lit(") engine, 2,"), F.lpad((F.col("p_size") * 10).cast("string"), 3, "0"), F.lit(" kW generator. Total diesel fuel"))
    before = F.substring_index(body, "Total", 1)
    found = F.regexp_extract_all(F.right(before, F.lit(900)), F.lit(r"(?is)\([0-9 ]{1,3}\)[^()]{0,100}?[0-9,]{3,6} *kW.{0,160}?(?:generator|genset)"), F.lit(0))
    return t.part.select("p_partkey", F.element_at(found, -1).alias("context"))


_LINES = "lines AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(
    "doc_line_window",
    f"WITH {_LINES} SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_offset, md5(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), ' ')) AS digest FROM lines",
)
def line_window(t: Tables) -> DataFrame:
    """Lines with offset and the lines around them."""
    lines = D.line_windows(t.documents, "doc_id", "text")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line_offset", F.md5("window").alias("digest"))


@query("doc_ids_regex", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || 'AAB' END AS ids, CASE WHEN o_orderkey % 3 = 0 THEN 'Unreviewed' WHEN o_orderkey % 3 = 1 THEN 'Consistent' ELSE 'Possible mismatch' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'A-2024-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') ELSE 'none' END AS notice FROM orders")
def ids_regex(t: Tables) -> DataFrame:
    """Source ids, whether they fit, and notice numbers (F20 F21); ids and notices are the low digits of keys of any width."""
    k = F.col("o_orderkey")
    own = F.concat(F.lpad((k % 1_000_000).cast("string"), 6, "0"), F.lit("AAB"))
    text = F.concat(F.when(k % 3 == 0, "no id").otherwise(F.concat(F.lit("id "), own, F.lit(" and again "), own)), F.when(k % 2 == 0, F.concat(F.lit(" notice A-2024-"), F.lpad((k % 100_000).cast("string"), 5, "0"))).otherwise(""))
    ids = T.source_ids(text)
    expected = F.when(k % 3 == 1, own).otherwise("other")
    return t.orders.select("o_orderkey", F.array_join(ids, "|").alias("ids"), T.identity_status(ids, expected).alias("status"), T.notice_number(text, F.lit("none")).alias("notice"))


@query("doc_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_date(t: Tables) -> DataFrame:
    """Four written forms, with ends and case as scans have them."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "M/d/yyyy")).when(k == 1, F.concat(F.lit(" "), F.date_format(d, "M/d/yy"), F.lit(" ;"))).when(k == 2, F.upper(F.date_format(d, "MMMM d, yyyy"))).when(k == 3, F.concat(F.date_format(d, "MMM  d, yyyy"), F.lit("."))).otherwise("undated")
    return t.orders.select("o_orderkey", T.parse_date(text).alias("day"))


_IMPL = "r AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, CAST(l_quantity % 3 AS INT) AS quantity, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 4 * 100 END AS kw, CASE WHEN l_suppkey % 5 = 4 THEN NULL ELSE l_suppkey % 2 * 100 END AS hp, l_tax < 0.04 AS stated, l_linenumber FROM lineitem)"


@query(
    "doc_implicit_suppression",
    f"""WITH {_IMPL}, b AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r g WHERE g.quantity > 1 AND g.doc = r.doc AND g.page = r.page AND g.kw IS NOT DISTINCT FROM r.kw AND (g.hp IS NOT DISTINCT FROM r.hp OR r.hp IS NULL) AND r.quantity = 1 AND NOT r.stated)
  AND NOT EXISTS (SELECT 1 FROM r k WHERE k.kw IS NOT NULL AND k.doc = r.doc AND k.page = r.page AND k.quantity = r.quantity AND k.hp IS NOT DISTINCT FROM r.hp AND r.kw IS NULL))
SELECT doc, CAST(page AS INT) AS page, quantity, CAST(kw AS BIGINT) AS kw, CAST(hp AS BIGINT) AS hp, min(l_linenumber) AS first_line FROM b GROUP BY ALL""",
)
def implicit_suppression(t: Tables) -> DataFrame:
    """Rows that others explain go, then the first of each key stays."""
    li = t.lineitem
    rows = li.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_quantity") % 3).cast("int").alias("quantity"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey") % 4 * 100).alias("kw"), F.when(F.col("l_suppkey") % 5 != 4, F.col("l_suppkey") % 2 * 100).alias("hp"), (F.col("l_tax") < 0.04).alias("stated"), "l_linenumber",
    )
    kept = D.suppress_implicit(rows, "doc").drop("stated")
    return first_wins(kept, ["doc", "page", "quantity", "kw", "hp"], ["l_linenumber"]).withColumnRenamed("l_linenumber", "first_line")


@query(
    "doc_near_duplicates",
    """WITH s AS (SELECT source, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT a.source, a.doc_id AS a, b.doc_id AS b, floor(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 10000 + 0.5) / 10000 AS jaccard
FROM s a JOIN s b ON a.source = b.source AND a.doc_id < b.doc_id AND len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) >= 0.72 * len(b.w) AND len(b.w) >= 0.72 * len(a.w)
WHERE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.72::DOUBLE""",
)
def near_duplicates(t: Tables) -> DataFrame:
    """Documents of a source that share most words."""
    return D.near_duplicate_evidence(t.documents, "source", "doc_id", "text").select("source", "a", "b", rounded(F.col("jaccard")).alias("jaccard"))


def _permits(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "FESOP / operating permit").when(F.col("o_orderstatus") == "O", "Construction permit").otherwise("Application")
    return t.orders.select(
        F.col("o_custkey").alias("agency"), F.col("o_orderkey").alias("doc"), kind.alias("kind"), F.when(F.col("o_orderkey") % 13 == 0, "Confirmed mismatch").otherwise("Consistent").alias("status"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate").cast("date")).alias("day"), (F.col("o_orderkey") % 3 != 0).alias("has_rows"), (F.col("o_orderkey") % 19 == 0).alias("misfiled"),
    )


_PERMITS = "p AS (SELECT o_custkey AS agency, o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'FESOP / operating permit' WHEN 'O' THEN 'Construction permit' ELSE 'Application' END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN 'Confirmed mismatch' ELSE 'Consistent' END AS status, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 3 <> 0 AS has_rows, o_orderkey % 19 = 0 AS misfiled FROM orders)"
_LATEST = f"{_PERMITS}, latest AS (SELECT agency, doc AS latest_doc, day AS baseline_day FROM (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY day DESC, doc) AS n FROM p WHERE status <> 'Confirmed mismatch' AND lower(kind) LIKE '%operating%' AND day IS NOT NULL) WHERE n = 1)"
_ROLES = f"{_LATEST}, roles AS (SELECT p.*, CASE WHEN doc = latest_doc THEN 'latest_operating_permit' WHEN lower(kind) LIKE '%construction%' AND day > baseline_day THEN 'post_baseline_construction' WHEN lower(kind) LIKE '%construction%' THEN 'construction' WHEN lower(kind) LIKE '%operating%' THEN 'historical_operating' ELSE 'other' END AS role FROM p LEFT JOIN latest USING (agency))"


@query("doc_latest_permit", f"WITH {_LATEST} SELECT agency, latest_doc, baseline_day FROM latest")
def latest_permit(t: Tables) -> DataFrame:
    """Newest eligible permit, the first of equals."""
    return D.latest_operating(_permits(t), "agency", "doc").withColumnRenamed("_a", "agency")


@query("doc_evidence_role", f"WITH {_ROLES} SELECT agency, doc, role FROM roles")
def evidence_role(t: Tables) -> DataFrame:
    """Role of each document against its agency's baseline."""
    return D.evidence_roles(_permits(t), "agency", "doc").select("agency", "doc", "role")


@query(
    "doc_selection",
    f"""WITH {_ROLES}, w AS (SELECT *, coalesce(bool_or(role = 'latest_operating_permit' AND has_rows) OVER (PARTITION BY agency), false) AS latest_has, max(CASE WHEN has_rows THEN day END) OVER (PARTITION BY agency) AS newest FROM roles)
SELECT agency, doc, role, NOT misfiled AND CASE WHEN latest_has THEN role IN ('latest_operating_permit', 'post_baseline_construction') ELSE has_rows AND coalesce(day = newest, false) END AS selected FROM w""",
)
def selection(t: Tables) -> DataFrame:
    """Which documents make the current inventory."""
    return D.select_current(D.evidence_roles(_permits(t), "agency", "doc"), "agency", "doc").select("agency", "doc", "role", "selected")


@query("doc_category_map", "SELECT doc_id, 'DOC-' || source || '-' || CASE doc_id % 5 WHEN 0 THEN 'AIR' WHEN 1 THEN 'COMP' WHEN 2 THEN 'NPDES' WHEN 3 THEN 'SR' ELSE 'DOC' END || '-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS id, CASE WHEN doc_id = 3 THEN 'src_corrected' ELSE source END AS agency FROM documents")
def category_map(t: Tables) -> DataFrame:
    """Codes by folder and keyed corrections."""
    slug = F.element_at(F.array(*[F.lit(x) for x in ("air", "compliance", "npdes", "site-remediation", "maps")]), (F.col("doc_id") % 5 + 1).cast("int"))
    fixes = t.spark.createDataFrame([(3, "src_corrected")], "fix_id long, fixed string")
    joined = t.documents.join(F.broadcast(fixes), F.col("doc_id") == F.col("fix_id"), "left")  # one row for each manual correction
    ident = F.concat_ws("-", F.lit("DOC"), "source", T.category_code(slug), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    return joined.select("doc_id", ident.alias("id"), F.coalesce("fixed", "source").alias("agency"))


@query("doc_plausibility", "SELECT count(*) AS plausible FROM lineitem WHERE l_quantity BETWEEN 1 AND 200 AND (l_partkey % 3 = 0 OR l_extendedprice / 10 BETWEEN 100 AND 10000) AND l_extendedprice / 5 BETWEEN 100 AND 20000")
def plausibility(t: Tables) -> DataFrame:
    """Bounds that nulls pass (Q04 Q05)."""
    kw = F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice") / 10)
    return t.lineitem.where(D.plausible(F.col("l_quantity"), kw, F.col("l_extendedprice") / 5)).agg(F.count(F.lit(1)).alias("plausible"))


@query("doc_validate", "SELECT doc_id, regexp_full_match(substr(text, 1, 4), '[0-9]+') AS digits, substr(text, 1, 1) = 'T' AS magic, length(text) > 0 AS filled FROM documents")
def validate(t: Tables) -> DataFrame:
    """Digits, leading bytes and emptiness (Q13 Q14)."""
    return t.documents.select("doc_id", F.substring("text", 1, 4).rlike("^[0-9]+$").alias("digits"), (F.substring(F.encode("text", "UTF-8"), 1, 1) == F.lit(b"T")).alias("magic"), (F.length("text") > 0).alias("filled"))


@query("doc_confidence", f"SELECT user_id, {r_sql('sum(m)::DOUBLE / count(m) / 1000000')} AS mean_confidence FROM (SELECT user_id, day(ts) AS page, CAST(floor(sum(CAST(round(value * 1000000) AS BIGINT))::DOUBLE / count(value) + 0.5) AS BIGINT) AS m FROM events GROUP BY ALL) GROUP BY user_id")
def confidence(t: Tables) -> DataFrame:
    """Mean of page means (A35), in whole millionths so that no order of rows shows."""
    mean = F.floor(F.sum(F.round(F.col("value") * 1e6).cast("long")).cast("double") / F.count("value") + 0.5)
    by_page = t.events.groupBy("user_id", F.dayofmonth("ts").alias("page")).agg(mean.alias("m"))
    return by_page.groupBy("user_id").agg(rounded(F.sum("m").cast("double") / F.count("m") / 1e6).alias("mean_confidence"))


@query("doc_reading_order", "SELECT l_orderkey, array_to_string(list(CAST(l_linenumber AS VARCHAR) ORDER BY -(l_quantity + l_tax), l_discount, l_linenumber, l_partkey), ' ') AS text FROM lineitem GROUP BY l_orderkey")
def reading_order(t: Tables) -> DataFrame:
    """Boxes from top to bottom, then left to right."""
    key = F.struct((-(F.col("l_quantity") + F.col("l_tax"))).alias("y"), F.col("l_discount").alias("x"), "l_linenumber", "l_partkey")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("b"))
    return rows.select("l_orderkey", F.array_join(F.transform("b", lambda s: s["l_linenumber"].cast("string")), " ").alias("text"))


@query("doc_sha_manifest", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def sha_manifest(t: Tables) -> DataFrame:
    """Hash and size of each content."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("doc_incremental", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'new' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0")
def incremental(t: Tables) -> DataFrame:
    """What is not yet held with this hash: even ids are, every tenth with an old one (S15 S23 T-S1)."""
    from ..sources.manifest import todo

    now = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    held = t.documents.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.sha2("text", 256)).alias("sha256"))
    return todo(now, held, "doc_id", "sha256").select("doc_id", "reason")


@query("html_links", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS INT) AS links, coalesce((regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))[1], '') AS first_link, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def html_links(t: Tables) -> DataFrame:
    """Links of a page and its host."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.size(links).alias("links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), T.url_host(F.col("url")).alias("host"))


@query("html_cells", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, 1 AS row_no, CAST(n_nationkey AS VARCHAR) AS second_cell, n_name AS name, '/d/' || n_nationkey AS href FROM nation")
def html_cells(t: Tables) -> DataFrame:
    """Rows of a scraped table whose second cell is a number."""
    from ..sources.html_table import table_rows

    page = F.concat(F.lit("<table><tr><th>a</th><th>id</th><th>n</th></tr><tr><td>x</td><td>"), "n_nationkey", F.lit('</td><td><a href="/d/'), "n_nationkey", F.lit('">'), "n_name", F.lit("</a> </td></tr></table>"))
    rows = table_rows(t.nation.select("n_nationkey", page.alias("html")), "n_nationkey", "html")
    good = rows.where((F.size("cells") >= 3) & F.get("cells", F.lit(1)).rlike("^[0-9]+$"))
    return good.select("n_nationkey", "row_no", F.get("cells", F.lit(1)).alias("second_cell"), F.get("cells", F.lit(2)).alias("name"), F.get("hrefs", F.lit(0)).alias("href"))


@query("txt_safe_name", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_brand || ' / ' || p_name || '.', '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') AS name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS copy FROM part")
def safe_name(t: Tables) -> DataFrame:
    """File names, and a number where a name is taken."""
    name = T.safe_name(F.concat("p_brand", F.lit(" / "), "p_name", F.lit(".")))
    copy = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey")).cast("long")
    return t.part.select("p_partkey", name.alias("name"), copy.alias("copy"))


@query("txt_agency_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS agency FROM orders")
def agency_id(t: Tables) -> DataFrame:
    """Ids as digits, decimals or something else."""
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", T.normalize_agency_id(F.when(k % 3 == 0, F.concat(F.lit(" "), k)).when(k % 3 == 1, F.concat(k, F.lit(".0"))).otherwise(F.concat(k, F.lit(".5")))).alias("agency"))


@query("txt_joins", "SELECT n_nationkey, array_to_string(list_filter([n_name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE r_name END], lambda x: x IS NOT NULL AND x <> ''), '|') AS joined, CASE WHEN r_name LIKE '%A%' AND lower(r_name) LIKE '%asia%' THEN 'Allegation' ELSE 'Record' END AS kind FROM nation JOIN region ON r_regionkey = n_regionkey")
def joins(t: Tables) -> DataFrame:
    """Joined lists without empties; text from a category."""
    j = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    parts = F.array("n_name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("r_name")))
    return j.select("n_nationkey", T.safe_join(parts).alias("joined"), F.when(F.lower("r_name").contains("asia"), "Allegation").otherwise("Record").alias("kind"))


@query("txt_snippet", "SELECT doc_id, substr(regexp_extract(text, '[^.]*\\.'), 1, 100) AS snippet FROM documents")
def snippet(t: Tables) -> DataFrame:
    """A match cut to a length."""
    return t.documents.select("doc_id", T.snippet(F.col("text"), r"[^.]*\.", 100).alias("snippet"))


@query("txt_ascii_fold", "SELECT doc_id, md5(f) AS digest, length(f) AS chars FROM (SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS f FROM documents)")
def ascii_fold(t: Tables) -> DataFrame:
    """NFKD to ASCII (F32); the SQL strips accents, which is the same for the letters that the texts have."""
    folded = t.documents.select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.md5("folded").alias("digest"), F.length("folded").alias("chars"))


@query("txt_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST((month(o_orderdate) - 1) // 3 + 1 AS INT) AS q, month(o_orderdate) BETWEEN 5 AND 10 AS in_season FROM orders")
def date_parts(t: Tables) -> DataFrame:
    """Parts of dates, quarter and season."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.month(d).between(5, 10).alias("in_season"))


@query("wb_text", "SELECT doc_id, CASE WHEN length(c) > 80 THEN substr(c, 1, 79) || '...' ELSE c END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS c FROM documents)")
def workbook_text(t: Tables) -> DataFrame:
    """Text cut for a cell."""
    return t.documents.select("doc_id", T.ellipsis(F.col("text"), 80).alias("short"))


@query("xlsx_column_index", "SELECT p_partkey, CAST(p_partkey % 17000 AS INT) AS idx FROM part")
def column_index(t: Tables) -> DataFrame:
    """Column letters and back."""
    k = (F.col("p_partkey") % 17_000).cast("int")
    return t.part.select("p_partkey", T.column_index(T.column_letters(k)).alias("idx"))
