"""Entity resolution queries over the star tables: customers are curated records, suppliers registry ones, parts a layer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import albers, coordinate_valid
from ..functions.numeric import rounded
from ..operators import graph, match, rollup, spatial, survive
from .base import Tables, lat, lat_sql, lon, lon_sql, points, points_sql, query, r_sql

STOPS_SQL = "[" + ", ".join(f"'{t}'" for t in T.STOP_TOKENS) + "]"
ROMAN_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ROMAN.items()) + "}"


def norm_sql(x: str) -> str:
    return f"array_to_string({tokens_list_sql(x)}, ' ')"


def tokens_list_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(replace(lower(trim(coalesce({x}, ''))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT list_contains({STOPS_SQL}, t))"


def set_sql(x: str) -> str:
    return f"list_sort(list_distinct({tokens_list_sql(x)}))"


def codes_sql(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower(trim(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
    num = lambda t: f"regexp_replace({t}, '^0+([0-9])', '\\1')"
    compact = f"list_transform(list_filter({words}, lambda t: regexp_full_match(t, '[a-z]{{2,}}[0-9]{{1,3}}')), lambda t: regexp_extract(t, '^[a-z]+') || {num("regexp_extract(t, '[0-9]+$')")})"
    paired = f"list_filter(list_transform({words}, lambda t, i: CASE WHEN NOT list_contains({STOPS_SQL}, t) AND length(t) >= 2 THEN t || CASE WHEN regexp_full_match(({words})[i + 1], '[0-9]{{1,3}}') THEN {num(f'({words})[i + 1]')} ELSE {ROMAN_SQL}[({words})[i + 1]] END END), lambda c: c IS NOT NULL)"
    return f"list_sort(list_distinct(list_concat({compact}, {paired})))"


def score_sql(a: str, b: str) -> str:
    """Of two token sets."""
    both, j = f"len(list_intersect({a}, {b}))", f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"
    sa, sb = f"array_to_string(list_sort({a}), ' ')", f"array_to_string(list_sort({b}), ' ')"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE WHEN contains({sa}, {sb}) OR contains({sb}, {sa}) THEN greatest({j}, {both}::DOUBLE / least(len({a}), len({b}))) ELSE {j} END"


@query("er_clean_number", "SELECT p_partkey, " + r_sql("TRY_CAST(nullif(regexp_extract(regexp_replace(v, '[$,]', '', 'g'), '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)", 2) + " AS number FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE 'about $' || p_partkey || ',' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.5 sq ft' END AS v FROM part)")
def clean_number(t: Tables) -> DataFrame:
    """First number of a money-like text, null if there is none."""
    v = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("about $"), F.col("p_partkey"), F.lit(","), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5 sq ft")))
    return t.part.select("p_partkey", rounded(T.clean_number(v), 2).alias("number"))


@query("er_clean_text", "SELECT n_nationkey, trim(coalesce(CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '  ' || n_name || ' ' END, '')) AS cleaned FROM nation")
def clean_text(t: Tables) -> DataFrame:
    """Trimmed, null as empty."""
    return t.nation.select("n_nationkey", T.clean_text(F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))).alias("cleaned"))


def _part_name() -> Column:
    return F.concat(F.col("p_name"), F.lit(" Data Center & "), F.col("p_brand"), F.lit(" LLC"))


PART_NAME_SQL = "(p_name || ' Data Center & ' || p_brand || ' LLC')"


@query("er_normalize_name", f"SELECT p_partkey, {norm_sql(PART_NAME_SQL)} AS name FROM part")
def normalize_name(t: Tables) -> DataFrame:
    """F03."""
    return t.part.select("p_partkey", T.normalize_name(_part_name()).alias("name"))


@query("er_tokens", f"SELECT p_partkey, array_to_string({set_sql(PART_NAME_SQL)}, '|') AS tokens FROM part")
def tokens(t: Tables) -> DataFrame:
    """F04."""
    return t.part.select("p_partkey", F.array_join(F.array_sort(T.token_set(_part_name())), "|").alias("tokens"))


def _coded() -> Column:
    tail = F.element_at(F.array(*[F.lit(x) for x in ("II", "07", "site 3", "ix", "")]), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return F.concat(F.col("p_name"), F.lit(" "), F.regexp_replace("p_brand", "#", ""), F.lit(" ORD-"), F.col("p_size"), F.lit(" Chicago "), tail)


CODED_SQL = "(p_name || ' ' || replace(p_brand, '#', '') || ' ORD-' || p_size || ' Chicago ' || (['II', '07', 'site 3', 'ix', ''])[p_partkey % 5 + 1])"


@query("er_facility_codes", f"SELECT p_partkey, array_to_string({codes_sql(CODED_SQL)}, '|') AS codes FROM part")
def facility_codes(t: Tables) -> DataFrame:
    """F05."""
    return t.part.select("p_partkey", F.array_join(T.facility_codes(_coded()), "|").alias("codes"))


_PAIRS_SQL = "SELECT a.p_partkey AS a, b.p_partkey AS b, {cols} FROM ({src}) a JOIN ({src}) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


def _part_pairs(t: Tables, **columns: Column) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", "p_size", *[c.alias(n) for n, c in columns.items()])
    a, b = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]), rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    return spatial.dealt_join(a, b, [("a_p_brand", "b_p_brand"), ("a_p_size", "b_p_size")], F.col("a_p_partkey") < F.col("b_p_partkey"))


@query("er_code_conflict", _PAIRS_SQL.format(cols="len(a.c) > 0 AND len(b.c) > 0 AND len(list_intersect(a.c, b.c)) = 0 AS conflict", src=f"SELECT p_partkey, p_brand, p_size, {codes_sql(CODED_SQL)} AS c FROM part"))
def code_conflict(t: Tables) -> DataFrame:
    """F07 over part pairs of a brand and size."""
    return _part_pairs(t, c=T.facility_codes(_coded())).select(F.col("a_p_partkey").alias("a"), F.col("b_p_partkey").alias("b"), match.code_conflict(F.col("a_c"), F.col("b_c")).alias("conflict"))


@query("er_name_score", _PAIRS_SQL.format(cols=r_sql(score_sql("a.s", "b.s")) + " AS score", src=f"SELECT p_partkey, p_brand, p_size, {set_sql(PART_NAME_SQL)} AS s FROM part"))
def name_score(t: Tables) -> DataFrame:
    """F06 U03."""
    s = T.token_set(_part_name())
    score = match.token_score(F.col("a_s"), F.col("b_s"), F.col("a_text"), F.col("b_text"))
    return _part_pairs(t, s=s, text=match.token_text(s)).select(F.col("a_p_partkey").alias("a"), F.col("b_p_partkey").alias("b"), rounded(score).alias("score"))


# Records: names share words by key, so that every rule has cases.
_WORDS = ("alpha", "bravo", "cirrus", "delta", "ember", "falcon", "garnet", "harbor", "indigo", "juniper")
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"


def _name(key: Column) -> Column:
    words = F.array(*[F.lit(w) for w in _WORDS])
    word = lambda m: F.element_at(words, (F.pmod(F.floor(key * m), F.lit(10)) + 1).cast("int"))
    return F.concat(word(1), F.lit(" "), word(3), F.when(key % 4 == 0, F.concat(F.lit(" "), (key % 3).cast("string"))).otherwise(""), F.lit(" Data Center LLC"))


def _name_sql(key: str) -> str:
    return f"({_WORDS_SQL}[{key} % 10 + 1] || ' ' || {_WORDS_SQL}[{key} * 3 % 10 + 1] || CASE WHEN {key} % 4 = 0 THEN ' ' || ({key} % 3) ELSE '' END || ' Data Center LLC')"


def curated(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.concat(F.lit("C:"), "c_custkey").alias("uid"), F.lit("curated").alias("source"), F.lit("curated").alias("layer"), _name(F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("operator"),
        F.when(F.col("c_custkey") % 3 == 0, "Proposed").otherwise(" Operating ").alias("status"), lon(F.col("c_custkey")).alias("lon"), lat(F.col("c_custkey")).alias("lat"), F.col("c_custkey").alias("ord"),
    )


def registry(t: Tables) -> DataFrame:
    s = t.supplier
    return s.select(
        F.concat(F.lit("S:"), "s_suppkey").alias("uid"), F.lit("registry").alias("source"), F.lit("registry").alias("layer"), _name(F.col("s_suppkey") * 7).alias("name"), F.lit("").alias("operator"),
        F.lit("Operating/inferred").alias("status"), lon(F.col("s_suppkey"), 0.0006).alias("lon"), lat(F.col("s_suppkey"), 0.0003).alias("lat"), (F.col("s_suppkey") + 10_000_000).alias("ord"),
    )


CURATED_SQL = f"SELECT 'C:' || c_custkey AS uid, 'curated' AS source, 'curated' AS layer, {_name_sql('c_custkey')} AS name, c_mktsegment AS operator, CASE WHEN c_custkey % 3 = 0 THEN 'Proposed' ELSE ' Operating ' END AS status, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat, c_custkey AS ord FROM customer"
REGISTRY_SQL = f"SELECT 'S:' || s_suppkey AS uid, 'registry' AS source, 'registry' AS layer, {_name_sql('s_suppkey * 7')} AS name, '' AS operator, 'Operating/inferred' AS status, {lon_sql('s_suppkey', 0.0006)} AS lon, {lat_sql('s_suppkey', 0.0003)} AS lat, s_suppkey + 10000000 AS ord FROM supplier"


_READ = ["tokens", "operator_tokens", "tokens_text", "operator_tokens_text", "codes"]


def _read(df: DataFrame) -> DataFrame:
    """df with what pairs need to know of a name and an operator."""
    read = df.withColumn("tokens", T.token_set(F.col("name"))).withColumn("operator_tokens", T.token_set(F.col("operator")))
    return read.withColumns({f"{c}_text": match.token_text(F.col(c)) for c in ("tokens", "operator_tokens")} | {"codes": T.facility_codes(F.col("name"))})


def _side(df: DataFrame, prefix: str, point: str) -> DataFrame:
    """What pairs need to know of a record, worked out once a record."""
    return _read(df).select(F.struct("uid", "source", "status", *_READ).alias(prefix), albers(F.col("lon"), F.col("lat")).alias(point))


#: Pairs of different facts whose rules are worked out ahead; if there are more, each pair of records is scored.
RULES_AHEAD = 1 << 18
_FACTS = ["source", "status", "name", "operator"]


def _rules_ahead(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Records of both sides (uid, x, y, kind), kind being the number of their facts, and of each two kinds (lk, rk) the score and the rule in each of match.BANDS. Pairs
    of records are many, pairs of what they say few: None if these are not, for then nothing is saved. Each step is written, for what is used more than once
    would be worked out again at each use."""
    sides = []
    for df in (curated(t), registry(t)):
        p = albers(F.col("lon"), F.col("lat"))
        sides.append(graph.cut(df.select("uid", p.alias("p"), *_FACTS)))
    kinds = [df.select(*_FACTS).distinct() for df in sides]
    n = [k.count() for k in kinds]
    if n[0] * n[1] > RULES_AHEAD:
        return None
    number = (F.row_number().over(Window.orderBy(*_FACTS)) - 1).cast("int")
    kinds = [graph.cut(_read(k.withColumn("kind", number))) for k in kinds]  # no more rows than RULES_AHEAD, as what is broadcast

    def records(df: DataFrame, kind: DataFrame) -> DataFrame:
        known = kind.select("kind", *[F.col(c).alias(f"_{c}") for c in _FACTS])
        return graph.cut(df.join(F.broadcast(known), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _FACTS]).select("uid", "p.x", "p.y", "kind"))

    left, right = (k.select(F.col("kind").alias(f"{s}k"), F.struct("source", "status", *_READ).alias(s)) for k, s in zip(kinds, "lr", strict=True))
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    scored = graph.cut(left.repartition(parts).crossJoin(right).withColumn("score", match.best_score(F.col("l"), F.col("r"))))
    rules = F.array(*[match.match_rule(F.lit(d), F.col("score"), F.col("l"), F.col("r")) for d in match.BANDS])
    return records(sides[0], kinds[0]), records(sides[1], kinds[1]), graph.cut(scored.select("lk", "rk", "score", rules.alias("rules")))


def _per_kinds(rules: DataFrame, value: Column, kind: type) -> np.ndarray:
    """A value of each two kinds as an array [lk, rk]."""
    found = rules.select("lk", "rk", value.alias("v")).toArrow()
    lk, rk, v = (found.column(c).to_numpy() for c in ("lk", "rk", "v"))
    out = np.zeros((lk.max() + 1, rk.max() + 1), kind) if len(v) else np.zeros((1, 1), kind)
    out[lk, rk] = v
    return out


def _arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(t.column(c).to_numpy() for c in ("x", "y", "kind"))


def candidates(t: Tables) -> DataFrame:
    """Pairs of a curated and a registry record within 1 km with score and rule."""
    ahead = _rules_ahead(t)
    if ahead is None:
        return _scored(_side(curated(t), "l", "point"), _side(registry(t), "r", "other_point"), 1000.0)
    left, right, rules = ahead
    left, right = (df.select(F.col("uid").alias(f"{side}_uid"), F.struct("x", "y").alias(point), F.col("kind").alias(f"_{side[0]}k")) for df, side, point in ((left, "left", "point"), (right, "right", "other_point")))
    pairs = spatial.distance_join(left, right, 1000.0)
    met = pairs.join(F.broadcast(rules), (F.col("_lk") == F.col("lk")) & (F.col("_rk") == F.col("rk")))  # no more rows than RULES_AHEAD
    away = F.col("distance_m")
    rule = F.when(away <= match.BANDS[0], F.col("rules")[0]).when(away <= match.BANDS[1], F.col("rules")[1]).otherwise(F.col("rules")[2])
    return met.select("left_uid", "right_uid", "distance_m", "score", rule.alias("rule")).withColumn("grouped", match.is_grouped(F.col("rule")))


def _scored(left: DataFrame, right: DataFrame, radius: float, how: Column | None = None) -> DataFrame:
    pairs = spatial.distance_join(left, right, radius, how=how)
    scored = pairs.withColumn("score", match.best_score(F.col("l"), F.col("r")))
    rule = match.match_rule(F.col("distance_m"), F.col("score"), F.col("l"), F.col("r"))
    return scored.select(F.col("l.uid").alias("left_uid"), F.col("r.uid").alias("right_uid"), "distance_m", "score", rule.alias("rule")).withColumn("grouped", match.is_grouped(F.col("rule")))


def _side_sql(src: str, key: str, table: str, dlon: float = 0.0, dlat: float = 0.0) -> str:
    from .base import albers_sql

    x, y = albers_sql("lon", "lat")
    return f"SELECT *, {x} AS x, {y} AS y, {set_sql('name')} AS tk, {set_sql('operator')} AS ot, {codes_sql('name')} AS cd FROM ({src})"


CANDIDATES_SQL = f"""l AS ({_side_sql(CURATED_SQL, '', '')}), r AS ({_side_sql(REGISTRY_SQL, '', '')}),
near AS (SELECT l.uid AS left_uid, r.uid AS right_uid, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d, l.status AS ls, l.tk AS lt, l.ot AS lo, l.cd AS lc, r.tk AS rt, r.ot AS ro, r.cd AS rc FROM l JOIN r ON abs(l.x - r.x) <= 1000 AND abs(l.y - r.y) <= 1000),
scored AS (SELECT *, greatest({score_sql('lt', 'rt')}, {score_sql('lt', 'ro')}, {score_sql('lo', 'rt')}, {score_sql('lo', 'ro')}) AS s FROM near WHERE d <= 1000),
cand AS (SELECT left_uid, right_uid, d, s, CASE WHEN len(lc) > 0 AND len(rc) > 0 AND len(list_intersect(lc, rc)) = 0 THEN 'candidate_only_code_conflict'
  WHEN d > 100 AND len(rt) <= 2 AND len(rc) = 0 THEN 'candidate_only_low_specificity' WHEN d <= 100 AND NOT (lower(trim(ls)) <> 'operating' AND s < 0.30) THEN 'spatial_100m'
  WHEN d <= 500 AND s >= 0.30 THEN 'name_supported_500m' WHEN s >= 0.45 THEN 'strong_name_supported_1km' ELSE 'candidate_only' END AS rule FROM scored)"""


@query("er_candidate_rule", f"WITH {CANDIDATES_SQL} SELECT left_uid, right_uid, {r_sql('d', 3)} AS distance_m, {r_sql('s', 3)} AS score, rule, NOT starts_with(rule, 'candidate_only') AS grouped FROM cand")
def candidate_rule(t: Tables) -> DataFrame:
    """F08 F09 over pairs within 1 km."""
    return candidates(t).select("left_uid", "right_uid", rounded(F.col("distance_m"), 3).alias("distance_m"), rounded(F.col("score"), 3).alias("score"), "rule", "grouped")


def groups(t: Tables) -> DataFrame:
    """(node, component) of all records under grouped matches."""
    nodes = curated(t).select("uid").union(registry(t).select("uid")).withColumnRenamed("uid", "node")
    ahead = _rules_ahead(t)
    if ahead is None:
        left, right = _side(curated(t), "l", "point"), _side(registry(t), "r", "other_point")
        return graph.widened(nodes, left, right, "l.uid", "r.uid", [100.0, 1000.0], lambda a, b, radius, how: _scored(a, b, radius, how).where("grouped").select(F.col("left_uid").alias("a"), F.col("right_uid").alias("b")))
    return graph.components(nodes, _links_ahead(*ahead))


def _links_ahead(left: DataFrame, right: DataFrame, rules: DataFrame) -> DataFrame:
    """Links (a, b) that join what grouped matches join: of a block of records a forest, however many its matches are."""
    groups_at = [match.is_grouped(F.col("rules")[i]) for i in range(len(match.BANDS))]
    said = _per_kinds(rules, sum((F.when(g, F.lit(1 << i)).otherwise(F.lit(0)) for i, g in enumerate(groups_at)), F.lit(0)), np.uint8)

    def forest(a: pa.Table, b: pa.Table) -> pa.Table:
        (ax, ay, ak), (bx, by, bk) = _arrays(a), _arrays(b)
        root = graph.Forest(len(ax) + len(bx))
        farthest = np.zeros(said.shape[1])  # at which a right kind may be grouped
        for i, d in enumerate(match.BANDS):
            farthest[(said & (1 << i)).any(axis=0)] = d
        for radius in (match.BANDS[0], match.BANDS[-1]):  # what is near joins most; then only what is apart is looked at
            for chunk in spatial.chunks(ax, ay):
                near = spatial.within_bounds(bx, by, ax[chunk], ay[chunk], np.minimum(farthest[bk], radius))
                near = near[farthest[bk[near]] > 0]
                label, there = root.labels(chunk), root.labels(near + len(ax))
                values, count = np.unique(label, return_counts=True)
                most = values[count.argmax()]
                for rows, columns in ((chunk[label == most], near[there != most]), (chunk[label != most], near)):
                    if len(rows) and len(columns):
                        dx, dy = ax[rows][:, None] - bx[columns], ay[rows][:, None] - by[columns]
                        away = np.sqrt(dx * dx + dy * dy)
                        band = np.where(away <= match.BANDS[0], np.uint8(1), np.where(away <= match.BANDS[1], np.uint8(2), np.uint8(4)))
                        i, j = np.nonzero((away <= radius) & ((np.take(said[ak[rows]], bk[columns], axis=1) & band) > 0))
                        root.add(rows[i], columns[j] + len(ax))
        member, of = root.links()
        uid = pa.chunked_array([*a.column("uid").chunks, *b.column("uid").chunks], type=a.schema.field("uid").type)
        return pa.table({"a": uid.take(pa.array(member)), "b": uid.take(pa.array(of))})

    return spatial.met_in_blocks(left, right, match.BANDS[-1], forest, "a string, b string")


GROUPS_SQL = f"""RECURSIVE {CANDIDATES_SQL}, e AS (SELECT left_uid AS u, right_uid AS v FROM cand WHERE NOT starts_with(rule, 'candidate_only') UNION SELECT right_uid, left_uid FROM cand WHERE NOT starts_with(rule, 'candidate_only')),
nodes AS (SELECT uid FROM l UNION ALL SELECT uid FROM r), reach AS (SELECT uid AS u, uid AS v FROM nodes UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY u)"""


@query("graph_components", f"WITH {GROUPS_SQL} SELECT node, component, 'site_' || lpad(CAST(dense_rank() OVER (ORDER BY component) AS VARCHAR), 5, '0') AS group_id FROM comp")
def graph_components(t: Tables) -> DataFrame:
    """Groups of matched records, numbered by their smallest member."""
    return graph.numbered(groups(t), "site_", 5).select("node", "component", "group_id")


def _grouped_records(t: Tables) -> DataFrame:
    records = curated(t).union(registry(t))
    return records.join(groups(t), records.uid == F.col("node")).select(F.col("component").alias("group_id"), F.col("uid").alias("record_id"), "layer", "source", "name", "operator", "status", "ord")


_REC_SQL = f"WITH {GROUPS_SQL}, rec AS (SELECT component AS group_id, x.* FROM (SELECT uid, source, layer, name, operator, status, ord FROM l UNION ALL SELECT uid, source, layer, name, operator, status, ord FROM r) x JOIN comp ON node = uid), ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE layer WHEN 'curated' THEN 3 ELSE 4 END, name = '', ord) AS n FROM rec)"


@query("er_survivorship", f"{_REC_SQL} SELECT group_id, uid AS record_id, name, status FROM ranked WHERE n = 1")
def survivorship(t: Tables) -> DataFrame:
    """The record that stands for its group."""
    order = [survive.priority(F.col("layer")), F.when(F.col("name") != "", 0).otherwise(1), F.col("ord")]
    return survive.first_of(_grouped_records(t), ["group_id"], ["record_id", "name", "status"], order)


@query(
    "er_site_summary",
    f"""{_REC_SQL} SELECT group_id, count(*) AS members, max(CASE WHEN n = 1 THEN uid END) AS primary_id, coalesce(arg_min(name, n) FILTER (WHERE name <> ''), '') AS name, coalesce(arg_min(operator, n) FILTER (WHERE operator <> ''), '') AS operator,
array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE name <> ''))), '|') AS names, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources,
bool_or(layer <> 'curated' OR lower(trim(status)) = 'operating') AS is_built, bool_or(layer = 'curated' AND lower(trim(status)) <> 'operating') AS is_pipeline,
CASE WHEN count(DISTINCT source) > 1 THEN 'multi_source' WHEN max(CASE WHEN n = 1 THEN layer END) = 'curated' THEN 'curated_location' ELSE 'single_source_geometry' END AS confidence,
coalesce(nullif(array_to_string(list_sort(list_distinct(list(status) FILTER (WHERE layer = 'curated' AND status <> ''))), '|'), ''), 'Operating/inferred') AS status_summary FROM ranked GROUP BY group_id""",
)
def site_summary(t: Tables) -> DataFrame:
    """What each group says."""
    return survive.summarize(_grouped_records(t)).select("group_id", "members", "primary_id", "name", "operator", "names", "sources", "is_built", "is_pipeline", "confidence", "status_summary")


@query("er_match_notes", f"WITH {GROUPS_SQL} SELECT component AS group_id, array_to_string(list_sort(list_distinct(list(rule))), '|') AS notes FROM (SELECT left_uid AS u, rule FROM cand UNION ALL SELECT right_uid, rule FROM cand) x JOIN comp ON node = u GROUP BY component")
def match_notes(t: Tables) -> DataFrame:
    """Rules seen at either end of a group's candidate pairs."""
    ahead = _rules_ahead(t)
    if ahead is None:
        c = candidates(t)
        # a record's rules are few, so they are gathered where pairs are made
        ends = graph.cut(c.select(F.explode(F.array("left_uid", "right_uid")).alias("u"), "rule").distinct())
        return ends.join(groups(t), F.col("u") == F.col("node")).groupBy(F.col("component").alias("group_id")).agg(survive.joined(F.col("rule")).alias("notes"))
    labels = graph.components(curated(t).select("uid").union(registry(t).select("uid")), _links_ahead(*ahead), node="uid")
    seen = _rules_seen(*ahead).join(labels, F.col("uid") == F.col("node")).groupBy(F.col("component").alias("group_id")).agg(F.bit_or("seen").alias("seen"))
    notes = F.array(*[F.when(F.col("seen").bitwiseAND(1 << i) > 0, rule) for i, rule in enumerate(match.RULES)])
    return seen.select("group_id", F.array_join(notes, "|").alias("notes"))


def _rules_seen(left: DataFrame, right: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, seen): rules of a record's pairs within 1 km as bits in the order of match.RULES, a row for each block that it met."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.array_position(F.array(*map(F.lit, match.RULES)), F.col("rules")[i]).cast("int") - 1)
    said = [_per_kinds(rules, bit(i), np.uint8) for i in range(len(match.BANDS))]

    def see(a: pa.Table, b: pa.Table) -> pa.Table:
        (ax, ay, ak), (bx, by, bk) = _arrays(a), _arrays(b)
        seen, there = np.zeros(len(ax), np.uint8), np.zeros(len(bx), np.uint8)
        for chunk in spatial.chunks(ax, ay):
            near = spatial.within_bounds(bx, by, ax[chunk], ay[chunk], match.BANDS[-1])
            dx, dy = ax[chunk][:, None] - bx[near], ay[chunk][:, None] - by[near]
            away = np.sqrt(dx * dx + dy * dy)
            bits = np.zeros(away.shape, np.uint8)
            for of, radius in reversed(list(zip(said, match.BANDS, strict=True))):
                np.copyto(bits, np.take(of[ak[chunk]], bk[near], axis=1), where=away <= radius)
            seen[chunk] = np.bitwise_or.reduce(bits, axis=1)
            there[near] |= np.bitwise_or.reduce(bits, axis=0)
        uid = pa.chunked_array([*a.column("uid").chunks, *b.column("uid").chunks], type=a.schema.field("uid").type)
        seen = np.concatenate([seen, there])
        found = np.flatnonzero(seen)
        return pa.table({"uid": uid.take(pa.array(found)), "seen": pa.array(seen[found].astype(np.int32))})

    return spatial.met_in_blocks(left, right, match.BANDS[-1], see, "uid string, seen int")


@query("er_same_id_noop", "SELECT count(*) AS records, count(*) AS groups FROM supplier")
def same_id_noop(t: Tables) -> DataFrame:
    """Joining records that share a source id joins nothing, for the id is the record's own."""
    r = registry(t).select("uid", F.concat(F.lit("S:"), F.substring("uid", 3, 20)).alias("by_id"))
    labels = graph.components(r.select(F.col("uid").alias("node")), r.select(F.col("uid").alias("a"), F.col("by_id").alias("b")))
    return labels.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("groups"))


_RULES = [("unit_1", "NATION_1", "NATION_3;NATION_5"), ("unit_2", "NATION_2", "NATION_4;NATION_2"), ("unit_3", "NATION_7", "")]


@query(
    "er_crosswalk",
    """WITH rules(unit, seed, related) AS (VALUES ('unit_1', 'NATION_1', 'NATION_3;NATION_5'), ('unit_2', 'NATION_2', 'NATION_4;NATION_2'), ('unit_3', 'NATION_7', '')),
m AS (SELECT unit, seed AS name, 'seed' AS role FROM rules UNION ALL SELECT unit, trim(x), 'related' FROM rules, unnest(string_split(related, ';')) u(x) WHERE trim(x) <> '' AND trim(x) <> seed)
SELECT coalesce(unit, 'single_' || n_name) AS unit, n_name AS name, coalesce(role, 'seed') AS role FROM nation LEFT JOIN m ON name = n_name""",
)
def crosswalk(t: Tables) -> DataFrame:
    """Rules merge seeds and related ids into units; seeds that no rule names stay alone."""
    rules = t.spark.createDataFrame(_RULES, "unit string, seed string, related string")
    related = rollup.list_members(rules, "related").where("member <> seed").select("unit", F.col("member").alias("name"), F.lit("related").alias("role"))
    members = rules.select("unit", F.col("seed").alias("name"), F.lit("seed").alias("role")).union(related)
    nations = t.nation.select(F.col("n_name").alias("name"))
    rollup.require_none(rollup.missing(members.select("name"), nations, ["name"]), "rule names an unknown record")
    merged = members.join(nations, "name", "left_semi").select("unit", "name", "role")
    alone = nations.join(members.select("name"), "name", "left_anti").select(F.concat(F.lit("single_"), "name").alias("unit"), "name", F.lit("seed").alias("role"))
    return merged.union(alone)


@query("inv_seed_inventory", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS wave, CASE WHEN c_custkey % 11 = 0 THEN 'reference' WHEN c_acctbal < 0 THEN 'deferred' ELSE 'standard' END AS priority FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def seed_inventory(t: Tables) -> DataFrame:
    """Seeds of some classes with wave and overwritten priority."""
    from ..operators.landcover import review_priority

    wave = F.coalesce(F.element_at(F.create_map(F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2)), F.col("c_mktsegment")), F.lit(3))
    label = review_priority((F.col("c_acctbal") < 0, "deferred"), (F.col("c_custkey") % 11 == 0, "reference"))
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")).select("c_custkey", wave.alias("wave"), label.alias("priority"))


@query("inv_seed_counts", "SELECT c_mktsegment AS taxonomy, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY ALL")
def seed_counts(t: Tables) -> DataFrame:
    """A01 A03."""
    return t.customer.groupBy(F.col("c_mktsegment").alias("taxonomy")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("nations"))


_STD = ["uid", "source", "layer", "name", "status", "coordinate_valid", "is_built"]


@query(
    "er_standard_records",
    f"""SELECT uid, source, layer, name, status, lat BETWEEN 18 AND 72 AND lon BETWEEN -180 AND -60 AS coordinate_valid, source IN ('registry', 'layer') OR lower(trim(status)) = 'operating' AS is_built
FROM (SELECT * EXCLUDE (operator, ord) FROM ({CURATED_SQL} UNION ALL {REGISTRY_SQL}) UNION ALL SELECT 'building_' || p_partkey, 'layer', CASE WHEN p_partkey % 2 = 0 THEN 'building' ELSE 'campus' END, p_name, '', -88.0, CASE WHEN p_partkey % 10 = 0 THEN 0.0 ELSE 41.0 END FROM part)""",
)
def standard_records(t: Tables) -> DataFrame:
    """Three sources in one schema with derived columns."""
    layer = t.part.select(
        F.concat_ws("_", F.lit("building"), "p_partkey").alias("uid"), F.lit("layer").alias("source"), F.when(F.col("p_partkey") % 2 == 0, "building").otherwise("campus").alias("layer"), F.col("p_name").alias("name"),
        F.lit("").alias("status"), F.lit(-88.0).alias("lon"), F.when(F.col("p_partkey") % 10 == 0, 0.0).otherwise(41.0).alias("lat"),
    )
    records = curated(t).unionByName(registry(t)).unionByName(layer, allowMissingColumns=True)
    return records.withColumn("coordinate_valid", coordinate_valid(F.col("lat"), F.col("lon"))).withColumn("is_built", match.currently_built(F.col("source"), F.col("status"))).select(*_STD)


@query("er_row_ids", "SELECT n_name, 'rec_row_' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS row_id, 'nat_' || lpad(CAST(row_number() OVER (ORDER BY n_name) AS VARCHAR), 4, '0') AS serial FROM nation")
def row_ids(t: Tables) -> DataFrame:
    """Ids from file order and from a sort."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.orderBy("n_nationkey")) - 1
    serial = F.lpad(F.row_number().over(Window.orderBy("n_name")).cast("string"), 4, "0")
    return t.nation.select("n_name", F.concat(F.lit("rec_row_"), row).alias("row_id"), F.concat(F.lit("nat_"), serial).alias("serial"))


@query("er_lookup_default", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, CASE WHEN s_nationkey = 3 THEN 400 WHEN s_nationkey IN (4, 5) THEN 150 ELSE 35 END AS radius_m FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = s_nationkey")
def lookup_default(t: Tables) -> DataFrame:
    """Lookups with a default."""
    radius = t.spark.createDataFrame([(3, 400), (4, 150), (5, 150)], "k int, radius_m int")
    joined = t.supplier.join(t.nation.where("n_nationkey % 2 = 0"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(F.broadcast(radius), F.col("k") == F.col("s_nationkey"), "left")  # three rows
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("radius_m", F.lit(35)).alias("radius_m"))


@query("er_complete_keys", "SELECT n_nationkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(newest, '') AS newest FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n, floor(sum(s_acctbal) * 100 + 0.5) / 100 AS total, max(s_name) AS newest FROM supplier GROUP BY ALL) USING (n_nationkey)")
def complete_keys(t: Tables) -> DataFrame:
    """Every key with its aggregates, zeros where there is none."""
    facts = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("s_acctbal"), 2).alias("total"), F.max("s_name").alias("newest"))
    return rollup.complete_keys(t.nation.select("n_nationkey"), facts, ["n_nationkey"], {"n": 0, "total": 0.0, "newest": ""})
