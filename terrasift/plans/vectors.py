"""Retrieval queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import vectors as V
from ..operators.graph import cut
from ..operators.order import global_rank
from .base import Tables, points, points_sql, query, r_sql

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query("emb_cosine_topk", f"SELECT vec_id, rank, {r_sql('s')} AS score FROM (SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS s, row_number() OVER (ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 20")
def cosine_topk(t: Tables) -> DataFrame:
    """Exact search for one vector."""
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = t.embeddings.join(F.broadcast(q)).withColumn("s", V.cosine(F.col("embedding"), F.col("q")))  # one row
    top = scored.orderBy(F.col("s").desc(), "vec_id").limit(20)
    return top.select("vec_id", F.row_number().over(Window.orderBy(F.col("s").desc(), "vec_id")).cast("long").alias("rank"), rounded(F.col("s")).alias("score"))


_PROTO = "proto AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label)"


@query("emb_prototype", f"WITH {_PROTO} SELECT e.vec_id, {r_sql(_COS.format(a='e.embedding', b='a.p') + ' * 2 - ' + _COS.format(a='e.embedding', b='b.p'))} AS score FROM embeddings e, (SELECT p FROM proto WHERE label = 1) a, (SELECT p FROM proto WHERE label = 2) b")
def prototype(t: Tables) -> DataFrame:
    """Score against twice a positive prototype less a negative one."""
    proto = V.prototype(t.embeddings, ["label"], "embedding")
    a, b = proto.where("label = 1").select(F.col("prototype").alias("pa")), proto.where("label = 2").select(F.col("prototype").alias("pb"))
    both = t.embeddings.join(F.broadcast(a)).join(F.broadcast(b))  # one row each
    return both.select("vec_id", rounded(V.cosine(F.col("embedding"), F.col("pa")) * 2 - V.cosine(F.col("embedding"), F.col("pb"))).alias("score"))


# A site is a fifth of a label's vectors. The query of a site is the mean of its label's other sites; those are out of the pool it searches.
_SITES = 5
_OUT = f"""t AS (SELECT vec_id, label, vec_id % {_SITES} AS site, embedding FROM embeddings), e AS (SELECT vec_id, label, site, i, CAST(embedding[i] AS DOUBLE) AS x FROM t, range(1, 65) r(i)),
own AS (SELECT label, site, i, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL), whole AS (SELECT label, i, sum(s) AS s, sum(n) AS n FROM own GROUP BY ALL),
q AS (SELECT own.label, own.site, list((whole.s - own.s) / (whole.n - own.n) ORDER BY i) AS p FROM own JOIN whole USING (label, i) WHERE whole.n > own.n GROUP BY ALL),
s AS (SELECT q.label AS ql, q.site AS qs, t.vec_id, t.label = q.label AS hit, {_COS.format(a='t.embedding', b='q.p')} AS s FROM t, q WHERE t.label <> q.label OR t.site = q.site),
r AS (SELECT *, row_number() OVER (PARTITION BY ql, qs ORDER BY s DESC, vec_id) AS rank FROM s), hits AS (SELECT ql AS label, qs AS site, min(rank) AS first_hit FROM r WHERE hit GROUP BY ALL)"""
_BOOTS = 200


def _held_out(t: Tables) -> DataFrame:
    """ql, qs, vec_id, hit, s: the scores of every site's query over its pool."""
    tiles = t.embeddings.select("vec_id", "label", (F.col("vec_id") % _SITES).alias("site"), "embedding")
    return V.held_out_scores(tiles, "label", "site", "embedding").select(F.col("_label").alias("ql"), F.col("_site").alias("qs"), "vec_id", (F.col("label") == F.col("_label")).alias("hit"), "s")


def _first_hits(t: Tables) -> DataFrame:
    """Per site the rank of the first of its own vectors that its query finds."""
    return V.first_hits(_held_out(t), ["ql", "qs"], "vec_id", "s", "hit").select(F.col("ql").alias("label"), F.col("qs").alias("site"), "first_hit")


@query(
    "emb_recall_at_k",
    f"""WITH {_OUT}, n AS (SELECT *, row_number() OVER (ORDER BY label, site) - 1 AS k, count(*) OVER () AS n FROM hits),
b AS (SELECT draw, avg(CASE WHEN h.first_hit <= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall FROM (SELECT b.draw, CAST('0x' || substr(md5('boot|' || b.draw || '|' || n.k), 1, 8) AS BIGINT) % n.n AS pick FROM range({_BOOTS}) b(draw), n) d JOIN n h ON h.k = d.pick GROUP BY draw)
SELECT """
    + ", ".join(f"{r_sql(f'avg(CASE WHEN first_hit <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS recall_at_{k}" for k in (1, 5, 20))
    + f", {r_sql('quantile_cont(first_hit, 0.5)')} AS median_rank, (SELECT {r_sql('quantile_cont(recall, 0.025)')} FROM b) AS low_20, (SELECT {r_sql('quantile_cont(recall, 0.975)')} FROM b) AS high_20 FROM hits",
)
def recall_at_k(t: Tables) -> DataFrame:
    """Leave-one-site-out recall, median rank and a bootstrap interval of the recall."""
    hits = cut(_first_hits(t))  # a row a site, read by the recall and by its interval
    out = V.recall_at(hits, "first_hit", (1, 5, 20))
    ends = V.bootstrap_recall(hits, ["label", "site"], "first_hit", 20, _BOOTS)
    return out.crossJoin(ends).select(*[rounded(F.col(c)).alias(c) for c in (*out.columns, "low_20", "high_20")])  # one row each


@query("emb_loo", f"WITH {_OUT} SELECT label, site, first_hit FROM hits")
def leave_one_out(t: Tables) -> DataFrame:
    """First hit of each site whose vectors are left out of its query."""
    return _first_hits(t)


@query("emb_archetype_recall", f"WITH {_OUT} SELECT label AS archetype, count(*) AS sites, {r_sql('avg(CASE WHEN first_hit <= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS recall_at_20 FROM hits GROUP BY label")
def archetype_recall(t: Tables) -> DataFrame:
    """Leave-one-site-out recall of each archetype, which is the label."""
    return _first_hits(t).groupBy(F.col("label").alias("archetype")).agg(F.count(F.lit(1)).alias("sites"), rounded(F.avg((F.col("first_hit") <= 20).cast("double"))).alias("recall_at_20"))


@query(
    "emb_auc",
    f"""WITH {_OUT}, c AS (SELECT ql, qs, CAST(floor(s * 1000) AS BIGINT) AS bin, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM s GROUP BY ALL),
d AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY ql, qs ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT ql AS label, qs AS site, {r_sql('sum(pos * (below + neg / 2.0::DOUBLE))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE')} AS auc FROM d GROUP BY ALL HAVING sum(pos) * sum(neg) > 0""",
)
def auc(t: Tables) -> DataFrame:
    """Area under the curve of each held-out search, scores in thousandths."""
    out = V.binned_auc(_held_out(t), ["ql", "qs"], "s", "hit", 1000)
    return out.select(F.col("ql").alias("label"), F.col("qs").alias("site"), rounded(F.col("auc")).alias("auc"))


_NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300"


@query(
    "emb_truth_hits",
    f"""WITH t AS (SELECT vec_id, label, embedding, x, y FROM embeddings JOIN ({points_sql('embeddings', 'vec_id')}) USING (vec_id)), place AS ({points_sql('supplier', 's_suppkey', ', s_suppkey % 10 AS label')}),
near AS (SELECT b.s_suppkey, a.vec_id, a.label, a.embedding FROM t a JOIN place b ON a.label = b.label AND {_NEAR}),
own AS (SELECT s_suppkey, label, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n FROM near, range(1, 65) r(i) GROUP BY ALL), whole AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n FROM t, range(1, 65) r(i) GROUP BY ALL),
q AS (SELECT s_suppkey, max(own.n) AS removed, list((whole.s - own.s) / (whole.n - own.n) ORDER BY i) AS p FROM own JOIN whole USING (label, i) WHERE whole.n > own.n GROUP BY s_suppkey),
r AS (SELECT s_suppkey, removed, vec_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY {_COS.format(a='t.embedding', b='q.p')} DESC, vec_id) AS rank FROM t, q)
SELECT r.s_suppkey, any_value(removed) AS removed, min(rank) AS first_hit FROM r JOIN near USING (s_suppkey, vec_id) GROUP BY r.s_suppkey""",
)
def truth_hits(t: Tables) -> DataFrame:
    """For each known place the rank of the first tile within 300 m of it, searched for by the tiles of its kind but those."""
    tiles = points(t.embeddings, "vec_id")
    places = points(t.supplier, "s_suppkey", "other_point").select("s_suppkey", (F.col("s_suppkey") % 10).alias("label"), "other_point")
    return V.held_out_places(tiles, places, "label", "vec_id", "s_suppkey", "embedding", 300.0)


# A fourth of each label's vectors are its seeds, the rest is searched.
_K = 30
_SEEDED = f"""seed AS (SELECT * FROM embeddings WHERE vec_id % 4 = 0), pool AS (SELECT * FROM embeddings WHERE vec_id % 4 <> 0),
pos AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM seed, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
one AS (SELECT * FROM (SELECT q.label AS query, e.vec_id, e.label, e.embedding, row_number() OVER (PARTITION BY q.label ORDER BY {_COS.format(a='e.embedding', b='q.p')} DESC, e.vec_id) AS rank FROM pool e, pos q) WHERE rank <= {_K})"""


@query(
    "emb_feedback",
    f"""WITH {_SEEDED}, neg AS (SELECT query, list(m ORDER BY i) AS w FROM (SELECT query, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM one, range(1, 65) r(i) WHERE label <> query GROUP BY ALL) GROUP BY query),
sc AS (SELECT q.label AS query, e.vec_id, e.label, CASE WHEN w IS NULL THEN {_COS.format(a='e.embedding', b='q.p')} ELSE 2 * {_COS.format(a='e.embedding', b='q.p')} - {_COS.format(a='e.embedding', b='w')} END AS s FROM pool e, pos q LEFT JOIN neg ON neg.query = q.label),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM sc) WHERE rank <= {_K}),
n AS (SELECT label, count(*) AS n FROM pool GROUP BY label)
SELECT n.label, a.hits AS hits_before, b.hits AS hits_after, {r_sql('a.hits / n.n')} AS recall_before, {r_sql('b.hits / n.n')} AS recall_after
FROM n JOIN (SELECT query, count(*) FILTER (WHERE label = query) AS hits FROM one GROUP BY query) a ON a.query = n.label JOIN (SELECT query, count(*) FILTER (WHERE label = query) AS hits FROM two GROUP BY query) b ON b.query = n.label""",
)
def feedback(t: Tables) -> DataFrame:
    """Recall of a search, and of a second one that takes the first one's false hits as hard negatives."""
    seeds, pool = t.embeddings.where("vec_id % 4 = 0"), t.embeddings.where("vec_id % 4 <> 0")
    first, second = V.feedback_search(pool, seeds, "label", "vec_id", "embedding", _K)
    a, b = (V.recall_in(f, "query", "label", pool).select("query", F.col("hits").alias(f"hits_{n}"), rounded(F.col("recall")).alias(f"recall_{n}")) for f, n in ((first, "before"), (second, "after")))
    return a.join(b, "query").withColumnRenamed("query", "label")


@query(
    "emb_ensemble",
    f"""WITH seed AS (SELECT * FROM embeddings WHERE vec_id % 4 = 0), pool AS (SELECT * FROM embeddings WHERE vec_id % 4 <> 0),
pos AS (SELECT label, prompt, list(m ORDER BY i) AS p FROM (SELECT label, vec_id // 4 % 3 AS prompt, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM seed, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL),
r AS (SELECT q.label AS query, e.vec_id, e.label, row_number() OVER (PARTITION BY q.label, q.prompt ORDER BY {_COS.format(a='e.embedding', b='q.p')} DESC, e.vec_id) AS rank FROM pool e, pos q),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY best, vec_id) AS rank FROM (SELECT query, vec_id, any_value(label) AS label, min(rank) AS best FROM r WHERE rank <= {_K} GROUP BY query, vec_id))
SELECT query AS label, count(*) FILTER (WHERE f.label = query) AS hits, {r_sql('count(*) FILTER (WHERE f.label = query) / any_value(n.n)')} AS recall FROM f JOIN (SELECT label, count(*) AS n FROM pool GROUP BY label) n ON n.label = f.query WHERE rank <= {_K} GROUP BY query""",
)
def ensemble(t: Tables) -> DataFrame:
    """Recall of three prompts a label, fused by the best rank that any gives."""
    seeds, pool = t.embeddings.where("vec_id % 4 = 0"), t.embeddings.where("vec_id % 4 <> 0")
    prompts = V.prototype(seeds.withColumn("prompt", F.floor(F.col("vec_id") / 4) % 3), ["label", "prompt"], "embedding").withColumnRenamed("label", "query")
    found = V.fused_search(pool, prompts, "query", "prompt", "vec_id", "embedding", _K, "label")
    return V.recall_in(found, "query", "label", pool).select(F.col("query").alias("label"), "hits", rounded(F.col("recall")).alias("recall"))


@query(
    "emb_spearman",
    f"""WITH {_PROTO}, s AS (SELECT e.label, CAST(floor({_COS.format(a='e.embedding', b='a.p')} * 100) AS BIGINT) AS x, CAST(floor({_COS.format(a='e.embedding', b='b.p')} * 100) AS BIGINT) AS y FROM embeddings e, (SELECT p FROM proto WHERE label = 1) a, (SELECT p FROM proto WHERE label = 2) b),
r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0::DOUBLE AS ry FROM s)
SELECT label, count(*) AS n, {r_sql('corr(rx, ry)')} AS rho FROM r GROUP BY label""",
)
def rank_correlation(t: Tables) -> DataFrame:
    """How two queries agree in the order of each label's vectors, scores in hundredths with their ties."""
    proto = V.prototype(t.embeddings, ["label"], "embedding")
    a, b = proto.where("label = 1").select(F.col("prototype").alias("pa")), proto.where("label = 2").select(F.col("prototype").alias("pb"))
    both = t.embeddings.join(F.broadcast(a)).join(F.broadcast(b))  # one row each
    steps = lambda p: F.floor(V.cosine(F.col("embedding"), F.col(p)) * 100).cast("long")
    out = V.spearman(both.select("label", steps("pa").alias("x"), steps("pb").alias("y")), ["label"], "x", "y")
    return out.select("label", F.col("n").cast("long").alias("n"), rounded(F.col("rho")).alias("rho"))


_MOMENTS = "m AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i), c AS (SELECT a.i, b.i AS j, avg((CAST(embedding[a.i] AS DOUBLE) - a.m) * (CAST(embedding[b.i] AS DOUBLE) - b.m)) AS c FROM embeddings, m a, m b GROUP BY ALL)"


@query("emb_covariance", f"WITH {_MOMENTS} SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, {r_sql('c', 6)} AS value FROM c")
def covariance(t: Tables) -> DataFrame:
    """Covariance of all vectors' components from one partial sum a task."""
    return V.covariance_cells(t.embeddings, "embedding").select("i", "j", rounded(F.col("value"), 6).alias("value"))


@query(
    "emb_whitened_covariance",
    "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id = 0), (SELECT unnest(range(len(embedding))) AS j FROM embeddings WHERE vec_id = 0)",
)
def whitened_covariance(t: Tables) -> DataFrame:
    """Covariance of the whitened vectors before they get unit length: no two components go together, and each varies by one."""
    white = V.whiten(t.embeddings, "embedding", "white", unit=False)
    return V.covariance_cells(white, "white").select("i", "j", (rounded(F.col("value"), 6) + 0.0).alias("value"))


def _power_sql(squarings: int) -> str:
    """p: the covariance squared again and again, each time by its trace, which leaves the strongest component times itself."""
    square = "list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: list_dot_product(m[i], m[j])))"
    over = "list_transform(q, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(range(1, 65), lambda i: q[i][i]))))"
    return ", ".join(f"p{k + 1} AS MATERIALIZED (SELECT {over} AS m FROM (SELECT {square} AS q FROM p{k}))" for k in range(squarings))


@query(
    "emb_drop_top",
    f"""WITH {_MOMENTS}, p0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)), {_power_sql(12)},
x AS (SELECT vec_id, list(CAST(embedding[i] AS DOUBLE) - m ORDER BY i) AS x FROM embeddings, m GROUP BY vec_id)
SELECT vec_id, {r_sql('list_dot_product(x, x)')} AS whole, {r_sql('list_dot_product(x, x) - list_dot_product(x, list_transform(m, lambda r: list_dot_product(r, x)))')} AS rest FROM x, p12""",
)
def drop_top(t: Tables) -> DataFrame:
    """Squared length of each centred vector, and of what is left of it without the strongest component (V02); the SQL finds that by powers of the covariance."""
    rest = V.without_components(V.without_components(t.embeddings, "embedding", "whole", 0), "embedding", "rest", 1)
    return rest.select("vec_id", *[rounded(V.dot(F.col(c), F.col(c))).alias(c) for c in ("whole", "rest")])


@query("emb_fusion", "WITH a AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier), b AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier), u AS (SELECT key, rank * 2 AS place, 0 AS list FROM a UNION ALL SELECT key, rank * 2 + 1, 1 FROM b) SELECT key, arg_min(list, place) AS list, row_number() OVER (ORDER BY min(place)) AS rank FROM u GROUP BY key")
def fusion(t: Tables) -> DataFrame:
    """Two ranked lists dealt one by one."""
    lists = [global_rank(t.supplier.select(F.col("s_suppkey").alias("key"), "s_acctbal"), "rank", o, "key") for o in (F.col("s_acctbal").desc(), F.col("s_acctbal"))]
    return V.interleaved(*lists).select("key", "list", F.col("rank").cast("long").alias("rank"))


@query("emb_whiten")
def whiten(t: Tables) -> DataFrame:
    """ZCA-whitened unit vectors (V02); tests hold their covariance against the identity."""
    return V.whiten(t.embeddings, "embedding", "white").select("vec_id", F.transform("white", lambda x: rounded(x)).alias("white"))


@query(
    "emb_dedup",
    f"""WITH RECURSIVE p AS ({points_sql('customer', 'c_custkey', ', c_nationkey % 4 AS list, c_acctbal')}), l AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY c_acctbal DESC, c_custkey) AS rank FROM p),
g AS (SELECT DISTINCT list, 0::BIGINT AS rank, 0::BIGINT AS c_custkey, FALSE AS kept, []::DOUBLE[] AS kx, []::DOUBLE[] AS ky FROM l
  UNION ALL SELECT l.list, l.rank, l.c_custkey, s.free, CASE WHEN s.free THEN list_append(g.kx, l.x) ELSE g.kx END, CASE WHEN s.free THEN list_append(g.ky, l.y) ELSE g.ky END
  FROM g JOIN l ON l.list = g.list AND l.rank = g.rank + 1, LATERAL (SELECT len(list_filter(range(1, len(g.kx) + 1), lambda i: power(g.kx[i] - l.x, 2) + power(g.ky[i] - l.y, 2) <= 250000)) = 0 AS free) s)
SELECT list, c_custkey, rank::INT AS rank FROM g WHERE kept""",
)
def location_dedup(t: Tables) -> DataFrame:
    """Greedy list in which no two points are within 500 m."""
    p = points(t.customer, "c_custkey")
    listed = p.select((F.col("c_nationkey") % 4).alias("list"), "c_custkey", F.col("point.x").alias("x"), F.col("point.y").alias("y"), F.row_number().over(Window.partitionBy(F.col("c_nationkey") % 4).orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("rank"))
    return V.greedy_spread(listed, "list", 500.0).select("list", "c_custkey", "rank")
