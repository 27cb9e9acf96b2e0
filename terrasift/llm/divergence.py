"""Operator 11: how far the sources of a language are apart in their words, by a vocabulary automaton that recounts the kept terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

LEAST_DOCS = 10
TOP = 10
ONE = 1_000_000_000
#: Bytes of terms, over all languages, that the automata may hold: those in most documents. Terms beyond are counted by a shuffle.
AUTOMATON_BYTES = 4_000_000
#: Entries that a task's counters hold before they are sent on, and bytes of text that are split into words at once.
ENTRIES = 400_000
PIECE = 1 << 20
#: Pairs of postings that are held against each other at once.
PAIRS = 1 << 20
#: Bytes of UTF-8: A-Z lower-cased, all else of ASCII but a-z a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_bytes(text: str | bytes) -> bytes:
    """The UTF-8 of a text, terms lower-cased and all between them spaces, with a space at either end."""
    return b" " + (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_TERMS) + b" "


def term_lists(data: bytes) -> Iterator[list[bytes]]:
    """The terms of term_bytes() in lists of a bounded size."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _sent(counts: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each key: the key's parts, the terms and their counts."""
    for key, counter in counts.items():
        if counter:
            parts = [pa.array([x] * len(counter), pa.string()) for x in key]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(counter.keys(), pa.binary()).cast(pa.string()), pa.array(counter.values(), pa.int64())], names)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): the number of documents of each language that hold a term, exact; a task sends partial counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str], Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch), strict=True):
                own = set()
                for terms in term_lists(term_bytes(text)):
                    own.update(terms)
                counts.setdefault((lang,), Counter()).update(own)
                if sum(map(len, counts.values())) > ENTRIES:
                    yield from _sent(counts, ["lang", "term", "docs"])
                    counts.clear()
        yield from _sent(counts, ["lang", "term", "docs"])

    partial = docs.select("lang", "text").mapInArrow(count, "lang string, term string, docs long")
    return partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


class Automata:
    """Aho-Corasick automata of each language's terms, each term between spaces; built where they are used, once a worker."""

    def __init__(self, terms: dict[str, list[bytes]]):
        self.terms, self.built = terms, {}

    def __getstate__(self):
        return {"terms": self.terms, "built": {}}

    def of(self, lang: str):
        """The automaton of a language, None if it has no terms. Matches give the term's place in its list."""
        if lang not in self.built:
            import ahocorasick

            found = None
            if self.terms.get(lang):
                found = ahocorasick.Automaton()
                for i, term in enumerate(self.terms[lang]):
                    found.add_word(f" {term.decode('latin-1')} ", i)
                found.make_automaton()
            self.built[lang] = found
        return self.built[lang]

    def occurrences(self, lang: str, data: bytes) -> Iterator[int]:
        """Place of the term of each occurrence in term_bytes(). A space that ends a term begins the next, so neighbours are both found."""
        automaton = self.of(lang)
        return map(itemgetter(1), automaton.iter(data.decode("latin-1"))) if automaton else iter(())


def _head(kept: DataFrame, most: int) -> tuple[dict[str, list[bytes]], int | None]:
    """The terms in most documents, `most` bytes of them at most, by language; and the octave step of documents below which terms are left out, None
    if none are."""
    step = F.floor(F.log2(F.col("docs").cast("double")) * 8).cast("int")
    sizes = kept.groupBy(step.alias("step")).agg(F.sum(F.octet_length("term") + 2).alias("size")).collect()  # some hundred rows
    lowest, total = None, 0
    for s, size in sorted(sizes, reverse=True):
        if total + size > most:
            lowest = s + 1
            break
        total += size
    chosen = kept if lowest is None else kept.where(step >= lowest)
    terms: dict[str, list[bytes]] = {}
    for lang, term in chosen.select("lang", F.encode("term", "UTF-8")).collect():
        terms.setdefault(lang, []).append(bytes(term))
    return terms, lowest


def occurrences(docs: DataFrame, kept: DataFrame, most: int = AUTOMATON_BYTES) -> DataFrame:
    """(lang, source, term, n): how often each kept term (lang, term, docs) occurs in a group, where it does.

    The automata are broadcast; they hold `most` bytes of terms at most, those in most documents. If there are more terms, the words that
    are not in the automata go on as partial counts and meet the rest of the kept terms in a join, so that none is left out."""
    terms, lowest = _head(kept, most)
    shared, rest = docs.sparkSession.sparkContext.broadcast(Automata(terms)), lowest is not None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, names = shared.value, ["lang", "source", "term", "n"]
        held: dict[tuple[str, str], Counter] = {}
        others: dict[tuple[str, str], Counter] = {}
        known = {lang: set(own) for lang, own in automata.terms.items()} if rest else {}

        def sent() -> Iterator[pa.RecordBatch]:
            yield from _sent({k: {automata.terms[k[0]][i]: n for i, n in c.items()} for k, c in held.items()}, names)
            yield from _sent(others, names)
            held.clear()
            others.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch), strict=True):
                data = term_bytes(text)
                held.setdefault((lang, source), Counter()).update(automata.occurrences(lang, data))
                if rest:
                    counter, own = others.setdefault((lang, source), Counter()), known.get(lang, ())
                    for listed in term_lists(data):
                        counter.update(t for t in listed if t not in own)
                if sum(map(len, held.values())) + sum(map(len, others.values())) > ENTRIES:
                    yield from sent()
        yield from sent()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counted.join(kept.select("lang", "term"), ["lang", "term"], "left_semi") if rest else counted


def chance(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) in whole numbers of any size; null without terms."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(10,0)")
    below = F.when(terms > 0, total + 2 * terms).cast("decimal(19,0)")
    return (F.call_function("div", above, below) + 1).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared(postings: DataFrame) -> DataFrame:
    """(lang, i, j, v), i < j: what terms that both sources hold add to their distance beyond what either adds by itself.

    A row of postings is a term with a (source, p, p at no occurrence) for each source that holds it; pairs of these are made in arrays of a bounded
    size and summed there, so no row is made for them."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("held")
            ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            flat = lists.flatten()
            source, p, base = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            _, lang = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            after = ends[row + 1] - np.arange(len(row)) - 1  # partners of each posting: those behind it in its list
            cuts = np.concatenate([[0], np.cumsum(after)])
            sums: dict[tuple[int, int, int], int] = {}
            at = 0
            while at < len(row):
                stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PAIRS, "right")) - 1)
                first = np.repeat(np.arange(at, stop), after[at:stop])
                second = first + 1 + np.arange(len(first)) - np.repeat(cuts[at:stop] - cuts[at], after[at:stop])
                v = _distance(p[first], p[second]) - _distance(p[first], base[second]) - _distance(base[first], p[second]) + _distance(base[first], base[second])
                low, high = np.minimum(source[first], source[second]), np.maximum(source[first], source[second])
                order = np.lexsort((high, low, lang[row[first]]))
                keys = np.stack([lang[row[first]], low, high])[:, order]
                new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if len(order) else np.empty(0, np.int64)
                if len(new):
                    for k, total in zip(keys[:, new].T.tolist(), np.add.reduceat(v[order], new).tolist(), strict=True):
                        sums[tuple(k)] = sums.get(tuple(k), 0) + total
                at = stop
            if sums:
                names = sorted(set(batch.column("lang").to_pylist()))
                k, i, j = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in k], pa.string()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(sums.values(), pa.int64())], ["lang", "i", "j", "v"])

    return postings.select("lang", "held").mapInArrow(pairs, "lang string, i long, j long, v long").groupBy("lang", "i", "j").agg(F.sum("v").alias("v"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, most: int = AUTOMATON_BYTES) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part, item, value, rank.

    Two passes over the texts: exact document frequencies give each language's kept terms, and an automaton of these recounts their occurrences by
    (lang, source). Part `pair`: the distance of a source to each other one of its language; part `term`: the terms that it uses most beyond its
    language, to rank `top`. Nulls in text, lang and source are empty strings; a repeated row is a document of its own; empty texts are in their group and
    hold no term; a language without kept terms has distances of 0 and no `term` rows; an empty table gives no rows.

    A distance is a sum over all kept terms, most of which a source doesn't hold, so it is summed over postings alone: all terms at the two
    chances of no occurrence, then what the terms of either add against the other's chance of no occurrence (by how many terms have
    which chance), then what terms of both add beyond."""
    spark = docs.sparkSession
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    with Scratch(spark) as scratch:
        kept = scratch.keep(document_frequencies(plain).where(F.col("docs") >= least_docs), "kept")
        found = scratch.keep(occurrences(plain, kept, most), "occurrences")
        terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v_terms"))
        totals = found.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("n").alias("total"))
        groups = plain.select("lang", "source").distinct().join(totals, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left").drop("_l", "_s").join(terms, "lang", "left")
        groups = groups.withColumns({"total": F.coalesce("total", F.lit(0)), "v_terms": F.coalesce("v_terms", F.lit(0)), "sid": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")})
        groups = scratch.keep(groups.withColumn("base", chance(F.lit(0).cast("long"), F.col("total"), F.col("v_terms"))), "groups")
        postings = found.join(groups, ["lang", "source"]).withColumn("p", chance(F.col("n"), F.col("total"), F.col("v_terms")))
        postings = scratch.keep(postings.select("lang", "source", "sid", "term", "n", "p", "base"), "postings")

        of_lang = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("v_terms").alias("of"))
        lang_terms = postings.groupBy("lang", "term").agg(F.sum("n").alias("all_n")).join(of_lang, "lang").select("lang", "term", chance(F.col("all_n"), F.col("all"), F.col("of")).alias("q"))
        over = postings.join(lang_terms, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        over = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

        g = groups.select("lang", F.col("sid").alias("i"), "source", F.col("base").alias("gb"), "v_terms")
        h = groups.select(F.col("lang").alias("_l"), F.col("sid").alias("j"), F.col("source").alias("item"), F.col("base").alias("hb"))
        every = g.join(h, (F.col("lang") == F.col("_l")) & (F.col("i") != F.col("j")))
        every = every.select("lang", "i", "j", "source", "item", F.coalesce(F.col("v_terms") * distance(F.col("gb"), F.col("hb")), F.lit(0)).alias("none"))
        by_p = postings.groupBy("lang", F.col("sid").alias("i"), F.col("base").alias("gb"), "p").agg(F.count(F.lit(1)).alias("n"))
        alone = by_p.join(h, (F.col("lang") == F.col("_l")) & (F.col("i") != F.col("j"))).groupBy("lang", "i", "j").agg(F.sum(F.col("n") * (distance(F.col("p"), F.col("hb")) - distance(F.col("gb"), F.col("hb")))).alias("v"))
        shared = _shared(postings.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "base")).alias("held")))
        beyond = alone.union(shared)
        beyond = beyond.union(beyond.select("lang", F.col("j"), F.col("i"), "v")).groupBy("lang", "i", "j").agg(F.sum("v").alias("v"))
        pairs = every.join(beyond, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("none") + F.coalesce("v", F.lit(0))).alias("value"))
        pairs = pairs.withColumn("rank", F.row_number().over(by_value))
        return scratch.result(pairs.union(over), "divergence")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS t FROM docs) GROUP BY ALL),
kept AS (SELECT lang, t FROM words GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, t, sum(n)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, t) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN terms USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS total FROM found GROUP BY ALL) USING (lang, source)),
dense AS (SELECT g.lang, g.source, k.t, coalesce(f.c, 0) AS c, 1 + ({ONE}::HUGEINT * (coalesce(f.c, 0) + 2)) // (g.total + 2 * g.v) AS p FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, t)),
langs AS (SELECT lang, k.t, 1 + ({ONE}::HUGEINT * (sum(c) + 2)) // (any_value(n) + 2 * any_value(v)) AS q FROM dense k JOIN (SELECT lang, sum(total)::HUGEINT AS n, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY ALL),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over_ AS (SELECT lang, source, t AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM dense JOIN langs USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM over_) WHERE rank <= {TOP}
"""
