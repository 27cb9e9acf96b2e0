"""Operator 11 against dense sums over all kept terms, and against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from terrasift.llm import divergence

DOC = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def dense(rows, least):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in in_docs.items()}

    def chances(counter, terms):
        total = sum(counter[t] for t in terms)
        return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * len(terms)) for t in terms}

    out = set()
    for (lang, source), counter in counts.items():
        terms, whole = kept[lang], Counter()
        for (other, _), c in counts.items():
            if other == lang:
                whole.update(c)
        p, q = chances(counter, terms), chances(whole, terms)
        pairs = []
        for (other, name), c in counts.items():
            if other == lang and name != source:
                o = chances(c, terms)
                pairs.append((-sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in terms), name.encode()))
        over = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode()) for t in terms if counter[t] and p[t] > q[t]]
        out |= {(lang, source, "pair", n.decode(), -v, i) for i, (v, n) in enumerate(sorted(pairs), 1)}
        out |= {(lang, source, "term", n.decode(), -v, i) for i, (v, n) in enumerate(sorted(over)[:10], 1)}
    return out


def check(spark, rows, least=10, **how):
    got = divergence.divergence(spark.createDataFrame(rows, DOC), least, **how).collect()
    assert {tuple(r) for r in got} == dense(rows, least) and len(got) == len(set(got))
    return got


def test_divergence_is_its_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = divergence.op11_source_divergence(spark, data)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(divergence.OP11_SQL).fetchall())


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_divergence_of_any_automaton(spark, most):
    """Terms that the automata have no room for are counted all the same."""
    rows = [(i, " ".join(f"w{chr(97 + (i * j + j) % 20)}{'é' * (j % 3)}, W{'x' * (j % 4)}" for j in range(i % 25)), "en" if i % 3 else "fr", f"s{i % 7}") for i in range(150)]
    check(spark, rows, 3, most=most)


def test_divergence_in_small_pieces(monkeypatch):
    data = divergence.term_bytes("Ab1c ÄB-d\x7fe " * 30)
    whole = data.split()
    assert whole[:5] == [b"ab", b"c", "Äb".encode(), b"d", b"e"]
    monkeypatch.setattr(divergence, "PIECE", 5)
    assert [t for part in divergence.term_lists(data) for t in part] == whole
    automata = divergence.Automata({"en": [b"ab", b"d", "Äb".encode()]})
    assert Counter(automata.occurrences("en", data)) == {0: 30, 1: 30, 2: 30} and not list(automata.occurrences("fr", data))


def test_pairs_of_many_sources(spark):
    rows = [(i, f"common {'rare' * (i % 4 == 0)} word", "en", f"s{i % 30}") for i in range(90)]
    whole = check(spark, rows, 2)
    assert len(whole) == 30 * 29 + sum(r.part == "term" for r in whole)


def test_divergence_of_odd_rows(spark):
    long = " ".join("abcdefghij"[i % 10] * (1 + i % 3) for i in range(40_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (3, " 1\n", "de", "b"), (4, long, "en", "a"), (5, "x" * 300_000, "en", "c"), *[(100 + i, "the hot row", "en", "hot") for i in range(60)], *[(9, "Same SAME same", "en", "a")] * 3]
    check(spark, rows)
    check(spark, rows, 1)
    check(spark, [(1, "one source alone", "en", "a")], 1)
    check(spark, [(1, "12 34", "en", "a"), (2, "", "en", "b")], 1)  # no terms: distances of 0
    empty = divergence.divergence(spark.createDataFrame([], DOC))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0
    clash = spark.createDataFrame([(1, "a b", "en", "x", "y", 5, "z")], DOC + ", item string, rank int, p string")
    assert divergence.divergence(clash, 1).columns == empty.columns


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, v = 7 * 10**15 + 3, 9 * 10**15 + 11, 10**6 + 1
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.chance(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert df.first().p == 1 + 10**9 * (n + 2) // (total + 2 * v)
