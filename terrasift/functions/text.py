"""Text functions as Column expressions; every one stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which site a name means.
STOP_TOKENS = (
    "a", "and", "c", "center", "centers", "centre", "co", "company", "corp", "corporation", "d", "data", "datacenter", "datacenters", "dba", "dc", "facilities",
    "facility", "inc", "incorporated", "llc", "lp", "ltd", "na", "of", "park", "partners", "properties", "property", "realty", "site", "the",
)
# Roman numerals of facility numbers.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
# Document folders and their codes.
CATEGORY_CODES = {"air": "AIR", "compliance": "COMP", "npdes": "NPDES", "site-remediation": "SR"}
PAGE_MARK = "===== PAGE [0-9]+ =====\n?"


def _stops() -> Column:
    return F.array(*[F.lit(t) for t in STOP_TOKENS])


def clean_text(value: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def clean_number(value: Column) -> Column:
    """First signed decimal of a text without $ and commas, else null."""
    found = F.regexp_extract(F.regexp_replace(clean_text(value), "[$,]", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def words_of(value: Column) -> Column:
    """Lower-case alphanumeric words in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(clean_text(value)), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def normalize_name(value: Column) -> Column:
    """Lower case, & as and, alphanumeric words without stop tokens."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(clean_text(value)), "&", " and "), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda t: (t != "") & ~F.array_contains(_stops(), t)), " ")


def token_set(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(value), " "), lambda t: t != ""))


def facility_codes(value: Column) -> Column:
    """Sorted distinct codes such as ord1: a compact token, or a word of two letters or more before a number or Roman numeral."""
    words = words_of(value)
    number = lambda t: F.regexp_replace(t, "^0+(?=[0-9])", "")
    compact = F.transform(F.filter(words, lambda t: t.rlike("^[a-z]{2,}[0-9]{1,3}$")), lambda t: F.concat(F.regexp_extract(t, "^[a-z]+", 0), number(F.regexp_extract(t, "[0-9]+$", 0))))
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    after = lambda i: F.get(words, i + 1)
    paired = F.transform(
        words,
        lambda t, i: F.when(
            ~F.array_contains(_stops(), t) & (F.length(t) >= 2),
            F.concat(t, F.when(after(i).rlike("^[0-9]{1,3}$"), number(after(i))).otherwise(F.element_at(roman, after(i)))),
        ),
    )
    return F.array_sort(F.array_distinct(F.concat(compact, F.filter(paired, lambda c: c.isNotNull()))))


def safe_join(values: Column, sep: str = "|") -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), sep)


def clean_space(value: Column) -> Column:
    """White space collapsed, ends free of spaces, semicolons, commas and full stops."""
    return F.btrim(F.regexp_replace(value, r"\s+", " "), F.lit(" ;,.\n\t"))


def parse_date(value: Column) -> Column:
    """Date of four written forms, with white space collapsed, ends free of ` ;,.` and months in any case; two-digit years from 69 on are of the
    last century; else null."""
    text = clean_space(clean_text(value))
    named = F.initcap(F.lower(text))
    short = F.try_to_timestamp(F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), text), F.lit("M/d/yy")).cast("date")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    full = F.try_to_timestamp(F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), text), F.lit("M/d/yyyy")).cast("date")
    long_month = F.try_to_timestamp(F.when(named.rlike("^[A-Z][a-z]{3,} [0-9]{1,2}, [0-9]{4}$"), named), F.lit("MMMM d, yyyy")).cast("date")
    short_month = F.try_to_timestamp(F.when(named.rlike("^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$"), named), F.lit("MMM d, yyyy")).cast("date")
    return F.coalesce(full, short, long_month, short_month)


def split_pages(text: Column) -> Column:
    """Texts between page marks, from the first mark on."""
    parts = F.split(text, PAGE_MARK)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


# Fixed values below: what permits say, and what kinds, actions and ids are called.
def permit_type(text: Column) -> Column:
    first = F.upper(F.array_join(F.slice(split_pages(text), 1, 5), "\n"))
    return (
        F.when(first.contains("FEDERALLY ENFORCEABLE STATE OPERATING PERMIT") | first.rlike(r"\bTO\s+OPERATE\b"), "FESOP / operating permit")
        .when(first.contains("CLEAN AIR ACT PERMIT PROGRAM") | first.contains("CAAPP PERMIT"), "CAAPP operating permit")
        .when(first.contains("CONSTRUCTION PERMIT") | first.rlike(r"\bTO\s+CONSTRUCT\b"), "Construction permit")
        .otherwise("Air permit / application record")
    )


def permit_action(text: Column) -> Column:
    first = F.upper(F.array_join(F.slice(split_pages(text), 1, 5), "\n"))
    return F.when(first.contains("REVISED"), "Revised").otherwise("Initial or unspecified")


def subject(text: Column) -> Column:
    """struct(subject, page) of the first of five pages that states one."""
    found = F.transform(F.slice(split_pages(text), 1, 5), lambda p, i: F.struct(clean_space(F.regexp_extract(p, r"(?i)Subject\s*:\s*([^\n]{3,160})", 1)).alias("subject"), (i + 1).alias("page")))
    return F.get(F.filter(found, lambda s: s["subject"] != ""), F.lit(0))


def source_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9]{6}[A-Z]{3}\b"), F.lit(0))))


def identity_status(ids: Column, expected: Column) -> Column:
    return F.when(F.size(ids) == 0, "Unreviewed").when((F.size(ids) == 1) & (ids[0] == expected), "Consistent").otherwise("Possible mismatch")


def notice_number(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\bA-[0-9]{4}-[0-9]{5}\b", 0), F.lit("")), fallback)


def snippet(text: Column, pattern: str, most: int = 900) -> Column:
    return F.substring(F.regexp_extract(text, pattern, 0), 1, most)


def evidence_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two distinct arrays; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def normalize_agency_id(raw: Column) -> Column:
    """Digits as they are; another integral number in digits; else null."""
    value = F.trim(raw)
    number = value.try_cast("decimal(38,10)")
    return F.when(value.rlike("^[0-9]+$"), value).when(number == F.floor(number), F.floor(number).cast("decimal(28,0)").cast("string"))


def safe_name(value: Column, fallback: str = "document") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(clean_text(value), "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit("")), F.lit(fallback))


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters as an index from 0."""
    return (F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1).cast("int")


def column_letters(index: Column) -> Column:
    """The letters of a column index below 18278."""
    n = index + 1
    letter = lambda x: F.char(F.pmod(x - 1, F.lit(26)) + 65)
    n2, n3 = F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    return F.concat(F.when(n3 > 0, letter(n3)).otherwise(""), F.when(n2 > 0, letter(n2)).otherwise(""), letter(n))


def ellipsis(value: Column, most: int) -> Column:
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("..."))).otherwise(text)


def category_code(slug: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in CATEGORY_CODES.items() for x in pair])
    return F.coalesce(F.element_at(codes, slug), F.lit("DOC"))


def year_prefix(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, 4).try_cast("int")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def ascii_fold(value: Column) -> Column:
    """NFKD without what is not ASCII; Arrow batches, for Spark has no built-in."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    return fold(value)
