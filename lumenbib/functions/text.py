"""Scalar rules on names, titles, venues and dates. Native expressions; Unicode normal forms by Arrow functions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words without weight in the comparison of titles.
TITLE_STOP_WORDS = (
    "a", "an", "the", "of", "for", "on", "in", "and", "or", "but", "is", "to", "with", "by", "from", "via", "using", "based", "towards", "approach", "study",
    "evaluation", "analysis", "system", "systems",
)
# Venue rules in order, (pattern on the lower-case venue, canonical event).
EVENT_RULES = (
    (r"^(?:ccs|acm ccs)$", "ACM CCS"),
    (r"asiaccs|asia[ -]?ccs", "ACM ASIA CCS"),
    (r"euro.?s.?p", "IEEE EURO S&P"),
    (r"ndss", "NDSS"),
    (r"usenix", "USENIX Security"),
    (r"\bsp\b|symposium on security and privacy", "IEEE S&P"),
    (r"hotnets", "HotNets"),
    (r"sacmat", "ACM SACMAT"),
    (r"csur|computing surveys|comput\. surv", "ACM Computing Surveys"),
    (r"comst|communications surveys|commun\. surv", "IEEE Communications Surveys & Tutorials"),
    (r"fntsec|foundations and trends|found\. trends priv", "Foundations and Trends in Privacy and Security"),
)
# Record types of the source and the canonical type.
TYPE_MAP = {
    "article": "article", "conference and workshop papers": "article", "inproceedings": "article", "proceedings": "proceedings", "editorship": "editorship",
}
DEFAULT_MONTH = 7


def _ascii_safe(col: Column, function) -> Column:
    """Python sees only texts that hold something else than ASCII; the rest is its own normal form."""
    return F.coalesce(function(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


@F.pandas_udf(T.StringType())
def _nfkd_bare(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else html.unescape(v))


def nfkd_bare(col: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _ascii_safe(col, _nfkd_bare)


def unescape_entities(col: Column) -> Column:
    """Character references decoded; texts without an ampersand never leave the JVM."""
    return F.coalesce(_unescape(F.when(col.contains("&"), col)), col)


def normalize_author(col: Column) -> Column:
    """Lower-case letters, spaces, hyphens and apostrophes of a name, without a trailing four-digit number."""
    t = F.regexp_replace(F.lower(nfkd_bare(col)), r"\s+\d{4}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z\s\-']", " "), r"\s+", " "))


def author_key(normal: Column) -> Column:
    """Last name and first initial of a normalised name; a single word, an empty name and null are their own key."""
    parts = F.split(normal, " ")
    full = F.concat_ws(" ", F.element_at(parts, -1), F.left(F.element_at(parts, 1), F.lit(1)))
    return F.when(normal.isNull() | (F.size(parts) <= 1), normal).otherwise(full)


def strict_author_key(normal: Column) -> Column:
    """The whole normalised name if it has two words and a first one of two letters; else ''."""
    parts = F.split(normal, " ")
    return F.when((F.size(parts) >= 2) & (F.length(F.element_at(parts, 1)) > 1), normal).otherwise("")


def title_tokens(col: Column) -> Column:
    """Distinct content words of a title, longer than one character."""
    t = F.regexp_replace(nfkd_bare(F.lower(col)), r"[^a-z0-9]+", " ")
    words = F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) > 1))
    return F.array_except(words, F.array(*map(F.lit, TITLE_STOP_WORDS)))


def token_set(col: Column) -> Column:
    """Distinct ASCII words of a text without stop words; null if there is none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"[a-z0-9]+"), F.lit(0)))
    return F.when(F.size(words) > 0, words)


def jaccard(a: Column, b: Column) -> Column:
    """Common against all elements; 0 where either side is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def squeeze_title(col: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "")


def parse_authors(col: Column) -> Column:
    """Names between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def collapse(col: Column) -> Column:
    """White space of any kind to single spaces, trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


def identity(col: Column) -> Column:
    """Case-folded compatibility form with runs of other signs as one space; null becomes ''."""
    c = F.coalesce(col, F.lit(""))
    folded = F.coalesce(_nfkc_casefold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), F.lower(c))
    return F.trim(F.regexp_replace(folded, r"(?U)[\W_]+", " "))


def word_count(col: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.size(F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


_OWN_RULES: list[tuple[str, str]] = []


def register_event_rule(pattern: str, event: str) -> None:
    """Adds a rule behind the fixed ones: a pattern on the lower-case venue and its canonical event."""
    _OWN_RULES.append((pattern, event))


@contextmanager
def event_rules(rules: list[tuple[str, str]]) -> Iterator[None]:
    """Registers rules for the expressions that are built inside."""
    for pattern, event in rules:
        register_event_rule(pattern, event)
    try:
        yield
    finally:
        del _OWN_RULES[len(_OWN_RULES) - len(rules) :]


def normalize_event(venue: Column) -> Column:
    """The canonical event by the first rule that matches, else the venue as it is."""
    v = F.replace(F.trim(F.lower(venue)), F.lit("&amp;"), F.lit("&"))
    out = F.when(venue.isNull() | (venue == ""), venue)
    for pattern, event in (*EVENT_RULES, *_OWN_RULES):
        out = out.when(v.rlike(pattern), event)
    return out.otherwise(venue)


def normalize_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPE_MAP.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(kind))), F.lit("unknown"))


def stable_join(values: Column) -> Column:
    """Sorted distinct non-empty values joined by a semicolon."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))), ";")


def lag_days(submitted: Column, year: Column, month: Column | int = DEFAULT_MONTH) -> Column:
    """Floored days from submission to the first day of the venue's month, in UTC."""
    month = F.lit(month) if isinstance(month, int) else month
    start = F.unix_micros(F.make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
    return F.floor((start - F.unix_micros(F.to_timestamp(submitted))) / F.lit(86_400_000_000)).cast("int")


def extractor_name(event: Column) -> Column:
    """Which page extractor serves an event."""
    e = F.lower(F.coalesce(event, F.lit("")))
    return (
        F.when(e.contains("usenix") | e.contains("uss"), "usenix")
        .when(e.contains("ndss"), "ndss")
        .when(e.contains("ieee") | e.contains("euro s&p") | e.contains("communications surveys") | e.contains("comsur") | e.contains("s&p"), "ieee")
        .otherwise("acm")
    )


def key_tail(cache_key: Column) -> Column:
    """What follows the first underscore, in lower case."""
    return F.lower(F.coalesce(F.get(F.split(cache_key, "_", 2), F.lit(1)), F.lit("")))


def looks_like_timestamp(col: Column) -> Column:
    return col.rlike(r"^20\d\d-\d\d-\d\d \d\d:\d\d:\d\d$")


def last_path_part(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)
