"""Derived columns of a paper and the projections that exports and pages show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.text import word_count

# Beginnings of journal events.
JOURNALS = ("acm computing", "ieee communications", "foundations and trends")
PREVIEW = 280


def doi(ee: Column) -> Column:
    """After the first ``doi.org/``, else the value itself if it starts with ``10.``, else null."""
    return F.when(ee.contains("doi.org/"), F.element_at(F.split(ee, r"doi\.org/", 2), 2)).when(ee.startswith("10."), ee)


def doi_anywhere(text: Column) -> Column:
    """The first DOI in a text, in lower case, without closing signs."""
    found = F.lower(F.regexp_extract(text, r"(?i)(10\.\d{4,9}/[^\s\"<>]+)", 1))
    return F.nullif(F.regexp_replace(found, r"[.,;:)\]}]+$", ""), F.lit(""))


def doi_of_url(url: Column) -> Column:
    """The DOI that ends a resolver address, without trailing slashes; '' for none."""
    return F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)doi\.org/(10\..+)$", 1), F.lit("/"))


def first_author(authors: Column) -> Column:
    return F.nullif(F.trim(F.get(F.split(authors, ",", 2), F.lit(0))), F.lit(""))


def cite_key(bibtex: Column) -> Column:
    return F.nullif(F.regexp_extract(bibtex, r"@\w+\{([^,\s]+)\s*,", 1), F.lit(""))


def cite_command(bibtex: Column) -> Column:
    return F.concat(F.lit("\\cite{"), cite_key(bibtex), F.lit("}"))


def paper_class(title: Column, event: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    e = F.lower(F.coalesce(event, F.lit("")))
    return (
        F.when(t.contains("sok:") | t.contains("systematization of knowledge"), "SoK")
        .when(t.contains("survey") | t.contains("systematic review") | t.contains("literature review"), "Survey")
        .when(t.contains("poster:") | t.startswith("poster "), "Poster")
        .when(t.contains("workshop"), "Workshop")
        .when(t.contains("short paper"), "Short")
        .when(e.startswith(JOURNALS[0]) | e.startswith(JOURNALS[1]) | e.startswith(JOURNALS[2]), "Journal")
        .otherwise("Article")
    )


def preview(text: Column, size: int = PREVIEW) -> Column:
    """At most ``size`` characters, cut at a space, with an ellipsis; a dash for none."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    head = F.regexp_replace(F.substring(t, 1, size), " [^ ]*$", "")
    return F.when(text.isNull() | (text == ""), "—").when(F.length(t) <= size, t).otherwise(F.concat(head, F.lit("…")))


def _or_dash(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("—"))


def page_rows(papers: DataFrame) -> DataFrame:
    """Rows of a result page: authors cut at 90, missing values as a dash, and a link."""
    authors = F.when(F.length("authors") > 90, F.concat(F.substring("authors", 1, 90), F.lit("…"))).otherwise(F.col("authors"))
    return papers.select(
        "paper_id", F.col("title"), _or_dash(authors).alias("authors"), _or_dash(F.col("event")).alias("event"), "year",
        preview(F.col("abstract")).alias("abstract"), F.coalesce(F.nullif("ee", F.lit("")), F.nullif("url", F.lit("")), F.lit("")).alias("link"),
    )


def export_rows(papers: DataFrame) -> DataFrame:
    """The thirteen columns of an export."""
    return papers.select(
        "paper_id", "title", "authors", "event", "year", "paper_type", paper_class(F.col("title"), F.col("event")).alias("paper_class"), doi(F.col("ee")).alias("doi"),
        "ee", "pages", "abstract", word_count(F.col("abstract")).alias("abstract_words"), cite_key(F.col("bibtex")).alias("cite_key"),
    )


def brief_rows(papers: DataFrame) -> DataFrame:
    """Title, shortened authors, event and year."""
    return papers.select("title", F.substring("authors", 1, 50).alias("authors"), "event", "year")


def detail_label(year: Column, title: Column) -> Column:
    return F.format_string("[%d] %s", year, title)


def end_author(authors: Column, position: int) -> Column:
    """The first (1) or last (-1) of an array of authors, as an array of one; null for none."""
    return F.when(F.size(authors) > 0, F.array(F.element_at(authors, position)))
