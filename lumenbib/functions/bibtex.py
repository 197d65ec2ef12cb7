"""Citation entries rendered and checked as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.derived import doi
from lumenbib.functions.text import parse_authors

# The order of fields in an entry, the width of a field's name, the column of a further author.
FIELD_ORDER = (
    "author", "editor", "title", "booktitle", "journal", "volume", "number", "pages", "year", "publisher", "series", "address", "isbn", "url", "doi", "biburl", "bibsource",
)
WIDTH, AUTHOR_COLUMN = 13, 18
# Fields that an entry inherits from its proceedings.
INHERITED = ("editor", "booktitle", "publisher", "series", "volume", "address", "isbn")
SOURCE = "dblp computer science bibliography, https://dblp.org"
JOURNAL_EVENTS = ("ACM Computing Surveys", "IEEE Communications Surveys & Tutorials", "Foundations and Trends in Privacy and Security")


def join_names(names: Column) -> Column:
    return F.array_join(names, " and\n" + " " * AUTHOR_COLUMN)


def format_entry(tag: Column, key: Column, fields: dict[str, Column]) -> Column:
    """An entry in the source's house style; null fields are left out. ``author`` and ``editor`` are texts already joined."""
    given = dict(fields)
    given.setdefault("biburl", F.concat(F.lit("https://dblp.org/rec/"), key, F.lit(".bib")))
    given.setdefault("bibsource", F.lit(SOURCE))
    if "pages" in given:
        given["pages"] = F.regexp_replace(given["pages"], r"(\d)-(\d)", "$1--$2")
    lines = [F.when(given[f].isNotNull(), F.concat(F.lit(f"  {f:<{WIDTH}}= {{"), given[f], F.lit("}"))) for f in FIELD_ORDER if f in given]
    return F.concat(F.lit("@"), tag, F.lit("{DBLP:"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def entry_tag(paper_type: Column, event: Column) -> Column:
    return F.when(paper_type == "proceedings", "proceedings").when(event.isin(*JOURNAL_EVENTS), "article").otherwise("inproceedings")


def entry_of_paper(p: str = "") -> Column:
    """An entry from the columns of a paper; null without a key."""
    c = lambda name: F.col(p + name)
    some = lambda name: F.nullif(c(name), F.lit(""))
    tag = entry_tag(c("paper_type"), c("event"))
    names = parse_authors(c("authors"))
    fields = {
        "author": F.when(F.length(c("authors")) > 0, join_names(names)),
        "title": F.rtrim(some("title"), F.lit(".")),
        "booktitle": F.when(tag != "article", some("event")),
        "journal": F.when(tag == "article", some("event")),
        "pages": some("pages"),
        "year": c("year").cast("string"),
        "url": some("ee"),
        "doi": F.nullif(doi(c("ee")), F.lit("")),
    }
    return F.when(F.length(c("key")) > 0, format_entry(tag, c("key"), fields))


def is_valid_entry(text: Column) -> Column:
    head, t = F.regexp_replace(text, r"^\s+", ""), F.lower(text)
    return F.coalesce(head.rlike(r"^@\w+\{[^,]+,") & t.contains("title") & t.contains("year") & (t.contains("author") | t.contains("editor")), F.lit(False))


def inherit_from_proceedings(entries: DataFrame, proceedings: DataFrame) -> DataFrame:
    """Entries with fields they lack taken from the proceedings that ``crossref`` names.

    Both frames have ``key``, the fields of INHERITED and, for entries, ``crossref``.
    """
    parent = proceedings.select(F.col("key").alias("_pk"), *[F.col(f).alias(f"_p_{f}") for f in INHERITED])
    keep = [c for c in entries.columns if c not in INHERITED]
    joined = entries.join(parent, F.col("crossref") == F.col("_pk"), "left")
    return joined.select(*keep, *[F.coalesce(f, f"_p_{f}").alias(f) for f in INHERITED])


def entry_of_fields() -> Column:
    """An entry from the columns of an XML record (``author`` and ``editor`` arrays, the rest texts)."""
    fields = {f: F.col(f) for f in FIELD_ORDER if f not in ("biburl", "bibsource", "author", "editor")}
    fields |= {f: F.when(F.size(f) > 0, join_names(F.col(f))) for f in ("author", "editor")}
    return format_entry(F.col("tag"), F.col("key"), fields)
