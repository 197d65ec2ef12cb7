"""Search, filters, orders, limits and pages."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.derived import doi, paper_class
from lumenbib.functions.text import word_count

#: Word counts of the length classes of an abstract.
LENGTH_CLASSES = {"short": (1, 150), "medium": (151, 300), "long": (301, None)}
ORDERS = {
    "newest": lambda: [F.desc("year"), F.asc(F.coalesce("title", F.lit("")))],
    "oldest": lambda: [F.asc("year"), F.asc(F.coalesce("title", F.lit("")))],
    "title": lambda: [F.asc(F.lower(F.coalesce("title", F.lit(""))))],
    "event": lambda: [F.asc(F.coalesce("event", F.lit(""))), F.desc("year")],
}
PAGE_SIZES = (25, 50, 100, 200)


@dataclass(frozen=True)
class SearchFilters:
    """Conjunctive search; unset, empty and zero values are ignored. Terms are literal and match in any case."""

    title: str | None = None
    abstract: str | None = None
    author: str | None = None
    event: str | None = None
    year: int | None = None
    technology: str | None = None

    def is_set(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))

    def column(self) -> Column:
        tests = [has(c, t) for c, t in (("title", self.title), ("abstract", self.abstract), ("authors", self.author)) if t]
        if self.technology:
            tests.append(has("title", self.technology) | has("abstract", self.technology))
        if self.event:
            tests.append(F.col("event") == self.event)
        if self.year:
            tests.append(F.col("year") == self.year)
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def has(column: str, term: str) -> Column:
    """Whether a column holds a literal term, in any case; null counts as empty."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(term)))


def default_order() -> list[Column]:
    return [F.desc("year"), F.asc("event"), F.asc("title"), F.asc("paper_id")]


def ordered(papers: DataFrame, by: str | None = None) -> DataFrame:
    """By a named order, with the default order and the id as tie-break."""
    return papers.orderBy(*(ORDERS[by]() if by else []), *default_order())


def search(papers: DataFrame, filters: SearchFilters, limit: int | None = None, by: str | None = None) -> DataFrame:
    """Matching papers in order; a limit of 0 or None is none. With a limit Spark keeps the top rows of each task only."""
    out = ordered(papers.where(filters.column()), by)
    return out.limit(limit) if limit else out


def like_search(papers: DataFrame, term: str) -> DataFrame:
    """The SQL form: ``%`` and ``_`` in the term are wildcards."""
    pattern = F.lit(f"%{term}%")
    return papers.where(F.coalesce(F.ilike("title", pattern), F.lit(False)) | F.coalesce(F.ilike("abstract", pattern), F.lit(False)))


def page(papers: DataFrame, number: int, size: int, by: str | None = None) -> DataFrame:
    """The page ``number`` (from 1, clamped to those that exist) of ``size`` rows."""
    pages = max(1, -(-papers.count() // size))
    number = min(max(1, number), pages)
    return ordered(papers, by).offset((number - 1) * size).limit(size)


def length_class(papers: DataFrame, name: str) -> DataFrame:
    """``any``, ``has`` or a class of abstract length in words; ``short`` leaves out abstracts without words."""
    if name == "any":
        return papers
    n = word_count(F.col("abstract"))
    if name == "has":
        return papers.where(F.coalesce("abstract", F.lit("")) != "")
    low, high = LENGTH_CLASSES[name]
    return papers.where((n >= low) & (n <= high) if high else n >= low)


def with_entry(papers: DataFrame) -> DataFrame:
    return papers.where(F.coalesce("bibtex", F.lit("")) != "")


def of_classes(papers: DataFrame, classes: list[str]) -> DataFrame:
    """Papers of the classes named; none named means all."""
    return papers.where(paper_class(F.col("title"), F.col("event")).isin(*classes)) if classes else papers


def lacking_entry(papers: DataFrame) -> DataFrame:
    return papers.where((F.coalesce("bibtex", F.lit("")) == "") & (F.coalesce("key", F.lit("")) != ""))


def lacking_abstract(papers: DataFrame, event: str | None = None) -> DataFrame:
    out = papers.where(F.coalesce("abstract", F.lit("")) == "")
    return out.where(F.col("event") == event) if event else out


def fetchable(papers: DataFrame) -> DataFrame:
    """Papers without abstract whose address yields a DOI."""
    return lacking_abstract(papers).where((F.coalesce("ee", F.lit("")) != "") & doi(F.col("ee")).isNotNull())


def refined(papers: DataFrame, term: str, low: int, high: int, without: list[str]) -> DataFrame:
    """A keyword within years and without some events; rows with a null event drop out."""
    return papers.where((has("title", term) | has("abstract", term)) & F.col("year").between(low, high) & ~F.col("event").isin(*without))


def in_scope(papers: DataFrame, events: list[str] | None, years: tuple[int, int], need: tuple[str, ...] = ("title", "authors")) -> DataFrame:
    out = papers.where(F.col("year").between(*years))
    if events:
        out = out.where(F.col("event").isin(*events))
    return out.dropna(subset=list(need))


def cohort(preprints: DataFrame, year: int) -> DataFrame:
    """Preprints whose submission text begins with the year."""
    return preprints.where(F.col("submitted_at").startswith(str(year)))
