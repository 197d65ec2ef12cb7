"""Counts, coverage, distributions and service summaries; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.functions.derived import paper_class
from lumenbib.functions.stats import ratio
from lumenbib.operators.search import has


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def totals(papers: DataFrame) -> DataFrame:
    """Papers, with and without abstract, with entry, in one pass."""
    return papers.agg(
        F.count("*").alias("total"), F.count_if(_filled("abstract")).alias("with_abstract"),
        F.count_if(~_filled("abstract")).alias("without_abstract"), F.count_if(_filled("bibtex")).alias("with_bibtex"),
    )


def counts_by(papers: DataFrame, column: str) -> DataFrame:
    """Rows per value, null being a value."""
    return papers.groupBy(column).agg(F.count("*").alias("n"))


def coverage_by(papers: DataFrame, column: str) -> DataFrame:
    """Per value the papers, those with abstract and with entry, and the percentages."""
    n = F.count("*")
    a, b = F.count_if(_filled("abstract")), F.count_if(_filled("bibtex"))
    return papers.groupBy(column).agg(n.alias("total"), a.alias("with_abstract"), b.alias("with_bibtex"), (a * 100.0 / n).alias("abstract_pct"), (b * 100.0 / n).alias("bibtex_pct"))


def percentages(papers: DataFrame) -> DataFrame:
    """The shares of all papers with abstract and with entry; null for no papers."""
    n = F.count("*")
    share = lambda c: F.try_divide(F.count_if(_filled(c)) * 100.0, n)
    return papers.agg(n.alias("total"), share("abstract").alias("abstract_pct"), share("bibtex").alias("bibtex_pct"))


def retries(calls: DataFrame) -> DataFrame:
    """Per service the attempts beyond the first, the most of one call, and the calls that a retry saved."""
    once = calls.dropDuplicates(["call_id"])
    return once.groupBy("service").agg(
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.max("attempts").alias("most"), F.count_if((F.col("attempts") > 1) & (F.col("status") == "ok")).alias("recovered")
    )


def counts_by_class(papers: DataFrame) -> DataFrame:
    return papers.groupBy(paper_class(F.col("title"), F.col("event")).alias("paper_class")).agg(F.count("*").alias("n"))


def cross_coverage(papers: DataFrame) -> DataFrame:
    a, b = _filled("abstract"), _filled("bibtex")
    return papers.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_abstract"), F.count_if(~a & b).alias("only_bibtex"))


def key_counts(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count_distinct("key").alias("distinct_keys"), (F.count("*") - F.count_distinct("ee")).alias("ee_excess"))


def identity_groups(papers: DataFrame) -> DataFrame:
    """How many (title, authors, year, pages) occur more than once, titles and authors trimmed and in lower case."""
    groups = papers.groupBy(F.lower(F.trim("title")), F.lower(F.trim("authors")), "year", "pages").agg(F.count("*").alias("n"))
    return groups.where("n > 1").agg(F.count("*").alias("duplicate_groups"))


def keyword_hits(papers: DataFrame, terms: list[str], by: str | None = None) -> DataFrame:
    """Papers per term (and per value of ``by``) that hold it in title or abstract; one scan for all terms."""
    marked = papers.select(*([by] if by else []), F.explode(F.array_compact(F.array(*[F.when(has("title", t) | has("abstract", t), F.lit(t)) for t in terms]))).alias("term"))
    return marked.groupBy("term", *([by] if by else [])).agg(F.count("*").alias("n"))


def missing_by_event(papers: DataFrame) -> DataFrame:
    return papers.where(~_filled("abstract")).groupBy("event").agg(F.count("*").alias("n"))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``(by..., inner0, nearest0, ...)``: for each share the interpolated quantile and the value at the nearest rank.

    A sketch brackets each rank within a thousandth of the rows; values below the bracket are only counted, and those
    inside it ranked, so that no group's values are gathered, however many it has.
    """
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-0.001, 0.001)]
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sketch = some.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(10_000)).alias("b"))
    near = some.join(sketch, by)
    below = near.groupBy(*by).agg(*[F.count_if(F.col("_v") < F.get("b", F.lit(2 * i))).alias(f"below{i}") for i in range(len(shares))])
    inside = F.array(*[F.when(F.col("_v").between(F.get("b", F.lit(2 * i)), F.get("b", F.lit(2 * i + 1))), F.lit(i)) for i in range(len(shares))])
    w = Window.partitionBy(*by, "i").orderBy("_v")
    ranked = near.select(*by, "n", "_v", F.explode(F.array_compact(inside)).alias("i")).withColumn("r", F.row_number().over(w)).join(below, by)
    rank = F.col("r") + F.element_at(F.array(*[F.col(f"below{i}") for i in range(len(shares))]), F.col("i") + 1)
    at = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1) * (F.col("n") - 1)
    ranked = ranked.withColumns({"rank": rank, "at": at})
    low, high = F.col("rank") == F.floor("at") + 1, F.col("rank") == F.ceil("at") + 1
    nearest = F.col("rank") == F.greatest(F.lit(1), F.ceil(F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1) * F.col("n")))
    picked = ranked.groupBy(*by, "n", "i").agg(F.max(F.when(low, F.col("_v"))).alias("low"), F.max(F.when(high, F.col("_v"))).alias("high"), F.max(F.when(nearest, F.col("_v"))).alias("nearest"), F.max(F.col("at") - F.floor("at")).alias("part"))
    interpolated = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return picked.groupBy(*by).agg(*[c for i in range(len(shares)) for c in (F.max(F.when(F.col("i") == i, interpolated)).alias(f"inner{i}"), F.max(F.when(F.col("i") == i, F.col("nearest"))).alias(f"nearest{i}"))])


def service_summary(calls: DataFrame) -> DataFrame:
    """Per service and operation: requests, attempts, items, latencies of successes, metered cost and its completeness.

    The median is interpolated, the 95th percentile is by nearest rank; a call delivered twice counts once.
    """
    once = calls.dropDuplicates(["call_id"])
    cost = F.col("server_reported_api_budget_metering_usd")
    by = ["service", "operation"]
    sums = once.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("attempts").alias("attempts"), F.sum("items").alias("items"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.round(F.sum(cost), 6).alias("metered_usd"), F.count(cost).alias("metered_requests"), (F.count(cost) == F.count("*")).alias("metering_complete"),
    )
    marks = exact_quantiles(once.where("status = 'ok'"), by, "latency_ms", [0.5, 0.95])
    rows = sums.alias("s").join(marks.alias("m"), [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by], "left")
    return rows.select(
        *[f"s.{c}" for c in by], "requests", "attempts", "items", "ok", F.col("inner0").alias("median_ms"), F.col("nearest1").alias("p95_ms"), "metered_usd", "metered_requests", "metering_complete"
    )


def service_status(calls: DataFrame, statuses: list[str]) -> DataFrame:
    """Calls per service with one column per status."""
    return calls.dropDuplicates(["call_id"]).groupBy("service").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def date_range(papers: DataFrame) -> DataFrame:
    return papers.agg(*[f(c).alias(f"{n}_{c}") for c in ("created_at", "updated_at") for n, f in (("min", F.min), ("max", F.max))])


def hit_rate(calls: DataFrame) -> DataFrame:
    """Share of calls that a cache answered: those that made no attempt."""
    return calls.groupBy("service").agg(ratio(F.count_if(F.col("attempts") == 0), F.count("*")).alias("hit_rate"))


def label_summary(labels: DataFrame, population: DataFrame) -> DataFrame:
    """Per event the valid share of labels and its population; ``labels (event, label)``, ``population (event, n)``."""
    rate = labels.groupBy("event").agg(F.count_if(F.col("label") == "valid").alias("valid"), F.count("*").alias("labelled"))
    return rate.join(population, "event").withColumn("rate", F.col("valid") / F.col("labelled"))


def weighted_rate(summary: DataFrame) -> DataFrame:
    return summary.agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("weighted_rate"))
