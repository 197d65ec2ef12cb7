"""Does an author's track record tell which preprints get published? One pass per study, not per threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.stats import ratio
from lumenbib.functions.text import parse_authors, strict_author_key
from lumenbib.operators.similarity import name_keys, title_pairs
from lumenbib.session import cut


def prior_authors(papers: DataFrame, least: int = 1) -> DataFrame:
    """Strict keys of authors with at least ``least`` papers; a name twice on one paper counts once."""
    keys = name_keys(papers, "paper_id", parse_authors(F.col("authors")), strict_author_key)
    return keys.groupBy("k").agg(F.count("*").alias("papers")).where(F.col("papers") >= least)


def sampled_authors(prior: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` authors by the order of a seeded digest; a top-n, kept per task before it is merged."""
    return prior.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "k"), 256)).limit(n)


def outcomes(preprints: DataFrame, papers: DataFrame, least: float) -> DataFrame:
    """``(arxiv_id, best)``: the most alike published title at or above ``least``; null for none."""
    pairs = title_pairs(preprints.select(F.col("arxiv_id").alias("id"), "title"), papers.select(F.col("paper_id").alias("id"), "title"), least)
    best = pairs.groupBy(F.col("l").alias("arxiv_id")).agg(F.max("similarity").alias("best"))
    return preprints.select("arxiv_id").distinct().join(best, "arxiv_id", "left")


def has_record(preprints: DataFrame, prior: DataFrame, names: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``(arxiv_id, record)``: whether a strict key of the preprint is among the prior authors; ``keys (arxiv_id, k)`` if they are known."""
    names = F.col("authors") if names is None else names
    keys = name_keys(preprints, "arxiv_id", names, strict_author_key) if keys is None else keys
    hit = keys.join(prior.select("k"), "k", "left_semi").select("arxiv_id").distinct()
    return preprints.select("arxiv_id").distinct().join(hit.withColumn("record", F.lit(True)), "arxiv_id", "left").select("arxiv_id", F.coalesce("record", F.lit(False)).alias("record"))


def counts(record: DataFrame, outcome: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """The four counts of each threshold; the likeness is computed once and compared with all of them."""
    rows = record.join(outcome, "arxiv_id").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.coalesce(F.col("best") >= F.col("threshold"), F.lit(False))
    return rows.groupBy(*(by or []), "threshold").agg(
        F.count_if("record").alias("n_with"), F.count_if(~F.col("record")).alias("n_without"),
        F.count_if(F.col("record") & hit).alias("converted_with"), F.count_if(~F.col("record") & hit).alias("converted_without"),
    )


def rates(table: DataFrame) -> DataFrame:
    """Precision, base rate, relative risk (``lift``), recall, volume reduction and conventional lift; no division by zero.

    ``lift`` is infinite where only filtered preprints convert.
    """
    nw, no, cw, co = (F.col(c) for c in ("n_with", "n_without", "converted_with", "converted_without"))
    precision, base = ratio(cw, nw), ratio(co, no)
    overall = ratio(cw + co, nw + no)
    infinite = F.when((base == 0) & (precision > 0), F.lit(float("inf")))
    return table.select(
        "*", precision.alias("precision"), base.alias("base_rate"), F.coalesce(infinite, ratio(precision, base)).alias("lift"),
        ratio(cw, cw + co).alias("recall"), F.when(nw + no == 0, 0.0).otherwise(1 - ratio(nw, nw + no)).alias("volume_reduction"), ratio(precision, overall).alias("conventional_lift"),
    )


def study(preprints: DataFrame, papers: DataFrame, years: list[int], thresholds: list[float]) -> DataFrame:
    """Rates per cohort year and threshold; the record is that of papers before the cohort's year."""
    own = preprints.dropDuplicates(["arxiv_id"]).withColumn("cohort", F.expr("try_cast(left(submitted_at, 4) as int)")).where(F.col("cohort").isin(*years))
    keys = name_keys(own, "arxiv_id", F.col("authors"), strict_author_key).join(own.select("arxiv_id", "cohort"), "arxiv_id")
    first = name_keys(papers.dropna(subset=["year"]), "paper_id", parse_authors(F.col("authors")), strict_author_key)
    first = first.join(papers.select("paper_id", "year"), "paper_id").groupBy("k").agg(F.min("year").alias("since"))
    hit = keys.join(first, "k").where("since < cohort").select("arxiv_id").distinct().withColumn("record", F.lit(True))
    record = own.select("arxiv_id", "cohort").join(hit, "arxiv_id", "left").select("arxiv_id", "cohort", F.coalesce("record", F.lit(False)).alias("record"))
    return rates(counts(record, outcomes(own, papers, min(thresholds)), thresholds, ["cohort"]))


def baselines(preprints: DataFrame, papers: DataFrame, events: list[str], threshold: float = 0.6, prolific: int = 3, seed: int = 42) -> DataFrame:
    """Rates of other filters: any venue, chosen venues, prolific, as many random, first and last authors."""
    own = preprints.dropDuplicates(["arxiv_id"])
    # Names are normalised once for all variants.
    keys = cut(name_keys(own, "arxiv_id", F.col("authors"), strict_author_key))
    everyone, chosen = cut(prior_authors(papers)), cut(prior_authors(papers.where(F.col("event").isin(*events))))
    many = everyone.where(F.col("papers") >= prolific)
    listed = parse_authors(F.col("authors"))
    ends = {n: name_keys(papers.where(F.size(listed) > 0), "paper_id", F.array(F.element_at(listed, at)), strict_author_key).select("k").distinct() for n, at in (("first", 1), ("senior", -1))}
    sample = sampled_authors(everyone, max(1, chosen.count()), seed)
    variants = {"any": everyone, "chosen_venues": chosen, "prolific": many, "random": sample, **ends}
    outcome = outcomes(own, papers, threshold)
    rows = None
    for name, prior in variants.items():
        one = has_record(own, prior, keys=keys).withColumn("variant", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rates(counts(rows, outcome, [threshold], ["variant"]))
