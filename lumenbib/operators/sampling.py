"""Stratified samples with largest-remainder allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strata that the allocation gathers on the driver; it needs all of them at once, and they are groups, not rows.
MAX_STRATA = 100_000


def allocation(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Rows per stratum: in proportion, at least one, remainders by size of fraction and then of stratum."""
    population = sum(sizes.values())
    if not population:
        return {}
    quota = {k: total * n / population for k, n in sizes.items()}
    given = {k: min(sizes[k], max(1, int(q))) for k, q in quota.items()}
    by_fraction = sorted(sizes, key=lambda k: (-(quota[k] - int(quota[k])), -sizes[k], k))
    while sum(given.values()) < min(total, population):
        for k in by_fraction:
            if sum(given.values()) >= min(total, population):
                break
            if given[k] < sizes[k]:
                given[k] += 1
    while sum(given.values()) > total and any(n > 1 for n in given.values()):
        given[max(given, key=lambda k: (given[k], k))] -= 1
    return given


def strata(rows: DataFrame, by: str, total: int) -> DataFrame:
    """``(by, population, sample)`` of every stratum; a null stratum is left out."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).limit(MAX_STRATA + 1).collect()
    if len(counts) > MAX_STRATA:
        raise ValueError("too many strata to allocate")
    sizes = {r[by]: r.n for r in counts}
    given = allocation(sizes, total)
    return rows.sparkSession.createDataFrame([(k, n, given[k]) for k, n in sizes.items()], f"{by} string, population long, sample long")


def stratified_sample(rows: DataFrame, key: str, by: str, total: int, seed: int = 42) -> DataFrame:
    """Rows drawn without replacement per stratum by the order of a seeded digest, with their weight."""
    plan = F.broadcast(strata(rows, by, total))
    w = Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    drawn = rows.join(plan, by).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("sample"))
    return drawn.withColumn("weight", F.col("population") / F.col("sample")).drop("_n")


def sample_difference(sample: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows of one and not of the other, marked by side; empty when they agree."""
    cols = committed.columns
    a, b = sample.select(*cols), committed
    return a.exceptAll(b).withColumn("only_in", F.lit("sample")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("committed")))
