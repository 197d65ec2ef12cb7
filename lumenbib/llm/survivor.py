"""Problem 3: the best representative of each duplicate group.

Method: records are ranked by completeness, trust and recency with a deterministic tie-break in window order,
and the top record of each group is kept. Spark cuts such a window to the best row of each group before the
shuffle (WindowGroupLimit), so a group of any size sends one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("authors", "year", "pages", "doi", "event")
# Words and signs that only stand in for a missing value.
STAND_INS = (
    "", "none", "null", "nil", "nan", "na", "n/a", "n.n.", "nn", "n. n.", "unknown", "anonymous", "anon", "anon.", "tba", "tbd", "pending",
    "missing", "undefined", "not available", "to appear", "et al.", "et al", "and others", "-", "--", "?", "0", "0-0", "0000",
)
# Signs of a shortened list of authors.
ABRIDGED = r"(?i)(?:\bet al\.?|\band others|\bu\.\s?a\.|…|\.\.\.)\s*$|^\s*et al"
# What speaks for and against the record in a free reason, the denials of the former first.
DISTRUST = (
    r"\bnot (?:yet )?(?:been )?(?:checked|verified|confirmed|reviewed)|\bunverified|\bunchecked|\bunreviewed|\bautomatic|\bauto-|\bcrawl|\bscrap"
    r"|\bharvest|\bsuperseded|\bobsolete|\bretracted|\bupload|\bimported|\bsearch index|\bguess|\bcopy\b"
)
TRUST = r"\bverified|\bchecked|\bconfirmed|\bcurat|\bpublisher|\bversion of record|\bprinted|\bauthoritative|\bofficial|\bmanually reviewed"


def filled(name: str) -> Column:
    """Whether a field truly holds a value: no null, stand-in, empty range or shortened list."""
    c = F.trim(F.col(name).cast("string"))
    ok = c.isNotNull() & ~F.lower(c).isin(*STAND_INS) & c.rlike(r"[\p{L}\p{N}]")
    if name == "authors":
        ok = ok & ~c.rlike(ABRIDGED)
    elif name == "pages":
        ok = ok & c.rlike(r"[1-9]") & ~c.rlike(r"\?")
    elif name == "doi":
        ok = ok & c.rlike(r"(?i)\b10\.[0-9]{4,9}/\S") & ~c.rlike(r"(?i)/(?:unknown|none|null|pending|tba)$") & ~c.rlike(r"^10\.0+/")
    elif name == "year":
        ok = ok & c.cast("int").between(1900, 2100)
    return F.coalesce(ok, F.lit(False))


def trust(reason: str = "retention_reason") -> Column:
    """1 for a reason that vouches for the record, -1 for one that speaks against it, 0 else."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(r.rlike(DISTRUST), -1).when(r.rlike(TRUST), 1).otherwise(0)


def ranked_candidates(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct candidates with ``filled`` (0 to 5), ``trust`` and ``updated_at`` of papers."""
    n = reduce(lambda a, b: a + b, [filled(f).cast("int") for f in FIELDS])
    cols = ["cluster_id", "paper_id", "title", *FIELDS, "retention_reason"]
    rows = candidates.select(*cols).distinct().withColumn("filled", n).withColumn("trust", trust())
    dates = papers.select("paper_id", "updated_at").groupBy("paper_id").agg(F.max("updated_at").alias("updated_at"))
    wanted = rows.select("paper_id").distinct()
    return rows.join(dates.join(wanted, "paper_id", "left_semi"), "paper_id", "left")


def order() -> list[Column]:
    """Most complete, most trusted, most recent first; the smaller paper_id breaks a tie."""
    return [F.desc("filled"), F.desc("trust"), F.desc_nulls_last("updated_at"), F.asc("paper_id")]


def survivors(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per cluster: its best record. Rows with a null cluster or record are left out.

    Ties in all three respects go to the smaller ``paper_id``, then to the smaller spelling of the fields.
    """
    rows = ranked_candidates(candidates, papers).where("cluster_id is not null and paper_id is not null")
    w = Window.partitionBy("cluster_id").orderBy(*order(), F.to_json(F.struct("title", *FIELDS, "retention_reason")))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def found(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """``(cluster_id, paper_id)`` of the surviving records."""
    return survivors(candidates, papers).select("cluster_id", "paper_id")


def golden_records(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """One built record per cluster: of each field the value of the best record that truly has one.

    ``min_by`` over the rank keys aggregates on the map side; a field that no record of the cluster has is null.
    """
    rows = ranked_candidates(candidates, papers).where("cluster_id is not null and paper_id is not null")
    key = F.struct(
        (-F.col("filled")).alias("a"), (-F.col("trust")).alias("b"),
        (-F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0))).alias("c"), F.col("paper_id").alias("d"),
    )
    best = [F.min_by(F.when(filled(f), F.col(f)), F.when(filled(f), F.struct(key.alias("k"), F.col(f).cast("string").alias("v")))).alias(f) for f in FIELDS]
    return rows.groupBy("cluster_id").agg(
        F.min_by("paper_id", key).alias("paper_id"), F.min_by("title", F.struct(key.alias("k"), "title")).alias("title"), *best,
        F.count_distinct("paper_id").alias("records"),
    )
