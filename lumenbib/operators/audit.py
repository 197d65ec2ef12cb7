"""Provenance of abstracts, and claims checked against aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.derived import doi_anywhere
from lumenbib.functions.hashing import text_digest
from lumenbib.functions.text import collapse, key_tail, looks_like_timestamp, stable_join
from lumenbib.operators.records import numbered


def log_evidence(papers: DataFrame, log: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Per paper the sources whose logged text equals its abstract, first and last time, and the rows.

    The join is on the id and a digest of the collapsed text, so that no long text is shuffled.
    """
    own = papers.where(collapse(F.col("abstract")) != "").select("paper_id", text_digest(F.col("abstract")).alias("d"))
    rows = log.where((F.col("status") == "ok") & (collapse(F.col("abstract")) != ""))
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    rows = rows.select("paper_id", text_digest(F.col("abstract")).alias("d"), "source", "logged_at")
    return own.join(rows, ["paper_id", "d"]).groupBy("paper_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.min("logged_at").alias("first_at"), F.max("logged_at").alias("last_at"), F.count("*").alias("rows")
    )


def cache_evidence(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Per paper the cache entries for its DOI with the same text; ``cache (key, value)``, the key ends in a DOI."""
    own = papers.select("paper_id", doi_anywhere(F.coalesce("ee", F.lit(""))).alias("doi"), text_digest(F.col("abstract")).alias("d"), collapse(F.col("abstract")).alias("t"))
    entries = cache.select(doi_anywhere(key_tail(F.col("key"))).alias("doi"), text_digest(F.col("value")).alias("d"), F.substring_index("key", "_", 1).alias("source"))
    return own.where("t <> '' and doi is not null").join(entries, ["doi", "d"]).groupBy("paper_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("entries"))


def in_audit_order(papers: DataFrame) -> DataFrame:
    """``(paper_id, place)``: the place of each paper in the order of key, an absent one as '', and id."""
    keyed = papers.select("paper_id", F.coalesce("key", F.lit("")).alias("_key"))
    return numbered(keyed, [], ["_key", "paper_id"], "place").select("paper_id", "place")


def provenance(papers: DataFrame, log: DataFrame, cache: DataFrame) -> DataFrame:
    """Each paper's evidence status, digest and joined sources."""
    rows = papers.select("paper_id", "abstract")
    l = log.select("paper_id", F.col("sources").alias("ls"))  # noqa: E741
    c = cache.select("paper_id", F.col("sources").alias("cs"))
    joined = rows.join(l, "paper_id", "left").join(c, "paper_id", "left")
    text = collapse(F.col("abstract"))
    status = (
        F.when(text == "", "missing_abstract")
        .when(F.col("ls").isNotNull() & F.col("cs").isNotNull(), "exact_log_and_cache")
        .when(F.col("ls").isNotNull(), "exact_log")
        .when(F.col("cs").isNotNull(), "exact_cache")
        .otherwise("unresolved")
    )
    none = F.array().cast("array<string>")
    return joined.select(
        "paper_id", status.alias("evidence_status"), F.when(text != "", text_digest(F.col("abstract"))).alias("abstract_sha256"),
        stable_join(F.concat(F.coalesce("ls", none), F.coalesce("cs", none))).alias("sources"),
    )


def provenance_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("papers"), F.count_if(F.col("evidence_status").startswith("exact_")).alias("exact"),
        F.count_if(F.col("evidence_status") == "unresolved").alias("unresolved"), F.count_if(F.col("evidence_status") == "missing_abstract").alias("missing"),
    )


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "status").agg(F.count("*").alias("n"))


def well_formed_times(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count_if(looks_like_timestamp(F.col(column))).alias("well_formed"), F.count("*").alias("n"))


def digest_mismatches(sample: DataFrame, papers: DataFrame) -> DataFrame:
    """Sampled papers that are gone or whose abstract changed; ``sample (paper_id, abstract_sha256)``."""
    now = papers.select("paper_id", text_digest(F.col("abstract")).alias("now"))
    return sample.join(now, "paper_id", "left").where(F.col("now").isNull() | (F.col("now") != F.col("abstract_sha256")))


def verify_inputs(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``(role, path, sha256, ok)`` of input files against expected digests by role; an error names what differs.

    ``files (role, path, bytes, sha256)``; roles without an expectation pass. Files are few by nature.
    """
    known = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair]) if expected else F.create_map().cast("map<string,string>")
    judged = files.select("role", "path", "sha256", F.coalesce(F.col("sha256") == F.try_element_at(known, F.col("role")), F.lit(True)).alias("ok"))
    if wrong := [f"{r.role}: {r.path}" for r in judged.where("not ok").collect()]:
        raise ValueError(f"digests differ: {wrong}")
    return judged


def guarded_audit(papers: DataFrame, log: DataFrame, cache: DataFrame, expected: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The provenance of all papers and its summary; with ``expected`` counts an error where the summary differs."""
    manifest = provenance(papers, log_evidence(papers, log), cache_evidence(papers, cache))
    summary = provenance_summary(manifest)
    if expected:
        row = summary.first().asDict()
        if wrong := {k: row[k] for k, v in expected.items() if row[k] != v}:
            raise ValueError(f"counts differ: {wrong}")
    return manifest, summary


def corpus_claims(papers: DataFrame, observed: dict[str, Column], expected: dict[str, tuple[float, float]]) -> DataFrame:
    """Claims on aggregates of all papers, taken in one pass: ``observed`` names them, ``expected`` has value and tolerance."""
    return claims(papers.agg(*[c.alias(name) for name, c in observed.items()]), expected)


def claims(observed: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """A row per claim from a one-row aggregate: observed and expected value, tolerance and verdict."""
    rows = [
        observed.select(
            F.lit(name).alias("claim"), F.col(name).cast("double").alias("observed"), F.lit(float(value)).alias("expected"), F.lit(float(tolerance)).alias("tolerance"),
            (F.abs(F.col(name) - value) <= tolerance).alias("ok"),
        )
        for name, (value, tolerance) in expected.items()
    ]
    return reduce(DataFrame.unionByName, rows)
