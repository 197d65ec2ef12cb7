"""Digests of texts, groups and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.text import collapse


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with its white space collapsed."""
    return F.sha2(collapse(text), 256)


def cluster_id(members: Column) -> Column:
    """``ta-`` and twelve hex digits of the digest of the sorted members, one per line."""
    return F.concat(F.lit("ta-"), F.left(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), F.lit(12)))


def cache_path(key: Column) -> Column:
    return F.concat(F.md5(key), F.lit(".json"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One digest over ``(role, path, bytes, sha256)`` rows in order of role and path.

    A manifest lists input files, so it is small by nature; its lines are aggregated in order.
    """
    line = F.concat(F.concat_ws("\x00", "role", "path", F.col("bytes").cast("string"), "sha256"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("role", "path", line.alias("line"))))
    return files.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), ""), 256).alias("digest"))


def file_fingerprint(files: DataFrame) -> DataFrame:
    """``(path, fingerprint)`` from the size and the time of change of files read with the binary source."""
    return files.select("path", F.concat_ws("-", F.col("length").cast("string"), F.unix_seconds("modificationTime").cast("string")).alias("fingerprint"))
