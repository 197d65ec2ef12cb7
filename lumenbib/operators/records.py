"""First-seen and last-writer choices, duplicate groups, set operations and interleaving."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.functions.text import identity
from lumenbib.session import cut


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key. The rank is limited before the shuffle, so a hot key sends one row per task."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def consolidated(rows: DataFrame, key: str = "paper_id", *order: str) -> DataFrame:
    """Editorships dropped, then the first row of each id."""
    return first_seen(rows.where("paper_type <> 'editorship'"), key, *order)


def repeated_values(papers: DataFrame, column: str) -> DataFrame:
    """Values of a column that more than one row holds."""
    some = papers.where(F.coalesce(F.col(column), F.lit("")) != "")
    return some.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def identity_clusters(papers: DataFrame) -> DataFrame:
    """Members of each cluster of records equal in title and authors: id, kind, size and record.

    Counts come from a map-side combined aggregation. The digest that names a cluster covers all its members in order;
    it is taken over the sorted rows as they pass, so no cluster is gathered. Rows without a title have no identity.
    """
    keyed = papers.select(
        "paper_id", F.sha2(F.concat_ws("\x1f", identity(F.col("title")), identity(F.col("authors"))), 256).alias("_id"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("_year"), identity(F.col("pages")).alias("_pages"), F.length(identity(F.col("title"))).alias("_t"),
    ).where("_t > 0")
    kind = F.when((F.col("years") == 1) & (F.col("pages") == 1), "exact_bibliographic_duplicate_candidate").otherwise("possible_version_relation")
    groups = keyed.groupBy("_id").agg(F.count("*").alias("cluster_size"), F.count_distinct("_year").alias("years"), F.count_distinct("_pages").alias("pages")).where("cluster_size > 1")
    members = keyed.select("_id", "paper_id").join(groups.select("_id", "cluster_size", kind.alias("classification")), "_id")
    named = members.select("_id", "paper_id").repartition("_id").sortWithinPartitions("_id", "paper_id").mapInArrow(_digests, "_id string, cluster_id string")
    return members.join(named, "_id").select("cluster_id", "classification", "cluster_size", "paper_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(_id, cluster_id)`` of sorted ``(_id, paper_id)``: the members' digest, fed one line at a time."""
    group, digest = None, None

    def closed(rows: list) -> list:
        return [*rows, (group, "ta-" + digest.hexdigest()[:12])] if group is not None else rows

    for batch in batches:
        rows: list = []
        for key, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != group:
                rows = closed(rows)
                group, digest = key, hashlib.sha256((member or "").encode())
            else:
                digest.update(b"\n" + (member or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["_id", "cluster_id"])
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in closed([])], pa.string()) for i in (0, 1)], names=["_id", "cluster_id"])


def duplicate_summary(papers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups by key and by DOI, clusters and surplus records."""
    keys = repeated_values(papers, "key").agg(F.count("*").alias("key_groups"))
    dois = repeated_values(papers, "doi").agg(F.count("*").alias("doi_groups"))
    heads = clusters.select("cluster_id", "cluster_size").distinct()
    sums = heads.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("cluster_size") - 1), F.lit(0)).alias("excess_records"))
    return keys.join(F.broadcast(dois)).join(F.broadcast(sums))


def evidence_sets(log_ids: DataFrame, cache_ids: DataFrame) -> DataFrame:
    """Ids in either, in both, and in one only, from one aggregation of the union."""
    marked = log_ids.select("paper_id", F.lit(1).alias("l"), F.lit(0).alias("c")).unionByName(cache_ids.select("paper_id", F.lit(0).alias("l"), F.lit(1).alias("c")))
    per = marked.groupBy("paper_id").agg(F.max("l").alias("l"), F.max("c").alias("c"))
    return per.agg(F.count("*").alias("either"), F.count_if(F.expr("l + c = 2")).alias("both"), F.count_if(F.expr("l = 1 and c = 0")).alias("log_only"), F.count_if(F.expr("l = 0 and c = 1")).alias("cache_only"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 1 in each group of ``by`` in the order given.

    Rows are ranged over the tasks by group and order and numbered in each range, to which the counts of the ranges
    before it are added. A group of any size is thus numbered by many tasks, where a window would sort it in one.
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).withColumn("_g", group))
    sizes = ranged.groupBy("_g", "_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_g", "_part", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_g", "_part").orderBy(*order))
    return ranged.withColumn("_i", own).join(before, ["_g", "_part"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_g", "_part", "_i", "_before")


def interleaved(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows in turns: one of each group, then the next of each; by digest of the key within a group."""
    marked = rows.withColumn("_d", F.sha2(F.col(key).cast("string"), 256))
    return numbered(marked, [group], ["_d"], "turn").drop("_d").orderBy("turn", group)
