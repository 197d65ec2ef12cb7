"""Structured Streaming forms of incremental ingest, expiry and service protection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.operators.dml import VersionedStore, fold_batch, upsert
from lumenbib.schema import PAPER

BREAKER = T.StructType([T.StructField("service", T.StringType()), T.StructField("call_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("refused", T.BooleanType())])


def ingest(spark: SparkSession, source: str, store: VersionedStore, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Papers that land as parquet files, folded and upserted batch by batch until none is left.

    Rows of a batch apply in the order of their files' times and of their places in them, which a retry does not change.
    ``on_batch`` is shown each batch and its number first. The sink is idempotent, so a batch that is replayed after a failure changes nothing, and it rewrites only the
    buckets of the store that the batch touches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            if on_batch:
                on_batch(batch, number)
            store.merge(fold_batch(batch, "_at"), upsert, spark.createDataFrame([], PAPER))

    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("_at")
    return (
        spark.readStream.schema(PAPER).parquet(source).select("*", place).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def calls_per_window(calls: DataFrame, late: str = "7 days", window: str = "1 hour") -> DataFrame:
    """Calls and errors per service and event-time window; deliveries twice within the watermark count once."""
    once = calls.withWatermark("called_at", late).dropDuplicatesWithinWatermark(["call_id"])
    return once.groupBy(F.window("called_at", window), "service").agg(F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("errors"))


def unexpired(cache: DataFrame, now: str) -> DataFrame:
    """Cache entries that have not expired; entries without a date never do."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def read_through(cache: DataFrame, reads: DataFrame) -> DataFrame:
    """``(key, value, access_count, last_accessed)`` after ``reads (key, at)``: a read counts while its entry has not expired."""
    rows = cache.select("key", "value", "expires_at", F.coalesce("access_count", F.lit(0)).alias("before"))
    hit = rows.join(reads, "key").where(F.col("expires_at").isNull() | (F.col("expires_at") > F.col("at")))
    counts = hit.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last_accessed"))
    return rows.join(counts, "key", "left").select("key", "value", (F.col("before") + F.coalesce("n", F.lit(0))).alias("access_count"), "last_accessed")


def backoff(calls: DataFrame, first_s: int = 60, most_s: int = 3600) -> DataFrame:
    """``(service, failures, blocks, wait_s)``: failures since the last success, refusals, and the wait after the last one.

    Each refusal doubles the wait up to a bound; a call delivered twice counts once.
    """
    once = calls.groupBy("call_id").agg(F.any_value("service").alias("service"), F.min("called_at").alias("at"), F.min("status").alias("status"))
    good = once.groupBy("service").agg(F.max(F.when(F.col("status") == "ok", F.struct("at", "call_id"))).alias("good"))
    rows = once.join(good, "service")
    since = F.coalesce(F.struct("at", "call_id") > F.col("good"), F.lit(True))
    counts = rows.groupBy("service").agg(F.count_if((F.col("status") != "ok") & since).alias("failures"), F.count_if(F.col("status") == "throttled").alias("blocks"))
    wait = F.least(F.lit(most_s), F.lit(first_s) * F.pow(F.lit(2.0), F.col("blocks") - 1)).cast("int")
    return counts.withColumn("wait_s", F.when(F.col("blocks") > 0, wait).otherwise(0))


def breaker_states(calls: DataFrame, failures: int = 5, recovery_s: int = 60) -> DataFrame:
    """The state of a breaker after each call of a service, in order of time.

    The state depends on every call before, so a service is one ordered stream; it is read in Arrow batches
    sorted by service and time, with a few counters as state, and is never gathered. A call delivered twice counts once.
    """
    rows = calls.dropDuplicates(["call_id"]).select("service", "call_id", F.unix_micros(F.col("called_at").cast("timestamp")).alias("at"), (F.col("status") == "ok").alias("ok"))
    ordered = rows.repartition("service").sortWithinPartitions("service", "at", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, state, failed, good, last = object(), "CLOSED", 0, 0, 0
        for batch in batches:
            out = []
            for s, call, at, ok in batch.itertuples(index=False):
                if s != service:
                    service, state, failed, good, last = s, "CLOSED", 0, 0, 0
                if state == "OPEN":
                    if at - last < recovery_s * 1_000_000:
                        out.append((s, call, state, True))
                        continue
                    state, good = "HALF_OPEN", 0
                if ok:
                    failed = 0
                    if state == "HALF_OPEN":
                        good += 1
                        state = "CLOSED" if good >= 2 else state
                else:
                    failed, last = failed + 1, at
                    state = "OPEN" if failed >= failures else state
                out.append((s, call, state, False))
            yield pd.DataFrame(out, columns=BREAKER.fieldNames())

    return ordered.mapInPandas(run, BREAKER)
