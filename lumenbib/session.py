"""Session helpers shared by every operator: sizing, checkpoints, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "lumenbib", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with AQE, skew handling and UTC; cluster settings given elsewhere win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing a scratch folder is made, but only for a purely local master: on a
    cluster a machine-local folder would lose the data with its machine, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lumenbib-checkpoint-")
    sc.setCheckpointDir(shared)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for files that a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint while its counted ``rows`` stay within ``max_rows``; else as it is."""
    return F.broadcast(df) if rows <= max_rows else df
