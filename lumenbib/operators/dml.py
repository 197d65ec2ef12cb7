"""Changes to the corpus as new frames: upserts, fills and updates, and the versioned store that holds them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions.bibtex import entry_of_paper
from lumenbib.schema import PAPER, UPSERT_COLUMNS, conform

MIN_IMPORT = 50


def fold_batch(batch: DataFrame, position: str) -> DataFrame:
    """One row per id of a batch applied in order: the last metadata, the first non-null abstract."""
    meta = [c for c in UPSERT_COLUMNS if c not in ("paper_id", "abstract")]
    return batch.groupBy("paper_id").agg(
        F.max_by(F.struct(*meta), position).alias("m"), F.min_by("abstract", F.when(F.col("abstract").isNotNull(), F.col(position))).alias("abstract")
    ).select("paper_id", "m.*", "abstract")


def upsert(papers: DataFrame, batch: DataFrame, now: str | None = None) -> DataFrame:
    """``papers`` with ``batch`` (unique ids) written over it.

    Metadata of the batch wins, an abstract that is not null stays (an empty one too), the entry text and the
    creation time are untouched. Applying the same batch twice equals applying it once, but for the time.
    """
    time_now = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    old = conform(papers).select(*[F.col(c).alias(f"o_{c}") for c in PAPER.fieldNames()], F.lit(True).alias("_old"))
    new = conform(batch).select(*[F.col(c).alias(f"n_{c}") for c in UPSERT_COLUMNS], F.lit(True).alias("_new"))
    joined = old.join(new, F.col("o_paper_id") == F.col("n_paper_id"), "full")
    fresh = F.coalesce("_new", F.lit(False))

    def value(c: str):
        if c == "paper_id":
            return F.coalesce("o_paper_id", "n_paper_id")
        if c == "abstract":
            return F.coalesce("o_abstract", "n_abstract")
        if c == "bibtex":
            return F.col("o_bibtex")
        if c == "created_at":
            return F.when(F.col("_old"), F.col("o_created_at")).otherwise(time_now)
        if c == "updated_at":
            return F.when(fresh, time_now).otherwise(F.col("o_updated_at"))
        return F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    return joined.select(*[value(c).alias(c) for c in PAPER.fieldNames()])


def fill_abstracts(papers: DataFrame, staged: DataFrame, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Empty abstracts filled from ``staged (paper_id, abstract)``, and the five counts of the import.

    Texts below fifty characters are not staged; of repeated ids the last by ``position`` counts. Staged rows without a
    position have no order, so of them the greatest text counts.
    """
    usable = staged.where(F.length("abstract") >= MIN_IMPORT)
    position = position or ("position" if "position" in staged.columns else "abstract")
    order = F.col(position)
    once = usable.groupBy("paper_id").agg(F.max_by("abstract", order).alias("_new"))
    joined = papers.join(once, "paper_id", "left")
    blank = F.coalesce("abstract", F.lit("")) == ""
    filled = joined.withColumn("abstract", F.when(blank, F.coalesce("_new", "abstract")).otherwise(F.col("abstract"))).drop("_new")
    match = once.join(papers.select("paper_id", blank.alias("_blank")), "paper_id", "left")
    counts = match.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("_blank").isNotNull()).alias("matched"), F.count_if("_blank").alias("updated"),
        F.count_if(~F.col("_blank")).alias("skipped_existing"), F.count_if(F.col("_blank").isNull()).alias("missing_in_db"),
    )
    return filled, counts


def update_column(papers: DataFrame, values: DataFrame, column: str, on: str = "paper_id") -> DataFrame:
    """``column`` replaced where ``values (on, column)`` has a row; ``on`` is unique there."""
    new = values.select(on, F.col(column).alias("_v"))
    return papers.join(new, on, "left").withColumn(column, F.coalesce("_v", column)).drop("_v").select(*papers.columns)


def fill_entries(papers: DataFrame, overwrite: bool = False) -> DataFrame:
    """Entries rendered from the columns where there is none, or everywhere."""
    blank = F.coalesce("bibtex", F.lit("")) == ""
    return papers.withColumn("bibtex", F.when(F.lit(overwrite) | blank, F.coalesce(entry_of_paper(), "bibtex")).otherwise(F.col("bibtex")))


def add_column(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    """``df`` with a null column if it lacks it."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


class CorpusNotFoundError(RuntimeError):
    """No version of the corpus exists at a place."""


class VersionedStore:
    """Parquet versions in a directory and numbered manifests, the highest of which is current.

    A write goes to new directories and its manifest is created after them under the next number, which fails if that
    number exists: readers never see half a version, and of two writers who read the same version one is refused. With a
    ``key`` the rows are kept in buckets by its hash, and :meth:`merge` writes only those that a batch touches.
    File access is through Hadoop's API, so a lost executor costs a retry of its tasks only.
    """

    def __init__(self, spark: SparkSession, root: str, key: str | None = None, buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _get(self, path: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))

    def _put(self, path: str, content: dict, replace: bool) -> None:
        out = self._fs.create(self._path(path), replace)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and n[:1].isdigit()]

    def manifest(self) -> dict | None:
        numbers = self._numbers()
        return self._get(f"{self.root}/manifests/{max(numbers):08}.json") if numbers else None

    def _commit(self, now: dict | None, version: str, parts: dict[str, str], schema: str) -> str:
        number = (now or {}).get("number", 0) + 1
        try:
            self._put(f"{self.root}/manifests/{number:08}.json", {"number": number, "version": version, "before": (now or {}).get("version"), "parts": parts, "schema": schema}, replace=False)
        except Exception as e:
            raise RuntimeError("the corpus changed since it was read") from e
        return version

    def _write(self, df: DataFrame, partition_by: list[str] | None, compression: str) -> tuple[str, dict[str, str]]:
        version = f"v{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
        out = df.write.option("compression", compression)
        if self.key is None or partition_by:
            out.partitionBy(*(partition_by or [])).parquet(f"{self.root}/{version}")
            return version, {"": version}
        df.withColumn("_bucket", self._bucket()).write.option("compression", compression).partitionBy("_bucket").parquet(f"{self.root}/{version}")
        return version, {n.removeprefix("_bucket="): f"{version}/{n}" for n in self._names(f"{self.root}/{version}") if n.startswith("_bucket=")} or {"": version}

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, base: str | None = None, partition_by: list[str] | None = None, compression: str = "snappy") -> str:
        """Writes a whole version and makes it current; ``base`` is the version that was read, if any."""
        now = self.manifest()
        if base is not None and (now or {}).get("version") != base:
            raise RuntimeError("the corpus changed since it was read")
        return self._commit(now, *self._write(df, partition_by, compression), df.schema.json())

    def merge(self, batch: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame) -> str:
        """Makes ``apply(rows, batch)`` current, where only the buckets that hold a key of the batch are read and written.

        A store without a key is read and written as a whole.
        """
        now = self.manifest()
        parts = dict((now or {}).get("parts", {}))
        whole = self.key is None or "" in parts
        touched = set() if whole else {str(r.b) for r in batch.select(self._bucket().alias("b")).distinct().collect()}
        held = list(parts.values()) if whole else [parts[b] for b in touched if b in parts]
        rows = self._read(held, now["schema"]).select(*empty.columns) if held else empty
        merged = apply(rows, batch)
        version, fresh = self._write(merged, None, "snappy")
        return self._commit(now, version, fresh if whole else parts | fresh, merged.schema.json())

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self) -> DataFrame:
        now = self.manifest()
        if now is None:
            raise CorpusNotFoundError(f"no corpus at {self.root}")
        return self._read(list(now["parts"].values()), now["schema"])

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{d}" for d in parts])

    def require(self) -> DataFrame:
        """The current rows; an error if there is no corpus or it holds no row."""
        rows = self.read()
        if rows.isEmpty():
            raise CorpusNotFoundError(f"the corpus at {self.root} is empty")
        return rows

    def restore(self, version: str) -> None:
        """Makes an older version current again, as a new manifest."""
        for number in self._numbers():
            old = self._get(f"{self.root}/manifests/{number:08}.json")
            if old["version"] == version:
                self._commit(self.manifest(), version, old["parts"], old["schema"])
                return
        raise CorpusNotFoundError(f"no version {version} at {self.root}")

    def bootstrap(self, other: VersionedStore) -> bool:
        """Takes over another store's current version if this one has none; whether it did."""
        if self.exists() or not other.exists():
            return False
        self.write(other.read())
        self.mark_synced(other)
        return True

    def state(self, other: VersionedStore) -> str:
        """``in_sync``, ``behind``, ``ahead`` or ``conflict`` against another store, by their lineage."""
        a, b = self.manifest(), other.manifest()
        if a == b or (a or {}).get("version") == (b or {}).get("version"):
            return "in_sync"
        if a is None or (b or {}).get("before") == a["version"]:
            return "behind"
        return "ahead" if b is None or a.get("before") == b["version"] else "conflict"

    def mark_synced(self, other: VersionedStore) -> None:
        """Notes the versions of both stores as those last synchronised."""
        self._put(f"{self.root}/SYNC.json", {"theirs": (other.manifest() or {}).get("version"), "ours": (self.manifest() or {}).get("version")}, replace=True)

    def refresh_decision(self, other: VersionedStore) -> str:
        """What is due against a published snapshot, by the versions noted when both were last synchronised.

        ``adopted``: nothing was noted, so the present state is; ``in_sync``: the snapshot is the one noted;
        ``refresh``: it is newer and this store unchanged; ``conflict``: both have changed.
        """
        if not self._fs.exists(self._path(f"{self.root}/SYNC.json")):
            self.mark_synced(other)
            return "adopted"
        noted = self._get(f"{self.root}/SYNC.json")
        if (other.manifest() or {}).get("version") == noted["theirs"]:
            return "in_sync"
        return "refresh" if (self.manifest() or {}).get("version") == noted["ours"] else "conflict"
