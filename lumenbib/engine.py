"""One object for a corpus: ingest, enrich, search, export, statistics and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.functions.abstracts import abstract_of_page
from lumenbib.functions.bibtex import entry_of_fields, inherit_from_proceedings, is_valid_entry
from lumenbib.functions.text import extractor_name
from lumenbib.operators import aggregates, dml, records
from lumenbib.operators import search as searching
from lumenbib.schema import BATCH, PAPER, conform
from lumenbib.sources import records as sources
from lumenbib.sources import sinks


class Engine:
    """A corpus of papers below ``root``, kept in versions; every change writes a new one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = dml.VersionedStore(spark, root, key="paper_id")

    def papers(self) -> DataFrame:
        """The current papers; an error if there is no corpus."""
        return self.store.read()

    def _current(self) -> DataFrame:
        return self.store.read() if self.store.exists() else self.spark.createDataFrame([], PAPER)

    def _save(self, papers: DataFrame) -> str:
        return self.store.write(papers)

    def _merge(self, batch: DataFrame) -> str:
        return self.store.merge(batch, dml.upsert, self.spark.createDataFrame([], PAPER))

    def ingest(self, listing_path: str) -> str:
        """Listing files into the corpus: first record of each id, editorships dropped, upserted."""
        rows = sources.listing_papers(sources.read_listing_json(self.spark, listing_path))
        return self._merge(records.consolidated(rows, "paper_id", "file", "position"))

    def import_csv(self, path: str) -> str:
        rows = sources.read_paper_csv(self.spark, path).withColumn("_at", F.monotonically_increasing_id())
        return self._merge(dml.fold_batch(conform(rows, BATCH), "_at"))

    def bootstrap(self, csv: str) -> bool:
        """Loads a CSV if the corpus is missing or empty; whether it did."""
        if self.store.exists() and not self.store.read().isEmpty():
            return False
        self.import_csv(csv)
        return True

    def run_all(self, listing_path: str, payloads: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
        """Ingest, abstracts from services and pages, and entries, in this order; returns the totals."""
        self.ingest(listing_path)
        if payloads is not None:
            self.enrich_from_services(payloads)
        if pages is not None:
            self.enrich_from_pages(pages)
        self.bibtex()
        return self.stats()["totals"]

    def fill_abstracts(self, path: str) -> DataFrame:
        """Empty abstracts from a CSV; returns the counts of the import."""
        filled, counts = dml.fill_abstracts(self.papers(), sources.read_abstract_csv(self.spark, path))
        row = counts.collect()
        self._save(filled)
        return self.spark.createDataFrame(row, counts.schema)

    def enrich_from_pages(self, pages: DataFrame) -> str:
        """Empty abstracts from ``pages (paper_id, html)`` by the extractor of each paper's event."""
        own = self.papers()
        found = pages.join(own.select("paper_id", extractor_name(F.col("event")).alias("by")), "paper_id").select("paper_id", abstract_of_page(F.col("html"), F.col("by")).alias("abstract"))
        return self._save(dml.fill_abstracts(own, found.where("abstract is not null"))[0])

    def enrich_from_services(self, payloads: DataFrame) -> str:
        return self._save(dml.fill_abstracts(self.papers(), sources.payload_abstracts(payloads).where("abstract is not null"))[0])

    def bibtex(self, source: str = "local", path: str | None = None, overwrite: bool = False) -> str:
        """Citation entries from the columns, from recorded answers ``(key, bibtex)`` or from an XML dump."""
        own = self.papers()
        if source == "local":
            return self._save(dml.fill_entries(own, overwrite))
        if source == "recorded":
            answers = self.spark.read.parquet(path).where(is_valid_entry(F.col("bibtex")))
            return self._save(dml.update_column(own, answers, "bibtex", on="key"))
        keys = searching.lacking_entry(own).select("key").distinct()
        entries = inherit_from_proceedings(sources.read_records(self.spark, path, keys), sources.read_proceedings(self.spark, path))
        rendered = entries.withColumn("editor", F.col("editor")).select("key", entry_of_fields().alias("bibtex")).dropDuplicates(["key"])
        return self._save(dml.update_column(own, rendered, "bibtex", on="key"))

    def search(self, filters: searching.SearchFilters, limit: int | None = 50, by: str | None = None) -> DataFrame:
        return searching.search(self.papers(), filters, limit, by)

    def export(self, df: DataFrame, fmt: str, path: str) -> None:
        sinks.write(df, fmt, path)

    def stats(self) -> dict[str, DataFrame]:
        own = self.papers()
        return {"totals": aggregates.totals(own), "by_event": aggregates.coverage_by(own, "event"), "by_year": aggregates.counts_by(own, "year"), "by_class": aggregates.counts_by_class(own)}

    def snapshot(self, path: str) -> str:
        """Copies the current version to another store, compressed, and notes both as synchronised."""
        other = dml.VersionedStore(self.spark, path)
        version = other.write(self.papers(), compression="gzip")
        self.store.mark_synced(other)
        return version

    def refresh(self, path: str) -> str:
        """Takes over the current version of another store, whatever has changed here."""
        other = dml.VersionedStore(self.spark, path)
        version = self._save(other.read())
        self.store.mark_synced(other)
        return version

    def refresh_if_due(self, path: str) -> str:
        """Takes a newer snapshot over where nothing has changed here; returns the decision."""
        decision = self.store.refresh_decision(dml.VersionedStore(self.spark, path))
        if decision == "refresh":
            self.refresh(path)
        return decision
