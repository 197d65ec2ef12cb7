"""Where results go: CSV, JSON, JSON lines, citation text, parquet versions and audit files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from lumenbib.functions.derived import export_rows
from lumenbib.operators.search import default_order

FORMATS = ("csv", "json", "jsonl", "bibtex", "parquet")


def _csv(out: DataFrameWriter) -> DataFrameWriter:
    """Values as they are: no blanks are trimmed, line ends stay inside quotes. Readers take an empty text for null."""
    return out.option("header", True).option("escape", '"').option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write(df: DataFrame, fmt: str, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Writes ``df`` in one of FORMATS. One file only on request: the parts of a large result stay apart."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt == "bibtex":
        df = df.where(F.coalesce("bibtex", F.lit("")) != "").orderBy(*default_order()).select("bibtex")
    out = (df.coalesce(1) if single_file else df).write.mode(mode)
    if fmt == "csv":
        _csv(out).csv(path)
    elif fmt == "bibtex":
        out.option("lineSep", "\n\n").text(path)
    elif fmt == "parquet":
        out.parquet(path)
    else:
        out.option("ignoreNullFields", False).json(path)


def write_preprints(df: DataFrame, path: str, compressed: bool = True) -> None:
    """JSON lines that keep null fields."""
    out = df.write.mode("overwrite").option("ignoreNullFields", False)
    (out.option("compression", "gzip") if compressed else out).json(path)


def write_audit(df: DataFrame, path: str, order: list[str]) -> None:
    """A deterministic CSV: fixed order, one file, and no overwriting of evidence."""
    _csv(df.orderBy(*order).coalesce(1).write.mode("errorifexists")).csv(path)


def write_download_log(log: DataFrame, path: str) -> None:
    """``log (event, year, file_name, url, http_code, status, message, timestamp)`` as CSV under its usual headers."""
    headers = {"event": "Event", "year": "Year", "file_name": "File", "url": "URL", "http_code": "HTTP_Code", "status": "Status", "message": "Message", "timestamp": "Timestamp"}
    _csv(log.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in headers.items()]).write.mode("overwrite")).csv(path)


def json_array(df: DataFrame, limit: int) -> str:
    """A bounded result as one JSON array."""
    rows = df.limit(limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).collect()
    return json.dumps([json.loads(r.r) for r in rows], ensure_ascii=False, indent=2)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """A result of any size as one JSON array in the order given: each row is a line, commas follow all but the last.

    The last row is told by the order itself, so only its key reaches the driver.
    """
    key = F.struct(*order)
    last = df.agg(F.max(key).alias("k"))
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    first = df.agg(F.min(key).alias("k0"))
    marked = df.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(first))
    text = F.concat(F.when(key == F.col("k0"), "[").otherwise(""), line, F.when(key == F.col("k"), "]").otherwise(","))
    marked.orderBy(*order).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_rows_as(papers: DataFrame, fmt: str, path: str) -> None:
    """The export of the result page: thirteen derived columns as CSV or JSON, or the entries."""
    write(papers if fmt == "bibtex" else export_rows(papers), fmt, path)


def write_summary(summary: dict, path: str, spark: SparkSession) -> None:
    """A summary as JSON with sorted keys and a final line end; evidence is never overwritten."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
