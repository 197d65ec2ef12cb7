"""Record types of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAPER = _struct(
    score=T.DoubleType(), paper_id=_S, authors=_S, title=_S, venue=_S, pages=_S, year=T.IntegerType(), paper_type=_S, access=_S, key=_S, ee=_S,
    url=_S, event=_S, abstract=_S, bibtex=_S, created_at=T.TimestampNTZType(), updated_at=T.TimestampNTZType(),
)
#: Columns that an upsert writes; the entry text and the creation time are left to others.
UPSERT_COLUMNS = [c for c in PAPER.fieldNames() if c not in ("bibtex", "created_at", "updated_at")]
#: A batch of papers and the position of each row in it.
BATCH = T.StructType([*(f for f in PAPER if f.name in UPSERT_COLUMNS), T.StructField("_at", T.LongType())])
PREPRINT = _struct(
    arxiv_id=_S, title=_S, authors=T.ArrayType(_S), submitted_at=_S, updated_at=_S, primary_category=_S, categories=T.ArrayType(_S), doi=_S, journal_ref=_S, summary=_S,
)
PAPER_CSV = T.StructType([T.StructField(c, _S) for c in "ID Score Authors Title Venue Pages Year Type Access Key EE URL Event Abstract".split()])


def conform(df: DataFrame, schema: T.StructType = PAPER) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are null, others are dropped, types are cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that ``df`` lacks."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks."""
    if missing := missing_columns(df, required):
        raise ValueError(f"columns are missing: {missing}")
    return df


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with a null column for each name of ``columns (name, type)`` it lacks."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns})


def split_valid_years(df: DataFrame, low: int = 1900, high: int = 2100) -> tuple[DataFrame, DataFrame]:
    """Rows with a year in range, and the rejected rest (a null year is rejected)."""
    ok = F.coalesce(F.col("year").between(low, high), F.lit(False))
    return df.where(ok), df.where(~ok)
