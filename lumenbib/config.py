"""What a run collects: events and years, kept as a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Configuration:
    """Events to collect, in given years or from a first year to a last one or the present."""

    events: tuple[str, ...] = ()
    listed_years: tuple[int, ...] = ()
    year_start: int = 2019
    year_end: int | None = None

    def years(self, now: int | None = None) -> list[int]:
        if self.listed_years:
            return list(self.listed_years)
        return list(range(self.year_start, (self.year_end or now or datetime.now(UTC).year) + 1))


_LOADED: dict[str, Configuration] = {}


def save(spark: SparkSession, configuration: Configuration, path: str) -> None:
    """Writes the configuration; what was loaded from the path before is forgotten."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps(asdict(configuration), indent=2).encode()))
    finally:
        out.close()
    _LOADED.pop(path, None)


def load(spark: SparkSession, path: str) -> Configuration:
    """The configuration of a path, read once."""
    if path not in _LOADED:
        given = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
        _LOADED[path] = Configuration(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    return _LOADED[path]
