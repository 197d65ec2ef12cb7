"""Record sources: listing JSON, XML dumps, CSV, JSON lines, archives, caches and service payloads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions.abstracts import clean_abstract, first_provider, from_inverted_index, from_jats
from lumenbib.functions.text import normalize_event, normalize_type, unescape_entities
from lumenbib.schema import PAPER_CSV, PREPRINT

# Kinds of records in an XML dump, and the five entities that XML itself defines.
RECORD_TAGS = ("article", "inproceedings", "incollection", "book", "phdthesis", "mastersthesis")
XML_ENTITIES = ("amp", "lt", "gt", "quot", "apos")
LIST_FIELDS = ("author", "editor", "ee", "crossref")
TEXT_FIELDS = ("title", "journal", "booktitle", "volume", "number", "pages", "year", "publisher", "series", "isbn", "address")


# --- listing JSON -------------------------------------------------------------------------------------------


def read_listing_json(spark: SparkSession, path: str) -> DataFrame:
    """``(file, v)``: each file as one VARIANT, null where it is no JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.try_parse_json("value").alias("v"))


def valid_listings(files: DataFrame) -> DataFrame:
    """Files whose result holds hits."""
    return files.where(F.try_variant_get("v", "$.result.hits", "variant").isNotNull())


def listing_papers(files: DataFrame) -> DataFrame:
    """A row per hit with id, title and year; authors may be one object or many, their text one or many.

    Keeps ``file`` and ``position`` for first-seen choices.
    """
    hits = valid_listings(files).createOrReplaceTempView
    name = "_lumenbib_listing"
    hits(name)
    spark = files.sparkSession
    rows = spark.sql(
        f"select file, h.pos as position, h.value as hit from {name}, lateral variant_explode_outer(try_variant_get(v, '$.result.hits.hit', 'variant')) h"
    ).where("hit is not null")
    get = lambda p: F.try_variant_get("hit", p, "string")
    author = F.try_variant_get("hit", "$.info.authors.author", "variant")
    kind = F.schema_of_variant(author)
    as_list = F.when(kind.startswith("ARRAY"), F.try_variant_get(author, "$", "array<variant>")).when(author.isNotNull(), F.array(author))
    texts = F.flatten(
        F.transform(
            as_list,
            lambda a: F.coalesce(
                F.try_variant_get(F.try_variant_get(a, "$.text", "variant"), "$", "array<string>"),
                F.array(F.try_variant_get(a, "$.text", "string")),
            ),
        )
    )
    names = F.filter(F.transform(texts, lambda t: F.trim(unescape_plain(t))), lambda t: t.isNotNull() & (t != ""))
    empty = lambda c: F.nullif(c, F.lit(""))
    out = rows.select(
        "file", "position", get("$['@id']").alias("paper_id"), F.try_variant_get("hit", "$['@score']", "double").alias("score"),
        F.when(F.size(names) > 0, F.array_join(names, ", ")).alias("authors"), get("$.info.title").alias("title"), empty(get("$.info.venue")).alias("venue"),
        get("$.info.pages").alias("pages"), F.expr("try_cast(try_variant_get(hit, '$.info.year', 'string') as int)").alias("year"),
        normalize_type(get("$.info.type")).alias("paper_type"), *[get(f"$.info.{c}").alias(c) for c in ("access", "key", "ee", "url")],
    )
    out = out.withColumns({"title": unescape_entities(F.col("title")), "venue": unescape_entities(F.col("venue")), "authors": unescape_entities(F.col("authors"))})
    return out.withColumn("event", normalize_event(F.col("venue"))).where("paper_id <> '' and title <> '' and year is not null")


def unescape_plain(col: Column) -> Column:
    """The ampersand reference, which a nested expression may decode without leaving the JVM."""
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


# --- XML dump -----------------------------------------------------------------------------------------------


def entity_table(dtd: DataFrame) -> DataFrame:
    """``(name, value)`` of the entity declarations in the text lines of a DTD."""
    pairs = dtd.select(F.regexp_extract("value", r"<!ENTITY\s+(\w+)\s+\"([^\"]*)\"", 1).alias("name"), F.regexp_extract("value", r"<!ENTITY\s+(\w+)\s+\"([^\"]*)\"", 2).alias("value"))
    code = F.expr("try_cast(regexp_extract(value, '^&#(\\\\d+);$', 1) as int)")
    return pairs.where("name <> ''").select("name", F.when(code.isNotNull(), F.decode(F.encode(F.chr(code), "UTF-8"), "UTF-8")).otherwise(F.col("value")).alias("value"))


def substitute_entities(lines: DataFrame, entities: dict[str, str]) -> DataFrame:
    """Lines with declared entities replaced; the five of XML and unknown ones stay.

    The table comes from a DTD, so its size is fixed by that file. Lines without an ampersand pass untouched.
    """
    known = {k: v for k, v in entities.items() if k not in XML_ENTITIES}
    pattern = re.compile(r"&(\w+);")

    @F.pandas_udf(T.StringType())
    def replace(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else pattern.sub(lambda m: known.get(m.group(1), m.group(0)), v))

    return lines.select(F.coalesce(replace(F.when(F.col("value").rlike(r"&\w+;"), F.col("value"))), "value").alias("value"))


def read_records(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Records of a cleaned dump as ``(tag, key, fields...)``; with ``keys (key)`` only those.

    Markup inside a field ends its text, as the source's own reader has it.
    """
    text, texts = T.StringType(), T.ArrayType(T.StringType())
    fields = [T.StructField("_key", text), *(T.StructField(c, texts) for c in LIST_FIELDS), *(T.StructField(c, text) for c in TEXT_FIELDS)]
    schema = T.StructType(fields)
    frames = [spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("tag", F.lit(tag)) for tag in RECORD_TAGS]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.where(F.col("_key").isNotNull())
    if keys is not None:
        rows = rows.join(keys.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi")
    return _record_fields(rows)


def read_proceedings(spark: SparkSession, path: str) -> DataFrame:
    text, texts = T.StringType(), T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("_key", text), *(T.StructField(c, texts) for c in LIST_FIELDS), *(T.StructField(c, text) for c in TEXT_FIELDS)])
    rows = spark.read.format("xml").option("rowTag", "proceedings").schema(schema).load(path)
    return _record_fields(rows.where(F.col("_key").isNotNull()).withColumn("tag", F.lit("proceedings")))


def _record_fields(rows: DataFrame) -> DataFrame:
    cut = lambda c: F.nullif(F.trim(F.substring_index(c, "<", 1)), F.lit(""))
    names = lambda c: F.coalesce(F.filter(F.transform(c, cut), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    links = names(F.col("ee"))
    resolver = F.filter(links, lambda u: u.contains("doi.org/"))
    return rows.select(
        "tag", F.col("_key").alias("key"), names(F.col("author")).alias("author"), F.array_join(names(F.col("editor")), " and\n" + " " * 18).alias("_e"),
        names(F.col("editor")).alias("editor"), F.get(names(F.col("crossref")), F.lit(0)).alias("crossref"), *[cut(F.col(c)).alias(c) for c in TEXT_FIELDS],
        F.coalesce(F.get(resolver, F.lit(0)), F.get(links, F.lit(0))).alias("url"), F.element_at(F.split(F.get(resolver, F.lit(0)), r"doi\.org/", 2), 2).alias("doi"),
    ).drop("_e")


# --- files --------------------------------------------------------------------------------------------------


def read_paper_csv(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a CSV with capitalised or lower-case headers; rows without title or year are left out.

    Columns are taken by header name, never by inferred type.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lower(): c for c in raw.columns}
    names = {"id": "paper_id", "type": "paper_type"}
    wanted = [f.name.lower() for f in PAPER_CSV]
    cols = []
    for c in wanted:
        source = have.get(c) or have.get(names.get(c, ""))
        cols.append((F.col(f"`{source}`") if source else F.lit(None).cast("string")).alias(names.get(c, c)))
    rows = raw.select(*cols)
    typed = rows.withColumns({"year": F.expr("try_cast(try_cast(year as double) as int)"), "score": F.expr("try_cast(score as double)")})
    typed = typed.withColumn("paper_type", normalize_type(F.col("paper_type")))
    return typed.where("title <> '' and year is not null")


def read_abstract_csv(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """``(paper_id, abstract, position)`` of texts of at least ``least`` characters, and the place of each.

    A file with quoted line ends is read by one task, so file name and running number give the order of the rows.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return raw.select(F.col("ID").alias("paper_id"), F.col("Abstract").alias("abstract"), place.alias("position")).where(F.length("abstract") >= least)


def read_preprints(spark: SparkSession, path: str) -> DataFrame:
    """Preprints of JSON lines, compressed or not, with a fixed schema."""
    return spark.read.schema(PREPRINT).json(path)


def read_keyed_csv(spark: SparkSession, path: str, key: str = "paper_id") -> DataFrame:
    """A small CSV with one row per key; of repeated keys the later row counts."""
    rows = spark.read.option("header", True).csv(path).withColumn("_i", F.monotonically_increasing_id())
    cols = [c for c in rows.columns if c not in (key, "_i")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_i").alias("r")).select(key, "r.*") if cols else rows.select(key).distinct()


def zip_members(spark: SparkSession, path: str, pattern: str = r".*") -> DataFrame:
    """``(file, member, content)`` of archive members whose name matches; one archive is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("member", T.StringType()), T.StructField("content", T.BinaryType())])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for name in sorted(archive.namelist()):
                        if re.fullmatch(pattern, name):
                            yield pd.DataFrame({"file": [file], "member": [name], "content": [archive.read(name)]})

    return files.mapInPandas(unpack, schema)


def read_cache_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256, key, value, expires_at, access_count)`` of JSON cache files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    text = F.decode("content", "UTF-8")
    get = lambda p: F.get_json_object(text, f"$.{p}")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), get("key").alias("key"), get("value").alias("value"),
        F.try_to_timestamp(get("expires_at")).alias("expires_at"), get("access_count").cast("int").alias("access_count"),
    )


# --- services -----------------------------------------------------------------------------------------------


def payload_abstracts(payloads: DataFrame, order: str | None = None) -> DataFrame:
    """``(paper_id, abstract)`` from recorded answers ``(paper_id, service, payload)`` of three services, in fixed order.

    One answer per service counts: the last by ``order``, or, of answers without one, the greatest text.
    """
    by = F.col(order) if order else F.col("payload")
    of = lambda s: F.when(F.col("service") == s, by)
    per = payloads.groupBy("paper_id").agg(*[F.max_by("payload", of(s)).alias(s) for s in ("semantic", "openindex", "registry")])
    index = F.from_json(F.get_json_object("openindex", "$.abstract_inverted_index"), "map<string,array<int>>")
    return per.select(
        "paper_id",
        first_provider(
            clean_abstract(F.get_json_object("semantic", "$.abstract")), from_inverted_index(index), from_jats(F.get_json_object("registry", "$.message.abstract"))
        ).alias("abstract"),
    )


def worklist(spark: SparkSession, events: list[str], years: tuple[int, int], volumes: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """``(event, year, volume)`` to fetch: events by years; an event with volumes only in the years that have one.

    Both sides come from a configuration.
    """
    left = spark.createDataFrame([(e,) for e in events], "event string")
    grid = left.select("event", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"))
    if not volumes:
        return grid.withColumn("volume", F.lit(None).cast("int"))
    known = spark.createDataFrame(volumes, "event string, year int, volume int")
    journals = [v[0] for v in volumes]
    return grid.join(F.broadcast(known), ["event", "year"], "left").where(~F.col("event").isin(*journals) | F.col("volume").isNotNull())


@dataclass(frozen=True)
class UrlStrategy:
    """How the pages of an event are addressed: templates of event and year, or of a volume where ``volumes`` maps years."""

    templates: tuple[str, ...] = ("https://dblp.org/db/conf/{event}/{event}{year}.html",)
    volumes: tuple[tuple[int, str], ...] = ()


def _journal(name: str, volumes: tuple[tuple[int, str], ...]) -> UrlStrategy:
    return UrlStrategy((f"https://dblp.org/db/journals/{name}/{name}{{volume}}.html",), volumes)


# Events with more than one address, and the volumes of journals by year.
STRATEGIES = {
    "asiaccs": UrlStrategy(("https://dblp.org/db/conf/asiaccs/asiaccs{year}.html", "https://dblp.org/db/conf/ccs/asiaccs{year}.html")),
    "acm_csur": _journal("csur", ((2019, "52"), (2020, "52"), (2021, "53"), (2022, "54"), (2023, "55"), (2024, "56"), (2025, "57"), (2026, "58"))),
    "ieee_comst": _journal("comsur", ((2019, "21"), (2020, "22"), (2021, "23"), (2022, "24"), (2023, "25"), (2024, "26"), (2025, "27"), (2026, "28"))),
    "fnt_privsec": _journal("ftsec", ((2019, "2"), (2020, "2"), (2022, "5"), (2023, "6"), (2024, "7"), (2025, "8"), (2026, "8"))),
}


def register_strategy(event: str, strategy: UrlStrategy) -> None:
    """Adds the addresses of an event, or replaces them."""
    STRATEGIES[event] = strategy


def page_urls(spark: SparkSession, events: list[str], years: tuple[int, int]) -> DataFrame:
    """``(event, year, url)`` of every page to fetch, in the order of its templates; a journal without a volume has none.

    Events and years come from a configuration; the strategies are joined to them as a small table.
    """
    rows = [(e, i, t, dict(s.volumes) or None) for e in events for s in [STRATEGIES.get(e, UrlStrategy())] for i, t in enumerate(s.templates)]
    table = spark.createDataFrame(rows, "event string, place int, template string, volumes map<int,string>")
    grid = table.withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    volume = F.try_element_at("volumes", F.col("year"))
    url = F.replace(F.replace("template", F.lit("{event}"), F.col("event")), F.lit("{year}"), F.col("year").cast("string"))
    url = F.when(F.col("volumes").isNull(), url).otherwise(F.replace(url, F.lit("{volume}"), volume))
    return grid.select("event", "year", "place", url.alias("url")).where("url is not null")


def listing_link(page: Column, base: str = "https://dblp.org") -> Column:
    """The first link of a page to its listing in JSON, made absolute; null for none."""
    link = F.replace(F.nullif(F.regexp_extract(page, r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*format=json[^\"']*)[\"']", 1), F.lit("")), F.lit("&amp;"), F.lit("&"))
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(base), link))


def year_windows(spark: SparkSession, since: int, until: int) -> DataFrame:
    """``(year, start, stop)`` of disjoint harvest windows, both ends inclusive."""
    years = spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until))).alias("year"))
    return years.select("year", F.format_string("%d01010000", "year").alias("start"), F.format_string("%d12312359", "year").alias("stop"))
