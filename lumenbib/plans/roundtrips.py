"""Sources, sinks, stores and the engine as queries: each writes files from the test tables and reads them back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib import config
from lumenbib.engine import Engine
from lumenbib.functions import abstracts, bibtex, derived, hashing, text
from lumenbib.operators import audit, dml, records, search, similarity
from lumenbib.plans import sql as Q
from lumenbib.plans.registry import query
from lumenbib.schema import PAPER, add_missing, conform, missing_columns, require_columns
from lumenbib.session import scratch, table
from lumenbib.sources import records as sources
from lumenbib.sources import sinks
from lumenbib.streaming import flows

#: Rows of one fixture file that is read as a whole.
FILE_ROWS = 500


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def _put(s: SparkSession, path: str, data: bytes) -> str:
    """Writes one small file through Hadoop's API."""
    place = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


# --- listing files ------------------------------------------------------------------------------------------
def _listing_files(s: SparkSession, papers: DataFrame) -> str:
    """Papers as listing files: one author is an object, several are an array."""
    names = F.split(F.coalesce("authors", F.lit("")), ", ")
    info = [F.col(c).alias(n) for c, n in (("title", "title"), ("venue", "venue"), ("pages", "pages"), ("paper_type", "type"), ("access", "access"), ("key", "key"), ("ee", "ee"), ("url", "url"))]
    hit = lambda author: F.to_json(F.struct(F.col("paper_id").alias("@id"), F.col("score").cast("string").alias("@score"), F.struct(*info, F.col("year").cast("string").alias("year"), F.struct(author.alias("author")).alias("authors")).alias("info")))
    as_text = lambda x: F.struct(x.alias("text"))
    row = F.when(F.size(names) == 1, hit(as_text(names[0]))).otherwise(hit(F.transform(names, as_text)))
    files = max(1, papers.count() // FILE_ROWS)
    bodies = papers.select(F.pmod(F.xxhash64("paper_id"), F.lit(files)).alias("part"), row.alias("hit")).groupBy("part").agg(F.array_join(F.collect_list("hit"), ",").alias("hits"))
    path = scratch(s, "listing")
    bodies.select("part", F.concat(F.lit('{"result":{"hits":{"hit":['), "hits", F.lit("]}}}")).alias("value")).write.partitionBy("part").text(path)
    return path


_NAMES = "nullif(array_to_string(list_filter(list_transform(string_split(coalesce(authors, ''), ', '), lambda x: trim(x)), lambda x: x <> ''), ', '), '')"
_TYPE = "case lower(trim(paper_type)) when 'article' then 'article' when 'conference and workshop papers' then 'article' when 'inproceedings' then 'article' when 'proceedings' then 'proceedings' when 'editorship' then 'editorship' else 'unknown' end"


@query("src_05_listing", f"select paper_id, replace(title, '&amp;', '&') as title, replace({_NAMES}, '&amp;', '&') as authors, year, {_TYPE} as paper_type, key, ee from papers where paper_id <> '' and title <> '' and year is not null")
def _(s, d):
    files = sources.read_listing_json(s, _listing_files(s, _papers(s, d)))
    return sources.listing_papers(files).select("paper_id", "title", "authors", "year", "paper_type", "key", "ee")


@query("scal_28_flat_authors", f"select paper_id, {_NAMES} as authors from papers where paper_id <> '' and title <> '' and year is not null and not contains(coalesce(authors, ''), '&')")
def _(s, d):
    files = sources.read_listing_json(s, _listing_files(s, _papers(s, d).where("not contains(coalesce(authors, ''), '&')")))
    return sources.listing_papers(files).select("paper_id", "authors")


@query("set_01_all_files", "select count(*) as n from papers where paper_id <> '' and title <> '' and year is not null")
def _(s, d):
    return sources.listing_papers(sources.read_listing_json(s, _listing_files(s, _papers(s, d)))).agg(F.count("*").alias("n"))


@query("src_06_valid_listings", "select * from (values (1), (6)) t(id)")
def _(s, d):
    given = [(1, '{"result":{"hits":{"hit":[]}}}'), (2, "no json"), (3, '{"result":null}'), (4, "[1]"), (5, '{"result":{}}'), (6, '{"result":{"hits":{}},"x":1}')]
    return sources.valid_listings(s.createDataFrame(given, "id int, t string").select("id", F.try_parse_json("t").alias("v"))).select("id")


# --- CSV ----------------------------------------------------------------------------------------------------
_HEADERS = {"paper_id": "ID", "ee": "EE", "url": "URL", "paper_type": "Type"}


def _paper_csv(s: SparkSession, papers: DataFrame) -> str:
    path = scratch(s, "papers")
    columns = ("paper_id", "score", "authors", "title", "venue", "pages", "year", "paper_type", "access", "key", "ee", "url", "event", "abstract")
    kind = F.when(F.col("paper_type") == "article", "Conference and Workshop Papers").when(F.col("paper_type") == "proceedings", "Proceedings").otherwise(F.col("paper_type"))
    sinks.write(papers.withColumn("paper_type", kind).select(*[F.col(c).alias(_HEADERS.get(c, c.capitalize())) for c in columns]), "csv", path)
    return path


@query("src_07_paper_csv", "select paper_id, title, nullif(authors, '') as authors, year, case when paper_type in ('article', 'proceedings', 'editorship') then paper_type when paper_type = 'inproceedings' then 'article' else 'unknown' end as paper_type, nullif(abstract, '') as abstract from papers where title <> '' and year is not null")
def _(s, d):
    return sources.read_paper_csv(s, _paper_csv(s, _papers(s, d))).select("paper_id", "title", "authors", "year", "paper_type", "abstract")


@query("sink_01_table_csv", "select paper_id, title, nullif(event, '') as event, nullif(abstract, '') as abstract from papers where title <> '' and year is not null")
def _(s, d):
    path = scratch(s, "table")
    sinks.write(_papers(s, d).drop("created_at", "updated_at"), "csv", path)
    return sources.read_paper_csv(s, path).select("paper_id", "title", "event", "abstract")


def _abstract_csv(s: SparkSession, d: str) -> str:
    path = scratch(s, "abstracts")
    rows = table(s, d, "abstract_log").orderBy("log_id").select(F.col("paper_id").alias("ID"), F.col("abstract").alias("Abstract"))
    sinks.write(rows, "csv", path, single_file=True)
    return path


@query("src_08_abstract_csv", "select paper_id, abstract from abstract_log where length(abstract) >= 50")
def _(s, d):
    return sources.read_abstract_csv(s, _abstract_csv(s, d)).select("paper_id", "abstract")


_STAGED = "with st as (select paper_id, arg_max(abstract, log_id) as a from abstract_log where length(abstract) >= 50 group by 1) "


@query("dml_03_import", _STAGED + "select p.paper_id, case when coalesce(p.abstract, '') = '' then coalesce(st.a, p.abstract) else p.abstract end as abstract from papers p left join st using (paper_id)")
def _(s, d):
    return dml.fill_abstracts(_papers(s, d), sources.read_abstract_csv(s, _abstract_csv(s, d)))[0].select("paper_id", "abstract")


@query("src_26_keyed_csv", "select paper_id, arg_max(status, log_id) as status from abstract_log group by 1")
def _(s, d):
    path = scratch(s, "labels")
    sinks.write(table(s, d, "abstract_log").orderBy("log_id").select("paper_id", "status"), "csv", path, single_file=True)
    return sources.read_keyed_csv(s, path)


# --- JSON lines ---------------------------------------------------------------------------------------------
@query("src_09_preprints", "select arxiv_id, title, authors[1] as first, len(authors) as n, submitted_at, doi, summary from preprints")
def _(s, d):
    path = scratch(s, "preprints")
    sinks.write_preprints(table(s, d, "preprints"), path)
    return sources.read_preprints(s, path).select("arxiv_id", "title", F.get("authors", F.lit(0)).alias("first"), F.size("authors").alias("n"), "submitted_at", "doi", "summary")


@query("sink_08_null_fields", "select count(*) as lines, count(*) as with_doi from preprints")
def _(s, d):
    path = scratch(s, "preprints")
    sinks.write_preprints(table(s, d, "preprints"), path, compressed=False)
    return s.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.contains("value", F.lit('"doi":'))).alias("with_doi"))


@query("sink_09_matches", "select paper_id, title from papers where year = 2023")
def _(s, d):
    path = scratch(s, "lines")
    sinks.write(_papers(s, d).where("year = 2023").select("paper_id", "title"), "jsonl", path)
    return s.read.schema("paper_id string, title string").json(path)


# --- XML dump -----------------------------------------------------------------------------------------------
# Letters that the fixture writes as entities.
_ENTITIES = {"ü": "uuml", "é": "eacute", "á": "aacute"}


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((k, f"&{v};") for k, v in _ENTITIES.items())):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _dump(s: SparkSession, papers: DataFrame) -> str:
    """A dump with entities, one record a line, and its proceedings; entities are replaced as when a dump is read."""
    rows = papers.where("coalesce(key, '') <> ''")
    names = F.array_join(F.transform(text.parse_authors(F.col("authors")), lambda n: F.concat(F.lit("<author>"), _xml(n), F.lit("</author>"))), "")
    field = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<{tag}>"), _xml(c), F.lit(f"</{tag}>"))).otherwise("")
    cross = F.concat(F.lit("conf/"), F.xxhash64("event").cast("string"), F.lit("/"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    line = F.concat(
        F.lit('<inproceedings key="'), _xml(F.col("key")), F.lit('">'), F.coalesce(names, F.lit("")), field("title", F.col("title")), field("pages", F.col("pages")), field("year", F.col("year").cast("string")),
        F.when(F.col("event").isNotNull(), F.concat(F.lit("<crossref>"), cross, F.lit("</crossref>"))).otherwise(""), F.lit("<ee>https://other.example/x</ee>"), field("ee", F.col("ee")), F.lit("</inproceedings>"),
    )
    books = rows.where("event is not null").select("event", cross.alias("c")).distinct().select(
        F.concat(F.lit('<proceedings key="'), "c", F.lit('">'), field("booktitle", F.col("event")), F.lit("<publisher>Press</publisher></proceedings>")).alias("value")
    )
    lines = rows.select(F.regexp_replace(line, r"[\r\n]+", " ").alias("value")).unionByName(books)
    dtd = s.createDataFrame([(f'<!ENTITY {v} "&#{ord(k)};">',) for k, v in _ENTITIES.items()], "value string")
    known = {r.name: r.value for r in sources.entity_table(dtd).collect()}
    path = scratch(s, "dump")
    files = max(1, rows.count() // FILE_ROWS)
    bodies = sources.substitute_entities(lines, known).groupBy(F.pmod(F.xxhash64("value"), F.lit(files)).alias("part")).agg(F.array_join(F.collect_list("value"), "\n").alias("body"))
    bodies.select("part", F.concat(F.lit("<dblp>\n"), "body", F.lit("\n</dblp>")).alias("value")).write.partitionBy("part").text(path)
    return path


_RECORD = """select key, trim(title) as title, len(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(x)), lambda x: x <> '')) as authors, nullif(trim(event), '') as booktitle,
 case when event is not null then 'Press' end as publisher, cast(year as varchar) as year from papers where coalesce(key, '') <> ''"""


@query("src_10_dump", _RECORD)
def _(s, d):
    path = _dump(s, _papers(s, d))
    rows = bibtex.inherit_from_proceedings(sources.read_records(s, path), sources.read_proceedings(s, path))
    return rows.select("key", "title", F.size("author").alias("authors"), "booktitle", "publisher", "year")


@query("join_09_inherited", _RECORD.replace("select key, trim(title) as title", "select key").replace("len(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(x)), lambda x: x <> '')) as authors, ", "").replace(", cast(year as varchar) as year", ""))
def _(s, d):
    path = _dump(s, _papers(s, d))
    return bibtex.inherit_from_proceedings(sources.read_records(s, path), sources.read_proceedings(s, path)).select("key", "booktitle", "publisher")


@query("join_08_wanted_keys", "select key from papers where coalesce(key, '') <> '' and coalesce(bibtex, '') = ''")
def _(s, d):
    wanted = search.lacking_entry(_papers(s, d)).select("key")
    return sources.read_records(s, _dump(s, _papers(s, d)), wanted).select("key")


@query("scal_23_links", r"select key, case when contains(ee, 'doi.org/') then ee else 'https://other.example/x' end as url, case when contains(ee, 'doi.org/') then substring(ee, strpos(ee, 'doi.org/') + 8) end as doi from papers where coalesce(key, '') <> ''")
def _(s, d):
    return sources.read_records(s, _dump(s, _papers(s, d))).select("key", "url", "doi")


@query("src_11_entities", "select * from (values ('uuml', 'ü'), ('eacute', 'é'), ('plain', 'text')) t(name, value)")
def _(s, d):
    lines = ['<!ENTITY uuml "&#252;">', "<!-- no entity -->", '<!ENTITY eacute "&#233;" >', '<!ENTITY plain "text">']
    return sources.entity_table(s.createDataFrame([(x,) for x in lines], "value string"))


@query("strm_02_substituted", "select * from (values (1, 'Müller &amp; Söhne'), (2, 'no entity'), (3, '&unknown; stays')) t(id, value)")
def _(s, d):
    lines = s.createDataFrame([("1|M&uuml;ller &amp; S&ouml;hne",), ("2|no entity",), ("3|&unknown; stays",)], "value string")
    out = sources.substitute_entities(lines, {"uuml": "ü", "ouml": "ö", "amp": "x"})
    return out.select(F.substring_index("value", "|", 1).cast("int").alias("id"), F.element_at(F.split("value", r"\|"), 2).alias("value"))


@query("dml_07_dump_entries", "select paper_id, key, coalesce(bibtex, '') <> '' or coalesce(key, '') <> '' as filled from papers")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.store.write(conform(_papers(s, d)))
    engine.bibtex("dump", _dump(s, _papers(s, d)))
    return engine.papers().select("paper_id", "key", (F.coalesce("bibtex", F.lit("")) != "").alias("filled"))


# --- archives and caches ------------------------------------------------------------------------------------
@query("src_12_archive", "select * from (values ('data/cache/a.json', 10), ('data/log/log.csv', 8)) t(member, size)")
def _(s, d):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("data/log/log.csv", "a,b\n1,2\n"), ("data/cache/a.json", '{"k": "v"}'), ("readme.txt", "none")):
            z.writestr(name, body)
    path = _put(s, f"{scratch(s, 'zip')}/evidence.zip", out.getvalue())
    return sources.zip_members(s, path, r"data/.*").select("member", F.octet_length("content").alias("size"))


def _cache_files(s: SparkSession, d: str) -> str:
    """One cache file per service, named by the digest of its key; services are few by nature."""
    path = scratch(s, "cache")
    rows = table(s, d, "service_calls").groupBy("service").agg(F.count("*").cast("string").alias("value"), F.count_if(F.col("attempts") == 0).alias("hits")).withColumn("key", F.concat("service", F.lit("_calls")))
    body = F.to_json(F.struct("key", "value", F.lit("2030-01-01 00:00:00").alias("expires_at"), F.col("hits").alias("access_count")))
    for r in rows.select(hashing.cache_path(F.col("key")).alias("file"), body.alias("body")).collect():
        _put(s, f"{path}/{r.file}", r.body.encode())
    return path


@query("src_13_cache_files", "select md5(service || '_calls') || '.json' as file, service || '_calls' as key, cast(count(*) as varchar) as value, count(*) filter (where attempts = 0) as access_count from service_calls group by service")
def _(s, d):
    return sources.read_cache_files(s, _cache_files(s, d)).select("file", "key", "value", F.col("access_count").cast("long").alias("access_count"))


@query("inf_01_cache", "select service || '_calls' as key, cast(count(*) as varchar) as value, count(*) filter (where attempts = 0) + 2 as access_count from service_calls group by service")
def _(s, d):
    cache = sources.read_cache_files(s, _cache_files(s, d))
    reads = cache.select("key", F.explode(F.array(*[F.lit(t).cast("timestamp") for t in ("2029-01-01", "2029-06-01", "2031-01-01")])).alias("at"))
    return flows.read_through(cache, reads).select("key", "value", F.col("access_count").cast("long").alias("access_count"))


@query("strm_04_unexpired", "select cache_key, count(*) as calls from service_calls where cache_key is not null and called_at + interval 30 day > timestamp '2024-06-01' group by 1")
def _(s, d):
    calls = table(s, d, "service_calls").where("cache_key is not null").select("cache_key", (F.col("called_at") + F.expr("interval 30 days")).cast("timestamp").alias("expires_at"))
    return flows.unexpired(calls, "2024-06-01 00:00:00").groupBy("cache_key").agg(F.count("*").alias("calls"))


@query("hash_05_fingerprints", "select count(distinct service) as files, count(distinct service) as fingerprints from service_calls")
def _(s, d):
    files = s.read.format("binaryFile").load(_cache_files(s, d))
    prints = hashing.file_fingerprint(files).select("path", F.rlike("fingerprint", F.lit(r"^\d+-\d+$")).alias("ok"))
    return prints.agg(F.count("*").alias("files"), F.count_if("ok").alias("fingerprints"))


# --- pages and payloads -------------------------------------------------------------------------------------
def _html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages(papers: DataFrame) -> DataFrame:
    """``(paper_id, extractor, html)``: each abstract in the layout of one of three publishers, by the last digit of the id."""
    body, digit = _html(F.col("abstract")), F.right("paper_id", F.lit(1)).cast("int")
    layouts = {
        "acm": ("<html><p>Menu<div id='abstract'>Abstract: ", "</div></html>"),
        "usenix": ("<html><body><div class='x field-name-field-paper-description y'><p>", "</p></div></body></html>"),
        "ndss": ("<div class='paper-data'><p>Authors here<p>", "</p></div><script>if (a < 'b</p>') {}</script>"),
    }
    which = F.element_at(F.array(*map(F.lit, layouts)), digit % 3 + 1)
    page = F.lit(None).cast("string")
    for name, (before, after) in layouts.items():
        page = F.when(which == name, F.concat(F.lit(before), body, F.lit(after))).otherwise(page)
    return papers.where("abstract is not null").select("paper_id", which.alias("extractor"), page.alias("html"))


_CLEAN = Q.COLLAPSE.format("regexp_replace({})")


def _cleaned(x: str) -> str:
    """The cleaning rules in SQL, for texts without leading author lists."""
    out = f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
    out = Q.COLLAPSE.format(out)
    out = f"regexp_replace({out}, '(?i)USENIX is committed to Open Access.*', '')"
    return f"nullif({Q.COLLAPSE.format(f'regexp_replace({out}, ' + chr(39) + r'(?i)^Abstract\s*[:?\-]?\s*' + chr(39) + ', ' + chr(39) * 2 + ')')}, '')"


_PLAIN = "not contains(abstract, '&') and not contains(abstract, '<')"


@query("src_15_pages", f"select paper_id, {_cleaned('abstract')} as abstract from papers where {_PLAIN} and length(regexp_replace({Q.COLLAPSE.format('abstract')}, '(?i)^Abstract\\s*[:?\\-]?\\s*', '')) >= 100")
def _(s, d):
    pages = _pages(_papers(s, d).where(_PLAIN))
    return pages.select("paper_id", abstracts.abstract_of_page(F.col("html"), F.col("extractor")).alias("abstract")).where("abstract is not null")


@query("udf_03_extractors", "select paper_id, length(trim(title)) >= 100 as long from papers where title is not null and not contains(title, '&') and not contains(title, '<')")
def _(s, d):
    abstracts.register_places("house", [abstracts.Place("article", "class", "summary", exact=True, paragraphs=False)])
    rows = _papers(s, d).where("title is not null and not contains(title, '&') and not contains(title, '<')")
    page = F.concat(F.lit("<article class='summary'>"), "title", F.lit("</article>"))
    return rows.select("paper_id", abstracts.abstract_of_page(page, F.lit("house")).isNotNull().alias("long"))


@query("api_11_page_check", f"select extractor, count(*) as pages, count(*) filter (where length(regexp_replace({Q.COLLAPSE.format('abstract')}, '(?i)^Abstract\\s*[:?\\-]?\\s*', '')) >= 100) as extracted from (select *, ['acm', 'usenix', 'ndss'][cast(right(paper_id, 1) as int) % 3 + 1] as extractor from papers where {_PLAIN}) group by 1")
def _(s, d):
    pages = _pages(_papers(s, d).where(_PLAIN))
    got = abstracts.abstract_of_page(F.col("html"), F.col("extractor"))
    return pages.groupBy("extractor").agg(F.count("*").alias("pages"), F.count(got).alias("extracted"))


def _words_index(papers: DataFrame) -> DataFrame:
    """``(paper_id, index)``: each abstract as a map of words to their places."""
    words = papers.select("paper_id", F.posexplode(F.split(F.trim(text.collapse(F.col("abstract"))), " ")).alias("p", "w"))
    per = words.groupBy("paper_id", "w").agg(F.collect_list("p").alias("ps"))
    return per.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))


@query("scal_20_inverted_index", f"select paper_id, {Q.COLLAPSE.format('abstract')} as abstract from papers where length({Q.COLLAPSE.format('abstract')}) >= 100")
def _(s, d):
    index = _words_index(_papers(s, d).where("trim(abstract) <> ''"))
    return index.select("paper_id", abstracts.from_inverted_index(F.col("index")).alias("abstract")).where("abstract is not null")


@query("src_17_open_index", f"select paper_id, {Q.COLLAPSE.format('abstract')} as abstract from papers where length({Q.COLLAPSE.format('abstract')}) >= 100")
def _(s, d):
    index = _words_index(_papers(s, d).where("trim(abstract) <> ''"))
    payloads = index.select("paper_id", F.lit("openindex").alias("service"), F.to_json(F.struct(F.col("index").alias("abstract_inverted_index"))).alias("payload"))
    return sources.payload_abstracts(payloads).where("abstract is not null")


@query("src_16_semantic", f"select paper_id, {_cleaned('abstract')} as abstract from papers where {_PLAIN} and {_cleaned('abstract')} is not null")
def _(s, d):
    payloads = _papers(s, d).where(_PLAIN).select("paper_id", F.lit("semantic").alias("service"), F.to_json(F.struct("abstract")).alias("payload"))
    return sources.payload_abstracts(payloads).where("abstract is not null")


_TAGGED = f"{Q.COLLAPSE.format('replace(replace(abstract, chr(60), chr(32)), chr(62), chr(32))')}"


def _jats(papers: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.col("abstract"), "[<>]", " ")
    return papers.where("abstract is not null").select("paper_id", F.concat(F.lit("<jats:title>Abstract\n</jats:title><jats:p>H<jats:sub>2</jats:sub>O: "), plain, F.lit("</jats:p>")).alias("tagged"))


@query("scal_21_tags", f"select paper_id, trim('H2O: ' || {_TAGGED}) as abstract from papers where abstract is not null and length(trim('H2O: ' || {_TAGGED})) >= 100")
def _(s, d):
    return _jats(_papers(s, d)).select("paper_id", abstracts.from_jats(F.col("tagged")).alias("abstract")).where("abstract is not null")


@query("src_18_registry", f"select paper_id, trim('H2O: ' || {_TAGGED}) as abstract from papers where abstract is not null and length(trim('H2O: ' || {_TAGGED})) >= 100")
def _(s, d):
    payload = F.to_json(F.struct(F.struct(F.col("tagged").alias("abstract")).alias("message")))
    return sources.payload_abstracts(_jats(_papers(s, d)).select("paper_id", F.lit("registry").alias("service"), payload.alias("payload"))).where("abstract is not null")


@query("scal_22_first_provider", f"select paper_id, case when right(paper_id, 1) in ('0', '1', '2') then 'semantic' else 'registry' end as provider from papers where {_PLAIN} and length({Q.COLLAPSE.format('abstract')}) >= 100")
def _(s, d):
    rows = _papers(s, d).where(_PLAIN).where(F.length(text.collapse(F.col("abstract"))) >= 100)
    semantic = rows.where("right(paper_id, 1) in ('0', '1', '2')").select("paper_id", F.lit("semantic").alias("service"), F.lit('{"abstract": "from the first service"}').alias("payload"))
    registry = rows.select("paper_id", F.lit("registry").alias("service"), F.to_json(F.struct(F.struct("abstract").alias("message"))).alias("payload"))
    got = sources.payload_abstracts(semantic.unionByName(registry))
    return got.select("paper_id", F.when(F.col("abstract") == "from the first service", "semantic").otherwise("registry").alias("provider"))


@query("scal_13_cleaned", f"select paper_id, {_cleaned('abstract')} as abstract from papers where {_PLAIN}")
def _(s, d):
    return _papers(s, d).where(_PLAIN).select("paper_id", abstracts.clean_abstract(F.col("abstract")).alias("abstract"))


@query("scal_14_author_lists", f"select paper_id, {Q.COLLAPSE.format('abstract')} as abstract from papers where {_PLAIN} and not contains(abstract, '(') and length({Q.COLLAPSE.format('abstract')}) >= 100")
def _(s, d):
    rows = _papers(s, d).where(_PLAIN).where("not contains(abstract, '(')").select("paper_id", text.collapse(F.col("abstract")).alias("a")).where("length(a) >= 100")
    return rows.select("paper_id", abstracts.strip_author_blocks(F.concat(F.lit("Ann Lee (Uni A), Bo Chi (Lab B); Cy D'Or (C Ltd.) "), "a")).alias("abstract"))


@query("scal_17_label", r"select paper_id, regexp_replace('ABSTRACT: ' || abstract, '(?i)^Abstract\s*[:?\-]?\s*', '') as abstract from papers where abstract is not null")
def _(s, d):
    return _papers(s, d).where("abstract is not null").select("paper_id", abstracts.strip_label(F.concat(F.lit("ABSTRACT: "), "abstract")).alias("abstract"))


_SCRIPT = r"regexp_replace(abstract, '[\\\x00-\x1f]', ' ', 'g')"


@query("scal_15_script_text", f"select paper_id, {Q.COLLAPSE.format(_SCRIPT)} as abstract from papers where abstract <> ''")
def _(s, d):
    plain = F.regexp_replace("abstract", r"[\\\x00-\x1f]", " ")
    page = F.concat(F.lit('<script>x = {"abstract" : "'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('", "n": 1}</script>'))
    return _papers(s, d).where("abstract <> ''").select("paper_id", abstracts.from_page_script(page).alias("abstract"))


@query("scal_16_script_object", "select paper_id, title as abstract from papers where title is not null and not contains(title, '};')")
def _(s, d):
    body = F.to_json(F.struct(F.lit("").alias("abstract_hint"), F.col("title").alias("abstractText")))
    page = F.concat(F.lit("xplGlobal.document.metadata="), F.replace(body, F.lit("abstractText"), F.lit("abs\\u0074ract")), F.lit(";"))
    return _papers(s, d).where("title is not null and not contains(title, '};')").select("paper_id", abstracts.from_page_script(page).alias("abstract"))


# --- addresses, configuration -------------------------------------------------------------------------------
@query("src_21_listing_link", "select paper_id, 'https://dblp.org/search?q=' || paper_id || '&format=json' as link from papers")
def _(s, d):
    page = F.concat(F.lit('<a href="/x">no</a><A class="b" HREF=\'/search?q='), "paper_id", F.lit("&amp;format=json'>JSON</a><a href='/later?format=json'>"))
    return _papers(s, d).select("paper_id", sources.listing_link(page).alias("link"))


_URLS = """
with e as (select unnest(['ccs', 'asiaccs', 'acm_csur', 'fnt_privsec']) as event), y as (select unnest(range(2019, 2027)) as year),
v(event, year, path) as (values ('acm_csur', 2019, 'csur/csur52'), ('acm_csur', 2020, 'csur/csur52'), ('acm_csur', 2021, 'csur/csur53'), ('acm_csur', 2022, 'csur/csur54'), ('acm_csur', 2023, 'csur/csur55'), ('acm_csur', 2024, 'csur/csur56'), ('acm_csur', 2025, 'csur/csur57'), ('acm_csur', 2026, 'csur/csur58'),
 ('fnt_privsec', 2019, 'ftsec/ftsec2'), ('fnt_privsec', 2020, 'ftsec/ftsec2'), ('fnt_privsec', 2022, 'ftsec/ftsec5'), ('fnt_privsec', 2023, 'ftsec/ftsec6'), ('fnt_privsec', 2024, 'ftsec/ftsec7'), ('fnt_privsec', 2025, 'ftsec/ftsec8'), ('fnt_privsec', 2026, 'ftsec/ftsec8'))
select e.event, cast(y.year as int) as year, 0 as place, 'https://dblp.org/db/conf/ccs/ccs' || y.year || '.html' as url from e, y where e.event = 'ccs'
union all select e.event, cast(y.year as int), 0, 'https://dblp.org/db/conf/asiaccs/asiaccs' || y.year || '.html' from e, y where e.event = 'asiaccs'
union all select e.event, cast(y.year as int), 1, 'https://dblp.org/db/conf/ccs/asiaccs' || y.year || '.html' from e, y where e.event = 'asiaccs'
union all select event, year, 0, 'https://dblp.org/db/journals/' || path || '.html' from v
"""


@query("src_22_urls", _URLS)
def _(s, d):
    return sources.page_urls(s, ["ccs", "asiaccs", "acm_csur", "fnt_privsec"], (2019, 2026))


@query("udf_02_strategies", "select 'house' as event, cast(y as int) as year, 'https://house.example/' || y as url from range(2020, 2023) t(y)")
def _(s, d):
    sources.register_strategy("house", sources.UrlStrategy(("https://house.example/{year}",)))
    return sources.page_urls(s, ["house"], (2020, 2022)).select("event", "year", "url")


@query("src_23_configuration", "select * from (values ('ccs', 2020), ('ccs', 2021), ('ndss', 2020), ('ndss', 2021)) t(event, year)")
def _(s, d):
    path = f"{scratch(s, 'config')}/config.json"
    config.save(s, config.Configuration(events=("ccs", "ndss"), year_start=2020, year_end=2021), path)
    c = config.load(s, path)
    return sources.worklist(s, list(c.events), (min(c.years()), max(c.years()))).select("event", "year")


@query("scal_37_years", "select cast(y as int) as year from range(2019, 2027) t(y)")
def _(s, d):
    years = config.Configuration(year_start=2019, year_end=None).years(now=2026)
    return s.createDataFrame([(y,) for y in years], "year int")


# --- sinks --------------------------------------------------------------------------------------------------
@query("sink_02_result_csv", "select paper_id, title, year from papers where contains(lower(title), 'fuzzing') and title <> '' and year is not null")
def _(s, d):
    path = scratch(s, "result")
    sinks.write(search.search(_papers(s, d), search.SearchFilters(title="fuzzing")).drop("created_at", "updated_at"), "csv", path)
    return sources.read_paper_csv(s, path).select("paper_id", "title", "year")


@query("sink_03_json_array", "select paper_id, title, year, event from papers")
def _(s, d):
    path = scratch(s, "array")
    sinks.write_json_array(_papers(s, d).select("paper_id", "title", "year", "event"), path, ["paper_id"])
    return s.read.schema("paper_id string, title string, year int, event string").option("multiLine", True).json(path)


@query("sink_04_entries", "select bibtex from papers where coalesce(bibtex, '') <> ''")
def _(s, d):
    path = scratch(s, "entries")
    sinks.write(_papers(s, d), "bibtex", path)
    return s.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("bibtex"))


_EXPORTED = f"select paper_id, title, {Q.CLASS} as paper_class, {Q.DOI} as doi, " + r"nullif(regexp_extract(bibtex, '@\w+\{([^,\s]+)\s*,', 1), '') as cite_key from papers"


@query("sink_05_page_export", _EXPORTED)
def _(s, d):
    path = scratch(s, "export")
    sinks.export_rows_as(_papers(s, d), "json", path)
    return s.read.schema("paper_id string, title string, paper_class string, doi string, cite_key string").json(path)


@query("sink_06_dataset", "select paper_id, title, abstract, created_at from papers")
def _(s, d):
    path = scratch(s, "dataset")
    sinks.write(_papers(s, d), "parquet", path)
    return s.read.parquet(path).select("paper_id", "title", "abstract", "created_at")


@query("sink_10_download_log", "select nullif(event, '') as \"Event\", cast(year as varchar) as \"Year\", 'SUCCESS' as \"Status\" from papers where event is not null and year is not null group by event, year")
def _(s, d):
    path = scratch(s, "log")
    rows = _papers(s, d).where("event is not null and year is not null").groupBy("event", "year").agg(F.count("*").alias("n"))
    sinks.write_download_log(rows.select("event", "year", F.lit("x.json").alias("file_name"), F.lit("u").alias("url"), F.lit(200).alias("http_code"), F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("message"), F.lit("2026-01-01T00:00:00").alias("timestamp")), path)
    return s.read.option("header", True).csv(path).select("Event", "Year", "Status")


@query("sink_11_audit", "select paper_id, nullif(event, '') as event from papers where event is not null")
def _(s, d):
    path = scratch(s, "audit")
    sinks.write_audit(_papers(s, d).where("event is not null").select("paper_id", "event"), path, ["paper_id"])
    return s.read.option("header", True).csv(path)


@query("sink_14_summary", "select count(*) as papers, count(distinct event) as events from papers")
def _(s, d):
    path = scratch(s, "summary")
    row = _papers(s, d).agg(F.count("*").alias("papers"), F.count_distinct("event").alias("events")).first()
    sinks.write_summary(row.asDict(), path, s)
    return s.read.schema("papers bigint, events bigint").option("multiLine", True).json(path)


@query("sink_12_manifest", "select count(distinct service) as files, 64 as digest_length from service_calls")
def _(s, d):
    files = sources.read_cache_files(s, _cache_files(s, d))
    rows = files.select(F.lit("cache").alias("role"), F.col("file").alias("path"), "bytes", "sha256")
    return rows.agg(F.count("*").alias("files")).join(F.broadcast(hashing.manifest_digest(rows).select(F.length("digest").alias("digest_length"))))


# --- stores and the engine ----------------------------------------------------------------------------------
def _store(s: SparkSession) -> dml.VersionedStore:
    return dml.VersionedStore(s, scratch(s, "store"), key="paper_id")


@query("src_03_snapshot", "select paper_id, title, abstract from papers")
def _(s, d):
    own, published = _store(s), _store(s)
    published.write(conform(_papers(s, d)), compression="gzip")
    own.bootstrap(published)
    return own.read().select("paper_id", "title", "abstract")


@query("sink_07_compressed_snapshot", "select paper_id, coalesce(abstract, '') <> '' as has_abstract from papers")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.store.write(conform(_papers(s, d)))
    copy = scratch(s, "snapshot")
    engine.snapshot(copy)
    return Engine(s, copy).papers().select("paper_id", (F.coalesce("abstract", F.lit("")) != "").alias("has_abstract"))


@query("src_04_guard", "select * from (values ('empty', true), ('filled', false), ('missing', true)) t(state, refused)")
def _(s, d):
    empty, filled = _store(s), _store(s)
    empty.write(conform(_papers(s, d)).limit(0))
    filled.write(conform(_papers(s, d)))
    rows = []
    for state, store in (("missing", _store(s)), ("empty", empty), ("filled", filled)):
        try:
            store.require()
            rows.append((state, False))
        except dml.CorpusNotFoundError:
            rows.append((state, True))
    return s.createDataFrame(rows, "state string, refused boolean")


@query("src_14_required_columns", "select * from (values ('paper_id', false), ('nothing', true)) t(name, missing)")
def _(s, d):
    rows = []
    for name in ("paper_id", "nothing"):
        try:
            require_columns(_papers(s, d), [name])
            rows.append((name, False))
        except ValueError:
            rows.append((name, bool(missing_columns(_papers(s, d), [name]))))
    return s.createDataFrame(rows, "name string, missing boolean")


@query("sort_04_audit_order", "select row_number() over (order by coalesce(key, ''), paper_id) as place, paper_id from papers")
def _(s, d):
    return audit.in_audit_order(_papers(s, d)).select("place", "paper_id")


@query("dml_09_refresh", "select * from (values (1, 'adopted'), (2, 'in_sync'), (3, 'refresh'), (4, 'in_sync'), (5, 'conflict')) t(step, decision)")
def _(s, d):
    p, steps = conform(_papers(s, d)), []
    engine, published = Engine(s, scratch(s, "corpus")), _store(s)
    published.write(p)
    engine.store.write(p)
    steps += [engine.refresh_if_due(published.root), engine.refresh_if_due(published.root)]
    published.write(p.where("year is not null"))
    steps += [engine.refresh_if_due(published.root), engine.refresh_if_due(published.root)]
    published.write(p)
    engine.store.write(p)
    steps.append(engine.refresh_if_due(published.root))
    return s.createDataFrame(list(enumerate(steps, 1)), "step int, decision string")


@query("dml_10_snapshot_refresh", "select count(*) as n from papers where year >= 2020")
def _(s, d):
    engine, copy = Engine(s, scratch(s, "corpus")), scratch(s, "copy")
    engine.store.write(conform(_papers(s, d)).where("year >= 2020"))
    engine.snapshot(copy)
    engine.store.write(conform(_papers(s, d)))
    engine.refresh(copy)
    return engine.papers().agg(F.count("*").alias("n"))


@query("dml_11_bootstrap", "select paper_id, title from papers where title <> '' and year is not null")
def _(s, d):
    engine, path = Engine(s, scratch(s, "corpus")), _paper_csv(s, _papers(s, d))
    if not engine.bootstrap(path) or engine.bootstrap(path):
        raise RuntimeError("a corpus is loaded once")
    return engine.papers().select("paper_id", "title")


@query("dml_12_layout", "select paper_id, year from papers where year between 2019 and 2021")
def _(s, d):
    store = dml.VersionedStore(s, scratch(s, "store"))
    store.write(conform(_papers(s, d)), partition_by=["year"])
    return store.read().where("year between 2019 and 2021").select("paper_id", F.col("year").cast("int").alias("year"))


@query("dml_08_added_column", "select paper_id, cast(null as varchar) as note, bibtex from papers")
def _(s, d):
    return add_missing(_papers(s, d), {"note": "string", "bibtex": "string"}).select("paper_id", "note", "bibtex")


@query("proj_13_rows", "select paper_id, score, authors, title, venue, pages, year, paper_type, access, key, ee, url, event, abstract from papers")
def _(s, d):
    from lumenbib.schema import UPSERT_COLUMNS

    return conform(_papers(s, d)).select(*UPSERT_COLUMNS)


@query("dml_05_entries_by_id", "select paper_id, '@misc{' || paper_id || ', title = {' || coalesce(title, '') || '}}' as bibtex from papers")
def _(s, d):
    new = _papers(s, d).select("paper_id", F.concat(F.lit("@misc{"), "paper_id", F.lit(", title = {"), F.coalesce("title", F.lit("")), F.lit("}}")).alias("bibtex"))
    return dml.update_column(_papers(s, d), new, "bibtex").select("paper_id", "bibtex")


_RECORDED = "case when right(paper_id, 1) in ('0', '1', '2') then '@misc{' || key || ', AUTHOR = {x}, Title = {y}, YEAR = {1}}' else 'not found' end"


@query("join_14_by_key", f"select paper_id, case when right(paper_id, 1) in ('0', '1', '2') and coalesce(key, '') <> '' then {_RECORDED} else bibtex end as bibtex from papers")
def _(s, d):
    answers = _papers(s, d).where("coalesce(key, '') <> ''").select("key", F.expr(_RECORDED).alias("bibtex"))
    return dml.update_column(_papers(s, d), answers.where(bibtex.is_valid_entry(F.col("bibtex"))), "bibtex", on="key").select("paper_id", "bibtex")


@query("src_19_recorded_answers", f"select paper_id, case when right(paper_id, 1) in ('0', '1', '2') and coalesce(key, '') <> '' then {_RECORDED} else bibtex end as bibtex from papers")
def _(s, d):
    engine, path = Engine(s, scratch(s, "corpus")), scratch(s, "answers")
    engine.store.write(conform(_papers(s, d)))
    _papers(s, d).where("coalesce(key, '') <> ''").select("key", F.expr(_RECORDED).alias("bibtex")).write.parquet(path)
    engine.bibtex("recorded", path)
    return engine.papers().select("paper_id", "bibtex")


@query("scal_25_valid_entry", "select paper_id, right(paper_id, 1) in ('0', '1', '2') and coalesce(key, '') <> '' as valid from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", bibtex.is_valid_entry(F.expr(_RECORDED)).alias("valid"))


@query("api_03_entries", "select paper_id, case when coalesce(p.bibtex, '') = '' then coalesce(e.entry, p.bibtex) else p.bibtex end as bibtex from papers p join (" + Q.ENTRY + ") e using (paper_id)")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.store.write(conform(_papers(s, d)))
    engine.bibtex()
    return engine.papers().select("paper_id", "bibtex")


@query("api_02_run_all", f"select count(*) as total, count(*) filter (where paper_type <> 'editorship' and {_PLAIN} and {_cleaned('abstract')} is not null and length({_cleaned('abstract')}) >= 50) as with_abstract from papers where paper_type <> 'editorship' and title <> '' and year is not null")
def _(s, d):
    p = _papers(s, d)
    payloads = p.where(_PLAIN).select("paper_id", F.lit("semantic").alias("service"), F.to_json(F.struct("abstract")).alias("payload"))
    return Engine(s, scratch(s, "corpus")).run_all(_listing_files(s, p), payloads).select("total", "with_abstract")


@query("api_04_search", "select paper_id, year from papers where contains(lower(coalesce(title, '')), 'towards') and year = 2023")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.store.write(conform(_papers(s, d)))
    return engine.search(search.SearchFilters(title="towards", year=2023), limit=None).select("paper_id", "year")


@query("api_05_export", "select bibtex from papers where coalesce(bibtex, '') <> '' and event = 'CIPHER Conf'")
def _(s, d):
    engine, path = Engine(s, scratch(s, "corpus")), scratch(s, "export")
    engine.store.write(conform(_papers(s, d)))
    engine.export(engine.search(search.SearchFilters(event="CIPHER Conf"), limit=None), "bibtex", path)
    return s.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("bibtex"))


@query("api_06_stats", "select event, count(*) as total, count(*) filter (where coalesce(abstract, '') <> '') as with_abstract from papers group by 1")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.store.write(conform(_papers(s, d)))
    return engine.stats()["by_event"].select("event", "total", "with_abstract")


@query("api_07_import", "select paper_id, title, nullif(abstract, '') as abstract from papers where title <> '' and year is not null")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.import_csv(_paper_csv(s, _papers(s, d)))
    return engine.papers().select("paper_id", "title", "abstract")


@query("api_08_snapshot", "select count(*) as n, count(distinct event) as events from papers")
def _(s, d):
    engine, copy = Engine(s, scratch(s, "corpus")), scratch(s, "copy")
    engine.store.write(conform(_papers(s, d)))
    engine.snapshot(copy)
    return Engine(s, copy).papers().agg(F.count("*").alias("n"), F.count_distinct("event").alias("events"))


@query("api_10_facade", "select paper_id, title from papers where title <> '' and year is not null and paper_type <> 'editorship'")
def _(s, d):
    engine = Engine(s, scratch(s, "corpus"))
    engine.ingest(_listing_files(s, _papers(s, d).where("not contains(title, '&')")))
    engine.ingest(_listing_files(s, _papers(s, d)))
    return engine.papers().select("paper_id", F.replace("title", F.lit("&"), F.lit("&")).alias("title"))


@query("api_01_engine", "select count(*) as n from papers")
def _(s, d):
    root = scratch(s, "corpus")
    Engine(s, root).store.write(conform(_papers(s, d)))
    return Engine(s, root).papers().agg(F.count("*").alias("n"))


@query("strm_01_ingest", "select paper_id, title, abstract from papers")
def _(s, d):
    landing, store = scratch(s, "landing"), _store(s)
    p = conform(_papers(s, d))
    p.withColumn("title", F.lit("old")).write.parquet(landing)
    flows.ingest(s, landing, store, scratch(s, "progress")).awaitTermination()
    p.write.mode("append").parquet(landing)
    flows.ingest(s, landing, store, scratch(s, "again")).awaitTermination()
    return store.read().select("paper_id", "title", "abstract")


@query("strm_03_resumed", "select paper_id, upper(title) as title from papers")
def _(s, d):
    landing, progress, store = scratch(s, "landing"), scratch(s, "progress"), _store(s)
    p = conform(_papers(s, d))
    p.write.parquet(landing)
    flows.ingest(s, landing, store, progress).awaitTermination()
    p.withColumn("title", F.upper("title")).write.mode("append").parquet(landing)
    flows.ingest(s, landing, store, progress).awaitTermination()
    return store.read().select("paper_id", "title")


@query("udf_04_per_batch", "select count(*) as n, count(*) as seen from papers")
def _(s, d):
    landing, store, seen = scratch(s, "landing"), _store(s), []
    conform(_papers(s, d)).write.parquet(landing)
    flows.ingest(s, landing, store, scratch(s, "progress"), on_batch=lambda batch, number: seen.append(batch.count())).awaitTermination()
    return store.read().agg(F.count("*").alias("n"), F.lit(sum(seen)).cast("long").alias("seen"))


@query("inf_02_checkpoints", "select phase, id from (select 'extract' as phase, unnest(range(3, 8)) as id union all select 'match', unnest(range(0, 2))) t")
def _(s, d):
    rows = s.range(8).select(F.lit("extract").alias("phase"), "id").unionByName(s.range(2).select(F.lit("match").alias("phase"), "id"))
    return records.newest(rows, "phase", "id", 5)


@query("udf_01_rules", "select paper_id, case when contains(lower(venue), 'sent') then 'House of Watch' end as event from papers where contains(lower(venue), 'sent') and not regexp_matches(lower(venue), 'asiaccs|asia[ -]?ccs|euro.?s.?p|ndss|usenix|hotnets|sacmat')")
def _(s, d):
    rows = _papers(s, d).where("contains(lower(venue), 'sent') and not lower(venue) rlike 'asiaccs|asia[ -]?ccs|euro.?s.?p|ndss|usenix|hotnets|sacmat'")
    with text.event_rules([("sent", "House of Watch")]):
        return rows.select("paper_id", text.normalize_event(F.col("venue")).alias("event"))
