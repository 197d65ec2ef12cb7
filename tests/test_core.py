import gzip
import json
import random
import statistics
import zipfile
from datetime import datetime
from fractions import Fraction
from math import comb, exp, fsum, lgamma, log, log1p

import pytest
from pyspark.sql import functions as F

from lumenbib.engine import Engine
from lumenbib.functions import abstracts, bibtex, derived, hashing, stats, text
from lumenbib.operators import aggregates, audit, dml, graph, readiness, records, sampling, search, similarity
from lumenbib.plans import catalog
from lumenbib.schema import PAPER, missing_columns, split_valid_years
from lumenbib.sources import records as sources
from lumenbib.sources import sinks
from lumenbib.streaming import flows


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


def papers(spark, *given):
    return spark.createDataFrame([tuple(g.get(f.name) for f in PAPER) for g in given], PAPER)


# --- scalar rules -------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("name", "normal", "key", "strict"),
    [
        ("José García 0001", "jose garcia", "garcia j", "jose garcia"), ("O'Connor", "o'connor", "o'connor", ""), ("Ｊ. Ｒ. Müller", "j r muller", "muller j", ""), ("", "", "", ""),
        ("Bob 0001", "bob", "bob", ""), (None, None, None, None),
    ],
)
def test_author_rules(spark, name, normal, key, strict):
    assert one(spark, name, text.normalize_author) == normal
    assert one(spark, name, lambda c: text.author_key(text.normalize_author(c))) == key
    if name is not None:
        assert one(spark, name, lambda c: text.strict_author_key(text.normalize_author(c))) == strict


def test_title_rules(spark):
    assert sorted(one(spark, "A Study of the ﬁne Réseau: X-Ray!", text.title_tokens)) == ["fine", "ray", "reseau"]
    assert one(spark, "the of a", text.title_tokens) == []
    assert one(spark, "…", text.token_set) is None
    pair = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "x array<string>, y array<string>, z array<string>")
    assert pair.select(text.jaccard(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1 / 3)
    assert pair.select(text.jaccard(F.col("x"), F.col("z"))).first()[0] == 0.0
    assert one(spark, "Straße & ＡＢ_c", text.identity) == "strasse ab c"
    assert one(spark, "a &amp; b &uuml;", text.unescape_entities) == "a & b ü"


def test_lag_floors(spark):
    df = spark.createDataFrame([("2023-08-01T12:00:00+00:00", 2023), ("2023-06-01T00:00:00Z", 2023)], "s string, y int")
    assert [r[0] for r in df.select(text.lag_days(F.col("s"), F.col("y"), 8)).collect()] == [-1, 61]


@pytest.mark.parametrize(("venue", "event"), [("CCS", "ACM CCS"), ("AsiaCCS", "ACM ASIA CCS"), ("EuroS&amp;P", "IEEE EURO S&P"), ("IEEE Symposium on Security and Privacy", "IEEE S&P"), ("Other", "Other"), ("", ""), (None, None)])
def test_events(spark, venue, event):
    assert one(spark, venue, text.normalize_event) == event


def test_projections(spark):
    assert one(spark, "https://doi.org/10.1/a/doi.org/b", derived.doi) == "10.1/a/doi.org/b"
    assert one(spark, "10.1/x", derived.doi) == "10.1/x" and one(spark, "http://x", derived.doi) is None
    assert one(spark, "see 10.1234/AbC).", derived.doi_anywhere) == "10.1234/abc"
    assert one(spark, "https://doi.org/10.1/x//", derived.doi_of_url) == "10.1/x"
    assert one(spark, " , B", derived.first_author) is None
    assert one(spark, "@inproceedings{DBLP:conf/x/Y, a", derived.cite_command) == "\\cite{DBLP:conf/x/Y}"
    assert one(spark, "w " * 200, derived.preview).endswith("w…") and one(spark, None, derived.preview) == "—"
    classes = [("SoK: A Survey", ""), ("A Literature Review", ""), ("Poster: X", ""), ("X Workshop", ""), ("A short paper", ""), ("Q", "ACM Computing Surveys"), ("Q", None)]
    df = spark.createDataFrame(classes, "t string, e string").select(derived.paper_class(F.col("t"), F.col("e")).alias("c"))
    assert [r.c for r in df.collect()] == ["SoK", "Survey", "Poster", "Workshop", "Short", "Journal", "Article"]


def test_entries(spark):
    p = papers(spark, {"paper_id": "1", "key": "conf/x/A", "authors": "Ann B, Cy D", "title": "On X.", "event": "Conf", "pages": "1-9", "year": 2020, "ee": "https://doi.org/10.1/x", "paper_type": "article"}, {"paper_id": "2", "year": 2020})
    got = {r.paper_id: r.e for r in p.select("paper_id", bibtex.entry_of_paper().alias("e")).collect()}
    assert got["2"] is None
    assert got["1"].startswith("@inproceedings{DBLP:conf/x/A,\n  author       = {Ann B and\n                  Cy D},\n  title        = {On X},\n") and "{1--9}" in got["1"] and not got["1"].endswith(",\n}")
    assert one(spark, got["1"], bibtex.is_valid_entry) and not one(spark, "x", bibtex.is_valid_entry)


BODY = "This body is long enough to be taken for an abstract because it has more than one hundred characters in it."


def test_abstract_rules(spark):
    assert abstracts.without_author_blocks(f"Ann B (Uni A), Cy D (Uni B), Ed F (Uni C) {BODY}") == BODY
    ics = "Industrial Control Systems (ICS), consisting of parts, " + BODY
    assert abstracts.without_author_blocks(ics) == ics
    assert one(spark, "Abstract: " + BODY.replace(" ", "  ") + " USENIX is committed to Open Access to it", abstracts.clean_abstract) == BODY
    words = BODY.split()
    index = {}
    for i, w in enumerate(words):
        index.setdefault(w, []).append(i)
    df = spark.createDataFrame([(index,), ({"a": [3]},)], "v map<string,array<int>>")
    assert [r[0] for r in df.select(abstracts.from_inverted_index(F.col("v"))).collect()] == [BODY, None]
    assert one(spark, f"<jats:title>T</jats:title><jats:p>{BODY}</jats:p>", abstracts.from_jats) == BODY
    page = f'<html><p>un<p>closed<div class="abstract x"><p>{BODY}</p></div><script>var x = "</p>";</script>'
    assert abstracts.page_abstract(page, "ndss") == BODY and abstracts.page_abstract("<p>", "acm") is None
    script = 'xplGlobal.document.metadata={"abstract":"' + BODY + '"};'
    df = spark.createDataFrame([(page, "ndss"), (script, "ieee"), (None, "acm")], "h string, e string")
    assert [r[0] for r in df.select(abstracts.abstract_of_page(F.col("h"), F.col("e"))).collect()] == [BODY, BODY, None]


def test_quantiles_and_intervals(spark):
    rng = random.Random(1)
    for n in (2, 3, 57, 200):
        values = [rng.randrange(1000) for _ in range(n)]
        want = statistics.quantiles(values, n=100)
        row = similarity.small_quantiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
        assert [row.p25, row.p50, row.p75, row.p90] == [want[24], want[49], want[74], want[89]]
        matches = spark.createDataFrame([(str(i), "x", 1.0, v) for i, v in enumerate(values)], "paper_id string, arxiv_id string, title_similarity double, lag_days int")
        lag = similarity.lag_quantiles(matches).first()
        assert [lag.p25, lag.p50, lag.p75, lag.p90, lag.max] == [want[24], want[49], want[74], want[89], max(values)]
    low, high = stats.exact_interval(168, 200)
    assert (round(low, 3), round(high, 3)) == (0.782, 0.888)
    assert stats.exact_interval(0, 5)[0] == 0.0 and stats.exact_interval(5, 5)[1] == 1.0
    ranks = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double").agg(stats.nearest_rank("v", 0.95).alias("p")).first().p
    assert ranks == 19.0


def test_interval_of_thousands(spark, tmp_path):
    def tail(k, n, p):
        return sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k, n + 1))

    low, high = stats.exact_interval(287, 307)
    assert float(tail(287, 307, low)) == pytest.approx(0.025, rel=1e-9) and float(tail(288, 307, high)) == pytest.approx(0.975, rel=1e-9)
    for k, n in ((2177, 2302), (1, 5000), (123_456, 1_000_000)):
        low, high = stats.exact_interval(k, n)
        logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(n + 1)]
        upper = fsum(exp(logs[i] + i * log(low) + (n - i) * log1p(-low)) for i in range(k, n + 1))
        lower = fsum(exp(logs[i] + i * log(high) + (n - i) * log1p(-high)) for i in range(k + 1))
        assert (upper, lower) == (pytest.approx(0.025, rel=1e-6), pytest.approx(0.025, rel=1e-6))
    event = F.when(F.col("id") < 2302, F.lit("big")).otherwise(F.lit("small"))
    valid = ((F.col("id") < 2302) & (F.col("id") < 2177)) | (F.col("id") >= 2310)
    df = spark.range(2320).select(event.alias("event"), F.when(valid, F.lit("x" * 120)).otherwise(F.lit("short")).alias("abstract"))
    df.write.parquet(f"{tmp_path}/papers.parquet")
    got = {r.event: (r.low, r.high) for r in catalog.queries()["stat_01_interval"](spark, str(tmp_path)).collect()}
    assert got == {"big": stats.exact_interval(2177, 2302), "small": stats.exact_interval(10, 18)}


# --- sources and sinks --------------------------------------------------------------------------------------
def test_listing_json(spark, tmp_path):
    hit = lambda i, **info: {"@id": i, "@score": "3", "info": {"title": "T &amp; U.", "year": "2020", "venue": "CCS", "type": "Conference and Workshop Papers", **info}}
    hits = [hit("1", authors={"author": {"text": "Ann"}}), hit("2", authors={"author": [{"text": "Ann"}, {"text": ["Bo", "Cy"]}]}), hit("3", title=""), hit("1", title="Later"), hit("4", type="Editorship")]
    (tmp_path / "a.json").write_text(json.dumps({"result": {"hits": {"hit": hits}}}))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text(json.dumps({"result": None}))
    files = sources.read_listing_json(spark, str(tmp_path))
    assert sources.valid_listings(files).count() == 1
    got = records.consolidated(sources.listing_papers(files), "paper_id", "file", "position").orderBy("paper_id").collect()
    assert [(r.paper_id, r.authors, r.title, r.event, r.paper_type, r.year) for r in got] == [("1", "Ann", "T & U.", "ACM CCS", "article", 2020), ("2", "Ann, Bo, Cy", "T & U.", "ACM CCS", "article", 2020)]
    engine = Engine(spark, str(tmp_path / "corpus"))
    with pytest.raises(dml.CorpusNotFoundError):
        engine.papers()
    engine.ingest(str(tmp_path / "a.json"))
    engine.ingest(str(tmp_path / "a.json"))
    engine.bibtex()
    assert engine.papers().count() == 2 and engine.stats()["totals"].first().total == 2
    assert [r.paper_id for r in engine.search(search.SearchFilters(author="bo")).collect()] == ["2"]
    engine.export(engine.papers(), "bibtex", str(tmp_path / "bib"))
    engine.snapshot(str(tmp_path / "copy"))
    assert Engine(spark, str(tmp_path / "copy")).papers().count() == 2


def test_xml_dump(spark, tmp_path):
    (tmp_path / "d.dtd").write_text('<!ENTITY uuml "&#252;">\n<!ENTITY amp "x">\n')
    entities = {r.name: r.value for r in sources.entity_table(spark.read.text(str(tmp_path / "d.dtd"))).collect()}
    assert entities["uuml"] == "ü"
    lines = spark.createDataFrame([("M&uuml;ller &amp; &nope;",), (None,)], "value string")
    assert [r.value for r in sources.substitute_entities(lines, entities).collect()] == ["Müller &amp; &nope;", None]
    xml = """<dblp>
<proceedings key="p/1"><title>Proc</title><booktitle>Conf X</booktitle><publisher>Pub</publisher></proceedings>
<inproceedings key="k/1"><author>Ann</author><author>Bo</author><title>On H<sub>2</sub></title><year>2020</year><crossref>p/1</crossref><ee>http://a</ee><ee>https://doi.org/10.1/z</ee></inproceedings>
<article key="k/2"><author>Cy</author><title>Two</title><journal>J</journal><year>2021</year></article>
</dblp>"""
    (tmp_path / "d.xml").write_text(xml)
    keys = spark.createDataFrame([("k/1",)], "key string")
    got = bibtex.inherit_from_proceedings(sources.read_records(spark, str(tmp_path / "d.xml"), keys), sources.read_proceedings(spark, str(tmp_path / "d.xml"))).collect()
    assert [(r.key, list(r.author), r.title, r.booktitle, r.publisher, r.doi) for r in got] == [("k/1", ["Ann", "Bo"], "On H", "Conf X", "Pub", "10.1/z")]
    assert sources.read_records(spark, str(tmp_path / "d.xml")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('ID,Title,Year,Type,Abstract\n7,"A ""q"", b",2020,article,"two\nlines"\n8,,2020,x,\n9,C,,x,\n10,D,2021.0,odd,\n')
    got = sources.read_paper_csv(spark, str(tmp_path / "p.csv")).orderBy("paper_id").collect()
    assert [(r.paper_id, r.title, r.year, r.paper_type, r.abstract) for r in got] == [("10", "D", 2021, "unknown", None), ("7", 'A "q", b', 2020, "article", "two\nlines")]
    engine = Engine(spark, str(tmp_path / "corpus"))
    engine.import_csv(str(tmp_path / "p.csv"))
    (tmp_path / "a.csv").write_text("ID,Abstract\n10," + "x" * 60 + "\n7," + "y" * 60 + "\n99," + "z" * 60 + "\n8,short\n")
    counts = engine.fill_abstracts(str(tmp_path / "a.csv")).first()
    assert tuple(counts) == (3, 2, 1, 1, 1)
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(json.dumps({"arxiv_id": "1", "title": "T", "authors": ["A"], "doi": None}) + "\n")
    back = sources.read_preprints(spark, str(tmp_path / "x.jsonl.gz"))
    sinks.write_preprints(back, str(tmp_path / "out"))
    assert sources.read_preprints(spark, str(tmp_path / "out")).first().authors == ["A"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("data/log.csv", "a,b")
        z.writestr("data/other.txt", "x")
    assert [(r.member, bytes(r.content)) for r in sources.zip_members(spark, str(tmp_path / "z.zip"), r".*\.csv").collect()] == [("data/log.csv", b"a,b")]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "1.json").write_text(json.dumps({"key": "src_10.1234/x", "value": "v", "expires_at": "2020-01-01 00:00:00", "access_count": 2}))
    cache = sources.read_cache_files(spark, str(tmp_path / "cache"))
    assert cache.first().key == "src_10.1234/x" and flows.unexpired(cache, "2021-01-01").count() == 0
    (tmp_path / "l.csv").write_text("paper_id,label\n1,a\n1,b\n")
    assert sources.read_keyed_csv(spark, str(tmp_path / "l.csv")).first().label == "b"
    payloads = spark.createDataFrame([("1", "registry", json.dumps({"message": {"abstract": f"<jats:p>{BODY}</jats:p>"}})), ("2", "semantic", json.dumps({"abstract": BODY}))], "paper_id string, service string, payload string")
    assert {r.paper_id: r.abstract for r in sources.payload_abstracts(payloads).collect()} == {"1": BODY, "2": BODY}
    assert json.loads(sinks.json_array(payloads.select("paper_id").orderBy("paper_id"), 1)) == [{"paper_id": "1"}]
    sinks.write(payloads, "csv", str(tmp_path / "c"), single_file=True)
    with pytest.raises(ValueError):
        sinks.write(payloads, "odd", str(tmp_path / "c"))


# --- relational operators -----------------------------------------------------------------------------------
def test_search_is_literal_and_total(spark):
    p = papers(spark, {"paper_id": "1", "title": "100% É_x", "year": 2020}, {"paper_id": "2", "title": None, "year": 2021}, {"paper_id": "3", "title": "100 éax", "year": 2021, "abstract": " "})
    ids = lambda df: [r.paper_id for r in df.collect()]
    assert ids(search.search(p, search.SearchFilters(title="100%"))) == ["1"]
    assert ids(search.search(p, search.SearchFilters(title="é_X"))) == ["1"]
    assert sorted(ids(search.like_search(p, "é_x"))) == ["1", "3"]
    assert ids(search.search(p, search.SearchFilters(year=0), limit=0, by="oldest"))[0] == "1"
    assert not search.SearchFilters(year=0, title="").is_set()
    assert ids(search.page(p, 99, 2)) == ["1"]
    assert search.length_class(p, "short").count() == 0 and search.length_class(p, "has").count() == 1
    good, bad = split_valid_years(papers(spark, {"paper_id": "1", "year": 1800}, {"paper_id": "2"}, {"paper_id": "3", "year": 2000}))
    assert (good.count(), bad.count()) == (1, 2) and missing_columns(p, ["title", "nope"]) == ["nope"]


def test_upsert_is_idempotent_and_keeps_abstracts(spark):
    p = papers(spark, {"paper_id": "1", "title": "old", "abstract": "", "bibtex": "b"}, {"paper_id": "2", "title": "two", "abstract": None})
    b = spark.createDataFrame([("1", "x", "new", 0), ("1", "new", None, 1), ("2", "zwei", "text", 2), ("3", "drei", None, 3)], "paper_id string, title string, abstract string, _at long")
    batch = dml.fold_batch(dml.add_column(b, "authors").select("*", *[F.lit(None).cast("string").alias(c) for c in ("venue", "pages", "paper_type", "access", "key", "ee", "url", "event")], F.lit(None).cast("int").alias("year"), F.lit(1.0).alias("score")), "_at")
    once = dml.upsert(p, batch, "2025-01-01")
    twice = dml.upsert(once, batch, "2025-01-01")
    rows = sorted((r.paper_id, r.title, r.abstract, r.bibtex) for r in once.collect())
    assert rows == [("1", "new", "", "b"), ("2", "zwei", "text", None), ("3", "drei", None, None)]
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_versions(spark, tmp_path):
    a, b = dml.VersionedStore(spark, str(tmp_path / "a")), dml.VersionedStore(spark, str(tmp_path / "b"))
    first = a.write(spark.range(3))
    assert a.state(b) == "ahead" and a.read().count() == 3
    second = a.write(spark.range(5), base=first)
    with pytest.raises(RuntimeError):
        a.write(spark.range(1), base=first)
    a.restore(first)
    assert a.read().count() == 3 and second != first


def test_clusters(spark):
    p = papers(spark, {"paper_id": "1", "title": "On Ｘ", "authors": "Ann", "year": 2020, "pages": "1-2"}, {"paper_id": "2", "title": "on x!", "authors": "ANN", "year": 2020, "pages": "1 2"}, {"paper_id": "3", "title": "Y", "authors": None}, {"paper_id": "4", "title": "y", "authors": "", "year": 2021}, {"paper_id": "5"})
    got = sorted((r.classification, r.paper_id, r.cluster_size) for r in records.identity_clusters(p).collect())
    assert got == [("exact_bibliographic_duplicate_candidate", "1", 2), ("exact_bibliographic_duplicate_candidate", "2", 2), ("possible_version_relation", "3", 2), ("possible_version_relation", "4", 2)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (200, 200)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 1)], "src int, dst int")
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == {n: find(n) for n in parent}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_title_join_against_brute_force(spark, sf):
    p = spark.read.parquet(f"{sf}/papers.parquet").select(F.col("paper_id").alias("id"), "title")
    x = spark.read.parquet(f"{sf}/preprints.parquet").dropDuplicates(["arxiv_id"]).select(F.col("arxiv_id").alias("id"), "title")
    for t in (0.3, 0.6):
        likeness = text.jaccard(text.title_tokens(F.col("a.title")), text.title_tokens(F.col("b.title")))
        want = x.alias("a").crossJoin(p.alias("b")).where(likeness >= t).select("a.id", "b.id")
        assert {tuple(r) for r in similarity.title_join(x, p, t).select("l", "r").collect()} == {tuple(r) for r in want.collect()}


def test_rates(spark):
    df = spark.createDataFrame([(0.6, 100, 100, 15, 1), (0.6, 0, 0, 0, 0), (0.6, 5, 5, 1, 0)], "threshold double, n_with long, n_without long, converted_with long, converted_without long")
    a, b, c = readiness.rates(df).collect()
    assert (a.precision, a.base_rate, round(a.lift, 6), a.recall, a.volume_reduction) == (0.15, 0.01, 15.0, 15 / 16, 0.5)
    assert (b.precision, b.lift, b.recall, b.volume_reduction) == (0.0, 0.0, 0.0, 0.0) and c.lift == float("inf")


def test_sampling(spark):
    assert sampling.allocation({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sampling.allocation({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 1}
    assert sampling.allocation({}, 5) == {}
    rows = spark.createDataFrame([(str(i), "ab"[i % 5 == 0]) for i in range(100)], "paper_id string, event string")
    s = sampling.stratified_sample(rows, "paper_id", "event", 20)
    assert s.count() == 20 and round(s.agg(F.sum("weight")).first()[0]) == 100
    assert sampling.sample_difference(s, s).count() == 0


def test_audit(spark):
    p = papers(spark, {"paper_id": "1", "abstract": "a  b", "ee": "https://doi.org/10.1234/x"}, {"paper_id": "2", "abstract": "c"}, {"paper_id": "3", "abstract": " "})
    log = spark.createDataFrame([("1", "ok", "s", "a b", datetime(2024, 1, 1)), ("2", "error", "s", "c", None), ("3", "ok", "s", " ", None)], "paper_id string, status string, source string, abstract string, logged_at timestamp")
    cache = spark.createDataFrame([("src_10.1234/X", "a b")], "key string, value string")
    m = audit.provenance(p, audit.log_evidence(p, log), audit.cache_evidence(p, cache))
    assert {r.paper_id: (r.evidence_status, r.sources) for r in m.collect()} == {"1": ("exact_log_and_cache", "s;src"), "2": ("unresolved", ""), "3": ("missing_abstract", "")}
    assert tuple(audit.provenance_summary(m).first()) == (3, 1, 1, 1)
    sample = m.select("paper_id", "abstract_sha256").where("paper_id = '1'")
    assert audit.digest_mismatches(sample, p).count() == 0
    assert audit.claims(aggregates.totals(p), {"total": (3, 0)}).first().ok
    files = spark.createDataFrame([("b", "p", 1, "s"), ("a", "p", 1, "s")], "role string, path string, bytes long, sha256 string")
    assert hashing.manifest_digest(files).first().digest == hashing.manifest_digest(files.orderBy("role")).first().digest


def test_breaker(spark):
    outcomes = [False] * 3 + [True, True] + [False]
    times = [0, 1, 2, 3, 70, 71]
    calls = [("s", i, datetime.fromtimestamp(t), "ok" if ok else "error") for i, (t, ok) in enumerate(zip(times, outcomes, strict=True))]
    df = spark.createDataFrame(calls, "service string, call_id long, called_at timestamp, status string")
    got = [(r.state, r.refused) for r in flows.breaker_states(df, failures=3).orderBy("call_id").collect()]
    assert got == [("CLOSED", False), ("CLOSED", False), ("OPEN", False), ("OPEN", True), ("HALF_OPEN", False), ("HALF_OPEN", False)]


def test_streaming_ingest(spark, tmp_path):
    src, store = str(tmp_path / "in"), dml.VersionedStore(spark, str(tmp_path / "store"))
    papers(spark, {"paper_id": "1", "title": "a", "abstract": "x"}).write.parquet(src)
    flows.ingest(spark, src, store, str(tmp_path / "ck")).awaitTermination()
    papers(spark, {"paper_id": "1", "title": "b"}, {"paper_id": "2", "title": "c"}).write.mode("append").parquet(src)
    flows.ingest(spark, src, store, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.paper_id, r.title, r.abstract) for r in store.read().collect()) == [("1", "b", "x"), ("2", "c", None)]


def test_calls_per_window(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/service_calls.parquet").schema
    spark.read.parquet(f"{sf}/service_calls.parquet").write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "calls")).withColumn("called_at", F.col("called_at").cast("timestamp"))
    query = flows.calls_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").where("calls < errors").count() == 0


# --- queries against SQL ------------------------------------------------------------------------------------
def test_queries_equal_their_sql(spark, sf):
    import glob
    import os

    import duckdb

    from lumenbib.plans import catalog

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")

    def plain(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        cell = lambda v: round(float(v), 9) if isinstance(v, float) else v
        return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)

    wrong = []
    for name, sql in catalog.oracle_sql().items():
        if name == "claim_01_totals":
            continue
        df = catalog.queries()[name](spark, sf)
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        if sorted(columns) != sorted(df.columns) or plain(df.collect(), df.columns) != plain(result.fetchall(), columns):
            wrong.append(name)
    assert not wrong
