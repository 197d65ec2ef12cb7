"""Rules, stores and exact aggregates added or mended after the first round."""

import hashlib
import json
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenbib import config
from lumenbib.engine import Engine
from lumenbib.functions import abstracts, bibtex, text
from lumenbib.operators import aggregates, audit, dml, records, similarity
from lumenbib.schema import PAPER, add_missing, require_columns
from lumenbib.sources import records as sources
from lumenbib.sources import sinks
from lumenbib.streaming import flows

BODY = "This body is long enough to be taken for an abstract because it has more than one hundred characters in it."


def papers(spark, *given):
    return spark.createDataFrame([tuple(g.get(f.name) for f in PAPER) for g in given], PAPER)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


def test_tags_leave_no_blank(spark):
    assert one(spark, f"<jats:title>A\nB</jats:title><jats:p>H<jats:sub>2</jats:sub>O. {BODY}</jats:p>", abstracts.from_jats) == f"H2O. {BODY}"
    assert one(spark, "<jats:p>short</jats:p>", abstracts.from_jats) is None and one(spark, None, abstracts.from_jats) is None


@pytest.mark.parametrize(("entry", "valid"), [("  @misc{k, AUTHOR = {x}, TITLE = {y}, Year = {1}}", True), ("@misc{k, editor={x}, title={y}, year={1}}", True), ("@misc{k, title={y}, year={1}}", False), ("x @misc{k, author, title, year", False), ("", False), (None, False)])
def test_valid_entries(spark, entry, valid):
    assert one(spark, entry, bibtex.is_valid_entry) is valid


def test_csv_types_are_mapped(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,Title,Year,Type\n1,A,2020,Conference and Workshop Papers\n2,B,2020,Article\n3,C,2020,\n4,D,2020,Editorship\n5,E,2020,odd\n")
    assert {r.paper_id: r.paper_type for r in sources.read_paper_csv(spark, str(tmp_path / "p.csv")).collect()} == {"1": "article", "2": "article", "3": "unknown", "4": "editorship", "5": "unknown"}


def test_last_row_of_the_file_is_imported(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'ID,Abstract\n1,{"z" * 60}\n2,"{"m" * 60}\nline"\n1,{"a" * 60}\n')
    got = dml.fill_abstracts(papers(spark, {"paper_id": "1"}, {"paper_id": "2", "abstract": "old"}), sources.read_abstract_csv(spark, str(tmp_path / "a.csv")))
    assert {r.paper_id: r.abstract for r in got[0].collect()} == {"1": "a" * 60, "2": "old"} and tuple(got[1].first()) == (2, 2, 1, 1, 0)
    answers = spark.createDataFrame([("1", "semantic", json.dumps({"abstract": x}), i) for i, x in enumerate(("zz", "aa"))], "paper_id string, service string, payload string, at int")
    assert sources.payload_abstracts(answers, "at").first().abstract == "aa" and sources.payload_abstracts(answers).first().abstract == "zz"


def test_author_lists_need_two_blocks_and_a_long_rest():
    strip = abstracts.without_author_blocks
    assert strip(f"Ann B (Uni A); Cy D (Uni B) {BODY}") == BODY
    assert strip(f"Ann B (Uni A) {BODY}") == f"Ann B (Uni A) {BODY}"
    assert strip("Ann B (Uni A), Cy D (Uni B) short rest") == "Ann B (Uni A), Cy D (Uni B) short rest"
    assert strip("".join(f"Ann Bee (Uni {i}), " for i in range(31)) + BODY) == BODY and strip("") == ""


def test_places_in_pages():
    usenix = f"<main><section><p>Authors<p>{BODY}<p>more words here<p>Footer</section><section><p>{BODY} other</section></main>"
    assert abstracts.page_abstract(usenix, "usenix") == f"{BODY} more words here"
    three = f"<main><section><p>Authors<p>{BODY}</section></main>"
    assert abstracts.page_abstract(three, "usenix") == BODY
    assert abstracts.page_abstract(f"<section><p>Authors<p>{BODY}<p>x</section>", "usenix") is None
    headed = f"<div class='content'><header><p>{BODY} head</p></header><p>{BODY}</p></div>"
    assert abstracts.page_abstract(headed, "usenix") == BODY
    many = f"<div class='abstract'><p>{BODY}</p></div><div class='abstract'><p>Second part.</p></div>"
    assert abstracts.page_abstract(many, "ndss") == f"{BODY} Second part." and abstracts.page_abstract(many, "acm") == BODY
    assert abstracts.page_abstract(f"<div class='abstractSection'>Abstract? {BODY}</div>", "acm") == BODY and abstracts.page_abstract("", "acm") is None


def test_rules_and_strategies_can_be_registered(spark):
    with text.event_rules([("my venue", "MINE")]):
        mine = text.normalize_event(F.col("v"))
    df = spark.createDataFrame([("My Venue 2020",), ("NDSS my venue",), ("x",)], "v string")
    assert [r[0] for r in df.select(mine).collect()] == ["MINE", "NDSS", "x"] and one(spark, "My Venue", text.normalize_event) == "My Venue"
    urls = sources.page_urls(spark, ["asiaccs", "fnt_privsec", "new"], (2020, 2021)).orderBy("event", "year", "place").collect()
    assert [(r.event, r.year, r.url.rsplit("/", 1)[1]) for r in urls] == [("asiaccs", 2020, "asiaccs2020.html")] * 2 + [("asiaccs", 2021, "asiaccs2021.html")] * 2 + [("fnt_privsec", 2020, "ftsec2.html"), ("new", 2020, "new2020.html"), ("new", 2021, "new2021.html")]
    assert one(spark, "<a href='https://x/y?format=json&amp;a=1'>", sources.listing_link) == "https://x/y?format=json&a=1" and one(spark, "<a href='/z'>", sources.listing_link) is None


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    first, second = (dml.VersionedStore(spark, str(tmp_path / "s")) for _ in range(2))
    first.write(spark.range(3))
    stale = second.manifest()
    first.write(spark.range(4))
    monkeypatch.setattr(second, "manifest", lambda: stale)
    with pytest.raises(RuntimeError):
        second.write(spark.range(5))
    assert first.read().count() == 4


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    store = dml.VersionedStore(spark, str(tmp_path / "s"), key="paper_id", buckets=8)
    empty = spark.createDataFrame([], PAPER)
    store.merge(papers(spark, *[{"paper_id": str(i), "title": "old"} for i in range(50)]), dml.upsert, empty)
    before = store.manifest()["parts"]
    store.merge(papers(spark, {"paper_id": "7", "title": "new"}, {"paper_id": "new", "title": "x"}), dml.upsert, empty)
    after = store.manifest()["parts"]
    assert len(before) > 4 and sum(before[b] != after[b] for b in before) <= 2
    assert {r.title for r in store.read().where("paper_id in ('7', 'new', '8')").collect()} == {"new", "x", "old"} and store.read().count() == 51
    store.write(empty)
    with pytest.raises(dml.CorpusNotFoundError):
        store.require()


def test_clusters_are_named_by_the_digest_of_their_members(spark):
    p = papers(spark, *[{"paper_id": f"{i:03}", "title": "Same", "authors": "A"} for i in range(300)], *[{"paper_id": f"x{i}", "title": f"T{i // 2}", "authors": "B"} for i in range(9)])
    got = {}
    for r in records.identity_clusters(p).collect():
        got.setdefault(r.cluster_id, []).append(r.paper_id)
    assert sorted(map(len, got.values())) == [2, 2, 2, 2, 300]
    for name, members in got.items():
        assert name == "ta-" + hashlib.sha256("\n".join(sorted(members)).encode()).hexdigest()[:12]
    assert records.identity_clusters(p.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 1000, 4001])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = {"a": [rng.choice((1.5, rng.random() * 100)) for _ in range(n)], "b": [7.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]], "g string, v double")
    rows = {r.g: r for r in aggregates.exact_quantiles(df, ["g"], "v", [0.5, 0.95]).collect()}
    assert rows["a"].inner0 == pytest.approx(statistics.median(values["a"])) and rows["b"].inner0 == rows["b"].nearest1 == 7.0
    assert rows["a"].nearest1 == sorted(values["a"])[-(-95 * n // 100) - 1]


def test_sinks_and_order(spark, tmp_path):
    p = papers(spark, {"paper_id": "2", "title": ' "q", '}, {"paper_id": "1", "title": "é\nü", "key": "k"}, {"paper_id": "3", "title": None})
    sinks.write_json_array(p.select("paper_id", "title"), str(tmp_path / "a"), ["paper_id"])
    whole = "\n".join(r.value for r in spark.read.text(str(tmp_path / "a")).collect())
    assert json.loads(whole) == [{"paper_id": "1", "title": "é\nü"}, {"paper_id": "2", "title": ' "q", '}, {"paper_id": "3", "title": None}]
    assert json.loads(sinks.json_array(p.select("paper_id", "title").orderBy("paper_id"), 1)) == [{"paper_id": "1", "title": "é\nü"}]
    sinks.write(p, "csv", str(tmp_path / "c"))
    assert {r.title for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).collect()} == {' "q", ', "é\nü", None}
    assert [(r.place, r.paper_id) for r in audit.in_audit_order(p).orderBy("place").collect()] == [(1, "2"), (2, "3"), (3, "1")]


def test_breaker_backoff_and_reads(spark):
    calls = [("s", i, datetime.fromtimestamp(100 + i), "error") for i in (1, 1, 1, 2, 2)] + [("t", 9, datetime.fromtimestamp(100), "throttled"), ("t", 10, datetime.fromtimestamp(101), "throttled")]
    df = spark.createDataFrame(calls, "service string, call_id long, called_at timestamp, status string")
    assert {(r.call_id, r.state) for r in flows.breaker_states(df, failures=3).where("service = 's'").collect()} == {(1, "CLOSED"), (2, "CLOSED")}
    assert {r.service: (r.failures, r.blocks, r.wait_s) for r in flows.backoff(df).collect()} == {"s": (2, 0, 0), "t": (2, 2, 120)}
    cache = spark.createDataFrame([("k", "v", datetime(2020, 1, 1), 4), ("n", "v", None, None)], "key string, value string, expires_at timestamp, access_count int")
    reads = spark.createDataFrame([("k", datetime(2019, 1, 1)), ("k", datetime(2021, 1, 1)), ("n", datetime(2021, 1, 1))], "key string, at timestamp")
    assert {r.key: r.access_count for r in flows.read_through(cache, reads).collect()} == {"k": 5, "n": 1}


def test_audit_guards(spark, tmp_path):
    p = papers(spark, {"paper_id": "1", "abstract": "a"})
    log = spark.createDataFrame([], "paper_id string, status string, source string, abstract string, logged_at timestamp")
    cache = spark.createDataFrame([], "key string, value string")
    assert audit.guarded_audit(p, log, cache, {"papers": 1})[1].first().unresolved == 1
    with pytest.raises(ValueError, match="counts differ"):
        audit.guarded_audit(p, log, cache, {"papers": 2})
    files = spark.createDataFrame([("log", "a.csv", 1, "d1")], "role string, path string, bytes long, sha256 string")
    assert audit.verify_inputs(files, {}).first().ok
    with pytest.raises(ValueError, match="log: a.csv"):
        audit.verify_inputs(files, {"log": "d2"})
    with pytest.raises(ValueError, match="nope"):
        require_columns(p, ["nope"])
    assert add_missing(p, {"nope": "int", "title": "int"}).schema["title"].dataType.simpleString() == "string"


def test_configuration_and_refresh(spark, tmp_path):
    path = str(tmp_path / "c.json")
    config.save(spark, config.Configuration(events=("a",), year_start=2024), path)
    assert config.load(spark, path).years(now=2026) == [2024, 2025, 2026] and config.Configuration(listed_years=(2001,)).years() == [2001]
    engine, other = Engine(spark, str(tmp_path / "own")), dml.VersionedStore(spark, str(tmp_path / "other"))
    other.write(papers(spark, {"paper_id": "1"}))
    assert engine.store.bootstrap(other) and not engine.store.bootstrap(other) and engine.refresh_if_due(other.root) == "in_sync"
    other.write(papers(spark, {"paper_id": "1"}, {"paper_id": "2"}))
    assert engine.refresh_if_due(other.root) == "refresh" and engine.papers().count() == 2


def test_matches_compare_titles_first_and_lose_none(spark, sf):
    p, x = spark.read.parquet(f"{sf}/papers.parquet"), spark.read.parquet(f"{sf}/preprints.parquet")
    once = x.dropDuplicates(["arxiv_id"])
    blocked = similarity.author_blocked_pairs(p, once)
    tokens = lambda df, key: df.select(key, text.title_tokens(F.col("title")).alias(f"t_{key}"))
    want = blocked.join(tokens(p, "paper_id"), "paper_id").join(tokens(once, "arxiv_id"), "arxiv_id").where(text.jaccard(F.col("t_paper_id"), F.col("t_arxiv_id")) >= similarity.TITLE_THRESHOLD)
    got = similarity.find_matches(p, x)
    assert {(r.paper_id, r.arxiv_id, tuple(r.shared_authors)) for r in got.collect()} == {(r.paper_id, r.arxiv_id, tuple(r.shared_authors)) for r in want.collect()}
    sizes = similarity.author_blocks(p, once).agg(F.sum(F.col("papers") * F.col("preprints"))).first()[0]
    assert sizes == blocked.select(F.sum(F.size("shared_authors"))).first()[0]
