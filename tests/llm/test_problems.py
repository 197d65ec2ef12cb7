import itertools
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenbib.llm import bpe, chunking, confusables, leakage, linkage, minhash, names, queries, residue, survivor, truncation

TOKENIZERS = bpe.TOKENIZER_DIR
LONG = "word and more of it. " * 60_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PAPERS = (
    "paper_id string, title string, authors string, abstract string, ee string, year int, updated_at timestamp, extra string, key string, words string, id string, text string"
)
PREPRINTS = "arxiv_id string, title string, authors array<string>, submitted_at string, doi string, summary string, extra string, id string"


def papers(spark, *given):
    base = dict.fromkeys(PAPERS.replace(" string", "").replace(" int", "").replace(" timestamp", "").split(", "))
    return spark.createDataFrame([tuple((base | g).values()) for g in given], PAPERS)


def preprints(spark, *given):
    base = dict.fromkeys(["arxiv_id", "title", "authors", "submitted_at", "doi", "summary", "extra", "id"])
    return spark.createDataFrame([tuple((base | g).values()) for g in given], PREPRINTS)


# --- 1 -------------------------------------------------------------------------------------------------------
def test_names_link_spellings(spark):
    given = ["Jonathan Brimahikai", "Jon Brimahikai", "Brimahikai, J.", "J. T. Brimahikai", "Brimahikai Jonathan", "Jonathan Brimaihkai", "JONATHAN BRIMAHIKAI", "Ruben Brimahikai",
             "Kenji Kimbodrákis 0001", "Kenji Kimbodrákis 0002", "Olga Krebogater", "Olga Krebogater 0007", "Krilan Research Consortium", "The Krilan Research Consort.", "Consortium for Krilan Research",
             "Zubérnivo Security Laboratory", "Ruben Hartodigo", "Jonathan Hartodigo", "et al.", "Olga Krebogater and others", "Unknown", ""]
    p = papers(spark, *[{"paper_id": str(i), "authors": n} for i, n in enumerate(given) if ", " not in n], {"paper_id": "x"})
    x = preprints(spark, {"arxiv_id": "1", "authors": [n for n in given if ", " in n] + [None, ""]}, {"arxiv_id": "2"})
    got = set(rows(names.found(p, x)))
    jon = sorted(given[:7])
    assert set(itertools.combinations(jon, 2)) <= got
    assert ("Olga Krebogater", "Olga Krebogater 0007") in got
    org = sorted(given[12:15])
    assert set(itertools.combinations(org, 2)) <= got
    assert len(got) == 21 + 1 + 3
    assert names.found(p.limit(0), x.limit(0)).count() == 0


def test_one_edit_against_brute_force(spark):
    def osa(a, b):
        letters = sorted(set(a) | set(b))
        near = {a}
        for i in range(len(a) + 1):
            near |= {a[:i] + c + a[i:] for c in letters} | {a[:i] + a[i + 1 :]} | {a[:i] + c + a[i + 1 :] for c in letters}
            near |= {a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :]}
        return b in near

    words = ["gostedidan", "gosetdidan", "gostedidann", "gostdidan", "gostedixan", "ostedidan", "gostedidna", "prundafalis", "prundafalos", "grundafaliz"]
    df = spark.createDataFrame([(w, "x") for w in words], "family string, initial string")
    got = set(rows(names.similar_families(df)))
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if osa(a, b)}
    assert got == want


# --- 2 -------------------------------------------------------------------------------------------------------
def brute_pairs(texts, t):
    sets = {k: frozenset(re.findall(r"[^\W_]+", v.lower())) for k, v in texts.items() if v}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_near_duplicates_against_brute_force(spark, sf):
    texts = {r.paper_id: r.abstract for r in spark.read.parquet(f"{sf}/papers.parquet").collect() if r.abstract and len(r.abstract) > 200}
    some = next(iter(texts.values()))
    texts |= {"a1": some, "a2": some.upper(), "a3": some + " Code is available.", "b": LONG, "c": "one"}
    df = spark.createDataFrame([*texts.items(), ("n", None), ("e", ""), ("a1", some), ("s", " ... ")], "paper_id string, abstract string")
    pairs = minhash.duplicate_pairs(df, "paper_id", "abstract")
    assert set(rows(pairs)) == brute_pairs(texts, 0.7)
    groups = {r.paper_id: (r.group_id, r.links) for r in minhash.duplicate_groups(df, "paper_id", "abstract").collect()}
    assert set(groups) == set(texts)
    assert groups["a1"][0] == groups["a2"][0] == groups["a3"][0]
    assert sum(n for _, n in groups.values()) == 2 * len(brute_pairs(texts, 0.7))
    assert minhash.duplicate_pairs(df.limit(0), "paper_id", "abstract").count() == 0


def test_estimate_is_corrected_for_collisions(spark):
    rows_ = [(str(k), list(range(k * 50, k * 50 + 100))) for k in range(3)]
    sets = spark.createDataFrame(rows_, "id string, w array<bigint>").select("id", F.transform("w", lambda v: F.xxhash64(v)).alias("words"))
    s = minhash.signatures(sets, "id", "words")
    a, b = s.select(F.col("id").alias("a"), F.col("packed").alias("pa")), s.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    got = {(r.a, r.b): r.e for r in a.join(b, F.col("a") < F.col("b")).select("a", "b", minhash.estimate("pa", "pb").alias("e")).collect()}
    assert abs(got["0", "1"] - 1 / 3) < 0.15 and abs(got["0", "2"]) < 0.15


def test_pairs_at_the_threshold_are_all_found(spark):
    texts = []
    for i in range(400):
        common = [f"c{i}x{k}" for k in range(70)]
        texts += [common + [f"l{i}x{k}" for k in range(15)], common + [f"r{i}x{k}" for k in range(15)]]
    df = spark.createDataFrame([(f"{i:04}", " ".join(t)) for i, t in enumerate(texts)], "paper_id string, abstract string")
    assert rows(minhash.duplicate_pairs(df, "paper_id", "abstract")) == [(f"{i:04}", f"{i + 1:04}") for i in range(0, 800, 2)]


# --- 3 -------------------------------------------------------------------------------------------------------
CANDIDATES = "cluster_id string, paper_id string, title string, authors string, year int, pages string, doi string, event string, retention_reason string, rank int, filled int"


def test_survivors(spark):
    full = ("t", "A B", 2020, "1-9", "10.1234/x", "Conf")
    data = [("c", "1", *full, None, 1, 1), ("c", "2", *full, "publisher record - verified", 1, 1), ("c", "2", *full, "publisher record - verified", 1, 1),
            ("c", "3", "t", "A et al.", 2020, "0-0", "pending", "TBA", "automatic harvest, not checked", 1, 1), ("d", "5", *full, None, 1, 1), ("d", "4", *full, None, 1, 1),
            (None, "9", *full, None, 1, 1), ("e", "8", None, None, None, None, None, None, None, None, None)]
    c = spark.createDataFrame(data, CANDIDATES)
    p = papers(spark, *[{"paper_id": k, "updated_at": datetime(2024, 1, 1)} for k in "1234"], {"paper_id": "4", "updated_at": datetime(2023, 1, 1)}, {"paper_id": None})
    assert rows(survivor.found(c, p)) == [("c", "2"), ("d", "4"), ("e", "8")]
    gold = {r.cluster_id: r for r in survivor.golden_records(c, p).collect()}
    assert gold["c"].doi == "10.1234/x" and gold["e"].doi is None and gold["c"].records == 3
    assert survivor.found(c.limit(0), p.limit(0)).count() == 0


# --- 4 -------------------------------------------------------------------------------------------------------
GOOD = "We study how operators of parking meters handle key exhaustion, and we measure the effect on latency across many networks. The results suggest that defenses deserve more attention."
CASES = ["404 Not Found. The page you requested on a.example may have moved. Return to the start page.", "Please turn on scripts in your browser settings to view this page.", "TBD", "n/a", "[object Object]",
         "{{ abstract }}", "Abstract: [Insert abstract here]", "No abstract available for this record.", "lorem vora pelle magnor erat vora lorem pelle vora magnor erat dolvar", "text text text text text",
         GOOD + " {{footer.copyright}}", "We use cookies to improve this site. " + GOOD, "Skip to main content | Log in | Basket (0) " + GOOD, GOOD.replace("many", "<insert number>"), "xxxx xxx xxxxx xx."]
CLEAN = [GOOD, "", "   ", None, GOOD + " A payload such as {{7*7}} was enough.", GOOD + " The variable ${HOME} is expanded by the shell.", GOOD + " We study pages that ask visitors to enable JavaScript.",
         GOOD + " Cookie notices that read 'accept all' were shown.", LONG]


def test_residue(spark):
    given = [{"paper_id": f"b{i:02}", "abstract": a, "title": f"Title {i}", "ee": "https://a.example/x/1"} for i, a in enumerate(CASES)]
    given += [{"paper_id": f"g{i:02}", "abstract": a} for i, a in enumerate(CLEAN)] + given[:1]
    got = [r[0] for r in rows(residue.found(papers(spark, *given)))]
    assert got == [f"b{i:02}" for i in range(len(CASES))]
    assert residue.found(papers(spark, *given).limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------
def test_truncation(spark, sf):
    p = spark.read.parquet(f"{sf}/papers.parquet").select("paper_id", "abstract")
    bad = residue.found(spark.read.parquet(f"{sf}/papers.parquet"))
    whole = [r for r in p.join(bad, "paper_id", "left_anti").where("abstract like '%.' and length(abstract) > 400").collect() if not r.abstract.endswith("..")][:60]
    cut_words = [(f"w{r.paper_id}", r.abstract[: r.abstract.rindex(" ") - 25].rstrip(" .")[:-3]) for r in whole[:15]]
    marked = [(f"m{r.paper_id}", r.abstract[:300] + "...") for r in whole[15:20]] + [("j1", whole[20].abstract[:250] + "<jats:"), ("j2", whole[21].abstract[:250] + "&am")]
    fine = [(r.paper_id, r.abstract) for r in whole] + [("u", whole[0].abstract + " Code: https://a.example/x"), ("k", whole[1].abstract + " Keywords: alpha, beta gamma"), ("q", whole[2].abstract + ' One said: "yes, it is"'), ("n", None), ("e", ""), ("b", "  "), ("l", LONG)]
    df = spark.createDataFrame(fine + cut_words + marked, "paper_id string, abstract string").withColumn("text", F.lit(1)).withColumn("id", F.lit("z"))
    got = {r.paper_id for r in truncation.truncated(df).collect()}
    assert not got & {k for k, _ in fine}
    assert {k for k, _ in marked} <= got
    assert len(got & {k for k, _ in cut_words}) >= 0.9 * len(cut_words)
    assert truncation.truncated(df.limit(0)).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("value", "form", "classes"),
    [
        ("Plain", "Plain", []), ("Ｄｅｅｐ Nets", "Deep Nets", ["full_width"]), ("eﬃcient", "efficient", ["ligature"]), ("Café", "Café", ["decomposed"]), ("Café", "Café", []), ("a​b", "ab", ["invisible"]),
        ("a b", "a b", ["space"]), ("Kenji Kimbоdrákis", "Kenji Kimbodrákis", ["letter"]), ("under β-Noise", "under β-Noise", []), ("Анализ утечек", "Анализ утечек", []), ("", "", []),
    ],
)
def test_forms(value, form, classes):
    assert confusables.analyse(value)[0] == form and confusables.analyse(value)[2] == classes


def test_affected_fields(spark):
    p = papers(spark, {"paper_id": "1", "title": "А Study of Keys", "authors": "Å B"}, {"paper_id": "2", "title": "A Study", "authors": None}, {"paper_id": "3", "title": "Анализ сети"}, {"paper_id": "4", "title": LONG + "​"})
    x = preprints(spark, {"arxiv_id": "7", "title": "Ｔｗｏ"}, {"arxiv_id": "7", "title": "Ｔｗｏ"}, {"arxiv_id": "8"})
    assert rows(confusables.affected_fields(p, x)) == [("papers", "1", "title"), ("papers", "4", "title"), ("preprints", "7", "title")]
    assert confusables.affected_fields(p.limit(0), x.limit(0)).count() == 0
    values = spark.createDataFrame([("Ｔｗｏ", "f"), ("Two", "f"), ("two", "f"), (None, "f")], "value string, form string")
    assert {r.original for r in confusables.lookalike_groups(values).collect()} == {"Ｔｗｏ", "Two", "two"}


# --- 7 -------------------------------------------------------------------------------------------------------
def test_cascade(spark):
    long = "Stealthy packets reach the hypervisors of many networks and nobody has measured how often that happens in practice so we do it here."
    p = papers(
        spark, {"paper_id": "1", "title": "Kival: Hybrid Sequence Models for Voting Kiosks.", "authors": "Ann Lorem, Bob Vurnaxis", "year": 2021, "ee": "https://doi.org/10.1234/a"},
        {"paper_id": "2", "title": "Another Tale of Radio Links", "authors": "Ann Lorem, Bob Vurnaxis", "year": 2021}, {"paper_id": "3", "title": "Anticipating Compositional Medical Scanners with Directed Fuzzing", "authors": "Cy Dorvitan", "year": 2023, "abstract": long},
        {"paper_id": "4", "title": "Kival: Hybrid Sequence Models for Voting Kiosks", "authors": "Ann Lorem, Bob Vurnaxis", "year": 2021}, {"paper_id": "5"}, {"paper_id": None, "title": "x"},
        {"paper_id": "6", "title": "Lonely Title on Five Things", "authors": None, "year": 2022},
    )
    x = preprints(
        spark, {"arxiv_id": "a", "title": "Hybrid sequence models for voting kiosks (Draft)", "authors": ["Ann Lorem", "Vurnaxis, B."], "submitted_at": "2020-11-01T00:00:00Z", "doi": "10.1234/A"},
        {"arxiv_id": "b", "title": "Anticipating Medical Scanners with Directed Fuzing", "authors": ["C. Dorvitan"], "submitted_at": "2022-11-01T00:00:00Z", "summary": "none"},
        {"arxiv_id": "c", "title": "Lonely title on five things", "authors": [], "submitted_at": "2022-01-01T00:00:00Z"}, {"arxiv_id": "c", "title": "Lonely title on five things", "authors": [], "submitted_at": "2022-01-01T00:00:00Z"},
        {"arxiv_id": "d"}, {"arxiv_id": None, "title": "q", "authors": [None]},
    )
    m = linkage.cascade(p, x)
    got = {(r.paper_id, r.arxiv_id): r.confidence for r in m.collect()}
    assert {("1", "a"), ("4", "a"), ("6", "c")} <= set(got) and ("2", "a") not in got
    assert all(0 < c < 1 for c in got.values())
    assert linkage.found(p.limit(0), x.limit(0)).count() == 0


def test_blocked_pairs_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"word{c}" for c in "abcdefghij"]
    titles = [["fuzzing", "embedded", "firmware"], ["quiet", "radio", "beacons"], ["locating", "stolen", "hidden", "wallets"]]
    others = [["fuzzing", "embeded", "firmware"], ["quiet", "secret", "radio", "covert", "beacons"], ["wallets", "hidden", "stolen", "locating"]]
    titles += [rng.sample(vocabulary, rng.randint(1, 6)) for _ in range(50)]
    others += [rng.sample(vocabulary, rng.randint(1, 6)) for _ in range(50)]
    letters = [a + b for a in "bcdfghjk" for b in "lmnprstv"]
    people = lambda side, i: ["Ann Brimo" if i % 3 else "Bob Krelan", f"Given{side}{letters[i]} Sur{side}{letters[i]}"]
    year = lambda i: 2020 + 8 * (i % 5 == 4)
    p = papers(spark, *[{"paper_id": f"p{i}", "title": " ".join(t), "authors": ", ".join(people("p", i)), "year": 2021} for i, t in enumerate(titles)])
    x = preprints(spark, *[{"arxiv_id": f"x{i}", "title": " ".join(t), "authors": people("x", i), "submitted_at": f"{year(i)}-01-01T00:00:00Z"} for i, t in enumerate(others)])
    common = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    equal = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(others) if a == b and people("p", i)[0] == people("x", j)[0]}
    done_p, done_x = {i for i, _ in equal}, {j for _, j in equal}
    want = {
        (f"p{i}", f"x{j}") for i, a in enumerate(titles) for j, b in enumerate(others)
        if i not in done_p and j not in done_x and people("p", i)[0] == people("x", j)[0] and common(a, b) >= 0.5 and -2 <= 2021 - year(j) <= 5
    }
    assert {(f"p{i}", f"x{i}") for i in range(3)} <= want and len(want) > 100
    assert {(r.paper_id, r.arxiv_id) for r in linkage.cascade(p, x).where("rule = 'blocked'").collect()} == want


def test_sibling_by_body_with_other_people(spark):
    body = "Stealthy packets reach the hypervisors of many networks and nobody has measured how often that happens in practice so we do it here."
    p = papers(
        spark, {"paper_id": "1", "title": "Stealthy Packets in Practice", "authors": "Ann Lorem, Bob Vurnaxis", "abstract": body},
        {"paper_id": "2", "title": "Measuring Hypervisors", "authors": "Ann Lorem, Cy Dorvitan", "abstract": body}, {"paper_id": "3", "title": "Others", "authors": "Eve Mirdal", "abstract": body},
    )
    x = preprints(spark, {"arxiv_id": "a", "title": "Stealthy packets in practice", "authors": ["Ann Lorem", "Bob Vurnaxis"], "submitted_at": "2020-11-01T00:00:00Z"})
    assert {(r.paper_id, r.arxiv_id, r.rule) for r in linkage.cascade(p, x).collect()} == {("1", "a", "title_authors"), ("2", "a", "sibling")}


# --- 8 and 10 ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference_encoding():
    import base64

    import tiktoken

    data = bpe.read_vocabulary(f"{TOKENIZERS}/{bpe.VOCABULARY}")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n \t", "<|endoftext|>", "a" * 30_000, "Größe über 3,141 Straßen", "日本語のテキスト" * 300, "x = {'a': 1}\n" * 400, "é́​\x00\x07", LONG[:9000]]


def test_ids_equal_the_public_encoder(spark, reference_encoding):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert got == {i: reference_encoding.encode_ordinary(t) for i, t in enumerate(TEXTS)} | {len(TEXTS): []}
    assert bpe.encode(df.limit(0)).count() == 0


def test_pieces(spark, reference_encoding):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, piece int")
    want = {i for i, t in enumerate(TEXTS) if len(reference_encoding.encode_ordinary(t)) > 1024}
    assert {r.doc_id for r in chunking.found(df).collect()} == want
    pieces = {}
    for r in sorted(chunking.split_documents(df).collect(), key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append(r)
    for i, group in pieces.items():
        ids = list(group[0].ids)
        for a, b in itertools.pairwise(group):
            assert list(b.ids[:64]) == list(a.ids[-64:])
            ids += b.ids[64:]
        assert ids == reference_encoding.encode_ordinary(TEXTS[i])
        assert all(len(r.ids) <= 1024 for r in group)
    assert all(r.boundary >= 4 for r in pieces[7][:-1]) and all(r.boundary >= 3 for r in pieces[9][:-1])
    assert chunking.found(df.limit(0)).count() == 0


# --- 9 -------------------------------------------------------------------------------------------------------
def test_leaks(spark):
    a = "According to the appendix, Gazukbi discards any batch in which more than 5 of 69 nodes carry a transparent checksum. The margin note in chapter 70 explains why Gazukbi rotates 10 keys after watering holes and only then resumes state machine learning."
    b = a.replace("Gazukbi", "Volkrim").replace("69", "12").replace("70", "33")
    items = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, None, "x"), (4, "", "x"), (5, "Too short", "x")], "item_id bigint, passage string, text string")
    docs = [(1, "Intro. " + a + " Outro."), (2, a.upper().replace(",", "")), (3, a[: len(a) // 3]), (4, "Some words. " + a[:118] + " noise here " + a[130:]), (5, a.replace("nodes", "nodez").replace(" ", "\n")), (6, None), (7, ""), (8, LONG), (1, "Intro. " + a + " Outro.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9)).withColumn("at", F.lit(1))
    assert rows(leakage.found(df, items)) == [(1, 1), (2, 1), (4, 1), (5, 1)]
    assert (1, 2) in [tuple(r) for r in leakage.reparameterised(df, items).select("doc_id", "item_id").collect()]
    assert leakage.found(df.limit(0), items).count() == 0 and leakage.found(df, items.limit(0)).count() == 0


def test_all_queries_have_the_given_columns(spark, sf):
    want = {
        "p1_found": ["name_a", "name_b"], "p2_found": ["paper_id_a", "paper_id_b"], "p3_found": ["cluster_id", "paper_id"], "p4_found": ["paper_id"], "p5_found": ["paper_id"],
        "p6_found": ["table_name", "record_id", "field"], "p7_found": ["paper_id", "arxiv_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
    }
    known = queries.queries()
    for name, columns in want.items():
        df = known[name](spark, sf)
        assert df.columns == columns
        assert df.count() == df.distinct().count() if name != "p8_ids" else df.count() == 100
