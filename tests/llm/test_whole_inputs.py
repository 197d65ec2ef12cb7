"""Texts of any length, names in any writing, hot families and items in any number of blocks: nothing is cut off or dropped."""

import itertools
import random
import string

import pytest
from pyspark.sql import functions as F

from lumenbib.llm import chunking, confusables, leakage, linkage, minhash, names, residue, truncation


def authors(spark, *given):
    papers = spark.createDataFrame([(str(i), n) for i, n in enumerate(given)], "paper_id string, authors string")
    return papers, spark.createDataFrame([], "arxiv_id string, authors array<string>")


def linked(spark, *given):
    return sorted(tuple(r) for r in names.found(*authors(spark, *given)).collect())


# --- 1 -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("family", ["Nguyễnhara", "Popescuș", "O’Brienson", "Петровский", "Παπαδάκης", "Nguyenhara", "O'Brienson"])
def test_names_in_any_writing_are_linked(spark, family):
    assert linked(spark, f"Kenji {family}", f"K. {family}") == [tuple(sorted([f"Kenji {family}", f"K. {family}"]))]


def test_cases_of_problem_6_stay_out(spark):
    assert linked(spark, "Kenji Brimahikai", "K. Brimаhikai", "Ｋ. Brimahikai", "Kenji Brimahi​kai") == []


def test_short_families_with_one_typing_error(spark):
    assert linked(spark, "Kenji Wong", "Kenji Wogn") == [("Kenji Wogn", "Kenji Wong")]
    assert linked(spark, "Kenji Sato", "Kenji Satoo") == [("Kenji Sato", "Kenji Satoo")]
    # Two usual short families share few of their given names, so those they share are two people's.
    rng = random.Random(2)
    given = ["".join(rng.sample(string.ascii_lowercase, 6)).capitalize() for _ in range(20)]
    assert linked(spark, *[f"{g} Wang" for g in given[:12]], *[f"{g} Yang" for g in given[10:]]) == []


def test_segment_join_against_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(150)}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        one = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"}
        return b in one | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}

    df = spark.createDataFrame([("x", w) for w in words] + [("y", w) for w in sorted(words)[:40]], "block string, w string")
    got = {tuple(r) for r in names.segment_join(df, ["block"], "w").collect()}
    pairs = lambda block, some: {(block, a, b) for a, b in itertools.combinations(sorted(some), 2) if near(a, b)}
    assert got == pairs("x", words) | pairs("y", sorted(words)[:40])


def test_hot_family_is_not_paired_with_itself(spark):
    rng = random.Random(3)
    given = sorted({"".join(rng.choice(string.ascii_lowercase) for _ in range(8)).capitalize() for _ in range(5000)})
    full = spark.createDataFrame([("person", "hot", g.lower(), g[0].lower()) for g in given] + [("person", "hot", "jonathan", "j"), ("person", "hot", "jon", "j"), ("person", "hot", "jonathn", "j")], "kind string, family string, given string, initial string")
    assert {(r.g, r.g2) for r in names.given_edges(full).collect()} >= {("jonathan", "jon"), ("jonathan", "jonathn")}
    met = names.segment_join(full.where("kind = 'person'"), ["family"], "given")
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and met.count() < 50


def test_learned_forms_need_a_share_of_families(spark):
    rows = [("person", f"fam{i}", g, "e") for i in range(6) for g in ("elizaveta", "lisbet")] + [("person", f"other{i}", "anna", "a") for i in range(9)] + [("person", f"fam{i}", "anna", "a") for i in range(3)]
    full = spark.createDataFrame(rows, "kind string, family string, given string, initial string")
    assert {(r.family, r.g, r.g2) for r in names.given_edges(full).collect()} == {(f"fam{i}", "elizaveta", "lisbet") for i in range(6)}


def test_organisations_meet_by_their_rarest_word(spark):
    found = linked(spark, "Krilan Security Research Lab", "Krilan Research Laboratory for Security", "Krilan Lab for Security Research, Inc", "Krilon Privacy Institute", "Krilan Systems Group")
    assert ("Krilan Research Laboratory for Security", "Krilan Security Research Lab") in found
    assert not any("Group" in a + b or "Privacy" in a + b for a, b in found)


# --- 2 -------------------------------------------------------------------------------------------------------
def test_repeated_rows_copies_and_estimate_at_scale_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [("a", text), ("a", text), ("b", text.upper()), ("c", text + " extra"), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("text", F.lit("x"))
    assert {tuple(r) for r in minhash.duplicate_pairs(df, "k", "t").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r.k: r.links for r in minhash.duplicate_groups(df, "k", "t").collect()} == {"a": 2, "b": 2, "c": 2}


# --- 4 -------------------------------------------------------------------------------------------------------
LONG_PAGE = (
    "The service is temporarily unavailable. We are sorry, but your request could not be completed at this time (error code 503). "
    "Please try again in a few minutes. If the problem persists, contact the help desk of your library and give the reference shown below. "
    "You may also clear the cache of your browser and reload. Our staff has been told and works on it. "
    "Your browser must accept cookies; enable cookies in the browser settings. Return to the start page. "
    "If you were sent here by a link, the page you requested may have moved. All rights reserved by the operator."
)
ABSTRACT = "We measure parking meters across many networks and report how operators handle key exhaustion. "


def bodies(spark, *rows):
    return spark.createDataFrame(rows, "paper_id string, title string, abstract string, ee string")


def test_long_error_page_is_found_and_long_discussion_is_not(spark):
    assert len(LONG_PAGE.split()) > 90
    more = " ".join(f"In the study of {w} meters we ask how the operators of {w} networks handle it, and that is of use to the {w} users." for w in ("parking", "water", "power", "traffic"))
    about = ABSTRACT + more + " Visitors saw 'access denied', were asked to enable JavaScript, and read that the site uses cookies. " + more
    df = bodies(spark, ("1", "Parking Meters and Key Exhaustion", LONG_PAGE, None), ("2", "Parking Meters and Key Exhaustion", about, None), ("3", None, ABSTRACT, None))
    assert [r.paper_id for r in residue.found(df).collect()] == ["1"]


def test_repetition_alone_is_enough_and_evidence_is_complete(spark):
    page = "Handle registry entry {} retired by curator; consult mirrored inventory ledger number {} instead of former locator placement today."
    rows = [(str(i), f"{w} Meters", page.format(i, i * 7), "https://h.example/a") for i, w in enumerate(("Parking", "Voting", "Tracing", "Hybrid"))]
    rows.append(("x", "Kiosks", "Error code 503. The page you requested on h.example could not be retrieved.", "https://h.example/b"))
    got = {r.paper_id: list(r.evidence) for r in residue.residue(bodies(spark, *rows)).collect()}
    assert got["0"] == ["page", "mismatch", "repeated"] and got["x"] == ["page", "notice", "mostly", "mismatch", "host"]
    assert {r.paper_id for r in residue.residue(bodies(spark, *rows), phrases=False).collect()} == {"0", "1", "2", "3"}


# --- 5 -------------------------------------------------------------------------------------------------------
def test_long_unusual_ends_are_complete(spark, sf):
    p = spark.read.parquet(f"{sf}/papers.parquet")
    bad = residue.found(p)
    whole = [r for r in p.select("paper_id", "abstract").join(bad, "paper_id", "left_anti").where("abstract like '%.' and length(abstract) > 400").collect() if not r.abstract.endswith("..")][:60]
    keywords = ", ".join(f"keyword{w} phrase" for w in string.ascii_lowercase + "abcdef")[:575]
    link = "https://repository.example/" + "segment/" * 74 + "x"
    word = "Rindfleischetikettierungs" * 4
    rows = [(r.paper_id, r.abstract) for r in whole]
    rows += [("keywords", whole[0].abstract + " Keywords: " + keywords), ("line", whole[1].abstract.rstrip(".") + "\nIndex terms: " + keywords), ("link", whole[2].abstract + " " + link), ("dots", whole[3].abstract[:200] + "." * 90)]
    rows += [(f"l{i}", whole[10 + i].abstract + f" It met the {word}ueberwachung twice.") for i in range(2)] + [("longword", whole[12].abstract[:300] + f" and then it met the {word}")]
    got = {r.paper_id: list(r.evidence) for r in truncation.truncated(spark.createDataFrame(rows, "paper_id string, abstract string")).collect()}
    assert not {"keywords", "line", "link"} & set(got)
    assert got["dots"] == ["marker"] and "prefix" in got["longword"] and set(got) <= {"dots", "longword"}


def test_nodes_of_any_length(spark):
    one = lambda *words: spark.createDataFrame([(w,) for w in words], "w string")
    vocabulary = one("abcdefgh", "abcdxyz", "a" * 5000 + "b", "ab", "zz", "abcd", "süß")
    asked = one("abc", "abcd", "abcde", "abcdx", "abcdxyz", "a" * 4999, "a", "ab", "z", "zz", "zzz", "s", "sü", "q", "")
    assert sorted(r.w for r in truncation.trie_nodes(asked, vocabulary).collect()) == sorted(["abc", "abcd", "abcde", "abcdx", "a" * 4999, "a", "ab", "z", "s", "sü"])


# --- 6 -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["हिन्दी", "שָׁלוֹם", "ไทยได้", "x̂", "Nguyễn", "Петров", "O’Brien", "½ m²", "김철수", "ガラス"])
def test_other_writings_are_no_cases(text):
    form, looks, classes, suspects, twins = confusables.analyse(text)
    assert form == text and not classes and looks == confusables.skeleton(form)


@pytest.mark.parametrize(("text", "form"), [("ℋilbert", "Hilbert"), ("Ⅳ", "IV"), ("ǆ", "dž"), ("a‐b", "a-b"), ("①", "1"), ("é", "é"), ("ﬃ", "ffi")])
def test_styled_characters_are_unified(text, form):
    assert confusables.analyse(text)[0] == form
    assert confusables.skeleton(text) == confusables.skeleton(form)


def test_only_changes_that_look_alike_make_a_case(spark):
    values = ["‐", "a‐b", "O’Neil", "O'Neil", "Ｏ'Neil", "ᴀb"]
    df = confusables.consistent_forms(spark.createDataFrame([(v,) for v in values], "value string"))
    got = {r.value: (r.affected, r.skeleton) for r in df.collect()}
    assert {v for v, (hit, _) in got.items() if hit} == {"Ｏ'Neil"}
    assert got["O’Neil"][1] == got["O'Neil"][1] and got["a‐b"][1] == "a-b"


# --- 7 -------------------------------------------------------------------------------------------------------
def test_hot_title_meets_by_names(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT_PAIRS", 100)
    n = 40
    who = lambda i: f"Ann{chr(97 + i % 26)}{chr(97 + i // 26)} Brimo{chr(97 + i % 26)}{chr(97 + i // 26)}kel"
    p = spark.createDataFrame([(str(i), "Editorial remarks on many matters", who(i), None, 2020, None) for i in range(n)] + [("bare", "Editorial remarks on many matters", None, None, 2020, None)], "paper_id string, title string, authors string, abstract string, year int, ee string")
    x = spark.createDataFrame([(str(i), "Editorial remarks on many matters", [who(i)], "2019-05-01T00:00:00Z", None, None) for i in range(n)], "arxiv_id string, title string, authors array<string>, submitted_at string, doi string, summary string")
    got = {(r.paper_id, r.arxiv_id) for r in linkage.found(p, x).collect()}
    assert got == {(str(i), str(i)) for i in range(n)} | {("bare", str(i)) for i in range(n)}
    monkeypatch.setattr(linkage, "HOT_PAIRS", 10**9)
    assert {(r.paper_id, r.arxiv_id) for r in linkage.found(p, x).collect()} == got


def test_rules_say_how_many_labels_they_have(spark):
    p = spark.createDataFrame([("1", "One title of a kind", "Ann Brimokel", None, 2020, "https://doi.org/10.1234/x")], "paper_id string, title string, authors string, abstract string, year int, ee string")
    x = spark.createDataFrame([("a", "One title of a kind", ["Ann Brimokel"], "2019-05-01T00:00:00Z", "10.1234/X", None)], "arxiv_id string, title string, authors array<string>, submitted_at string, doi string, summary string")
    row = linkage.cascade(p, x).first()
    assert (row.rule, row.labelled) == ("title_authors", 1) and row.confidence == pytest.approx(2 / 3)


# --- 9 -------------------------------------------------------------------------------------------------------
def test_items_in_blocks_give_the_same_rows(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(80)]
    made = lambda i: f"In the ledger, {words[i].capitalize()} moved {i} of {i * 3 + 7} tokens to {words[-i - 1].capitalize()} within {i + 2} ms and then " + " ".join(rng.sample(words[30:50], 14)) + "."
    passages = [made(i) for i in range(30)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    docs = [(i, f"Before it. {p.upper()} After it.") for i, p in enumerate(passages)] + [(100 + i, p.replace(words[i].capitalize(), "Volkrimex").replace(words[-i - 1].capitalize(), "Zanterol")) for i, p in enumerate(passages)]
    docs += [(500, " ".join(passages)), (501, None), (502, ""), (503, "word " * 300_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    one = {tuple(r) for r in leakage.matches(df, items).collect()}
    many = {tuple(r) for r in leakage.matches(df, items, block_chars=400).collect()}
    assert one == many
    found = {tuple(r) for r in leakage.found(df, items).collect()}
    assert found == {(i, i) for i in range(30)} | {(500, i) for i in range(30)}
    assert {(100 + i, i) for i in range(30)} <= {(r.doc_id, r.item_id) for r in leakage.reparameterised(df, items).collect()}


# --- 10 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("count", "size"), [(20, 700), (60, 700), (120, 700), (5, 1023), (3, 5000)])
def test_pieces_end_at_boundaries_if_they_hold_one(count, size):
    data = b" ".join([b"x" * size] * count)
    ends = list(range(1, len(data) + 1))
    cuts, marks, last = chunking.cut_points(data, ends), chunking.Boundaries(data), 0
    for c in cuts:
        start = last - chunking.OVERLAP if last else 0
        assert last < c <= start + chunking.LIMIT
        if marks.strength(ends[c - 1]) <= 0:
            assert all(marks.strength(ends[k - 1]) <= 0 for k in range(last + 1, min(start + chunking.LIMIT, len(data)) + 1))
        last = c
    assert cuts[-1] == len(data)


def test_sentence_end_far_before_the_cut():
    data = b"It ends here." + b" " * 500 + b"And goes on"
    assert chunking.Boundaries(data).strength(300) == 3 and chunking.Boundaries(b'He said "no."' + b")" * 30 + b" Then").strength(43) == 3
