"""Problem 1: spellings that mean the same person or organisation.

Method: pigeonhole segment join. A name with at most k edits keeps one of its k+1 segments, so each name is cut into
segments, looked up position-shifted in an inverted index of segments, and verified by a banded edit distance. What is
accepted is one typing error: a letter too many, missing or other, or two letters turned round, which counts as two
edits; so k is 2, and lengths and places shift by one. Families meet in such a join among names with the same first
initial, given names among those of one family, own names of organisations among organisations. What varies besides
edits (order, initials, nicknames, abbreviations, numbers) is parsed away first.

All joins run on distinct names, families and givens, not on records, and no step pairs all givens of a family.
Spellings of one entity are found as components of a sparse graph of full names; initials hang on a component only if
exactly one fits, so they never merge two people. Cases, defined: null and empty names and pieces that stand for others
have no partner; repeated names count once; names that are cases of problem 6 are left out, others in any writing are
kept; a name of one or two letters has no edited form.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.llm.confusables import consistent_forms
from lumenbib.operators.graph import connected_components
from lumenbib.session import cut

#: Edits that a name may carry. One transposition is two of them, so k is 2 and a name has 3 segments.
EDITS = 2
#: Families below this length are alike only if the given names of the rarer one mostly stand with the other too: short
#: names that differ by a letter are more often two names than one.
SHORT_FAMILY = 5
#: Given names that occur with a family: the share of the rarer one's families that the two must have in common.
TOGETHER = 0.5
#: Families in common from which two given names are taken for forms of one name although they differ much.
LEARNED = 4

# Pieces that stand for further or unknown authors, and such remarks at the end of a name.
REMARK = r"(?i)(?:^|\s)(?:et\.?\s*al\.?|and (?:\d+ )?others?|and (?:\d+ )?more|u\.\s?a\.)\s*$|^\s*(?:unknown|anonymous|anon\.?|n\.?\s?n\.?|none|null|n/a|tba|tbd|others?|various|\W*)\s*$"
# Words that make a name one of an organisation, each with its usual short forms.
ORG_WORDS = {
    "institute": "inst", "laboratory": "lab labs laboratories", "group": "grp gp", "collective": "coll", "consortium": "consort cons", "initiative": "init",
    "center": "centre ctr", "university": "univ", "department": "dept", "association": "assoc", "foundation": "found", "society": "soc", "alliance": "all",
    "team": "", "network": "netw", "council": "", "committee": "comm", "agency": "", "project": "proj",
}
# Words that say what an organisation works on, each with its usual short forms.
FIELD_WORDS = {
    "working": "wkg wrkg", "research": "res rsch", "security": "sec", "privacy": "priv", "systems": "sys syst", "verification": "verif", "science": "sci",
    "technology": "tech technol", "computing": "comput", "software": "softw", "engineering": "eng engr", "national": "natl", "international": "intl",
    "information": "inf info", "cryptography": "crypto", "data": "", "networks": "", "safety": "", "trust": "", "assurance": "", "analysis": "anal",
}
_SMALL = ("the", "of", "for", "and", "on", "in", "at")
# Given names and their usual short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck", "christopher": "chris kit",
    "daniel": "dan danny", "deborah": "deb debbie debby", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lisa", "francisco": "paco pancho cisco",
    "frederick": "fred freddy", "giuseppe": "beppe peppe", "gregory": "greg", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes johan",
    "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate kathy katie kat", "margaret": "maggie meg peggy", "matthew": "matt",
    "maximilian": "max", "michael": "mike mick mickey", "nicholas": "nick nico", "patricia": "pat patty trish tricia", "rebecca": "becca becky", "richard": "rick dick rich",
    "robert": "rob bob bobby", "samuel": "sam", "stephen": "steve", "steven": "steve", "susan": "sue susie", "theodore": "theo ted teddy", "thomas": "tom tommy",
    "timothy": "tim", "victoria": "vicky tori", "william": "will bill billy", "david": "dave", "ronald": "ron", "kenneth": "ken", "lawrence": "larry", "peter": "pete",
    "philip": "phil", "raymond": "ray", "gerald": "gerry", "catherine": "cathy kate", "barbara": "barb", "dorothy": "dot", "john": "jack johnny", "henry": "harry hank",
}


def spellings(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(name)``: distinct spellings as stored, without foreign-character cases and without remarks."""
    own = papers.select(F.explode(F.split("authors", ", ")).alias("name"))
    other = preprints.select(F.explode("authors").alias("name"))
    names = own.unionByName(other).where(F.col("name").isNotNull() & ~F.col("name").rlike(REMARK)).distinct()
    return consistent_forms(names, "name").where(~F.col("affected")).select("name")


def _org_map() -> dict[str, str]:
    out = {}
    for word, short in {**ORG_WORDS, **FIELD_WORDS}.items():
        out[word] = word
        out |= {s: word for s in short.split()}
    return out


_LETTER = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ß": "ss", "æ": "ae", "œ": "oe"}


def _plain(text: str) -> str:
    """Lower case without marks; letters with a stroke become the plain ones."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(_LETTER.get(c, c) for c in bare)


def _near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or transposition lies between two words."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or x[:2] == y[1::-1] and x[2:] == y[2:]


def read_name(name: str, table: dict[str, str]) -> tuple:
    """``(number, org, family, words, comma)`` of one spelling.

    For an organisation ``family`` is its own name and ``words`` the sorted known words; for a person ``words`` are
    the name's words in order, and ``family`` is set only if a comma tells it.
    """
    number = m.group(1) if (m := re.search(r"\s(\d{4})$", name)) else None
    last, comma, first = re.sub(r"\s+\d{4}$", "", name).partition(",")
    split = lambda s: [w for w in re.split(r"[\s.]+", _plain(s)) if any(c.isalpha() for c in w)]
    words, family = split(first if comma else last), split(last) if comma else []
    every = words + family
    heads = {w for word, short in ORG_WORDS.items() for w in (word, *short.split())}
    org = len(every) >= 2 and any(w in heads for w in every)
    if not org and number is None and len(every) >= 3:
        org = any(len(w) >= 5 and any(_near(w, h) for h in ORG_WORDS) for w in every)
    if not org:
        return number, False, "".join(family), words, bool(comma)
    known, own = set(), []
    for w in every:
        if w in _SMALL:
            continue
        found = table.get(w) or next((v for v in table if len(v) >= 5 and _near(v, w)), None)
        known.add(table[found]) if found else own.append(w)
    return number, True, "".join(own), sorted(known), bool(comma)


_READ = T.StructType(
    [T.StructField("number", T.StringType()), T.StructField("org", T.BooleanType()), T.StructField("family", T.StringType()), T.StructField("w", T.ArrayType(T.StringType())), T.StructField("comma", T.BooleanType())]
)


@F.pandas_udf(_READ)
def _read(names: pd.Series) -> pd.DataFrame:
    table = _org_map()
    return pd.DataFrame([read_name(n, table) for n in names], columns=["number", "org", "family", "w", "comma"])


def _same_letters(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or transposition turns ``a`` into ``b``; the distance is banded."""
    d = F.levenshtein(a, b, EDITS)
    turned = F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (d >= 0) & ((d <= 1) | F.when((d == 2) & (F.length(a) == F.length(b)) & _same_letters(a, b), turned).otherwise(False))


def parse(names: DataFrame) -> DataFrame:
    """``(name, kind, number, family, given, initial)`` of each spelling.

    kind is ``org`` or ``person``. For a person ``given`` is the joined full given names ('' if only initials) and
    ``initial`` the first letter; for an organisation ``family`` is its own name and ``given`` its sorted words.
    """
    read = cut(names.select("name", _read(F.col("name")).alias("r")).select("name", "r.*"))
    orgs = read.where("org").select("name", F.lit("org").alias("kind"), "number", "family", F.array_join("w", " ").alias("given"), F.lit("org").alias("initial"))
    people = _oriented(read.where("not org and (size(w) > 0 or family <> '')"))
    letters = lambda t: F.translate(t, "-‐'’", "")
    full = F.filter("g", lambda t: F.length(F.translate(t, "-", "")) >= 2)
    spelt = F.filter(full, lambda t: ~t.rlike("^.-.$"))
    people = people.select(
        "name", F.lit("person").alias("kind"), "number", letters(F.col("family")).alias("family"),
        letters(F.array_join(spelt, "")).alias("given"), F.coalesce(F.left(F.get("g", F.lit(0)), F.lit(1)), F.lit("")).alias("initial"),
    )
    return orgs.unionByName(people).where("family <> ''")


def _oriented(people: DataFrame) -> DataFrame:
    """``(name, number, family, g)``: the family name and the given words of persons.

    A comma decides; then an initial cannot be a family name; then the words' habits do: how often each stands
    first and last over all distinct spellings. Two last words are one family if they occur hyphenated.
    """
    initial_last = (F.size("w") > 1) & (F.length(F.element_at("w", -1)) == 1)
    turned = F.concat(F.filter("w", lambda t: F.length(t) == 1), F.filter("w", lambda t: F.length(t) > 1))
    free = people.where("not comma").select("name", "number", F.when(initial_last, turned).otherwise(F.col("w")).alias("w"))
    told = people.where("comma").select("name", "number", "family", F.col("w").alias("g"))
    ends = free.where("size(w) > 1").select(
        F.explode(F.array(F.struct(F.element_at("w", 1).alias("t"), F.lit(1).alias("f")), F.struct(F.element_at("w", -1).alias("t"), F.lit(0).alias("f")))).alias("e")
    )
    habits = ends.groupBy(F.col("e.t").alias("t")).agg(F.log((F.sum("e.f") + 0.5) / (F.sum(1 - F.col("e.f")) + 0.5)).alias("habit"))
    double = free.select(F.explode("w").alias("c")).where("c like '%-%'").select(F.replace("c", F.lit("-"), F.lit("")).alias("c")).distinct()
    two = F.when(F.size("w") >= 3, F.concat(F.element_at("w", -2), F.element_at("w", -1)))
    rows = free.withColumns({"a": F.element_at("w", 1), "b": F.element_at("w", -1), "c": two})
    rows = rows.join(habits.select(F.col("t").alias("a"), F.col("habit").alias("ha")), "a", "left")
    rows = rows.join(habits.select(F.col("t").alias("b"), F.col("habit").alias("hb")), "b", "left")
    rows = rows.join(double.withColumn("pair", F.lit(True)), "c", "left")
    flip = (F.size("w") > 1) & (F.length("a") > 1) & (F.coalesce("ha", F.lit(0.0)) < F.coalesce("hb", F.lit(0.0)))
    return told.unionByName(
        rows.select(
            "name", "number", F.when(F.col("pair"), F.col("c")).when(flip, F.col("a")).otherwise(F.col("b")).alias("family"),
            F.when(F.col("pair"), F.expr("slice(w, 1, size(w) - 2)")).when(flip, F.expr("slice(w, 2, size(w) - 1)")).otherwise(F.expr("slice(w, 1, size(w) - 1)")).alias("g"),
        )
    )


def _cuts(length: str) -> str:
    """The segments of a name of a length as an array of (number, start, size), by integer arithmetic."""
    n = EDITS + 1
    return f"transform(sequence(0, {EDITS}), s -> named_struct('s', s, 'at', s * {length} div {n}, 'len', (s + 1) * {length} div {n} - s * {length} div {n}))"


def segment_join(values: DataFrame, within: list[str], value: str) -> DataFrame:
    """``(within..., v, v2)`` of values one typing error apart, ``v < v2``: the pigeonhole segment join.

    Segments of the one are looked up among the substrings of the other at starts shifted by one, which is what one
    edit before them can move; lengths may differ by one. Nothing is compared that shares no segment at its place, so
    a group of ``within`` is never paired with itself. Values of fewer than three letters have no three segments.
    """
    base = values.select(*within, F.col(value).alias("v")).distinct().where(F.length("v") > EDITS)
    piece = lambda shift: f"substring(v, c.at + {shift} + 1, c.len)"
    index = base.select(*within, "v", F.length("v").alias("n"), F.explode(F.expr(_cuts("length(v)"))).alias("c"))
    index = index.select(*within, "v", "n", F.col("c.s").alias("s"), F.expr(piece(0)).alias("seg"))
    # For every length the other name may have, its segments' places, shifted by what the edits before may move.
    probe = base.select(*within, F.col("v"), F.explode(F.expr(f"sequence(greatest(length(v) - 1, {EDITS + 1}), length(v) + 1)")).alias("n"))
    probe = probe.select(*within, "v", "n", F.explode(F.expr(_cuts("n"))).alias("c")).select(*within, "v", "n", "c", F.explode(F.expr("sequence(-1, 1)")).alias("d"))
    probe = probe.where("c.at + d >= 0 and c.at + d + c.len <= length(v)").select(*within, F.col("v").alias("v2"), "n", F.col("c.s").alias("s"), F.expr(piece("d")).alias("seg"))
    met = index.join(probe.distinct(), [*within, "s", "n", "seg"]).where(one_edit(F.col("v"), F.col("v2")))
    return met.select(*within, F.least("v", "v2").alias("v"), F.greatest("v", "v2").alias("v2")).where("v < v2").distinct()


def similar_families(families: DataFrame) -> DataFrame:
    """``(f, f2)`` of families that share an initial and are one typing error apart; ``families (family, initial)``."""
    return segment_join(families, ["initial"], "family").select(F.col("v").alias("f"), F.col("v2").alias("f2")).distinct()


def _supported(near: DataFrame, full: DataFrame) -> DataFrame:
    """``near`` without pairs of short families whose given names do not mostly stand with both."""
    short = near.where(F.least(F.length("f"), F.length("f2")) < SHORT_FAMILY)
    people = full.where("kind = 'person'").select("family", "given").distinct()
    uses = people.groupBy("family").agg(F.count("*").alias("n"))
    both = short.join(people.withColumnRenamed("family", "f"), "f").join(people.withColumnRenamed("family", "f2"), ["f2", "given"]).groupBy("f", "f2").agg(F.count("*").alias("both"))
    both = both.join(uses.select(F.col("family").alias("f"), "n"), "f").join(uses.select(F.col("family").alias("f2"), F.col("n").alias("n2")), "f2")
    kept = both.where(F.col("both") / F.least("n", "n2") >= TOGETHER).select("f", "f2")
    return near.where(F.least(F.length("f"), F.length("f2")) >= SHORT_FAMILY).select("f", "f2").unionByName(kept)


def _learned(people: DataFrame, uses: DataFrame) -> DataFrame:
    """``(g, g2)`` of givens that share LEARNED families and TOGETHER of the rarer one's, however they differ.

    An exact prefix filter: such a pair shares a family among the rarest half of the rarer given's families, so only
    those are joined, and givens of fewer families not at all. The half is bounded by a quantile from above, so that
    no list of families is gathered; a family with very many givens stands in few of these halves.
    """
    often = people.join(uses.where(F.col("n") >= LEARNED), "given")
    weight = often.groupBy("family").agg(F.count("*").alias("w"))
    often = cut(often.join(weight.where("w > 1"), "family"))
    half = often.groupBy("given").agg(F.percentile_approx("w", F.lit(1 - TOGETHER / 2), F.lit(10_000)).alias("limit"))
    rare = often.join(half, "given").where("w <= limit").select("family", "given", "n")
    met = rare.join(often.select("family", F.col("given").alias("g2"), F.col("n").alias("n2")), "family")
    met = met.where("given <> g2 and n <= n2").select("given", "g2", "n").distinct()
    both = met.join(often.select("given", "family"), "given").join(often.select(F.col("given").alias("g2"), "family"), ["g2", "family"]).groupBy("given", "g2", "n").agg(F.count("*").alias("both"))
    ok = (F.col("both") >= LEARNED) & (F.col("both") / F.col("n") >= TOGETHER)
    return both.where(ok).select(F.least("given", "g2").alias("g"), F.greatest("given", "g2").alias("g2")).distinct()


def given_edges(full: DataFrame) -> DataFrame:
    """``(family, g, g2)``: given names of one family that are forms of one name.

    A typing error, found by the segment join within the family, is accepted when the rarer form seldom stands without
    the other; a nickname by table; other forms by the habit of standing with the same families.
    """
    people = cut(full.where("kind = 'person'").select("family", "given").distinct())
    uses = cut(people.groupBy("given").agg(F.count("*").alias("n")))
    typed = cut(segment_join(people, ["family"], "given"))
    share = typed.groupBy("v", "v2").agg(F.count("*").alias("both")).join(uses.select(F.col("given").alias("v"), "n"), "v").join(uses.select(F.col("given").alias("v2"), F.col("n").alias("n2")), "v2")
    ok = share.where(F.col("both") / F.least("n", "n2") >= TOGETHER).select("v", "v2")
    edits = typed.join(ok, ["v", "v2"]).select("family", F.col("v").alias("g"), F.col("v2").alias("g2"))
    # Fixed and small: each nickname with its full forms.
    table = people.sparkSession.createDataFrame([(long, short) for long, shorts in NICKNAMES.items() for short in shorts.split()], "g string, g2 string")
    nicks = people.withColumnRenamed("given", "g").join(F.broadcast(table), "g").join(people.withColumnRenamed("given", "g2"), ["family", "g2"])
    habits = _learned(people, uses).join(people.withColumnRenamed("given", "g"), "g").join(people.withColumnRenamed("given", "g2"), ["family", "g2"])
    return edits.unionByName(nicks.select("family", "g", "g2")).unionByName(habits.select("family", "g", "g2")).distinct()


def _within(orgs: DataFrame, near: DataFrame) -> DataFrame:
    """``(src, dst)`` of organisations with like own names where the known words of one are among the other's.

    The words of one are looked up by its rarest word only, among own names that are equal or one edit apart.
    """
    words = F.split("given", " ")
    weight = orgs.select(F.explode(words).alias("t")).groupBy("t").agg(F.count("*").alias("w"))
    listed = orgs.select("family", "given", F.explode(words).alias("t"))
    first = listed.join(weight, "t").groupBy("family", "given").agg(F.min_by("t", F.struct("w", "t")).alias("t"))
    same = first.select("family", "given", "t", F.col("family").alias("f2"))
    other = first.join(near.withColumnRenamed("f", "family"), "family").select("family", "given", "t", "f2")
    met = same.unionByName(other).join(listed.select(F.col("family").alias("f2"), F.col("given").alias("g2"), "t"), ["f2", "t"])
    inside = F.size(F.array_except(F.split("given", " "), F.split("g2", " "))) == 0
    node = lambda f, g: F.concat_ws("\x01", F.lit("org"), f, g)
    return met.where(inside).select(node("family", "given").alias("src"), node("f2", "g2").alias("dst")).where("src <> dst")


def entities(names: DataFrame) -> DataFrame:
    """``(name, entity)`` of every parsed spelling; spellings of one entity share it."""
    parsed = cut(parse(names))
    key = lambda f, g: F.concat_ws("\x01", "kind", f, g)
    full = cut(parsed.where("given <> ''").select("kind", "family", "given", "initial").distinct())
    near = cut(_supported(similar_families(parsed.select("family", "initial").distinct()), full))
    both = near.unionByName(near.select(F.col("f2").alias("f"), F.col("f").alias("f2")))

    # Edges between full names: other given form in one family, and one family edited under the same given name.
    person = lambda f, g: F.concat_ws("\x01", F.lit("person"), f, g)
    forms = given_edges(full).select(person("family", "g").alias("src"), person("family", "g2").alias("dst"))
    people = full.where("kind = 'person'").select("family", "given").distinct()
    edited = people.join(near.withColumnRenamed("f", "family"), "family").join(people.withColumnRenamed("family", "f2"), ["f2", "given"])
    edited = edited.select(person("family", "given").alias("src"), person("f2", "given").alias("dst"))
    orgs = _within(full.where("kind = 'org'").select("family", "given").distinct(), both)
    comps = connected_components(forms.unionByName(edited).unionByName(orgs))
    nodes = full.withColumn("node", key("family", "given")).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = cut(nodes.select("kind", "family", "given", "initial", "component"))

    # Initials: the one component of the family, or else of a family one edit away, that has this initial.
    short = parsed.where("given = '' and kind = 'person'").select("family", "initial").distinct()
    people_nodes = nodes.where("kind = 'person'").select("family", "initial", "component").distinct()
    direct = short.join(people_nodes, ["family", "initial"])
    direct = direct.groupBy("family", "initial").agg(F.min("component").alias("component"), F.count_distinct("component").alias("n"))
    left = short.join(direct, ["family", "initial"], "left_anti")
    around = left.join(both.withColumnRenamed("f", "family"), "family").join(people_nodes.withColumnRenamed("family", "f2"), ["f2", "initial"])
    around = around.groupBy("family", "initial").agg(F.min("component").alias("component"), F.count_distinct("component").alias("n"))
    placed = direct.unionByName(around).where("n = 1").select("family", "initial", "component")
    initials = parsed.where("given = '' and kind = 'person'").join(placed, ["family", "initial"], "left")
    initials = initials.select("name", "number", F.coalesce("component", F.concat_ws("\x01", "kind", "family", "initial")).alias("component"))
    fulls = parsed.where("given <> ''").join(nodes.select("kind", "family", "given", "component"), ["kind", "family", "given"]).select("name", "number", "component")
    bare_orgs = parsed.where("given = '' and kind = 'org'").select("name", "number", F.concat_ws("\x01", "kind", "family").alias("component"))
    placed_all = cut(fulls.unionByName(initials).unionByName(bare_orgs))

    # Numbers tell namesakes apart; a name without one belongs to the only number, if there is only one.
    numbers = placed_all.where("number is not null").groupBy("component").agg(F.min("number").alias("only"), F.count_distinct("number").alias("numbers"))
    joined = placed_all.join(numbers, "component", "left")
    suffix = F.coalesce("number", F.when(F.coalesce("numbers", F.lit(0)) == 1, F.col("only")).otherwise(""))
    return joined.select("name", F.concat_ws("\x01", "component", suffix).alias("entity"))


def pairs(names: DataFrame) -> DataFrame:
    """``(name_a, name_b)`` of different spellings of one entity, ``name_a < name_b``."""
    e = cut(entities(names))
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def found(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(name_a, name_b)`` over ``papers.authors`` and ``preprints.authors``."""
    return pairs(spellings(papers, preprints))
