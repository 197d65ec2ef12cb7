"""Problem 7: works that appear in two tables without a common identifier.

Method: a deterministic rule cascade. Each rule is an exact join on one combination of attributes, weaker than
the one before, with a residual comparison; what a rule resolves is anti-joined from the next pass. The
confidence of a match is the smoothed precision of its rule on the pairs whose DOI tells the truth.

Both sides are reduced once to narrow key tables of ids and hashes. A paper that a rule resolves leaves the
cascade; a preprint leaves it before the blocked rule, and the last rule brings in further records of a paper. Cases,
defined: rows without an id, and preprints without a title, match nothing; a paper without authors can match by
its title alone; repeated rows and harvests count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.folding import fold
from lumenbib.session import broadcast_if_small, cut

# Remarks on the state of a manuscript that are no part of its title.
REMARKS = r"[\(\[]\s*(?:draft|preprint|pre-print|extended version|extended abstract|full version|working paper|technical report|v\d+|version \d+)\s*[\)\]]"
# Words that carry no content in a title.
STOP = "a an and as at by for from how in into is of on or the to towards toward under via with study".split()
#: Title likeness and author likeness that the residual comparisons ask for.
TITLE_LIKE, AUTHOR_LIKE = 0.5, 0.5
#: Pseudo-counts of the smoothed precision.
PRIOR_HITS, PRIOR_MISSES = 1.0, 1.0

#: Pairs that one key value may make; beyond it its records meet by further words.
HOT_PAIRS = 10_000
#: Hot values up to this count are broadcast; beyond it the joins on them shuffle.
MAX_BROADCAST_KEYS = 100_000

RULES = ("title_authors", "body_authors", "subtitle_authors", "title_only", "all_authors", "blocked", "sibling")


def _title(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(col), REMARKS, " "), r"[^\p{L}\p{N}]+", " "))


def _subtitle(col: Column) -> Column:
    """The title after a leading name that a colon or a spaced dash ends; the whole title if there is none."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(col), REMARKS, " "), r"^\s*\S{1,40}?(?::\s|\s[-–—]\s)", ""))


def _content(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(title, " "), lambda t: (t != "") & ~t.isin(*STOP)))


def _surnames(names: Column) -> Column:
    """For each name the part before a comma, else the last word that is no number and no initial."""
    clean = F.transform(names, lambda n: F.trim(F.regexp_replace(fold(n), r"\s+\d{4}\s*$", "")))
    last = F.transform(
        clean,
        lambda n: F.when(n.contains(","), F.substring_index(n, ",", 1)).otherwise(
            F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(n, r"\s+")), lambda t: (F.length(F.replace(t, F.lit("."), F.lit(""))) > 2) | (t == "")), -1)
        ),
    )
    return F.array_distinct(F.filter(F.transform(last, lambda t: F.regexp_replace(t, r"[^\p{L}]", "")), lambda t: F.length(t) >= 3))


def _name_words(names: Column) -> Column:
    words = F.flatten(F.transform(names, lambda n: F.split(fold(n), r"[^\p{L}]+")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin("and", "others", "unknown")))


def _keys(df: DataFrame, key: str, title: str, names: Column, body: str, year: Column, doi: Column) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & F.col(title).isNotNull()).select(
        F.col(key).alias("id"),
        _title(F.col(title)).alias("title"),
        F.trim(F.regexp_replace(_subtitle(F.col(title)), r"[^\p{L}\p{N}]+", " ")).alias("subtitle"),
        _name_words(names).alias("words"),
        _surnames(names).alias("surnames"),
        F.regexp_replace(fold(F.col(body)), r"[^\p{L}\p{N}]+", " ").alias("_body"),
        year.alias("year"),
        F.lower(doi).alias("doi"),
    )
    small = lambda c: F.transform(c, lambda w: F.hash(w))
    return rows.where("title <> ''").select(
        "id", F.xxhash64("title").alias("title"), F.xxhash64("subtitle").alias("subtitle"), F.size(F.split("subtitle", " ")).alias("sub_n"),
        small(F.col("words")).alias("words"), small(F.col("surnames")).alias("surnames"), "year",
        F.when(F.col("doi").isNotNull(), F.xxhash64("doi")).alias("doi"), F.when(F.length("_body") >= 100, F.xxhash64("_body")).alias("body"),
        F.when(F.size("words") > 0, F.xxhash64(F.array_sort("words"))).alias("people"), small(_content(F.col("title"))).alias("content"),
    )


def paper_keys(papers: DataFrame) -> DataFrame:
    doi = F.nullif(F.regexp_extract("ee", r"(10\.\d{4,9}/\S+)$", 1), F.lit(""))
    names = F.split(F.coalesce("authors", F.lit("")), ", ")
    return _keys(papers, "paper_id", "title", names, "abstract", F.col("year"), doi)


def preprint_keys(preprints: DataFrame) -> DataFrame:
    year = F.expr("try_cast(left(submitted_at, 4) as int)")
    names = F.coalesce("authors", F.array().cast("array<string>"))
    keys = _keys(preprints, "arxiv_id", "title", names, "summary", year, F.col("doi"))
    return keys.distinct()


def _alike(a: str, b: str) -> Column:
    """Common elements against the shorter list; 0 where one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def _jaccard(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _near_titles(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(pid, xid)`` of all records with a surname in common whose titles can be ``TITLE_LIKE`` alike.

    A prefix filter, which loses nothing: words are ordered by the pairs they would build, those of one side only
    first, and titles alike share one of their first ``n - ceil(t n) + 1`` words. Sizes are compared in the join.
    """
    version = F.xxhash64("content", "surnames")
    p, x = (cut(df.select("id", "content", "surnames", version.alias("v")).where("size(content) > 0 and size(surnames) > 0").distinct()) for df in (papers, preprints))
    counts = lambda df, name: df.select(F.explode("content").alias("t")).groupBy("t").agg(F.count("*").alias(name))
    weight = cut(counts(p, "np").join(counts(x, "nx"), "t").select("t", (F.col("np") * F.col("nx")).alias("w")))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        words = df.select("id", "v", F.explode("content").alias("t")).join(weight, "t", "left")
        words = words.groupBy("id", "v").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("w", F.lit(0)).alias("w"), "t"))).alias("o"))
        first = F.slice("o", 1, (F.size("o") - F.ceil(F.size("o") * F.lit(TITLE_LIKE)) + 1).cast("int"))
        words = words.select("id", "v", F.size("o").alias(f"n_{name}"), F.filter(first, lambda e: e.w > 0).alias("o")).where("size(o) > 0")
        rows = words.join(df.select("id", "v", "surnames"), ["id", "v"]).select("id", f"n_{name}", "o", F.explode("surnames").alias("s"))
        return rows.select(F.col("id").alias(name), f"n_{name}", F.explode(F.expr("transform(o, e -> xxhash64(s, e.t))")).alias("b"))

    sizes = F.least("n_pid", "n_xid") >= TITLE_LIKE * F.greatest("n_pid", "n_xid")
    return blocks(p, "pid").join(blocks(x, "xid"), "b").where(sizes).select("pid", "xid").distinct()


def _exact_pairs(p: DataFrame, x: DataFrame, kinds: list[str]) -> DataFrame:
    """``(pid, xid, ks)``: records that share the value of some key, and the keys.

    A value that many records of both sides hold (a usual title, a prolific team) is not paired with itself: its
    records meet by a name in common, or under the key of names by a title word in common, without which no rule
    accepts them. Papers that have no names to share, which a title alone can match, are paired as they are.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v"), (F.col("content") if k == "people" else F.col("words")).alias("w")) for k in kinds])).alias("e")
        return df.select(F.col("id").alias(name), F.size("words").alias("n"), parts).select(name, "n", "e.k", "e.v", "e.w").where("v is not null")

    left, right = keyed(p, "pid"), keyed(x, "xid")
    sizes = [side.groupBy("k", "v").agg(F.count("*").alias(n)) for side, n in ((left, "np"), (right, "nx"))]
    hot = cut(sizes[0].join(sizes[1], ["k", "v"]).where(F.col("np") * F.col("nx") > HOT_PAIRS).select("k", "v"))
    many = hot.count()
    plain = left.select("pid", "k", "v").join(right.select("xid", "k", "v"), ["k", "v"])
    if many:
        few = broadcast_if_small(hot, many, MAX_BROADCAST_KEYS)
        left_hot, right_hot = left.join(few, ["k", "v"], "left_semi"), right.join(few, ["k", "v"], "left_semi")
        worded = lambda side, name: side.select(name, "k", "v", F.explode("w").alias("w"))
        met = worded(left_hot, "pid").join(worded(right_hot, "xid"), ["k", "v", "w"]).select("k", "v", "pid", "xid").distinct()
        bare = left_hot.where("k = 'title' and n <= 1").select("pid", "k", "v").join(right_hot.select("xid", "k", "v"), ["k", "v"])
        cool = left.select("pid", "k", "v").join(few, ["k", "v"], "left_anti").join(right.select("xid", "k", "v"), ["k", "v"])
        plain = cool.unionByName(met).unionByName(bare)
    return plain.groupBy("pid", "xid").agg(F.collect_set("k").alias("ks"))


def cascade(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(paper_id, arxiv_id, rule, confidence, labelled)`` of every match.

    confidence is the smoothed precision of the rule on the pairs whose DOI tells the truth, labelled how many they
    are; a rule with none has the precision of the prior alone, and 0 says so.

    The exact rules share one join on (rule, key) of ids only; the attributes for their residual comparisons are
    joined to the candidates once. That each paper keeps the matches of its first successful rule is what an
    anti-join after every pass leaves.
    """
    p = cut(paper_keys(papers))
    x = cut(preprint_keys(preprints))
    left = p.select(*[F.col(c).alias(f"p_{c}") for c in p.columns])
    right = x.select(*[F.col(c).alias(f"x_{c}") for c in x.columns])
    people = _alike("p_words", "x_words")
    titles = _jaccard("p_content", "x_content")
    when = F.coalesce(F.col("p_year") - F.col("x_year"), F.lit(0)).between(-2, 5)
    rules = {
        "title_authors": ("title", people >= 0.25),
        "body_authors": ("body", people >= 0.25),
        "subtitle_authors": ("subtitle", (people >= AUTHOR_LIKE) & (F.col("p_sub_n") >= 3) & when),
        "title_only": ("title", (F.size("p_words") <= 1) & (F.size("p_content") >= 4) & when),
        "all_authors": ("people", (titles >= TITLE_LIKE) & when),
    }
    pairs = _exact_pairs(p, x, sorted({on for on, _ in rules.values()}))
    both = pairs.join(left, F.col("pid") == F.col("p_id")).join(right, F.col("xid") == F.col("x_id"))
    rank = F.coalesce(*[F.when(F.array_contains("ks", on) & test, F.lit(i)) for i, (on, test) in enumerate(rules.values())])
    ranked = cut(both.select("pid", "xid", rank.alias("r")).where("r is not null").groupBy("pid", "xid").agg(F.min("r").alias("r")))
    first = ranked.groupBy("pid").agg(F.min("r").alias("r"))
    named = F.element_at(F.array(*map(F.lit, rules)), F.col("r") + 1)
    resolved = cut(ranked.join(first, ["pid", "r"]).select("pid", "xid", named.alias("rule")))

    # The blocked rule, for records that nothing has resolved: a surname in common, and titles, people and years alike.
    open_papers = p.join(resolved.select(F.col("pid").alias("id")), "id", "left_anti")
    open_preprints = x.join(resolved.select(F.col("xid").alias("id")), "id", "left_anti")
    near = _near_titles(open_papers, open_preprints)
    near = near.join(left, F.col("pid") == F.col("p_id")).join(right, F.col("xid") == F.col("x_id"))
    alike = (titles >= TITLE_LIKE) & (people >= AUTHOR_LIKE) & when
    blocked = cut(near.where(alike).select("pid", "xid", F.lit("blocked").alias("rule")).distinct())
    resolved = resolved.unionByName(blocked)

    # Further records of a matched paper: the same title and people, or the same abstract, as the matched one.
    rest = p.join(resolved.select(F.col("pid").alias("id")), "id", "left_anti")
    known = resolved.join(p.select(F.col("id").alias("pid"), "title", "people", "body", "words"), "pid")
    same_title = rest.select("id", "title", "people").join(known.select("title", "people", "xid"), ["title", "people"]).select("id", "xid")
    by_body = known.select("body", "xid", F.col("words").alias("w")).distinct()
    same_body = rest.select("id", "body", "words").join(by_body, "body").where(_alike("words", "w") >= 0.25).select("id", "xid")
    sibling = same_title.unionByName(same_body).distinct().select(F.col("id").alias("pid"), "xid", F.lit("sibling").alias("rule"))
    matches = cut(resolved.unionByName(sibling))

    labelled = matches.join(p.select(F.col("id").alias("pid"), F.col("doi").alias("pd")).where("pd is not null"), "pid").join(
        x.where("doi is not null").select(F.col("id").alias("xid"), F.col("doi").alias("xd")).distinct(), "xid"
    )
    precision = labelled.groupBy("rule").agg(
        ((F.count_if(F.col("pd") == F.col("xd")) + PRIOR_HITS) / (F.count("*") + PRIOR_HITS + PRIOR_MISSES)).alias("confidence"), F.count("*").alias("labelled")
    )
    default = PRIOR_HITS / (PRIOR_HITS + PRIOR_MISSES)
    return matches.join(F.broadcast(precision), "rule", "left").select(
        F.col("pid").alias("paper_id"), F.col("xid").alias("arxiv_id"), "rule", F.coalesce("confidence", F.lit(default)).alias("confidence"), F.coalesce("labelled", F.lit(0)).alias("labelled")
    )


def found(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(paper_id, arxiv_id)`` of the matches."""
    return cascade(papers, preprints).select("paper_id", "arxiv_id").distinct()
