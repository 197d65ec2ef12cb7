"""Matching preprints to papers, and whether a title was published: blocked set-similarity joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.functions.stats import exclusive_percentile
from lumenbib.functions.text import DEFAULT_MONTH, author_key, jaccard, lag_days, normalize_author, parse_authors, squeeze_title, title_tokens

TITLE_THRESHOLD, SHARED_AUTHORS, OUTCOME_THRESHOLD = 0.55, 1, 0.6
#: Counters of hashed words that order the words of titles from rare to frequent.
BUCKETS = 8192
#: 64-bit words of the bits by which titles are compared first.
BIT_WORDS = 2


def name_keys(rows: DataFrame, key: str, names: Column, keyed=author_key) -> DataFrame:
    """Distinct ``(key, k)``. Names are normalised once each, then joined back by the name, so a frequent one costs one call."""
    exploded = rows.select(key, F.explode(names).alias("_name"))
    distinct = exploded.select("_name").distinct().withColumn("k", keyed(normalize_author(F.col("_name"))))
    return exploded.join(distinct.where("k <> ''"), "_name").select(key, "k").distinct()


def author_blocked_pairs(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(paper_id, arxiv_id, shared)``: pairs with a common author key and the sorted keys."""
    p = name_keys(papers, "paper_id", parse_authors(F.col("authors")))
    x = name_keys(preprints, "arxiv_id", F.col("authors"))
    pairs = p.join(x, "k").groupBy("paper_id", "arxiv_id")
    return pairs.agg(F.array_sort(F.collect_set("k")).alias("shared_authors"))


def author_blocks(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(k, papers, preprints)``: how many records of each side an author key joins, without the pairs themselves."""
    sides = [name_keys(papers, "paper_id", parse_authors(F.col("authors"))), name_keys(preprints, "arxiv_id", F.col("authors"))]
    left, right = (side.groupBy("k").agg(F.count("*").alias(name)) for side, name in zip(sides, ("papers", "preprints"), strict=True))
    return left.join(right, "k")


def find_matches(
    papers: DataFrame, preprints: DataFrame, months: dict[str, int] | None = None, title_threshold: float = TITLE_THRESHOLD, shared: int = SHARED_AUTHORS
) -> DataFrame:
    """Pairs with ``shared`` authors and alike titles, with the lag from submission to the venue's month.

    Records meet by author key and carry their words, so that titles are compared inside the join: a prolific author
    costs bit counts, and no pair but a match is ever written.
    """
    once = preprints.dropDuplicates(["arxiv_id"])
    left = _authored(papers, "paper_id", parse_authors(F.col("authors")), "p")
    right = _authored(once, "arxiv_id", F.col("authors"), "x")
    pairs = left.join(right, "k").where(_alike("p", "x", title_threshold)).groupBy("paper_id", "arxiv_id", _likeness("p", "x").alias("title_similarity"))
    pairs = pairs.agg(F.array_sort(F.collect_set("k")).alias("shared_authors")).where(F.size("shared_authors") >= shared)
    month: Column = F.lit(DEFAULT_MONTH)
    if months:
        known = F.create_map(*[F.lit(v) for pair in months.items() for v in pair])
        month = F.coalesce(F.try_element_at(known, F.col("venue")), F.lit(DEFAULT_MONTH))
    pt = papers.select("paper_id", "title", "year", F.col("event").alias("venue"))
    xt = once.select("arxiv_id", F.col("title").alias("preprint_title"), F.col("submitted_at").alias("submitted"))
    return pairs.join(pt, "paper_id").join(xt, "arxiv_id").select(
        "paper_id", "arxiv_id", "title", "preprint_title", "title_similarity", "shared_authors", lag_days(F.col("submitted"), F.col("year"), month).alias("lag_days"), "year", "venue", "submitted"
    )


def ordered_matches(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("title_similarity"), "paper_id", "arxiv_id")


def one_per_paper(matches: DataFrame, best: bool = False) -> DataFrame:
    """One match per paper: by default the least similar one, which is what the study reports; or the best."""
    by = F.desc("title_similarity") if best else F.asc("title_similarity")
    w = Window.partitionBy("paper_id").orderBy(by, "arxiv_id")
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_matches(matches: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` papers with the most similar preprints."""
    return one_per_paper(matches, best=True).orderBy(F.desc("title_similarity"), "paper_id").limit(k)


def lag_quantiles(matches: DataFrame) -> DataFrame:
    """Exclusive quantiles of the lag, one value per matched paper.

    The exact quantile needs the sorted values: counts per distinct lag are gathered instead of rows, and
    lags are whole days, so their number is bounded by the span of years and not by the matches.
    """
    counts = one_per_paper(matches).groupBy("lag_days").agg(F.count("*").alias("n"))
    lists = counts.agg(F.array_sort(F.collect_list(F.struct("lag_days", "n"))).alias("h"), F.max("lag_days").alias("max"), F.sum("n").alias("n"))
    sums = "transform(sequence(1, size(h)), i -> named_struct('v', h[i - 1].lag_days, 'to', aggregate(slice(h, 1, i), 0L, (s, x) -> s + x.n)))"
    lists = lists.where("n >= 1").withColumn("c", F.expr(sums))

    def at(rank: Column) -> Column:
        return F.get(F.filter("c", lambda x: x["to"] >= rank), F.lit(0))["v"].cast("double")

    out = []
    for p in (25, 50, 75, 90):
        j = F.greatest(F.lit(1), F.least(F.floor(F.lit(p) * (F.col("n") + 1) / 100), F.col("n") - 1))
        d = F.lit(p) * (F.col("n") + 1) - j * 100
        out.append(F.when(F.col("n") >= 2, (at(j) * (100 - d) + at(j + 1) * d) / 100).alias(f"p{p}"))
    return lists.select("n", *out, F.col("max"))


def small_quantiles(values: DataFrame, column: str) -> DataFrame:
    """The same quantiles for a column of few rows."""
    a = values.agg(F.array_sort(F.collect_list(column)).alias("a"))
    return a.select(*[exclusive_percentile(F.col("a"), p).alias(f"p{p}") for p in (25, 50, 75, 90)])


def match_rate(matches: DataFrame, cohort: DataFrame) -> DataFrame:
    found = matches.agg(F.count_distinct("paper_id").alias("matched"))
    return cohort.agg(F.count("*").alias("cohort")).join(F.broadcast(found)).withColumn("rate", F.when(F.col("cohort") > 0, F.col("matched") / F.col("cohort")).otherwise(0.0))


def venue_rates(matches: DataFrame, papers: DataFrame) -> DataFrame:
    """Per venue matched papers against all its papers, those without title or authors included."""
    found = matches.groupBy(F.col("venue").alias("event")).agg(F.count_distinct("paper_id").alias("matched"))
    all_ = papers.where("event is not null").groupBy("event").agg(F.count("*").alias("total"))
    return all_.join(found, "event", "left").select("event", F.coalesce("matched", F.lit(0)).alias("matched"), "total", (F.coalesce("matched", F.lit(0)) / F.col("total")).alias("rate"))


def early_signal_study(papers: DataFrame, preprints: DataFrame, events: list[str], years: list[int]) -> DataFrame:
    """``(cohort, matched, median_lag)`` of the papers of some events and years that had a preprint."""
    chosen = papers.where(F.col("event").isin(*events) & F.col("year").isin(*years) & F.col("title").isNotNull() & F.col("authors").isNotNull())
    found = one_per_paper(find_matches(chosen, preprints))
    counts = found.groupBy("lag_days").agg(F.count("*").alias("n"))
    summary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"), F.percentile("lag_days", F.lit(0.5), F.col("n")).alias("median_lag"))
    return chosen.agg(F.count("*").alias("cohort")).join(F.broadcast(summary))


def _worded(rows: DataFrame, tokens: Column, tag: str) -> DataFrame:
    """``rows`` with the words of a title as one text, their number and the bits of their set."""
    n, words, bits = f"{tag}_n", f"{tag}_w", [f"{tag}_b{i}" for i in range(BIT_WORDS)]
    out = rows.withColumn(words, tokens).withColumn(n, F.size(words))
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(64 * BIT_WORDS))
    setting = lambda i: lambda b, w: F.when(F.floor(place(w) / 64) == i, b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(w), F.lit(64)).cast("int")))).otherwise(b)
    for i, b in enumerate(bits):
        out = out.withColumn(b, F.aggregate(words, F.lit(0).cast("long"), setting(i)))
    return out.withColumn(words, F.array_join(words, " "))


def _authored(rows: DataFrame, key: str, names: Column, tag: str) -> DataFrame:
    """``(key, k)`` and the words of the title, a row for each name that has a key."""
    own = _worded(rows.select(key, names.alias("_names"), F.col("title").alias("_title")), title_tokens(F.col("_title")), tag).drop("_title")
    normal = own.withColumn("_name", F.explode("_names")).withColumn("_name", normalize_author(F.col("_name")))
    # Exploded, not filtered: a condition on the key would move below and normalise every name again.
    return normal.withColumn("k", F.explode(F.filter(F.array(author_key(F.col("_name"))), lambda k: k != ""))).drop("_names", "_name")


def _likeness(a: str, b: str) -> Column:
    return jaccard(F.split(F.col(f"{a}_w"), " "), F.split(F.col(f"{b}_w"), " "))


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether two titles are at least ``threshold`` alike.

    Sizes and bits come first and lose no pair: words that the titles do not share are at least as many as the bits in
    which they differ, and at the threshold no more than ``(1 - t) / (1 + t)`` of both.
    """
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}_b{i}").bitwiseXOR(F.col(f"{b}_b{i}"))) for i in range(BIT_WORDS)])
    near = (na > 0) & (nb > 0) & (na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9) & (differ <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    return F.when(near, _likeness(a, b) >= threshold).otherwise(F.lit(False))


def title_pairs(left: DataFrame, right: DataFrame, threshold: float = OUTCOME_THRESHOLD) -> DataFrame:
    """``(l, r, similarity)`` of titles at least ``threshold`` alike, once for each rare word by which they meet; each side is ``(id, title)``.

    Exact, by prefix, length and bit filters: tokens are ordered from rare to frequent, and of each title only the
    first ``n - ceil(t n) + 1`` are joined, so that frequent words build no blocks. Rows carry their words and are
    compared inside the join, so that candidates are never written. The order is by counts of hashed words, of which
    the driver holds ``BUCKETS``; any order loses no pair.
    """
    l = left.select(F.col("id").alias("l"), title_tokens(F.col("title")).alias("t"))  # noqa: E741
    r = right.select(F.col("id").alias("r"), title_tokens(F.col("title")).alias("t"))
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")
    seen = l.select(F.explode("t").alias("t")).unionByName(r.select(F.explode("t").alias("t"))).groupBy(bucket(F.col("t")).alias("b")).agg(F.count("*").alias("f"))
    held = {row.b: row.f for row in seen.collect()}
    counts = F.split(F.lit(",".join(str(held.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<bigint>")

    def prefixes(side: DataFrame, key: str) -> DataFrame:
        rows = _worded(side, F.col("t"), key)
        rare = F.array_sort(F.transform("t", lambda t: F.struct(F.get(counts, bucket(t)).alias("f"), t.alias("t"))))
        n = F.col(f"{key}_n")
        return rows.withColumn("t", F.explode(F.slice(rare, F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")))).withColumn("t", F.xxhash64("t.t"))

    return prefixes(l, "l").join(prefixes(r, "r"), "t").where(_alike("l", "r", threshold)).select("l", "r", _likeness("l", "r").alias("similarity"))


def title_join(left: DataFrame, right: DataFrame, threshold: float = OUTCOME_THRESHOLD) -> DataFrame:
    """``(l, r, similarity)`` of titles at least ``threshold`` alike; each side is ``(id, title)``."""
    return title_pairs(left, right, threshold).distinct()


def agreement(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Rows whose likeness reaches the threshold; no likeness counts as 0. ``pairs (source, similarity)``."""
    return pairs.groupBy("source").agg(F.count_if(F.coalesce("similarity", F.lit(0.0)) >= threshold).alias("agree"), F.count("*").alias("n"))


def title_year_match(left: DataFrame, right: DataFrame, years: int = 1) -> DataFrame:
    """``(id, match)``: for each left row the first right row with the same squeezed title at most ``years`` apart.

    Both sides are ``(id, title, year)``. The join is on the title; the year is a residual, and the first
    match is the smaller id, taken by a grouped minimum.
    """
    key = squeeze_title(F.col("title"))
    l = left.select("id", key.alias("k"), F.col("year").alias("ly")).where("k <> ''")  # noqa: E741
    r = right.select(F.col("id").alias("rid"), key.alias("k"), F.col("year").alias("ry"))
    return l.join(r, "k").where(F.abs(F.col("ly") - F.col("ry")) <= years).groupBy("id").agg(F.min("rid").alias("match"))
