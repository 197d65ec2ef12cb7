"""Problem 5: texts cut off by a field limit or in transfer.

Method: a vocabulary trie of the corpus, kept as the sorted table of its words, in which a node is a proper prefix of
the next word; a text is cut when its final token is no known word but a node of the trie, together with evidence of
length. A break between two words leaves a known word at the end, so the same pass also measures how often a
sentence ends after that word in its context, with back-off from four words to one.

Vocabulary and context counts cover all texts and come from one aggregation. A text is read whole: its end is told by
its last words, however long they are. Cases, defined: null, empty and blank texts are not cases; a text in a
script without spaces is judged by its marker, its end sign and its length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.session import broadcast_if_small, cut

# What is put after a break, or what a break inside markup, an entity or an escape leaves.
MARKER = (
    r"(?:\.{3,}|…|\[\s*(?:\.{3}|…)\s*\]|\((?:more|truncated|continued|cont\.)\)|\[(?:more|truncated|continued)\]"
    r"|(?i:\b(?:read|show|see) more|continue reading)|<[^<>\s]{0,24}|&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?|�+|>>|»)\s*$"
)
# Signs after which a text is complete, and signs that may follow them.
STOPS, CLOSERS = (".", "!", "?", "。", "！", "？"), "\"'”’»)]"
# Last signs and last tokens of complete texts that are not sentences, and what begins a list of keywords.
ODD_SIGNS = ("\"", "”", "»", ")", "]", "}")
ODD_TOKEN = r"\b[\w+.-]+://\S|\b(?:www\.|doi:)\S"
LIST_START = r"(?i)^\s*(?:key ?words|index terms|categories|subject headings)\s*[:\-—]"
#: Broadcast bound, in rows, of the word pairs whose contexts are counted; beyond it the join shuffles.
MAX_BROADCAST_PAIRS = 500_000
#: Cases of problem 4 up to this count are left out by a broadcast, beyond it by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: A length is a field limit when at least so many unfinished texts share it, that many times the median over all
#: lengths at which texts stay unfinished, and they are at least this share of all texts of the length.
SPIKE_TEXTS, SPIKE_TIMES, SPIKE_SHARE = 4, 4, 0.4
#: Below this share of sentence ends a context is one in which sentences do not end.
END_SHARE = 0.5

_TRIM = "'.,;:!?()[]{}\"“”‘’«»…*<>'"
_SPACE = " \t\n\r\f\x0b"
#: Prefixes up to so many letters are written out for each word; longer ones are found beside their next word.
SHORT_NODES = 3


def _folded(text: Column) -> Column:
    """Lower case with every digit as 0."""
    return F.translate(F.lower(text), "123456789", "000000000")


def _word(token: Column) -> Column:
    """A folded token without the signs around it."""
    return F.btrim(token, F.lit(_TRIM))


def _stops(token: Column) -> Column:
    """Whether a token ends a sentence."""
    return F.right(F.rtrim(token, F.lit(CLOSERS)), F.lit(1)).isin(*STOPS)


def _read(texts: DataFrame) -> DataFrame:
    """Each text with single spaces, ``core`` without its marker, ``marked``, ``stopped`` and ``closed`` by an end sign, and its length."""
    t = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = texts.select("id", t.alias("_t")).where("_t <> ''").select("id", "_t", F.char_length("_t").alias("n"), F.trim(F.regexp_replace("_t", r"\s+", " ")).alias("flat"))
    # A marker has at most three words, so its pattern runs over the last three, whatever their length.
    rows = rows.withColumn("_m", F.regexp_extract(F.substring_index("flat", " ", -3), MARKER, 0))
    core = F.rtrim(F.expr("left(flat, length(flat) - length(_m))"))
    rows = rows.withColumn("core", F.when(F.col("_m") == "", F.col("flat")).otherwise(core))
    # A lone digit before the last full stop may be the whole part of a number that was cut.
    digit = F.substring_index("core", " ", -1).rlike(r"^\d\.$")
    rows = rows.withColumns({"marked": F.col("_m") != "", "stopped": _stops(F.col("core"))})
    return rows.select("id", "_t", "n", "flat", "core", "marked", "stopped", (F.col("stopped") & ~digit).alias("closed"))


def _ends(texts: DataFrame) -> DataFrame:
    """``(id, n, marked, stopped, closed, odd, last)``: how each text ends, and its last four words."""
    core = F.col("core")
    sentence = F.element_at(F.split(core, r"[.!?][\"'”’»)\]]*\s+"), -1)
    listed = sentence.rlike(LIST_START) | F.substring_index("_t", "\n", -1).rlike(LIST_START)
    odd = F.right(core, F.lit(1)).isin(*ODD_SIGNS) | F.substring_index(core, " ", -1).rlike(ODD_TOKEN) | listed
    last = F.split(_folded(F.substring_index(core, " ", -4)), " ")
    return _read(texts).select("id", "n", "marked", "stopped", "closed", F.when(F.col("closed"), False).otherwise(odd).alias("odd"), F.transform(last, _word).alias("last"))


def _counts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(w, w1, w2, w3, c, e)``: how often each word stands in the corpus and ends a sentence, by one aggregation.

    The words before it are kept where ``pairs (w1, w)`` asks for them, and null elsewhere. The last token of an
    unfinished text is left out.
    """
    tokens = F.split(_folded(F.col("flat")), " ")
    whole = F.when(F.col("marked") | ~F.col("stopped"), F.expr("slice(ts, 1, size(ts) - 1)")).otherwise(F.col("ts"))
    rows = _read(texts).withColumn("ts", tokens).select(whole.alias("ts"))
    # Shifted copies side by side put the context beside each token without a function call per element.
    shifted = [F.concat(F.array(*[F.lit("")] * k), F.col("ts")).alias(f"b{k}") if k else F.col("ts").alias("b0") for k in range(4)]
    rows = rows.select(F.explode(F.arrays_zip(*shifted)).alias("z")).where("z.b0 is not null")
    rows = rows.select(_word(F.col("z.b0")).alias("w"), _word(F.col("z.b1")).alias("w1"), F.col("z.b2").alias("b2"), F.col("z.b3").alias("b3"), _stops(F.col("z.b0")).alias("ends"))
    rows = rows.where("w <> ''").join(pairs.withColumn("asked", F.lit(True)), ["w1", "w"], "left")
    kept = lambda c: F.when(F.col("asked"), c)
    return rows.groupBy("w", kept(F.col("w1")).alias("w1"), kept(_word(F.col("b2"))).alias("w2"), kept(_word(F.col("b3"))).alias("w3")).agg(
        F.count("*").alias("c"), F.count_if("ends").alias("e")
    )


def trie_nodes(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(w)`` of ``asked`` that are proper prefixes of a word of ``vocabulary``; both hold distinct ``w``.

    In a sorted table the words below a node follow it at once, so a node is a prefix of the next word. The table
    is sorted within equal first letters; nodes that are no longer than these are written out instead.
    """
    short = vocabulary.select(F.explode(F.expr(f"transform(sequence(1, greatest(1, least({SHORT_NODES}, length(w) - 1))), k -> left(w, k))")).alias("w"), F.col("w").alias("v")).where("w <> v")
    few = asked.where(F.length("w").between(1, SHORT_NODES)).join(short.select("w").distinct(), "w", "left_semi")
    both = vocabulary.select("w", F.lit(0).alias("q")).unionByName(asked.select("w", F.lit(1).alias("q"))).where(F.length("w") > SHORT_NODES)
    upwards = Window.partitionBy(F.left("w", F.lit(SHORT_NODES))).orderBy(F.desc("w"), F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("q") == 0, F.col("w")), ignorenulls=True).over(upwards)
    many = both.withColumn("_next", following).where((F.col("q") == 1) & F.startswith("_next", F.col("w"))).select("w")
    return few.unionByName(many)


def truncated(df: DataFrame, key: str = "paper_id", text: str = "abstract") -> DataFrame:
    """``(key, evidence)`` of every text that breaks off, with all its evidence in order.

    Evidence: ``marker`` (a sign of omission or broken markup after an unfinished sentence), ``prefix`` (the
    final token is only a node of the vocabulary trie), ``length`` (unfinished at a length at which unfinished
    texts pile up), ``context`` (sentences do not end after these words). ``key`` must be unique.
    """
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and trim(text) <> ''")
    ends = cut(_ends(texts))
    marker = (F.col("marked") & ~F.col("closed")).alias("marker")
    doubt = ends.where("not closed and (marked or not odd)").select(
        "id", "n", marker, "stopped",
        F.element_at("last", -1).alias("w"),
        F.expr("coalesce(get(last, size(last) - 2), '')").alias("w1"),
        F.expr("coalesce(get(last, size(last) - 3), '')").alias("w2"),
        F.expr("coalesce(get(last, size(last) - 4), '')").alias("w3"),
    )

    lengths = ends.groupBy("n").agg(
        F.count("*").alias("texts"), F.count_if(F.expr("not closed and not odd")).alias("unfinished")
    )
    lengths = lengths.where("unfinished > 0")
    usual = lengths.agg((F.percentile_approx("unfinished", 0.5) * SPIKE_TIMES).alias("usual"))
    limits = (
        lengths.join(F.broadcast(usual))
        .where((F.col("unfinished") >= F.greatest("usual", F.lit(SPIKE_TEXTS))) & (F.col("unfinished") >= SPIKE_SHARE * F.col("texts")))
        .select("n", F.lit(True).alias("at_limit"))
    )

    pairs = doubt.select("w1", "w").distinct()
    counts = cut(_counts(texts, broadcast_if_small(pairs, pairs.count(), MAX_BROADCAST_PAIRS)))
    vocabulary = counts.groupBy("w").agg(F.sum("c").alias("seen")).where("seen >= 2").select("w")
    asked = doubt.select("w").distinct()
    words = asked.join(vocabulary, "w", "left_semi").select("w", F.lit(True).alias("known"))
    prefixes = trie_nodes(asked, vocabulary).select("w", F.lit(True).alias("node"))

    contexts = counts.where("w1 is not null")
    judged = doubt
    for n, cols in ((4, ["w3", "w2", "w1", "w"]), (3, ["w2", "w1", "w"]), (2, ["w1", "w"])):
        sums = contexts.groupBy(*cols).agg(F.sum("c").alias(f"c{n}"), F.sum("e").alias(f"e{n}"))
        judged = judged.join(sums, cols, "left")
    share = F.lit(None).cast("double")
    for n in (2, 3, 4):
        c, e = F.col(f"c{n}"), F.col(f"e{n}")
        share = F.when(c >= 3, e / c).otherwise(share)
    judged = judged.join(words, "w", "left").join(prefixes, "w", "left").join(limits, "n", "left")
    spaced = F.col("w").rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\d\p{Punct}]*$")
    by_word = spaced & ~F.col("marker")
    # A number that stands whole before its full stop, as it does elsewhere, is finished at any length.
    finished = F.col("stopped") & (F.coalesce(share, F.lit(0.0)) >= END_SHARE)
    evidence = F.array_compact(
        F.array(
            F.when(F.col("marker"), "marker"),
            F.when(by_word & F.col("known").isNull() & F.col("node").isNotNull(), "prefix"),
            F.when(~F.col("marker") & ~finished & F.coalesce("at_limit", F.lit(False)), "length"),
            F.when(by_word & (F.coalesce(share, F.lit(0.0)) < END_SHARE), "context"),
        )
    )
    return judged.select("id", evidence.alias("evidence")).where(F.size("evidence") > 0).withColumnRenamed("id", key)


def found(papers: DataFrame, residue: DataFrame) -> DataFrame:
    """``(paper_id)`` of the rows of papers whose abstract breaks off; ``residue`` holds the cases of problem 4."""
    return reasons(papers, residue).select("paper_id").distinct()


def reasons(papers: DataFrame, residue: DataFrame) -> DataFrame:
    """``(paper_id, evidence)`` of the same rows."""
    bad = residue.select("paper_id")
    # The cases are few, so the texts need not be shuffled to leave them out.
    clean = papers.select("paper_id", "abstract").join(broadcast_if_small(bad, bad.count(), MAX_BROADCAST_IDS), "paper_id", "left_anti")
    return truncated(clean)


def source_shares(log: DataFrame) -> DataFrame:
    """``(source, abstracts, cut, share)``: how often each source's abstracts stop early.

    Of a fetch that is logged twice one row counts; a source without any text does not appear.
    """
    ok = log.where("status = 'ok' and trim(abstract) <> ''").select("paper_id", "source", "abstract").distinct()
    ok = cut(ok.withColumn("fetch", F.sha2(F.concat_ws("\x01", "paper_id", "source", "abstract"), 256)))
    bad = truncated(ok, "fetch", "abstract").select("fetch", F.lit(1).alias("bad"))
    return (
        ok.join(bad, "fetch", "left")
        .groupBy("source")
        .agg(F.count("*").alias("abstracts"), F.count("bad").alias("cut"))
        .withColumn("share", F.col("cut") / F.col("abstracts"))
    )
