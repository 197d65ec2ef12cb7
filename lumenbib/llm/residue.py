"""Problem 4: template residue, filler, error pages and page notices in place of, or around, a text.

Method: address slug, title and body terms are compared, and mismatched, duplicated, low-information bodies
are flagged by combined host evidence and placeholder detectors. Every body, whatever its length, gets the same
evidence: whether it shares a term with its title or slug, under how many titles its masked signature repeats,
whether it names its own host, how many kinds of notice it holds and in what share of its sentences, and the shapes
of placeholders and filler. Points are added up; a phrase alone decides nothing.

All is native expressions but for the patterns over whole bodies, which run in Arrow batches; the only shuffle counts
the signatures of bodies that share no term with their title. Cases, defined: a null, empty or blank body is not a case; a body of any length is read whole; repeated rows
give one result row each; null title or address merely withdraw their evidence.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.session import cut

# What stands before a placeholder that is talked about, not left over.
_MENTION = r"(?<!\b(?:such as|variable|variables|the form|form|payload|payloads|like|named|called|syntax|literal|string)\s{1,2}['\"“]?)"
# Shapes of unfilled template fields, and the signs with which they all begin.
PLACEHOLDERS = {
    "mustache": r"\{\{\s*[A-Za-z_][\w.]*(?:\s*[|(][^}]*)?\s*\}\}",
    "dollar": r"\$\{\s*[A-Za-z_][\w.]*\s*\}",
    "erb": r"<%=?[^%]{0,200}%>",
    "ruby": r"#\{\s*[A-Za-z_][\w.]*\s*\}",
    "at": r"@@\w+@@",
    "dunder": r"\b__[A-Z][A-Z_]+__\b",
    "percent": r"%[A-Z][A-Z_]{2,}%",
    "wiki": r"\[\[\w+\]\]",
    "bracket": r"\[(?:(?i:insert|your|name of|add|enter|todo|tbd|to be)\b[^\]]{0,80}|[A-Z]{3,}(?: [A-Z]{2,})+)\]",
    "angle": r"<(?:(?i:insert|your|add|enter)\b[^<>]{0,80}|[A-Z][A-Z _]{2,60})>",
    "brace": r"(?<![\\\w^}{$#])\{[a-z]+(?:_[a-z]+)*\}(?!\})",
    "digits": r"\bX{2,}\s?%|\bX{3,}\b",
    "todo": r"\b(?:TODO|TBD|FIXME):",
}
SHAPE_SIGNS = r"\{\{|\$\{|<%|#\{|@@|__|%[A-Z]|\[|<[A-Za-z]|\{[a-z]|XX|(?:TODO|TBD|FIXME):"
# Phrases of error pages, demands for scripts, site notices, access walls and page furniture, by kind.
NOTICES = {
    "noscript": r"\bnoscript\b",
    "scripts": r"\bscript-capable\b|not run scripts|\b(?:enable|turn on|switch on|allow|activate)\b.{0,40}\b(?:javascript|scripts?|cookies)\b|\b(?:javascript|scripts)\b.{0,60}\b(?:allowed|enabled|switched on|turned on|to work properly)\b",
    "browser": r"\byour (?:web )?browser\b|\bbrowser settings\b",
    "cookies": r"\bwe use cookies\b|\baccept all\b|\breject all\b|\bmanage (?:your )?(?:preferences|choices|cookies)\b",
    "terms": r"\bterms of (?:use|service)\b|\bprivacy (?:notice|policy)\b|\bby continuing\b",
    "login": r"\b(?:sign|log) ?in\b|\bsession has expired\b|\bcreate a free account\b|\bfree account\b",
    "wall": r"\blimited to subscribers\b|\bbuy the article\b|\bthrough your institution\b|\byou are viewing a preview\b",
    "error": r"\berror code\b|\bbad gateway\b|\b404\b.{0,5}not found|\b\d{3} (?:forbidden|bad gateway|not found|service unavailable|internal server error)\b|\btemporarily unavailable\b|\btoo many requests\b|\bsomething went wrong\b|\bcould not be retrieved\b|\baccess denied\b|\(incident\b",
    "blocked": r"\baddress has been blocked\b|\bsite policy\b|\bfrom this network\b",
    "retry": r"\btry(?:ing)? again\b|\breload\b|\bif the problem persists\b|\bhelp desk\b|\bdown for maintenance\b",
    "page": r"\bpage you (?:requested|are looking)\b|\brecord you are looking\b|\bstart page\b|\bthis (?:site|page|website|article page)\b|\bproxy node\b",
    "robot": r"\byou are human\b|\bchecking your connection\b|\bthis may take a few seconds\b",
    "furniture": r"\bskip to (?:main )?content\b|\bbasket \(\d+\)|\bdownload pdf\b|\b\d+ views\b|\bclick here\b|\ball rights reserved\b",
}
# Bodies that only stand in for a missing text.
STAND_INS = (
    "tbd", "tba", "todo", "n a", "na", "none", "null", "nil", "nan", "undefined", "object object", "abstract", "no abstract",
    "unknown", "missing", "test", "untitled",
)
# Frequent function words of the languages written in Latin letters that the corpus holds.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "as", "by", "we", "are", "be", "this", "an", "or", "which", "from", "it",
    "its", "our", "at", "has", "have", "not", "can", "der", "die", "das", "und", "von", "zu", "den", "des", "mit", "für", "auf", "ist", "im", "eine",
    "ein", "nicht", "wir", "dass", "sich", "wie", "auch", "einer", "le", "la", "les", "et", "en", "du", "une", "un", "que", "dans", "pour", "est",
    "par", "sur", "nous", "au", "aux", "qui", "ces", "ont", "avec", "el", "los", "las", "una", "del", "se", "con", "por", "para", "como", "lo", "al",
    "sus", "este", "entre", "sobre", "y", "de", "o",
)

#: Titles, told apart by their first word, under which one signature must stand to count as repeated.
REPEATED = 3
#: Points that make a page of a body: see :func:`residue`.
PAGE_POINTS = 3
#: Below this share of distinct words a text repeats itself; below this share of function words it is no prose.
SCARCE, PROSE = 0.6, 0.2

_SPACE = " \t\n\r\f\x0b"


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


@F.arrow_udf(T.LongType())
def _marks(texts: pa.Array) -> pa.Array:
    """A bit for each kind of notice in a text, and a last one where a placeholder may be. The patterns run in Arrow's engine,
    whose time is linear in the text; tried one after the other in the JVM they would take most of the time of all."""
    low = pc.utf8_lower(texts)
    marks = np.zeros(len(texts), dtype=np.int64)
    for bit, pattern in enumerate([*NOTICES.values(), SHAPE_SIGNS]):
        held = pc.match_substring_regex(low if bit < len(NOTICES) else texts, pattern)
        marks |= pc.fill_null(held, False).to_numpy(zero_copy_only=False).astype(np.int64) << bit
    return pa.array(marks)


@F.arrow_udf(T.StringType())
def _signature_key(texts: pa.Array) -> pa.Array:
    """The digest of a text with addresses, numbers and identifiers masked, so that copies from one template agree."""
    masked = pc.utf8_lower(texts)
    for pattern, sign in ((r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b", "@"), (r"\b[a-z]*[0-9][a-z0-9]*", "#"), (r"[^\p{L}@#]+", " ")):
        masked = pc.replace_substring_regex(masked, pattern, sign)
    return pa.array([None if t is None else hashlib.md5(t.strip().encode()).hexdigest() for t in masked.to_pylist()], pa.string())


def _notice(col: Column) -> Column:
    low = F.lower(col)
    return _either([low.rlike(pattern) for pattern in NOTICES.values()])


def _terms(col: Column) -> Column:
    """Distinct lower-case words of four or more letters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))


def _edge_notice(col: Column) -> Column:
    """Whether a piece at the edge of a text speaks as the page around it, not about pages."""
    address = r"(?i)\bthis (?:site|page|website)\b|\byour (?:web )?browser\b|^\s*(?:please|click|skip|sign|log|accept|subscribe|share|download)\b"
    return F.when(col.contains("|") | col.rlike(address), _notice(col)).otherwise(False)


def features(df: DataFrame, key: str, title: str, body: str, address: str) -> DataFrame:
    """One row per non-blank body with its evidence as columns; see :func:`residue` for the verdict.

    The costly tests stand behind cheap ones that nearly every ordinary text fails.
    """
    b = F.col("_b")
    base = df.select(F.col(key).alias("key"), F.col(title).alias("_t"), F.btrim(F.col(body), F.lit(_SPACE)).alias("_b"), F.col(address).alias("_u")).where(b.isNotNull() & (b != ""))
    # A column of its own, so that it is computed once for the many tests on it.
    base = base.withColumn("_low", F.lower(b))
    base = base.withColumn("_w", F.array_remove(F.split("_low", r"[^\p{L}\p{N}]+"), ""))
    words = F.col("_w")
    u = F.coalesce("_u", F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1))
    slug = F.regexp_replace(u, r"^[a-zA-Z][\w+.-]*://[^/?#]*", "")
    head = F.substring_index(F.substring_index(b, "\n", 1), ". ", 1)
    tail = F.substring_index(F.substring_index(F.rtrim(b, F.lit("." + _SPACE)), "\n", -1), ". ", -1)
    bare = F.trim(F.regexp_replace("_low", r"[^\p{L}]+", " "))
    units = F.filter(F.split(b, r"[.!?]\s+|\n+|\s\|\s"), lambda x: x != "")
    scarce = F.size(F.array_distinct(words)) <= SCARCE * F.size(words)
    function_word = lambda w: w.isin(*FUNCTION_WORDS)
    prose = F.size(F.filter(words, function_word)) / F.size(words)

    def where(test: Column, value: Column) -> Column:
        return F.when(test, value).otherwise(False)

    base = base.withColumn("_about", F.array_union(_terms(F.col("_t")), _terms(slug)))
    base = base.withColumn("_marks", _marks(b)).withColumn("cues", F.bit_count(F.col("_marks").bitwiseAND(F.lit((1 << len(NOTICES)) - 1))))
    mismatch = (F.size("_about") > 0) & ~F.arrays_overlap(words, "_about")
    base = base.withColumn("mismatch", F.coalesce(mismatch, F.lit(False)))
    return base.select(
        "key",
        where(F.getbit("_marks", F.lit(len(NOTICES))) == 1, _either([b.rlike(_MENTION + shape) for shape in PLACEHOLDERS.values()])).alias("placeholder"),
        "cues",
        where(F.col("cues") > 0, F.size(F.filter(units, _notice)) >= 0.5 * F.size(units)).alias("mostly"),
        (_edge_notice(head) | _edge_notice(tail)).alias("edge_notice"),
        where(
            F.size(words) <= 12,
            bare.isin(*STAND_INS)
            | bare.rlike(r"\babstract\b")
            & bare.rlike(r"\b(?:no|not|missing|supplied|available|appear|add|insert|here|pending|follow|provided|written)\b"),
        ).alias("stand_in"),
        where(
            b.rlike(r"\p{IsLatin}") & (F.size(words) >= 4),
            where(scarce, prose < PROSE) | where(~b.contains(",") & (F.size(words) >= 10), ~F.arrays_overlap(words, F.array(*map(F.lit, FUNCTION_WORDS)))) | F.forall(words, lambda w: w.rlike(r"^(.)\1*$")),
        ).alias("filler"),
        "mismatch",
        where(host != "", F.contains("_low", host)).alias("names_host"),
        F.coalesce(_signature_key(F.when(F.col("mismatch"), b)), F.lit("")).alias("signature"),
        F.when(F.col("mismatch"), F.lower(F.element_at(F.split(F.trim(F.coalesce("_t", F.lit(""))), r"[^\p{L}\p{N}]+"), 1))).alias("_lead"),
    )


def residue(df: DataFrame, key: str = "paper_id", title: str = "title", body: str = "abstract", address: str = "ee", phrases: bool = True) -> DataFrame:
    """``(key, evidence)`` of every row whose body is residue or holds residue, with all its evidence.

    ``placeholder``, ``stand_in``, ``filler`` and ``edge_notice`` are cases by themselves. A body is a page at
    PAGE_POINTS points: one for a notice, one for a second kind, one if most of its sentences are notices (``mostly``),
    one if it shares no term with title and slug (``mismatch``), two if such a body's signature stands under REPEATED
    titles (``repeated``), one if it names its host (``host``). Without ``phrases`` notices give no points and
    no edge, which shows what the comparisons find alone.
    """
    # Written once: the narrow evidence is read for the repetitions and for the verdict, the texts only here.
    f = cut(features(df, key, title, body, address))
    if not phrases:
        f = f.withColumns({"cues": F.lit(0), "mostly": F.lit(False), "edge_notice": F.lit(False)})
    # Distinct leading title words per signature, counted once per pair.
    repeated = (
        f.where("signature <> ''").select("signature", "_lead").distinct().groupBy("signature").agg(F.count("*").alias("titles"))
        .where(F.col("titles") >= REPEATED).select("signature", F.lit(True).alias("repeated"))
    )
    doubtful = f.where("signature <> ''").join(repeated, "signature", "left")
    rows = f.where("signature = ''").withColumn("repeated", F.lit(False)).unionByName(doubtful)
    again = F.coalesce("repeated", F.lit(False))
    one = lambda test: F.when(test, 1).otherwise(0)
    points = one(F.col("cues") >= 1) + one(F.col("cues") >= 2) + one(F.col("mostly")) + one(F.col("mismatch")) + 2 * one(again) + one(F.col("names_host"))
    tests = {
        "placeholder": F.col("placeholder"), "stand_in": F.col("stand_in"), "filler": F.col("filler"), "edge_notice": F.col("edge_notice"), "page": points >= PAGE_POINTS,
        "notice": F.col("cues") >= 1, "mostly": F.col("mostly"), "mismatch": F.col("mismatch"), "repeated": again, "host": F.col("names_host"),
    }
    sure = reduce(lambda a, b: a | b, list(tests.values())[:5])
    return rows.where(sure).select(F.col("key").alias(key), F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()])).alias("evidence"))


def found(papers: DataFrame) -> DataFrame:
    """``(paper_id)`` of the rows of papers whose abstract is a case."""
    return residue(papers).select("paper_id").distinct()
