"""Problem 6: text that looks the same but is stored with other characters.

Method: confusables skeleton. A text is decomposed, every character is replaced by the prototype of a
look-alike table, and the result is decomposed again; texts with equal skeletons look alike. A value is affected
when its consistent form differs from it and both have one skeleton, so that nothing but the characters changed.
Words written wholly in look-alike letters are grouped with the corpus by skeleton, which shows their Latin twin.

The table holds letters of other alphabets as fixed values; styled letters, digraphs, small capitals, hyphens and
quotation marks follow from the character's Unicode decomposition, name or category. Only values with a character
outside printable ASCII and precomposed Latin letters reach Python; all others are their own consistent form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.session import broadcast_if_small, cut

# Letters of other alphabets that look like a Latin letter, and that letter.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅҺԌԚԜӀ" "аеорсухіјѕһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" "αονρικυϲϳ" "օսհոցՕՍ"
        "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏙᏞᏟᏢᏦᏴ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "ABEKMHOPCTYXIJShGQWI" "aeopcyxijshdqw" "ABEZHIKMNOPTYXC" "aovpikucj" "ouhngOU"
        "DRTAJEWMHGZRWSVLCPKB" "BPDTGKJCZFMNLSRVHWXYAEIOU",
        strict=True,
    )
)
# Latin letters that are drawn like a plain letter and do not decompose to it.
LATIN_PROTOTYPES = {"ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s", "ȷ": "j", "ɩ": "i", "ʋ": "v"}
# Invisible characters, as ranges of code points.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
)
# Kinds of compatibility decomposition that are one letter or digit in another style.
STYLES = ("<font>", "<wide>", "<narrow>", "<circle>", "<square>")
# Signs that are drawn like an apostrophe or like a double quote.
APOSTROPHES, DOUBLE_QUOTES = ("‘", "’", "‛", "ʼ", "ʹ", "′"), ("“", "”", "‟", "″")

FORMS, LIGATURE, DECOMPOSED, HIDDEN, SPACE, LETTER = "full_width", "ligature", "decomposed", "invisible", "space", "letter"
#: Printable ASCII and precomposed Latin letters cannot be affected, and are their own skeleton but for case.
PLAIN = r"^[ -~À-ÖØ-öø-įĴ-ľŁ-ňŊ-ž]*$"
#: Distinct suspect words up to this count are broadcast; beyond it the joins on them shuffle.
MAX_BROADCAST_WORDS = 100_000


def _remembered[R](function: Callable[[str], R]) -> Callable[[str], R]:
    """``function`` of one character, computed once for each: there are no more than Unicode has."""
    known: dict[str, R] = {}

    def look(ch: str) -> R:
        if ch not in known:
            known[ch] = function(ch)
        return known[ch]

    return look


def _is_invisible(code: int) -> bool:
    return any(lo <= code <= hi for lo, hi in INVISIBLE)


@_remembered
def _script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, ... of a letter, by its character name."""
    return unicodedata.name(ch, "?").split(" ", 1)[0]


@_remembered
def styled(ch: str) -> str | None:
    """The plain characters of one that only differs from them in style: wide, half-width, mathematical, encircled, boxed."""
    kind = unicodedata.decomposition(ch).split(" ", 1)[0]
    return unicodedata.normalize("NFKC", ch) if kind in STYLES else None


@_remembered
def ligature(ch: str) -> str | None:
    """The letters of one character that stands for several: ligatures, digraphs, Roman numerals."""
    plain = unicodedata.normalize("NFKC", ch)
    several = unicodedata.decomposition(ch).startswith("<compat>") and sum(c.isalpha() for c in plain) == len(plain)
    roman = unicodedata.name(ch, "").startswith(("ROMAN NUMERAL", "SMALL ROMAN NUMERAL")) and plain.isascii()
    return plain if several and len(plain) > 1 or roman else None


@_remembered
def prototype(ch: str) -> str:
    """What a character looks like; itself for most."""
    if ch in LOOKALIKES or ch in LATIN_PROTOTYPES:
        return LOOKALIKES.get(ch) or LATIN_PROTOTYPES[ch]
    if ch in APOSTROPHES or ch in DOUBLE_QUOTES:
        return "'" if ch in APOSTROPHES else '"'
    if unicodedata.category(ch) == "Pd" and unicodedata.name(ch, "").endswith("HYPHEN"):
        return "-"
    name = unicodedata.name(ch, "")
    if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name.rsplit(" ", 1)[1]) == 1:
        return name[-1].lower()
    return styled(ch) or ligature(ch) or ch


def analyse(text: str) -> tuple[str, str, list[str], list[str], list[str]]:
    """``(consistent form, skeleton, classes, suspects, twins)`` of one text.

    classes names what the form changed; suspects are words written wholly in look-alike letters of another
    alphabet, which only a Latin twin elsewhere in the data can convict, and twins their skeletons.
    """
    classes: set[str] = set()
    step: list[str] = []
    for ch in text:
        if _is_invisible(ord(ch)):
            classes.add(HIDDEN)
        elif ch != " " and (ch in "\t\n\r\v\f\x85\u2028\u2029" or unicodedata.category(ch) == "Zs"):
            classes.add(SPACE)
            step.append(" ")
        elif (plain := styled(ch)) is not None:
            classes.add(FORMS)
            step.append(plain)
        elif (plain := ligature(ch)) is not None:
            classes.add(LIGATURE)
            step.append(plain)
        else:
            # Other hyphens become the usual one, which makes no case of a value.
            step.append("-" if prototype(ch) == "-" else ch)
    bare = "".join(step)
    plain = unicodedata.normalize("NFC", bare)
    # Only marks that have a composed form are decomposed; those of other writings stand as they must.
    if plain != bare and any(unicodedata.combining(c) for c in bare):
        classes.add(DECOMPOSED)

    suspects: list[str] = []
    runs: list[tuple[int, int]] = []
    start = None
    for i, ch in enumerate(plain + " "):
        if ch.isalpha() or (start is not None and unicodedata.combining(ch)):
            start = i if start is None else start
        elif start is not None:
            runs.append((start, i))
            start = None
    out = list(plain)
    truly_foreign = any(
        plain[i] not in LOOKALIKES and _script(plain[i]) in ("CYRILLIC", "ARMENIAN")
        for lo, hi in runs
        if not any(_script(c) == "LATIN" for c in plain[lo:hi])
        for i in range(lo, hi)
    )
    has_latin = any(_script(c) == "LATIN" for lo, hi in runs for c in plain[lo:hi])
    for lo, hi in runs:
        word = plain[lo:hi]
        alike = [c in LOOKALIKES for c in word]
        if not any(alike):
            continue
        if any(_script(c) == "LATIN" for c in word):
            classes.add(LETTER)
            for i in range(lo, hi):
                out[i] = LOOKALIKES.get(out[i], out[i])
        elif all(alike) and has_latin and not truly_foreign and (len(word) > 1 or _script(word) == "CYRILLIC"):
            suspects.append(word)
    form = unicodedata.normalize("NFC", "".join(out))
    looks = skeleton(text)
    # The form must look like the text: a form with another skeleton would be another text.
    if form == text or skeleton(form) != looks:
        form, classes = text, set()
    return form, looks, sorted(classes), suspects, [skeleton(w) for w in suspects]


def skeleton(text: str) -> str:
    """The confusables skeleton of a text: equal skeletons look alike. Case is folded, marks are kept.

    After the second decomposition the text is stored composed, which leaves equality as it is and makes
    the skeleton of an ordinary text the text itself in lower case.
    """
    parts: list[str] = []
    for ch in unicodedata.normalize("NFD", text):
        if _is_invisible(ord(ch)):
            continue
        if unicodedata.category(ch) in ("Zs", "Cc", "Zl", "Zp"):
            parts.append(" ")
            continue
        parts.extend(prototype(c) for c in (styled(ch) or ligature(ch) or ch))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(parts))).lower()


_TEXTS = T.ArrayType(T.StringType())
_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in ("form", "skeleton") else _TEXTS) for c in ("form", "skeleton", "classes", "suspects", "twins")])


@F.pandas_udf(_SCHEMA)
def _analyse(values: pd.Series) -> pd.DataFrame:
    rows = [(None, None, [], [], []) if v is None else analyse(v) for v in values]
    return pd.DataFrame(rows, columns=_SCHEMA.fieldNames())


def consistent_forms(values: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``form``, ``skeleton``, ``classes`` and ``affected`` to every row of ``values``.

    A null value has null form and skeleton, no classes, and is not affected; an empty text stays empty.
    Existing columns with these names are replaced. Repeated rows are kept as they are. Words written
    wholly in look-alike letters are corrected when their skeleton equals that of a Latin word somewhere in
    the column; a word truly written in Cyrillic has no such twin, or stands beside others that have none.
    """
    base = values.drop("form", "skeleton", "classes", "affected", "suspects", "twins", "_a", "_words")
    v = F.col(value)
    none = F.array().cast("array<string>")
    plain = base.where(v.isNull() | v.rlike(PLAIN)).select("*", v.alias("form"), F.lower(v).alias("skeleton"), none.alias("classes"), none.alias("suspects"), none.alias("twins"))
    # Written once: it is read for the suspects, the twins and the result, and Python should see a value once.
    other = cut(base.where(~v.rlike(PLAIN)).withColumn("_a", _analyse(v)).select("*", "_a.*").drop("_a"))

    # Groups of originals with equal skeleton, at the level of words: does a suspect have a Latin twin? A word in plain
    # letters is its own skeleton, so the words of the column are compared as they are.
    suspects = cut(other.select(F.explode(F.arrays_zip("suspects", "twins")).alias("z")).select(F.col("z.suspects").alias("word"), F.col("z.twins").alias("twin")).distinct())
    few = suspects.count()
    asked = broadcast_if_small(suspects.select("twin").distinct(), few, MAX_BROADCAST_WORDS)
    words = base.select(F.explode(F.split(F.lower(v), r"[^\p{IsLatin}]+")).alias("twin")).where("twin <> ''")
    seen = words.join(asked, "twin", "left_semi").distinct()
    known = cut(suspects.join(seen, "twin", "left_semi").select("word"))
    convicted = (
        other.where(F.size("suspects") > 0)
        .select(value, F.explode("suspects").alias("word"))
        .join(broadcast_if_small(known, few, MAX_BROADCAST_WORDS), "word", "left_semi")
        .groupBy(value)
        .agg(F.collect_set("word").alias("_words"))
    )
    hit = F.size(F.coalesce("_words", F.array())) > 0
    flagged = (
        other.where(F.size("suspects") > 0)
        .join(convicted, value, "left")
        .withColumn("form", F.when(hit, _translate(F.col("form"))).otherwise(F.col("form")))
        .withColumn("classes", F.when(hit, F.array_sort(F.array_union("classes", F.array(F.lit(LETTER))))).otherwise(F.col("classes")))
        .drop("_words")
        .select(*plain.columns)
    )
    rest = other.where(F.size("suspects") == 0).select(*plain.columns)
    return plain.unionByName(rest).unionByName(flagged).withColumn("affected", F.coalesce((F.col("form") != v) & (F.size("classes") > 0), F.lit(False))).drop("suspects", "twins")


def _translate(col: Column) -> Column:
    """``col`` with every look-alike letter replaced by its Latin prototype."""
    return F.translate(col, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def field_values(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(table_name, record_id, field, value)`` of the text fields that problem 6 covers."""
    p = papers.select(
        F.lit("papers").alias("table_name"),
        F.col("paper_id").alias("record_id"),
        F.explode(
            F.array(
                F.struct(F.lit("title").alias("field"), F.col("title").alias("value")),
                F.struct(F.lit("authors").alias("field"), F.col("authors").alias("value")),
            )
        ).alias("f"),
    ).select("table_name", "record_id", "f.*")
    x = preprints.select(
        F.lit("preprints").alias("table_name"),
        F.col("arxiv_id").alias("record_id"),
        F.lit("title").alias("field"),
        F.col("title").alias("value"),
    )
    return p.unionByName(x)


def affected_fields(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """``(table_name, record_id, field)`` of every value stored with other characters."""
    forms = consistent_forms(field_values(papers, preprints))
    return forms.where("affected").select("table_name", "record_id", "field").distinct()


def lookalike_groups(values: DataFrame, value: str = "value") -> DataFrame:
    """``(skeleton, originals, form)`` for skeletons that more than one spelling shares.

    Distinct spellings are counted before anything is grouped; the result has one row for each spelling,
    so no group is gathered in one task.
    """
    seen = consistent_forms(values.select(value).where(F.col(value).isNotNull()).distinct(), value)
    sizes = seen.groupBy("skeleton").agg(F.count("*").alias("originals")).where("originals > 1")
    return seen.join(sizes, "skeleton").select("skeleton", "originals", F.col(value).alias("original"), "form")
