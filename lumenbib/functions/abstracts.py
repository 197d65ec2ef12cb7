"""Abstracts from pages and service payloads: cleaning, validity and fixed fallbacks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions.text import collapse, unescape_entities

MIN_LENGTH = 100
# Words that services return in place of a text.
NON_TEXTS = ("true", "false", "null", "undefined", "error")
# Fixed value: one name with its affiliation in brackets.
AUTHOR_BLOCK = r"[A-Za-zÀ-ÿ][\w\.\-'\sÀ-ÿ]*?\([^)]{2,120}\)"
#: A leading list: up to 31 authors with a separator behind each but the last, or a last one without.
AUTHOR_LIST = re.compile(rf"(?:{AUTHOR_BLOCK}\s*[,;]\s*){{1,30}}{AUTHOR_BLOCK}\s*[,;]?\s*")


def is_valid_abstract(text: Column, least: int = MIN_LENGTH) -> Column:
    t = F.trim(collapse(text))
    return (F.length(t) >= least) & ~F.lower(t).isin(*NON_TEXTS)


def without_author_blocks(text: str) -> str:
    """``text`` after a leading list of two or more authors with affiliations, if a long rest remains."""
    listed = AUTHOR_LIST.match(text)
    rest = text[listed.end() :].lstrip() if listed else ""
    return rest if len(rest) >= MIN_LENGTH else text


@F.pandas_udf(T.StringType())
def _without_author_blocks(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else without_author_blocks(v))


def strip_author_blocks(text: Column) -> Column:
    """Only texts with a bracket early on can begin with such a list, so only they reach Python."""
    return F.coalesce(_without_author_blocks(F.when(text.rlike(r"^[A-Za-zÀ-ÿ][^()]*\([^)]{2,120}\)\s*[,;]"), text)), text)


def strip_label(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^Abstract\s*[:?\-]?\s*", "")


def clean_abstract(text: Column) -> Column:
    """Entities decoded, author list, notice of open access and label removed, white space collapsed; null if empty."""
    t = strip_author_blocks(unescape_entities(text))
    t = F.regexp_replace(t, r"(?i)USENIX is committed to Open Access.*", "")
    return F.nullif(collapse(strip_label(t)), F.lit(""))


def from_inverted_index(index: Column, strict: bool = True) -> Column:
    """Text of a word-to-positions map. strict: null if the least position is above 0 or the text is short."""
    places = F.flatten(
        F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    ordered = F.array_sort(places)
    text = collapse(F.array_join(F.transform(ordered, lambda x: x["w"]), " "))
    if not strict:
        return F.nullif(text, F.lit(""))
    return F.when((F.element_at(ordered, 1)["p"] == 0) & (F.length(text) >= MIN_LENGTH), text)


def from_jats(text: Column) -> Column:
    """Text of a tagged abstract without its headings; null if short."""
    t = F.regexp_replace(text, r"(?s)<jats:title>.*?</jats:title>", "")
    t = collapse(F.regexp_replace(F.regexp_replace(t, r"</?jats:[a-z]+>", ""), r"<.*?>", ""))
    return F.when(F.length(t) >= MIN_LENGTH, t)


def from_page_script(page: Column) -> Column:
    """The abstract inside a page's metadata script: by pattern, else from the embedded object."""
    raw = F.nullif(F.regexp_extract(page, r"\"abstract\"\s*:\s*\"((?:[^\"\\]|\\.)+)\"", 1), F.lit(""))
    text = collapse(F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" ")))
    body = F.regexp_extract(page, r"(?s)xplGlobal\.document\.metadata\s*=\s*(\{.+?\});", 1)
    return F.coalesce(F.when(raw.isNotNull(), text), F.get_json_object(body, "$.abstract"))


def first_provider(*candidates: Column) -> Column:
    """The first non-null candidate, in the fixed order given."""
    return F.coalesce(*candidates)


class _Blocks(HTMLParser):
    """Text of elements as (path of (tag, id, class), own text) in document order, tolerant of unclosed tags."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    RAW = frozenset(("script", "style"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[int] = []
        self.nodes: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self.stack and self.nodes[self.stack[-1]]["tag"] == "p":
            self.stack.pop()
        a = dict(attrs)
        self.nodes.append({"tag": tag, "id": a.get("id") or "", "class": a.get("class") or "", "up": list(self.stack), "text": []})
        if tag not in self.VOID:
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]]["tag"] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.nodes[self.stack[-1]]["tag"] not in self.RAW:
            for k in self.stack:
                self.nodes[k]["text"].append(data)


@dataclass(frozen=True)
class Place:
    """Where a publisher keeps the abstract: elements by tag and attribute, and which of their paragraphs.

    Without ``paragraphs`` the text of the first element counts; with them the slice ``[first:last]`` of the paragraphs
    in all elements (or in the first one below ``below``), joined by spaces.
    """

    tag: str | None
    attribute: str = ""
    value: str = ""
    exact: bool = False
    paragraphs: bool = True
    first: int = 0
    last: int | None = None
    below: str | None = None
    outside: str | None = None

    def fits(self, node: dict) -> bool:
        held = node[self.attribute] if self.attribute else ""
        return self.tag in (None, node["tag"]) and (held == self.value if self.exact else self.value in held)


# The places of each publisher, in order.
PLACES = {
    "acm": [
        Place(None, "id", "abstract", exact=True, paragraphs=False), Place("div", "class", "abstract", paragraphs=False), Place("section", "class", "abstract", paragraphs=False),
        Place("div", "class", "abstractInFull", paragraphs=False), Place("div", "class", "abstractSection", exact=True, paragraphs=False), Place("div", "class", "abstractText", paragraphs=False),
    ],
    "usenix": [
        Place("div", "class", "field-name-field-paper-description"), Place("section", first=1, last=-1, below="main"), Place("section", first=1, last=2, below="main"),
        Place("div", "class", "content", exact=True, first=0, last=1, outside="header"),
    ],
    "ndss": [Place("div", "class", "paper-data", exact=True, first=1), Place("div", "id", "abstract", exact=True), Place("section", "class", "abstract"), Place("div", "class", "abstract")],
}


def register_places(extractor: str, places: list[Place]) -> None:
    """Adds an extractor, or replaces one; its name is what :func:`abstract_of_page` is given."""
    PLACES[extractor] = places


def _texts(nodes: list[dict], place: Place) -> str:
    found = [i for i, node in enumerate(nodes) if place.fits(node) and (place.below is None or any(nodes[k]["tag"] == place.below for k in node["up"]))]
    if not place.paragraphs or place.below:
        found = found[:1]
    if not place.paragraphs:
        return "".join("".join(nodes[i]["text"]) for i in found)
    inner = [n for n in nodes if n["tag"] == "p" and any(i in n["up"] for i in found) and not any(nodes[k]["tag"] == place.outside for k in n["up"])]
    return " ".join("".join(n["text"]) for n in inner[place.first : place.last])


def page_abstract(page: str, extractor: str, places: dict[str, list[Place]] | None = None) -> str | None:
    """The first valid text among an extractor's places in a page."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    for place in (PLACES if places is None else places).get(extractor, ()):
        text = " ".join(_texts(parser.nodes, place).split())
        if extractor == "acm":
            text = re.sub(r"(?i)^Abstract\s*[:?\-]?\s*", "", text)
        if len(text) >= MIN_LENGTH and text.lower() not in NON_TEXTS:
            return text
    return None


def abstract_of_page(page: Column, extractor: Column) -> Column:
    """The abstract of a publisher's page, cleaned; the script of one publisher is read natively."""
    places = dict(PLACES)

    @F.pandas_udf(T.StringType())
    def by_place(pages: pd.Series, extractors: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else page_abstract(p, e or "acm", places) for p, e in zip(pages, extractors, strict=True)], dtype="object")

    return clean_abstract(F.when(extractor == "ieee", from_page_script(page)).otherwise(by_place(F.when(extractor != "ieee", page), extractor)))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``b`` that ``a`` holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(b)), F.lit(1))
