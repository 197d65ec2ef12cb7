"""Problem 9: evaluation passages that appear, wholly or in part, in the documents.

Method: template canonicalisation. Numbers, names and units become typed placeholders, windows of the
canonical tokens are looked up in a hash index of the items' windows, and the slots are then compared: where they
hold the item's own values the passage itself leaked, where they are consistently others it was re-parameterised.

The items are the small side, but not assumed to be: they are indexed in blocks of a stated size, and each block is
broadcast and set against all documents. A document is read whole in one row of an Arrow function that makes its
windows, looks them up and returns only the items it covers, so no window is shuffled and a template that many
items or documents share costs memory in no task. Besides one block at a time the driver holds the distinct words
of the items, by which names are told from words alike at every number of items.

Cases, defined: null and empty texts and passages match nothing; repeated rows count once; of rows that share a
``doc_id`` each is read by itself and the best counts; passages shorter than a window never match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens in a window, and the most tokens between two windows that still count as one edited stretch.
WINDOW, BRIDGE = 3, 2
#: Least share of a passage's tokens, and of the slots in the matched part, that must agree.
COVERAGE, AGREEMENT = 0.5, 0.5
#: Characters of passages whose windows are broadcast at once; more items make more blocks.
BLOCK_CHARS = 8_000_000
#: Bytes of text that an executor turns into windows at once, at least one row.
SLICE_BYTES = 2_000_000

# Units of measurement.
UNITS = (
    "percent", "ms", "s", "sec", "secs", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "microsecond", "microseconds", "millisecond", "milliseconds", "nanosecond", "nanoseconds", "byte", "bytes", "kb", "mb", "gb", "tb", "bit", "bits",
    "hz", "khz", "mhz", "ghz", "km", "m", "cm", "mm", "kg", "g", "tick", "ticks",
)
NUMBER, UNIT, NAME, FIRST_WORD = 0, 1, 2, 3
_GROUPED = re.compile("(?<=[0-9])[,  '](?=[0-9]{3}(?![0-9]))")
_SENTENCE = re.compile(r"[.;!?]\s+")


def tokens(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Letters-and-digits tokens of all texts as written, and the text each belongs to.

    Texts are brought to compatibility form first; number grouping and hidden signs are removed.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKC"), "[­​-‏⁠﻿]", "")
    grouped = pc.match_substring_regex(texts, "[0-9][,  '][0-9]{3}")
    if pc.any(grouped).as_py():
        texts = pa.array([_GROUPED.sub("", t) if g else t for t, g in zip(texts.to_pylist(), grouped.to_pylist(), strict=True)], pa.string())
    lists = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}]+")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(keep), owner.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


class Vocabulary:
    """The names and the other words of all items, in lower case: a name is capitalised inside a sentence."""

    def __init__(self) -> None:
        self.names: set[str] = set()
        self.words: set[str] = set()

    def add(self, passages: list[str]) -> None:
        sentences = [s for p in passages for s in _SENTENCE.split(p)]
        flat, owner = tokens(pa.array(sentences, pa.string()))
        inner = np.zeros(len(flat), dtype=bool)
        inner[1:] = owner[1:] == owner[:-1]
        low = pc.utf8_lower(flat)
        named = pc.and_(pa.array(inner), pc.match_substring_regex(flat, r"^\p{Lu}"))
        self.names.update(low.filter(named).to_pylist())
        self.words.update(low.to_pylist())

    def sides(self) -> tuple[pa.Array, pa.Array]:
        """Names, and the words that are no names."""
        return pa.array(sorted(self.names), pa.string()), pa.array(sorted(self.words - self.names), pa.string())


def _known(low: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.is_in(low, value_set=among).to_numpy(zero_copy_only=False)


def canonical(flat: pa.StringArray, own: pa.Array, names: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(typed, literal)`` codes of tokens; -1 for what no token of the block equals.

    typed is NUMBER, UNIT, NAME or the code of the word; literal the place of the token among ``own``, the
    block's distinct tokens. Both are found once per distinct token.
    """
    coded = flat.dictionary_encode()
    low = pc.utf8_lower(coded.dictionary)
    literal = pc.fill_null(pc.index_in(low, value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    typed = np.where(literal >= 0, literal + FIRST_WORD, -1)
    capital = pc.match_substring_regex(coded.dictionary, r"^\p{Lu}.*\p{Ll}").to_numpy(zero_copy_only=False)
    typed[_known(low, names) | capital & ~_known(low, words)] = NAME
    typed[_known(low, pa.array(UNITS))] = UNIT
    typed[pc.match_substring_regex(coded.dictionary, "^[0-9]").to_numpy(zero_copy_only=False)] = NUMBER
    at = coded.indices.to_numpy(zero_copy_only=False)
    return typed[at], literal[at]


def _keys(codes: np.ndarray, base: int) -> np.ndarray:
    """One number per window, in the order of its first token; -1 where a token has no code."""
    n = max(len(codes) - WINDOW + 1, 0)
    key, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(WINDOW):
        part = codes[k : k + n]
        key, known = key * base + part, known & (part >= 0)
    return np.where(known, key, -1)


class Block:
    """The windows of some items, sorted by template, with what is needed to judge their coverage."""

    def __init__(self, items: list[tuple[int, str]], names: pa.Array, words: pa.Array):
        flat, owner = tokens(pa.array([p for _, p in items], pa.string()))
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.own = pc.unique(pc.utf8_lower(flat))
        self.names, self.words = names, words
        self.base = len(self.own) + FIRST_WORD
        typed, literal = canonical(flat, self.own, names, words)
        self.lengths = np.bincount(owner, minlength=len(items)).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(flat)) - self.first[owner] if len(flat) else np.zeros(0, dtype=np.int64)
        whole = owner[: max(len(flat) - WINDOW + 1, 0)] == owner[WINDOW - 1 :]
        template, exact = _keys(typed, self.base)[whole], _keys(literal, self.base)[whole]
        order = np.argsort(template, kind="stable")
        self.templates, self.starts, self.counts = np.unique(template[order], return_index=True, return_counts=True)
        at = np.flatnonzero(whole)[order]
        self.item, self.place, self.exact = owner[at], place[at], exact[order]
        slots = [np.flatnonzero(np.isin(t, (NUMBER, UNIT, NAME))) for t in np.split(typed, self.first[1:])] if len(items) else []
        self.slots = slots
        self.named = [s[t[s] == NAME] for s, t in zip(slots, np.split(typed, self.first[1:]), strict=True)] if len(items) else []

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """``(text, item, place, same)`` of each place of an item whose window a text holds, sorted."""
        flat, owner = tokens(texts)
        none = np.zeros(0, dtype=np.int64)
        if len(flat) < WINDOW or not len(self.templates):
            return none, none, none, none
        typed, literal = canonical(flat, self.own, self.names, self.words)
        template, exact = _keys(typed, self.base), _keys(literal, self.base)
        template[owner[: len(template)] != owner[WINDOW - 1 :]] = -1
        asked = np.flatnonzero(template >= 0)
        near = np.minimum(np.searchsorted(self.templates, template[asked]), len(self.templates) - 1)
        hit = self.templates[near] == template[asked]
        asked, near = asked[hit], near[hit]
        many = self.counts[near]
        row = np.repeat(np.arange(len(asked)), many)
        entry = self.starts[near][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = asked[row]
        same = (self.exact[entry] == exact[at]).astype(np.int64)
        # One number for text, item and place; its low bit says whether the tokens agree too, and the last of equals wins.
        total = int(self.lengths.sum()) or 1
        coded = np.unique((owner[at] * total + self.first[self.item[entry]] + self.place[entry]) * 2 + same)
        where = coded >> 1
        coded = coded[np.append(where[1:] != where[:-1], True)] if len(coded) else coded
        where, same = coded >> 1, coded & 1
        text, spot = where // total, where % total
        item = np.searchsorted(self.first, spot, side="right") - 1
        return text, item, spot - self.first[item], same

    def agreement(self, item: int, lit: np.ndarray) -> float:
        """The share of names between the first and last literal window that they cover; of slots where no name is there."""
        covered = np.unique((lit[:, None] + np.arange(WINDOW)).ravel())
        for places in (self.named[item], self.slots[item]):
            inside = places[(places >= lit[0]) & (places < lit[-1] + WINDOW)]
            if len(inside):
                return float(np.isin(inside, covered).mean())
        return 0.0 if len(self.slots[item]) else 1.0

    def covered(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """``(text, item_id, coverage, agreement, template_coverage)`` where either coverage reaches COVERAGE."""
        text, item, place, same = self.hits(texts)
        if not len(text):
            return []
        group = text * len(self.ids) + item
        out = []
        exact, loose = _spans(group[same == 1], place[same == 1], WINDOW + BRIDGE), _spans(group, place, WINDOW)
        lit_group, lit_place = group[same == 1], place[same == 1]
        for g, span in loose.items():
            j = g % len(self.ids)
            n = self.lengths[j]
            if max(span, exact.get(g, 0)) < COVERAGE * n:
                continue
            lo, hi = np.searchsorted(lit_group, [g, g + 1])
            agreed = self.agreement(j, lit_place[lo:hi]) if hi > lo else (0.0 if len(self.slots[j]) else 1.0)
            out.append((g // len(self.ids), int(self.ids[j]), exact.get(g, 0) / n, agreed, span / n))
        return out


def _spans(group: np.ndarray, place: np.ndarray, reach: int) -> dict[int, int]:
    """Tokens in the windows of each group; a gap counts where the next window begins within ``reach`` tokens."""
    if not len(group):
        return {}
    step = np.full(len(group), WINDOW, dtype=np.int64)
    gap = place[1:] - place[:-1]
    joined = (group[1:] == group[:-1]) & (gap <= max(reach, WINDOW))
    step[:-1][joined] = gap[joined]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return dict(zip(group[heads].tolist(), np.add.reduceat(step, heads).tolist(), strict=True))


_FOUND = "doc_id bigint, item_id bigint, coverage double, agreement double, template_coverage double"


def _set_against(documents: DataFrame, block) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = [f.name for f in T.StructType.fromDDL(_FOUND)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Block.__new__(Block)
        vars(index).update(block.value)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                rows = index.covered(part.column(1))
                docs = part.column(0)
                cells = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                cells[0] = docs.take(pa.array(cells[0], pa.int64())).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)
                lo = hi

    return documents.mapInArrow(run, _FOUND)


def matches(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, coverage, agreement, template_coverage)`` where either coverage is at least COVERAGE.

    coverage is the share of the passage's tokens in literal windows or in gaps of at most BRIDGE tokens between
    them; agreement the share of names between the first and the last literal window that are the item's, or of
    all slots where there is no name, 1 for a passage without slots; template_coverage is the share of tokens in
    windows that agree up to the values of slots.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "passage").where("item_id is not null and passage <> ''").distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("passage")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-chars // block_chars))
    placed = items.withColumn("b", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)))
    gather = lambda b: [(r.item_id, r.passage) for r in placed.where(F.col("b") == b).select("item_id", "passage").collect()]
    known, kept = Vocabulary(), {}
    for b in range(blocks):
        rows = gather(b)
        known.add([p for _, p in rows])
        kept = {b: rows} if blocks == 1 else {}
    names, words = known.sides()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    out = None
    for b in range(blocks):
        rows = kept.get(b) or gather(b)
        one = _set_against(docs, spark.sparkContext.broadcast(vars(Block(rows, names, words))))
        out = one if out is None else out.unionByName(one)
    best = F.struct("coverage", "template_coverage", "agreement")
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("m")).select("doc_id", "item_id", "m.coverage", "m.agreement", "m.template_coverage")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold at least half of an item's passage, with its own values in the slots."""
    return matches(documents, items).where((F.col("coverage") >= COVERAGE) & (F.col("agreement") >= AGREEMENT))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of the leaks."""
    return leaks(documents, items).select("doc_id", "item_id")


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold at least half of an item's template with other values in most of its slots."""
    m = matches(documents, items)
    return m.where((F.col("template_coverage") >= COVERAGE) & ((F.col("coverage") < COVERAGE) | (F.col("agreement") < AGREEMENT)))
