"""Problem 10: oversized documents cut at natural boundaries, with an overlap in tokens.

Method: balanced targets. For what is left of a document the least number of pieces that can hold it is computed, the
next cut is aimed at an equal share and moved to the strongest boundary nearby. Where no boundary lies where that
number of pieces allows, the last boundary in reach is taken instead, and a piece is thereby added. A cut falls
inside a word only where its piece holds no boundary at all, at every length of document.

A text has at most as many tokens as bytes, so texts of up to ``limit`` bytes are passed over before Python sees
them. Every document is cut in its own row; nothing is shuffled. Null, empty and short texts give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.llm.bpe import TOKENIZER_DIR, VOCABULARY, Encoder, vocabulary

LIMIT, OVERLAP = 1024, 64
#: Tokens on either side of a target that count as nearby.
NEARBY = 128

_SPACE = b" \t\r\n\v\f"
# Signs that end a sentence or a clause, the closing signs that may follow, wide forms included.
_STOPS = tuple(s.encode() for s in (".", "!", "?", "…", "。", "！", "？"))
_PAUSES = tuple(s.encode() for s in (",", ";", ":", "、", "，", "；", "："))
_WIDE = tuple(s.encode() for s in ("。", "！", "？", "、", "，"))
_CLOSERS = tuple(s.encode() for s in ('"', "'", ")", "]", "”", "’", "»", "」"))


class Boundaries:
    """How natural a cut before each byte of a text is."""

    def __init__(self, data: bytes):
        self.data = data
        # Just behind the last byte that is no white space, for every place: runs of any length are passed in one step.
        solid = ~np.isin(np.frombuffer(data, dtype=np.uint8), np.frombuffer(_SPACE, dtype=np.uint8))
        self.solid = np.maximum.accumulate(np.where(solid, np.arange(1, len(data) + 1), 0))

    def strength(self, at: int) -> int:
        """5 paragraph, 4 line, 3 sentence, 2 clause, 1 word, 0 none, -1 inside a character."""
        data = self.data
        if at >= len(data):
            return 5
        if data[at] & 0xC0 == 0x80:
            return -1
        head, follows = data[max(0, at - 2) : at], data[at : at + 2]
        if head == b"\n\n" or follows == b"\n\n":
            return 5
        if head.endswith(b"\n") or follows[:1] == b"\n":
            return 4
        spaced = follows[:1] in _SPACE or head[-1:] in _SPACE
        end = closed = int(self.solid[at - 1]) if at else 0
        while sign := next((c for c in _CLOSERS if data.startswith(c, closed - len(c)) and closed >= len(c)), None):
            closed -= len(sign)
        ends_with = lambda signs, place: any(place >= len(c) and data.startswith(c, place - len(c)) for c in signs)
        if ends_with(_STOPS, closed) and (spaced or ends_with(_WIDE, end)):
            return 3
        if ends_with(_PAUSES, end) and (spaced or ends_with(_WIDE, end)):
            return 2
        return 1 if spaced else 0


def cut_points(data: bytes, ends: list[int], limit: int = LIMIT, overlap: int = OVERLAP, nearby: int = NEARBY) -> list[int]:
    """Token positions at which the pieces of a text end; ``ends`` holds the byte at which each token ends."""
    n, fresh = len(ends), limit - overlap
    if n <= limit:
        return [n]
    at = Boundaries(data)
    strength = lambda c: at.strength(ends[c - 1])
    cuts, last = [], 0
    while n - (start := last - overlap if last else 0) > limit:
        # Equal lengths over the least number of pieces for the rest, counted with the overlap each of them repeats.
        left = 1 + -(-(n - start - limit) // fresh)
        low, high = max(last + 1, n - limit + overlap - fresh * (left - 2)), start + limit
        target = min(max(start + -(-(n - start + overlap * (left - 1)) // left), low), high)
        best = _snap(strength, target, low, high, nearby)
        if best is None:
            best = next((c for c in range(low - 1, last, -1) if strength(c) > 0), None)
        if best is None:
            best = next((c for c in range(target, last, -1) if strength(c) >= 0), target)
        cuts.append(best)
        last = best
    return [*cuts, n]


def _snap(strength, target: int, low: int, high: int, nearby: int) -> int | None:
    """The strongest boundary near the target, else the nearest boundary within the limits, else none."""
    best, rank = None, (0, 0)
    for c in range(max(low, target - nearby), min(high, target + nearby) + 1):
        s = strength(c)
        if s > 0 and (best is None or (s, -abs(c - target)) > rank):
            best, rank = c, (s, -abs(c - target))
    if best is not None:
        return best
    for d in range(nearby + 1, high - low + 1):
        for c in (target - d, target + d):
            if low <= c <= high and strength(c) > 0:
                return c
    return None


def split_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    tokenizer_dir: str = TOKENIZER_DIR,
    name: str = VOCABULARY,
) -> DataFrame:
    """``(key, piece, pieces, first_token, n_tokens, boundary, ids, text)`` of every document above the limit.

    ``piece`` counts from 0. Every piece but the first begins with the last ``overlap`` tokens of the one
    before it; ``boundary`` is the strength of the cut at its end. ``text`` is its bytes as UTF-8, where an
    overlap that begins inside a character shows the replacement sign; ``ids`` are exact.
    """
    spark = df.sparkSession
    data = vocabulary(spark, tokenizer_dir, name)
    rows = df.select(key, text).where(F.octet_length(text) > limit)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "first_token", "n_tokens", "boundary")), T.StructField("ids", ints), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data.value)
        names = [key, "piece", "pieces", "first_token", "n_tokens", "boundary", "ids", "text"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for k, value in zip(batch.column(0), batch.column(1), strict=True):
                whole = value.as_py()
                ids = encoder.encode(whole)
                if len(ids) <= limit:
                    continue
                raw = whole.encode("utf-8", "replace")
                ends = list(accumulate(len(encoder.bytes_of[i]) for i in ids))
                cuts = cut_points(raw, ends, limit, overlap)
                natural, start = Boundaries(raw), 0
                for j, stop in enumerate(cuts):
                    begin = start - overlap if j else 0
                    piece = raw[ends[begin - 1] if begin else 0 : ends[stop - 1]].decode("utf-8", "replace")
                    row = (k.as_py(), j, len(cuts), begin, stop - begin, natural.strength(ends[stop - 1]), ids[begin:stop].tolist(), piece)
                    for column, cell in zip(out, row, strict=True):
                        column.append(cell)
                    held += stop - begin
                    start = stop
                if held > 500_000:
                    yield _batch(batch, out, names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield _batch(batch, out, names)

    def _batch(batch: pa.RecordBatch, out: list[list], names: list[str]) -> pa.RecordBatch:
        kinds = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.list_(pa.int32()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def found(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(doc_id)`` of the documents that had to be cut."""
    pieces = split_documents(documents, tokenizer_dir=tokenizer_dir)
    return pieces.where("piece = 0").select("doc_id").distinct()
