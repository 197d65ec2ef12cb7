"""Problem 2: records that share most of their words.

Method: b-bit MinHash. Of each minimum the low bits are kept and packed, bands of the full minima generate
candidates, and the collision-corrected similarity of a candidate is estimated by bit counts on the packed
words where its keys meet. An exact check of the distinct words follows.

Records with equal word sets are one class from the start: only its least record takes part, and the members are put
back at the end. Texts are never shuffled: one Arrow pass writes a narrow table of ids and set digests, a second one
turns the texts of the representatives into columns of band keys, and only records that remain after the estimate
are read again for the exact check. Candidates are never written: unlike records meet by chance in numbers that grow
with the square of the records, so a task takes some bands whole, with the packed bits beside them, and passes on
what the estimate leaves. Cases, defined: a null, empty or wordless text has no partner; a repeated row counts once;
texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.operators.graph import connected_components
from lumenbib.session import broadcast_if_small, cut

#: At similarity 0.7 a pair shares no band with probability 1e-5, at 0.75 with 5e-9; at 0.2, usual among unrelated
#: records, it shares one with 0.002.
BANDS, ROWS = 134, 7
#: Minima that make up the packed signature of the estimate.
PACKED = 128
#: Bits kept of each minimum. Two unequal minima agree in them once in 2**BITS.
BITS = 2
THRESHOLD = 0.7
#: The estimate has a standard deviation of about 0.05; candidates below the threshold by five of it are dropped.
SLACK = 0.25
#: Copies and candidates are excluded and looked up by a broadcast up to so many rows, by a shuffle beyond.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of text that an executor sketches at once, at least one row.
SLICE_BYTES = 2_000_000
#: Bytes kept of a band key. Keys of a band that agree in them by chance cost a look at the packed bits, no more.
KEY_BYTES = 3
#: Tasks that share the bands of a block of records; each needs the packed bits of the block once.
PARTS = 8
#: Records whose packed bits a task holds at most. More records make blocks of half of it, each met with each.
HELD_RECORDS = 2_500_000
#: Records whose packed bits, and whose keys of a band, stand in one row, which bounds the batches that Spark hands over.
PACKED_RUN, KEYS_RUN = 64, 1024
#: Candidates estimated, and pairs collected, at once.
MEET_ROWS = 200_000
SEED = 20240607

_LANES = 0x5555555555555555


def word_set(text: Column) -> Column:
    """Distinct words of a text, regardless of case and punctuation, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, count, dtype=np.uint64)


def minima(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The least 32-bit hash of each run of ``values`` under each of ``count`` hash functions: one row per run."""
    a, b = _coefficients(count)
    out = np.empty((len(starts), count), dtype=np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def pack(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of every minimum, packed into 64-bit words, one row per record."""
    per = 64 // bits
    n, count = mins.shape
    words = -(-count // per)
    low = np.zeros((n, words * per), dtype=np.uint64)
    low[:, :count] = mins & np.uint32(2**bits - 1)
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(n, words, per) << shifts, axis=2)


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per record and band; equal keys mean equal minima in the band."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    keys = np.empty((len(mins), bands), dtype=np.uint64)
    for j in range(bands):
        h = np.full(len(mins), j + 1, dtype=np.uint64) * mix
        for k in range(j * rows, (j + 1) * rows):
            h = (h ^ mins[:, k]) * mix
            h ^= h >> np.uint64(29)
        keys[:, j] = h
    return keys


def signatures(sets: DataFrame, key: str, words: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(key, bands array<bigint>, packed array<bigint>)`` of records with a non-empty list of word hashes."""
    count = bands * rows
    longs = T.ArrayType(T.LongType())
    src = sets.select(key, words).where(F.size(words) > 0)
    schema = T.StructType([src.schema[key], T.StructField("bands", longs), T.StructField("packed", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                column = part.column(1)
                starts = np.asarray(column.offsets)[:-1].astype(np.int64)
                values = np.asarray(column.flatten()).view(np.uint64)
                mins = minima(values, starts - starts[0], count)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _longs(band_keys(mins, bands, rows)), _longs(pack(mins))], names=[key, "bands", "packed"]
                )

    return src.mapInArrow(run, schema)


def estimate(a: str, b: str, count: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity from two packed signatures: the share of equal lanes, corrected for chance collisions."""
    # Written out word by word, which stays inside generated code.
    differ = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(-(-count * bits // 64))]
    unlike = reduce(lambda s, c: s + c, [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LANES))) for x in differ])
    chance = 1 / 2**bits
    return (F.lit(1.0) - unlike / F.lit(float(count)) - chance) / (1 - chance)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each text, and the text each belongs to, in order of both."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}\p{N}]+")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    coded, owner = flat.filter(keep).dictionary_encode(), owner.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
    hashed = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    values = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(owner) else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], owner[first]


def _sketched(df: DataFrame, schema: str, make) -> DataFrame:
    """Batches of ``make(number, ids, values, starts)`` for the texts of ``df (id, text)`` that hold a word.

    ``number`` tells the slices of texts apart and is the same when a task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                values, owner = _word_hashes(part.column(1))
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=np.int64)
                if len(starts):
                    yield from make(number, part.column(0).take(pa.array(owner[starts])), values, starts)
                    number += 1
                lo = hi

    return df.select("id", "text").mapInArrow(run, schema)


def _longs(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(matrix.view(np.int64).ravel()))


def sketches(docs: DataFrame) -> DataFrame:
    """``(id, row, check)`` of ``docs (id, text)``; ``row`` and ``check`` are equal for equal sets of words."""

    def make(number: int, ids: pa.Array, values: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.add.reduceat(values * np.uint64(0x9E3779B97F4A7C15), starts).view(np.int64)
        mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        check = np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), starts).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(row), pa.array(check)], names=["id", "row", "check"])

    return _sketched(docs, f"id {docs.schema['id'].dataType.simpleString()}, row bigint, check bigint", make)


def band_columns(docs: DataFrame, blocks: int) -> DataFrame:
    """``(task, band, start, slice, second, ids, data)``: what each task of ``near_pairs`` needs of ``docs (id, text)``.

    Band -1 holds ids and packed bits, the others keys, of records from ``start`` in a slice. A task has some bands of
    one block or of two, then ``second`` marks the slices of the second.
    """
    kind = docs.schema["id"].dataType.simpleString()
    numbers = {pair: k for k, pair in enumerate((g, h) for g in range(blocks) for h in range(g, blocks))}
    parts, bands = np.arange(PARTS), np.arange(BANDS)

    def make(number: int, ids: pa.Array, values: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        mins = minima(values, starts, BANDS * ROWS)
        keys = np.ascontiguousarray((band_keys(mins, BANDS, ROWS) >> np.uint64(64 - 8 * KEY_BYTES)).T)
        keys = keys.astype("<u8").view(np.uint8).reshape(BANDS, len(ids), 8)[:, :, :KEY_BYTES]
        packed, n = pack(mins[:, :PACKED]), len(ids)
        own = ((number >> 32) + number) % blocks
        heads, runs = np.arange(0, n, PACKED_RUN), np.arange(0, n, KEYS_RUN)
        bits = [packed[lo : lo + PACKED_RUN].tobytes() for lo in heads] * PARTS
        cells = [k[lo : lo + KEYS_RUN].tobytes() for k in keys for lo in runs]
        ends = np.append(np.add.outer(parts * n, heads).ravel(), PARTS * n).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.concat_arrays([ids] * PARTS)), pa.nulls(len(cells), pa.list_(ids.type))
        for other in range(blocks):
            first = numbers[min(own, other), max(own, other)] * PARTS
            for task, band, start, held, data in (
                (np.repeat(parts, len(heads)), np.full(len(bits), -1), np.tile(heads, PARTS), lists[0], bits),
                (np.repeat(bands * PARTS // BANDS, len(runs)), np.repeat(bands, len(runs)), np.tile(runs, BANDS), lists[1], cells),
            ):
                numbered = [pa.array(x.astype(np.int32)) for x in (first + task, band, start)]
                both = [pa.array(np.full(len(data), x)) for x in (number, own > other)]
                yield pa.RecordBatch.from_arrays([*numbered, *both, held, pa.array(data, pa.binary())], names=["task", "band", "start", "slice", "second", "ids", "data"])

    return _sketched(docs, f"task int, band int, start int, slice bigint, second boolean, ids array<{kind}>, data binary", make)


def _meeting(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of equal ``keys``, some at a time."""
    both = np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))
    keys, at = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    del both
    left, apart = np.flatnonzero(keys[1:] == keys[:-1]), 1
    while len(left):
        for lo in range(0, len(left), MEET_ROWS):
            some = left[lo : lo + MEET_ROWS]
            yield at[some], at[some + apart]
        apart += 1
        left = left[left + apart < len(keys)]
        left = left[keys[left] == keys[left + apart]]


def near_pairs(docs: DataFrame, blocks: int, least: float) -> DataFrame:
    """``(ia, ib)`` of ``docs (id, text)``, ``ia < ib``: pairs with a common band and an estimate of at least ``least``."""
    kind = docs.schema["id"].dataType.simpleString()
    most = int(np.floor(PACKED * (1 - 1 / 2**BITS) * (1 - least) + 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bytes are gathered in place: many small pieces would stay in the worker's memory.
        ids, packed, second, keys, found, band = [], bytearray(), bytearray(), bytearray(), [], -1

        def settle() -> Iterator[pa.RecordBatch]:
            """The pairs of one band, then none."""
            if band < 0:
                return
            column = np.zeros((len(keys) // KEY_BYTES, 4), dtype=np.uint8)
            column[:, :KEY_BYTES] = np.frombuffer(bytes(keys), np.uint8).reshape(-1, KEY_BYTES)
            keys.clear()
            for i, j in _meeting(column.view("<u4").ravel()):
                if crossed:
                    keep = second[i] != second[j]
                    i, j = i[keep], j[keep]
                unlike = packed[i] ^ packed[j]
                unlike = (unlike | (unlike >> np.uint64(1))) & np.uint64(_LANES)
                keep = np.bitwise_count(unlike).sum(axis=1) <= most
                i, j = i[keep].astype(np.uint64), j[keep].astype(np.uint64)
                found.append((np.minimum(i, j) << np.uint64(32)) | np.maximum(i, j))
                if sum(map(len, found)) >= MEET_ROWS:
                    yield named()

        def named() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found))
            found.clear()
            a, b = (ids.take(pa.array(x)) for x in (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)))
            up = pc.less(a, b)
            # A repeated row meets itself.
            return pa.RecordBatch.from_arrays([pc.if_else(up, a, b), pc.if_else(up, b, a)], names=["ia", "ib"]).filter(pc.not_equal(a, b))

        for batch in batches:
            bands, data = batch.column(1).to_numpy(zero_copy_only=False), batch.column(6)
            for k, b in enumerate(bands):
                if b != band:
                    if band < 0:
                        ids, packed = pa.concat_arrays(ids), np.frombuffer(packed, np.uint64).reshape(len(second), -1)
                        second = np.frombuffer(second, bool)
                        crossed = second.any() and not second.all()
                    yield from settle()
                    band = b
                if b < 0:
                    part = batch.column(5).slice(k, 1).flatten()
                    # Copied, so that it doesn't hold its batch.
                    ids.append(pa.concat_arrays([part.slice(0, 0), part]))
                    second += bytes([batch.column(4)[k].as_py()]) * len(part)
                    packed += data[k].as_py()
                else:
                    keys += data[k].as_py()
        if band >= 0:
            yield from settle()
            if found:
                yield named()

    tasks = PARTS * blocks * (blocks + 1) // 2
    columns = band_columns(docs, blocks).repartitionById(tasks, "task").sortWithinPartitions("band", "slice", "start")
    return columns.mapInArrow(run, f"ia {kind}, ib {kind}").distinct()


def _classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``docs (id, text)``, and ``members (id, rep)`` by equal word set."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    seen = cut(sketches(docs))
    reps = seen.groupBy("row", "check").agg(F.min("id").alias("rep"))
    members = seen.distinct().join(reps, ["row", "check"]).select("id", "rep")
    return docs, cut(members)


def similar_sets(docs: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, similarity)`` of the representatives whose word sets are at or above the threshold alike, ``a < b``."""
    copies = members.where("id <> rep").select("id")
    n = copies.count()
    own = docs.join(broadcast_if_small(copies, n, MAX_BROADCAST_ROWS), "id", "left_anti")
    held = members.count() - n
    blocks = 1 if held <= HELD_RECORDS else -(-2 * held // HELD_RECORDS)
    near = cut(near_pairs(own, blocks, threshold - SLACK))
    ids = near.select(F.col("ia").alias("id")).union(near.select("ib")).distinct()
    # One string of words takes a third of the shuffle of an array.
    sets = docs.join(broadcast_if_small(ids, near.count(), MAX_BROADCAST_ROWS), "id", "left_semi").select("id", F.array_join(word_set(F.col("text")), " ").alias("w")).distinct()
    common = F.size(F.array_intersect("wa", "wb"))
    return (
        near.join(sets.select(F.col("id").alias("ia"), F.col("w").alias("wa")), "ia")
        .join(sets.select(F.col("id").alias("ib"), F.col("w").alias("wb")), "ib")
        .select("ia", "ib", F.split("wa", " ").alias("wa"), F.split("wb", " ").alias("wb"))
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), (common / (F.size("wa") + F.size("wb") - common)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b)`` of all records whose word sets are at least ``threshold`` alike, ``a < b``."""
    docs, members = _classes(df, key, text)
    links = similar_sets(docs, members, threshold)
    left = members.select(F.col("rep").alias("ra"), F.col("id").alias("ia"))
    right = members.select(F.col("rep").alias("rb"), F.col("id").alias("ib"))
    across = links.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb")).select("ia", "ib")
    within = left.join(right, (F.col("ra") == F.col("rb")) & (F.col("ia") < F.col("ib"))).select("ia", "ib")
    return across.unionByName(within).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(key, group_id, links)``: the connected group of every record with a text and the number of its partners.

    Copies are counted through their class, not paired with each other.
    """
    docs, members = _classes(df, key, text)
    links = cut(similar_sets(docs, members, threshold).select("a", "b"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("rep"), F.col("a").alias("other"))
    )
    partners = both.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("partners"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component"))
    return (
        members.join(sizes, "rep")
        .join(partners, "rep", "left")
        .join(groups, "rep", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("component", "rep").alias("group_id"),
            (F.coalesce("partners", F.lit(0)) + F.col("size") - 1).alias("links"),
        )
    )


def clean_abstracts(papers: DataFrame, residue: DataFrame, cut_off: DataFrame) -> DataFrame:
    """``(paper_id, abstract)`` without the cases of problems 4 and 5 and without empty abstracts."""
    drop = residue.select("paper_id").unionByName(cut_off.select("paper_id"))
    drop = broadcast_if_small(drop, drop.count(), MAX_BROADCAST_ROWS)
    return papers.select("paper_id", "abstract").where("trim(abstract) <> ''").join(drop, "paper_id", "left_anti")


def found(papers: DataFrame, residue: DataFrame, cut_off: DataFrame) -> DataFrame:
    """``(paper_id_a, paper_id_b)`` of the rows of papers that describe one publication."""
    pairs = duplicate_pairs(clean_abstracts(papers, residue, cut_off), "paper_id", "abstract")
    return pairs.select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"))
