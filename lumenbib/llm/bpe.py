"""Problem 8: the ids of every text by a public byte-level BPE vocabulary.

Method: within a pre-token a segment tree over byte positions stores the leftmost minimum pair rank. Each merge
reads the root, and updates the leaves of the merged pair and of its live neighbours, in logarithmic time, so
a run of a million bytes costs n log n and not n squared. Pre-tokens recur, so each Python worker keeps a
bounded table of the ones it has merged.

Only the vocabulary file (its size is fixed by the vocabulary) is broadcast. Texts stay in their partitions:
encoding adds no shuffle. Cases, defined: null and empty texts have an empty list; blank text is encoded as it
is; strings that look like special tokens are ordinary text; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers before it starts afresh, and the longest that it remembers.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
#: Ids per Arrow batch that leaves a worker, at least one row.
BATCH_IDS = 500_000

_NONE = 1 << 60


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly the leftmost pair of least rank is joined."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        while i > 1:
            i >>= 1
            left, right = tree[2 * i], tree[2 * i + 1]
            least = left if left <= right else right
            if tree[i] == least:
                break
            tree[i] = least

    while (least := tree[1]) != _NONE:
        i = 1
        while i < size:
            i = 2 * i if tree[2 * i] == least else 2 * i + 1
        i -= size
        gone = after[i]
        nxt = after[gone]
        after[i], end[i] = nxt, end[gone]
        put(gone, _NONE)
        if nxt < n:
            before[nxt] = i
            put(i, ranks.get(piece[i : end[nxt]], _NONE))
        else:
            put(i, _NONE)
        if (prev := before[i]) >= 0:
            put(prev, ranks.get(piece[prev : end[i]], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts by the vocabulary in ``data``, the content of a ``.tiktoken`` file."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if not text:
            return ids
        seen, ranks = self.seen, self.ranks
        for word in self.split(text):
            known = seen.get(word)
            if known is None:
                piece = word.encode("utf-8", "replace")
                rank = ranks.get(piece)
                known = [rank] if rank is not None else merge(piece, ranks)
                if len(piece) <= REMEMBERED_BYTES:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = known
            ids.extend(known)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def vocabulary(spark: SparkSession, tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The vocabulary file as a broadcast value; the driver reads it, executors need no such path."""
    return spark.sparkContext.broadcast(read_vocabulary(f"{tokenizer_dir}/{name}"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` of every row of ``df``."""
    spark = df.sparkSession
    data = vocabulary(spark, tokenizer_dir, name)
    rows = df.select(key, text)
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data.value)
        for batch in batches:
            keys, ids, offsets, first = batch.column(0), array("i"), [0], 0
            for i, value in enumerate(batch.column(1)):
                ids.extend(encoder.encode(value.as_py()))
                offsets.append(len(ids))
                if len(ids) >= BATCH_IDS or i + 1 == len(keys):
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), lists], names=[key, "ids"])
                    ids, offsets, first = array("i"), [0], i + 1

    return rows.mapInArrow(run, schema)
