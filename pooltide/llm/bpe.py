"""BPE encoding and decoding.

A word is a doubly linked list of symbols, with a priority queue of the merge
ranks of neighbouring pairs; entries whose pair has changed meanwhile are stale
and skipped. Decoding concatenates vocabulary strings. Words that were merged
before come from a bounded memory of the worker.

Null text counts as empty and gives no ids. Extra columns stay as they are; an
output column replaces an input column of the same name. Empty tables give empty
results, repeated rows are encoded each. Texts are encoded whole: only the words
of one text are held at a time, and a word of any length costs n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pooltide.llm.vocab import MAX_WORD_CHARS, MAX_WORDS, ByteBpe, load


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int], size: int) -> list[int]:
    """Merge neighbouring symbols by ascending rank, left before right."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    #: Rank of the pair that begins here; -1: none. A queued entry of another rank is stale.
    now = [rank_of(a * size + b, -1) for a, b in zip(symbols, symbols[1:])]
    now.append(-1)
    queue = [r << 40 | i for i, r in enumerate(now) if r >= 0]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i, rank = entry & 0xFFFFFFFFFF, entry >> 40
        if now[i] != rank:
            continue
        j = after[i]
        k = after[j]
        own = symbols[i] = merged[rank]
        after[i] = k
        now[j] = -1
        if k < n:
            before[k] = i
            now[i] = r = rank_of(own * size + symbols[k], -1)
            if r >= 0:
                heappush(queue, r << 40 | i)
        else:
            now[i] = -1
        h = before[i]
        if h >= 0:
            now[h] = r = rank_of(symbols[h] * size + own, -1)
            if r >= 0:
                heappush(queue, r << 40 | h)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class _Words(dict):
    """Packed ids by word."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        bpe = self.bpe
        symbols = [bpe.byte_ids[b] for b in word.encode()]
        ids = np.array(merge_symbols(symbols, bpe.ranks, bpe.merged, bpe.size), "<u4").tobytes()
        if len(word) <= MAX_WORD_CHARS:
            self[word] = ids
        return ids


def encode_text(text: str, store: dict) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    bpe: ByteBpe = store["bpe"]
    words = store.get("words")
    if words is None or len(words) > MAX_WORDS:
        words = store["words"] = _Words(bpe)
    of, out = words.__getitem__, []
    for part, special in bpe.segments(text):
        out.extend(map(of, bpe.words(part)))
        if special is not None:
            out.append(special.to_bytes(4, "little"))
    return b"".join(out)


def decode_ids(packed: bytes, store: dict) -> str:
    """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
    pieces = store["bpe"].pieces
    return b"".join(map(pieces.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def with_column(df: DataFrame, column: str, kind: T.DataType, rows) -> DataFrame:
    """``df`` with one column that ``rows`` computes from each Arrow batch; the new column is the last."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != column), T.StructField(column, kind)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fresh = rows(batch)
            yield pa.RecordBatch.from_arrays(
                [fresh if n == column else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids``: the text's ids, packed as little-endian unsigned 32-bit integers (binary).

    Special strings of the vocabulary inside texts become their ids, as the
    vocabulary's own library does by default; no others are added.
    """
    get = load(df.sparkSession, path)

    def rows(batch: pa.RecordBatch) -> pa.Array:
        store = get()
        return pa.array([encode_text(t.as_py() or "", store) for t in batch.column(text)], pa.binary())

    return with_column(df, ids, T.BinaryType(), rows)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``text``: the packed ids as text, special tokens included; null ids give empty text."""
    get = load(df.sparkSession, path)

    def rows(batch: pa.RecordBatch) -> pa.Array:
        store = get()
        return pa.array([decode_ids(p.as_py() or b"", store) for p in batch.column(ids)], pa.string())

    return with_column(df, text, T.StringType(), rows)
