"""Token counts without the tokens: rank-synchronous merging of ragged arrays.

The new words of a slice of texts are laid out as one flat array of symbols.
In each round every word merges its pair of lowest rank, all words at once,
until no word has a pair left; what counts is how many symbols survive. Words
counted before come from a bounded memory of the worker.

Null text counts as empty. Extra columns stay; output columns replace input
columns of the same name. Empty tables give empty results; repeated rows are
counted each. Whole texts are counted, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pooltide.llm.vocab import MAX_WORD_CHARS, MAX_WORDS, ByteBpe, load

#: Characters of text whose words are merged together; a longer text is a slice of its own.
SLICE_CHARS = 4 << 20
_NONE = np.int32(2**31 - 1)


class MergeTable:
    """Merge ranks of pairs as arrays: a dense square over bytes, sorted keys for the rest."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.size = np.int64(bpe.size)
        keys = np.fromiter(bpe.ranks.keys(), np.int64, len(bpe.ranks))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.values = np.append(np.fromiter(bpe.ranks.values(), np.int32, len(bpe.ranks))[order], _NONE)
        self.merged = np.array(bpe.merged, np.int32)
        self.bytes = np.array(bpe.byte_ids, np.int32)
        # A merge may only ever use pairs that were made before it; then all places
        # of a word's lowest pair can be merged in the same round.
        made = {m: r for r, m in reversed(list(enumerate(bpe.merged)))}
        self.ordered = all(made.get(a, -1) < r and made.get(b, -1) < r
                           for r, (a, b) in enumerate(zip(bpe.left.tolist(), bpe.right.tolist())))
        letters = np.arange(256)
        pairs = self._find(np.repeat(self.bytes[letters], 256), np.tile(self.bytes[letters], 256))
        self.byte_pairs = pairs

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word (none of them empty)."""
        result = np.zeros(len(words), np.int64)
        for word, sizes, _ in self.rounds(words):
            result[word] = sizes
        return result

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """The surviving symbols of each word, packed as little-endian unsigned 32-bit integers."""
        result = [b""] * len(words)
        for word, sizes, symbols in self.rounds(words):
            packed, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            for w, a, b in zip(word.tolist(), [0, *ends], ends):
                result[w] = packed[a:b]
        return result

    def rounds(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After each round the words that are finished: their numbers, sizes and symbols."""
        if not words:
            return
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.bytes[raw]
        rank = np.full(len(raw), _NONE, np.int32)
        if len(raw) > 1:
            rank[:-1] = self.byte_pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        ends = np.cumsum(sizes)
        rank[ends - 1] = _NONE
        word = np.arange(len(words))
        while len(word):
            starts = ends - sizes
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != _NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                yield word[~live], sizes[~live], symbols[~keep]
                symbols, rank = symbols[keep], rank[keep]
                word, sizes, lowest = word[live], sizes[live], lowest[live]
                ends = np.cumsum(sizes)
                if not len(word):
                    break
                starts = ends - sizes
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hits = self._apart(hits, starts, sizes)
            symbols[hits] = self.merged[rank[hits]]
            gone = hits + 1
            keep = np.ones(len(symbols), bool)
            keep[gone] = False
            new = hits - np.arange(len(hits))
            owner = np.searchsorted(starts, hits, side="right") - 1
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            # The pair that began at a swallowed symbol ends with its word.
            rank[hits] = rank[gone]
            symbols, rank = symbols[keep], rank[keep]
            ends = np.cumsum(sizes)
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            touched = touched[~last[touched]]
            rank[new[last[new]]] = _NONE
            rank[touched] = self._find(symbols[touched], symbols[touched + 1])

    def _apart(self, hits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of hits that overlap (a run of equal symbols) every other one, from the left."""
        if not self.ordered:
            owner = np.searchsorted(starts, hits, side="right") - 1
            return hits[np.unique(owner, return_index=True)[1]]
        if len(hits) < 2:
            return hits
        fresh = np.append(True, np.diff(hits) != 1)
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
        return hits[(np.arange(len(hits)) - head) % 2 == 0]


def count_texts(texts: list[str], store: dict) -> list[int]:
    bpe: ByteBpe = store["bpe"]
    if "table" not in store:
        store["table"] = MergeTable(bpe)
    known = store.get("counts")
    if known is None or len(known) > MAX_WORDS:
        known = store["counts"] = {}
    parts, extra = [], []
    for text in texts:
        segments = bpe.segments(text)
        parts.append([w for part, _ in segments for w in bpe.words(part)])
        extra.append(len(segments) - 1)
    fresh = set().union(*parts).difference(known)
    long_words: dict[str, int] = {}
    if fresh:
        fresh = list(fresh)
        for word, n in zip(fresh, store["table"].counts([w.encode() for w in fresh]).tolist()):
            (known if len(word) <= MAX_WORD_CHARS else long_words)[word] = n
    if long_words:
        known = known | long_words
    of = known.__getitem__
    return [sum(map(of, words)) + n for words, n in zip(parts, extra)]


def encode_texts(texts: list[str], store: dict) -> list[bytes]:
    """Packed ids of several texts; the words that are new are merged together."""
    bpe: ByteBpe = store["bpe"]
    if "table" not in store:
        store["table"] = MergeTable(bpe)
    known = store.get("pieces")
    if known is None or len(known) > MAX_WORDS:
        known = store["pieces"] = {}
    parts = [[(bpe.words(part), special) for part, special in bpe.segments(text)] for text in texts]
    fresh = list(set().union(*(words for segments in parts for words, _ in segments)).difference(known))
    made = dict(zip(fresh, store["table"].pieces([w.encode() for w in fresh])))
    known.update((w, p) for w, p in made.items() if len(w) <= MAX_WORD_CHARS)
    if any(len(w) > MAX_WORD_CHARS for w in made):
        known = known | made
    of = known.__getitem__
    return [b"".join(b"".join(map(of, words)) + (special.to_bytes(4, "little") if special is not None else b"")
                     for words, special in segments) for segments in parts]


def token_counts(df: DataFrame, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens",
                 path: str | None = None) -> DataFrame:
    """Add the text's UTF-8 bytes and its number of tokens (both long), special strings inside texts as one token."""
    get = load(df.sparkSession, path)
    fresh = [T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())]
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in (n_bytes, n_tokens)), *fresh])
    stay = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = get()
        for batch in batches:
            counts: list[int] = []
            sizes: list[int] = []
            held: list[str] = []
            chars = 0
            for value in batch.column(text):
                t = value.as_py() or ""
                sizes.append(len(t.encode()))
                held.append(t)
                chars += len(t)
                if chars >= SLICE_CHARS:
                    counts += count_texts(held, store)
                    held, chars = [], 0
            counts += count_texts(held, store) if held else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in stay),
                 pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema.names)

    return df.mapInArrow(run, schema)
