"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower case, ASCII punctuation counts as space. Every run of 4 words of
a test item is a seed. One scan of the documents finds the places where a seed may
stand (a filter of fixed size over all seeds), and cuts a passage around places
that lie close together, with room for the longest item on both sides. Passages
and items that share a seed, however common it is, are aligned word by word (match
2, mismatch and gap -1); similarity is the score as a share of the item's own.
Passages of the same words, and items of the same words, are aligned once, and all
their copies get the result. A pair in which too few of the item's words stand in
the passage to reach the similarity is not aligned.

Items of fewer than 4 words carry too little to be told from chance and take no
part; nor do null and empty texts. Repeated items or documents are compared each,
rows without an id too. Extra columns are ignored. An empty table on either side
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pooltide.llm.line_dedup import _PUNCTUATION, row_key
from pooltide.llm.near_dup import WordHashes
from pooltide.llm.tables import written

SEED_WORDS, SIMILARITY = 4, 0.5
MATCH, MISS, GAP = 2, -1, 1
#: Bits of the filter over all seeds (1 MB, however many seeds there are); cells of one block of alignments.
FILTER_BITS, CELLS = 1 << 23, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_values(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = (text or "").lower().encode().translate(_PUNCTUATION).split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def seed_values(words: np.ndarray) -> np.ndarray:
    """Value of the run of words that begins at each place."""
    n = len(words) - SEED_WORDS + 1
    if n < 1:
        return np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(SEED_WORDS):
        value = (value ^ (value >> np.uint64(29))) * _ODD + words[i:n + i]
    value = (value ^ (value >> np.uint64(31))) * _ODD
    return (value ^ (value >> np.uint64(32))).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words, seeds) of the items that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words = [word_values(v.as_py(), hashes) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists([w.view(np.int64) for w in words]), _lists([np.unique(seed_values(w)) for w in words])],
                ["item_id", "words", "seeds"])

    return items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string")).mapInArrow(
        run, f"item_id {items.schema[item_id].dataType.simpleString()}, words array<bigint>, seeds array<bigint>").where("size(seeds) > 0")


def passages(docs: DataFrame, doc_id: str, text: str, bits: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, row, start, words, seeds, said): stretches of documents around places where a seed may stand; ``said`` is a digest of all words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)  # FILTER_BITS bits
    room = longest + longest // 4 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, known = WordHashes(), shared.value
        for batch in batches:
            at, starts, words, seeds = [], [], [], []
            for i, value in enumerate(batch.column(2)):
                own = word_values(value.as_py(), hashes)
                run_values = seed_values(own)
                low = run_values & (FILTER_BITS - 1)
                hits = np.flatnonzero((known[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                if not len(hits):
                    continue
                for part in np.split(hits, np.flatnonzero(np.diff(hits) > room) + 1):
                    first = max(0, int(part[0]) - room)
                    at.append(i)
                    starts.append(first)
                    words.append(own[first:int(part[-1]) + SEED_WORDS + room].view(np.int64))
                    seeds.append(np.unique(run_values[part]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int64()), _lists(words), _lists(seeds),
                 pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary())],
                ["doc_id", "row", "start", "words", "seeds", "said"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), row_key(doc_id, text), F.col(text).cast("string")).mapInArrow(
        run, f"doc_id {kind}, row bigint, start bigint, words array<bigint>, seeds array<bigint>, said binary")


def align(items: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the place in the passage where it ends."""
    score, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = np.argsort([len(p) for p in parts], kind="stable")
    s = 0
    while s < len(order):
        stop = s + 1
        while stop < len(order) and (stop + 1 - s) * len(parts[order[stop]]) <= CELLS:
            stop += 1
        rows = order[s:stop]
        s = stop
        wide, tall = len(parts[rows[-1]]), max(len(items[r]) for r in rows)
        # Padding never matches: 0 and 1 are equal to no hash but by a chance of 2 in 2^64.
        p, q = np.zeros((len(rows), wide), np.int64), np.ones((len(rows), tall), np.int64)
        for k, r in enumerate(rows):
            p[k, :len(parts[r])], q[k, :len(items[r])] = parts[r], items[r]
        slope = GAP * np.arange(1, wide + 1, dtype=np.int32)
        last = np.zeros((len(rows), wide), np.int32)
        best, where = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i in range(tall):
            diagonal = np.where(p == q[:, [i]], np.int32(MATCH), np.int32(MISS))
            diagonal[:, 1:] += last[:, :-1]
            row = np.maximum(np.maximum(diagonal, last - GAP), 0)
            last = np.maximum.accumulate(row + slope, axis=1) - slope
            peak = last.argmax(axis=1)
            top = last[np.arange(len(rows)), peak]
            where = np.where(top > best, peak, where)
            best = np.maximum(best, top)
        score[rows], end[rows] = best, where
    return score, end


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, score, similarity, start_word, end_word): documents that hold a test item or an edited copy of it.

    One row for each document and item, of the best passage; ``row`` tells rows
    apart that share an id. Runs jobs: items, filter and passages.
    """
    known = written(item_words(items, item_id, item_text), "items")
    seeds = known.select("item_id", F.explode("seeds").alias("seed"))
    rows = seeds.select((F.pmod("seed", F.lit(FILTER_BITS)) + 1).alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits")).collect()  # FILTER_BITS bits at most; both functions count from 1
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["bucket"] - 1) * len(own):][:len(own)] = own
    longest = known.agg(F.max(F.size("words"))).collect()[0][0] or 0
    cut = written(passages(docs, doc_id, text, bits, longest), "passages")

    # One passage, and one item, for all of the same words.
    texts = cut.groupBy("said").agg(F.min_by(F.struct("words", "seeds"), F.struct("row", "start")).alias("of")).select("said", "of.*")
    asked = known.groupBy("words").agg(F.first("seeds").alias("seeds")).select(F.xxhash64("words").alias("ask"), F.col("words").alias("item"), "seeds")
    pairs = (texts.select("said", F.explode("seeds").alias("seed")).join(asked.select("ask", F.explode("seeds").alias("seed")), "seed")
             .select("said", "ask").distinct())
    both = pairs.join(texts.drop("seeds"), "said").join(asked.drop("seeds"), "ask").select("said", "words", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                part, item = ([np.asarray(v.values, np.int64) for v in batch.column(c)] for c in (1, 2))
                # Only words of the item that stand in the passage can match, each once.
                may = [k for k, (p, q) in enumerate(zip(part, item)) if np.isin(q, p).sum() >= similarity * len(q)]
                part, item, batch = [part[k] for k in may], [item[k] for k in may], batch.take(pa.array(may, pa.int64()))
                score, end = align(item, part)
                share = score / (MATCH * np.fromiter(map(len, item), np.int64, len(item)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(score, pa.int64()), pa.array(share, pa.float64()), pa.array(end, pa.int64())],
                    ["said", "item", "score", "similarity", "end"])

    scored = both.mapInArrow(run, "said binary, item array<bigint>, score bigint, similarity double, end bigint").where(
        F.col("similarity") >= similarity)
    scored = (scored.join(cut.select("doc_id", "row", "start", "said"), "said")
              .join(known.select("item_id", F.col("words").alias("item")), "item")
              .select("doc_id", "row", "item_id", "score", "similarity", F.col("start").alias("start_word"), (F.col("start") + F.col("end")).alias("end_word")))
    best = F.max(F.struct("score", "similarity", -F.col("start_word"), "end_word")).alias("best")
    return scored.groupBy("doc_id", "row", "item_id").agg(best).select(
        "doc_id", "row", "item_id", "best.score", "best.similarity", (-F.col("best.col3")).alias("start_word"), "best.end_word")


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay."""
    bad = contaminated(docs, items, doc_id, text, **options).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row_key(doc_id, text)).join(bad, "__row", "left_anti").drop("__row")
