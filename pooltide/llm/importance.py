"""Importance resampling towards a target distribution of hashed word runs.

Every run of 1 to ``max_words`` words is a feature; its bucket is the CRC-32 of
its bytes. CRC-32 is affine: up to a constant that depends on the length alone, it
is the XOR of what each byte contributes at its distance from the end. So all
features of a slice of texts are hashed at once: contributions come from a table
of byte by distance, ``bitwise_xor.reduceat`` joins those of a feature, and spans
longer than the table are cut into blocks that are folded one after the other.

A bucket's gain compares how common it is in the target and in the corpus, both
counted over all rows; a text's weight is the sum of its gains, and the highest
perturbed weights are drawn (Gumbel noise from a hash of the id).

Null and empty texts have no features, weight 0 and still a score, but are never
drawn. A null id is hashed as an empty one and comes last among ties. Repeated
rows count each and are drawn each; rows that agree in score and id are ranked in
some order. Only id and text are read, so extra columns do no harm. Empty tables
give empty results; an empty target is a target without features. Texts are
hashed whole: word positions of one slice are held, bytes in bounded chunks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pooltide.llm.tables import discard, written

#: Bytes of a feature that the position table covers; also the size of a folded block.
BLOCK = 64
#: Bytes of text, and of features, that are worked on together; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Most buckets: their counts and gains pass through the driver.
MAX_BUCKETS = 1 << 20
#: Scores that share a step are numbered together (a power of two).
STEP = 1024


def _lower_and_words() -> tuple[np.ndarray, np.ndarray]:
    """A-Z to a-z by byte, and whether the lower-cased byte belongs to a word (digits, letters, all beyond ASCII)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


_LOWER, _WORD = _lower_and_words()


class PositionTable:
    """CRC-32 of many spans of a byte buffer at once."""

    def __init__(self, block: int = BLOCK) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1)).astype(np.uint32)
        rows = [step]
        while len(rows) < block:
            rows.append((rows[-1] >> np.uint32(8)) ^ step[rows[-1] & np.uint32(255)])
        self.block = block
        #: By distance from the end * 256 + byte.
        self.flat = np.concatenate(rows)
        #: Moves a folded value one block further from the end: by byte of the value.
        self.shift = [rows[block - 1 - k] for k in range(4)]
        self.constants = {n: zlib.crc32(bytes(n)) for n in range(block + 1)}

    def _moved(self, value: np.ndarray) -> np.ndarray:
        out = self.shift[0][value & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ self.shift[k][(value >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def _blocks(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The XOR of contributions of spans of 1 to ``block`` bytes."""
        ends = np.cumsum(sizes)
        first = ends - sizes
        flat = np.arange(ends[-1])
        at = np.repeat(starts - first, sizes) + flat
        distance = np.repeat(ends - 1, sizes) - flat
        return np.bitwise_xor.reduceat(self.flat[(distance << 8) | data[at]], first)

    def crc32(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """CRC-32 of ``data[start:start + size]`` for each span (of one byte at least)."""
        if not len(starts):
            return np.zeros(0, np.uint32)
        if sizes.max() <= self.block:
            value = self._blocks(data, starts, sizes)
        else:
            count = -(-sizes // self.block)
            upto = np.cumsum(count)
            lead = upto - count
            place = np.arange(upto[-1]) - np.repeat(lead, count)
            head = sizes - (count - 1) * self.block
            cut = np.where(place == 0, np.repeat(head, count), self.block)
            begin = np.repeat(starts, count) + np.where(place == 0, 0, np.repeat(head, count) + (place - 1) * self.block)
            parts = self._blocks(data, begin, cut)
            value = parts[lead]
            for k in range(1, int(count.max())):
                on = np.flatnonzero(count > k)
                value[on] = self._moved(value[on]) ^ parts[lead[on] + k]
        kinds, which = np.unique(sizes, return_inverse=True)
        constants = np.array([self.constants.get(n) or zlib.crc32(bytes(n)) for n in kinds.tolist()], np.uint32)
        return value ^ constants[which]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts as (bytes, offsets of texts in them), each of ``limit`` bytes at most or of one text."""
    texts = column.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, at, raw = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bytes with one space after each word, starts and sizes of words in them, and the first word of each text."""
    text = _LOWER[data]
    word = _WORD[text]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(word)]
    begins[heads] = word[heads]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    ends[tails] = word[tails]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sizes = stop - start
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    kept = np.ones(len(joined), bool)
    kept[at + sizes] = False
    joined[kept] = text[word]
    return joined, at, sizes, np.searchsorted(start, offsets)


def features(data: np.ndarray, offsets: np.ndarray, table: PositionTable, buckets: int, max_words: int):
    """For each run length: the bucket of every feature, in order, and the first feature of each text."""
    joined, at, sizes, first = words_of(data, offsets)
    n = len(at)
    for words in range(1, max_words + 1):
        whole = np.ones(max(n - words + 1, 0), bool)
        if words > 1:
            text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            whole = text_of[words - 1:] == text_of[:len(whole)]
        lead = np.flatnonzero(whole)
        spans = at[lead + words - 1] + sizes[lead + words - 1] - at[lead]
        out = np.zeros(len(lead), np.int64)
        upto = np.cumsum(spans)
        i = 0
        while i < len(lead):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE_BYTES)))
            out[i:j] = table.crc32(joined, at[lead[i:j]], spans[i:j]) % buckets
            i = j
        yield out, np.searchsorted(lead, first)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = 10000, max_words: int = 1) -> DataFrame:
    """(bucket, n): occurrences of features over all texts; each task sends its own sums, one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = PositionTable(), np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in slices(batch.column(0)):
                for found, _ in features(data, offsets, table, buckets, max_words):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10000) -> np.ndarray:
    """The gain of each bucket, from counts of the corpus and of the target: floor(1000 ln) of the smoothed ratio."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets; {MAX_BUCKETS} at most")
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (corpus, target))
    of_all, of_target = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * of_all / ((s.get(b, 0) + 1.0) * of_target)))
                     for b in range(buckets)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", max_words: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket, MAX_BUCKETS at most
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gain = PositionTable(), shared.value
        for batch in batches:
            parts = []
            for data, offsets in slices(batch.column(1)):
                rows = np.zeros((3, len(offsets) - 1), np.int64)
                for order, (found, first) in enumerate(features(data, offsets, table, len(gain), max_words)):
                    upto = np.append(0, np.cumsum(gain[found]))
                    if order == 0:
                        rows[0] = np.diff(first)
                    rows[1] += np.diff(first)
                    rows[2] += np.diff(upto[first])
                parts.append(rows)
            if parts:
                sums = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, pa.int64()) for x in sums)], ["doc_id", "n_words", "n_features", "weight"])

    return df.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def perturbed(weight: str = "weight", doc_id: str = "doc_id", seed: int = 2024):
    """The weight plus Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    word = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(word, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.col(weight) + F.floor(-1000.0 * F.log(-F.log(share))).cast("bigint")


def draw(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... for the highest scores of the texts of ``min_words`` or more, ``percent`` of those; else null.

    Two numbers reach the driver, how many texts may be drawn and the step of
    scores below which none is. Only rows at or above it are numbered, score by score.
    """
    step = F.floor(F.col("score") / STEP).cast("bigint")
    fit = F.col("n_words") >= min_words
    steps = written(scored.where(fit).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")), "score-steps")
    wanted = (steps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = steps.withColumn("above", above).where(F.col("above") < wanted).agg(F.min("step")).first()[0]
    discard(steps)
    none = F.lit(None).cast("bigint")
    if low is None:
        return scored.withColumn("rank", none)
    near = fit & (step >= low)
    drawn = scored.where(near)
    each = drawn.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("step", step)
    before = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    outer = each.groupBy("step").agg(F.sum("n").alias("n")).select("step", F.coalesce(
        F.sum("n").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    # Written, so that rows are dealt by score and not by step.
    starts = written(each.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0))).join(outer, "step").select(
        "score", (F.col("inner") + F.col("outer")).alias("start")), "score-starts")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("start")
    numbered = drawn.join(starts, "score").withColumn("rank", place).select(
        *scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return numbered.unionByName(scored.where(~near).withColumn("rank", none))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = 10000, max_words: int = 1,
             percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` says which are drawn towards ``target``."""
    gain = gains(bucket_counts(docs, buckets=buckets, max_words=max_words),
                 bucket_counts(target, buckets=buckets, max_words=max_words), buckets)
    scored = written(weights(docs, gain, max_words=max_words).withColumn("score", perturbed(seed=seed)), "weights")
    return draw(scored, percent, min_words)
