"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

A file is a Parquet dataset whose rows are frames. A frame holds whole documents
in ascending order of their ids: a header with document ids and token counts, and
their token stream cut into blocks of BLOCK tokens. Every block is coded from a
fresh state and has its own CRC-32, so blocks can be decoded one by one.

Coding of an id. The order-2 and the order-1 context (hashed tables of the id that
followed last time, with its run of hits) each name a candidate. Adaptive weights,
chosen by the confidence of both, mix three predictions: the order-2 candidate, the
order-1 candidate and order 0. The range coder codes which of them gives the id; for
order 0 the upper byte is coded by adaptive frequencies and the lower one evenly.
Everything is integer arithmetic. The blocks of a frame advance in step, one token
of each at a time, as arrays.

Ids must be below 65536. Null text gives the end id alone. Documents without an id
come first; equal ids are ordered by a hash of their text and stored each. An empty
table gives no rows. A document of any length is in one frame, cut into blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pooltide.llm.token_counts import SLICE_CHARS, encode_texts
from pooltide.llm.vocab import load

BLOCK, FRAME_TOKENS = 1024, 1024 * 2048
_MAGIC, _HEAD = b"PTKS", "<4sIII"
_SLOTS, _SLOT_BITS = 1 << 8, 8
_FULL, _TOTAL_BITS = 1 << 48, 16
_TOTAL, _MIN = 1 << _TOTAL_BITS, 1 << 32
_RATE, _REFRESH, _STEP = 5, 64, 24
#: Weights stay inside, so no prediction ever gets an empty interval.
_LEAST, _MOST = 48, _TOTAL - 48


class _Model:
    """Predictors of all blocks of a frame; the state of a block is never seen by another."""

    def __init__(self, lanes: int) -> None:
        self.lane = np.arange(lanes)
        self.followed1, self.followed2 = (np.full(lanes * _SLOTS, -1, np.int32) for _ in range(2))
        self.runs1, self.runs2 = (np.zeros(lanes * _SLOTS, np.int8) for _ in range(2))
        self.weight2 = np.full(lanes * 32, _TOTAL // 4, np.int64)
        self.weight1 = np.full(lanes * 32, _TOTAL // 4, np.int64)
        self.counts = np.ones((lanes, 256), np.int64)
        self.sums = np.zeros((lanes, 257), np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps = 0

    def predict(self, n: int) -> None:
        """Candidates and weights of the next id of the first ``n`` blocks."""
        if self.steps % _REFRESH == 0:
            total = np.cumsum(self.counts, axis=1)
            self.sums[:, 1:] = total * (_TOTAL - 256) // total[:, -1:] + np.arange(1, 257)
        self.steps += 1
        base = self.lane[:n] << _SLOT_BITS
        last, before = self.last[:n], self.before[:n]
        self.at1 = base + ((last * 40503 >> 4) & (_SLOTS - 1))
        self.at2 = base + ((last * 40503 + before * 60493 >> 5) & (_SLOTS - 1))
        self.id1, self.id2 = self.followed1[self.at1], self.followed2[self.at2]
        self.run1, self.run2 = self.runs1[self.at1], self.runs2[self.at2]
        self.state = (self.lane[:n] << 5) + (self.run2 << 2) + self.run1 + 16 * (self.id1 == self.id2)
        self.share2 = self.weight2[self.state]
        self.rest = self.weight1[self.state]
        self.share1 = np.maximum((_TOTAL - self.share2) * self.rest >> _TOTAL_BITS, 1)

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``hit1``: given by the order-1 candidate because the order-2 candidate failed."""
        n = len(ids)
        self.weight2[self.state] = np.clip(self.share2 + ((hit2 * _TOTAL - self.share2) >> _RATE), _LEAST, _MOST)
        fresh = np.clip(self.rest + ((hit1 * _TOTAL - self.rest) >> _RATE), _LEAST, _MOST)
        self.weight1[self.state] = np.where(hit2, self.rest, fresh)
        same1 = self.id1 == ids
        self.followed1[self.at1], self.followed2[self.at2] = ids, ids
        self.runs1[self.at1] = np.where(same1, np.minimum(self.run1 + 1, 3), 0)
        self.runs2[self.at2] = np.where(hit2, np.minimum(self.run2 + 1, 3), 0)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Coded blocks of a stream of ids."""
    if not len(ids):
        return []
    if int(ids.max()) >= _TOTAL or int(ids.min()) < 0:
        raise ValueError("ids must be between 0 and 65535")
    lanes = -(-len(ids) // BLOCK)
    tall = min(BLOCK, len(ids))
    stream = np.zeros(lanes * BLOCK, np.int64)
    stream[:len(ids)] = ids
    stream = np.ascontiguousarray(stream.reshape(lanes, BLOCK).T)
    left_over = len(ids) - (lanes - 1) * BLOCK
    model = _Model(lanes)
    width = 3 * tall + 8
    out = np.zeros(lanes * width, np.int32)
    row = np.arange(lanes) * width
    place = row.copy()
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _FULL - 1, np.int64)
    sums, counts = model.sums.ravel(), model.counts.ravel()

    def put(who, start: np.ndarray, share: np.ndarray, bits: int) -> None:
        part = span[who] >> bits
        l, s, p = low[who] + part * start, part * share, place[who]
        over = l >= _FULL
        if over.any():
            out[p[over] - 1] += 1
            l = np.where(over, l - _FULL, l)
        while True:
            short = s < _MIN
            if not short.any():
                break
            out[p[short]] = l[short] >> 32
            l = np.where(short, (l & (_MIN - 1)) << 16, l)
            s = np.where(short, s << 16, s)
            p = p + short
        low[who], span[who], place[who] = l, s, p

    for t in range(tall):
        n = lanes if t < left_over else lanes - 1
        x = stream[t, :n]
        model.predict(n)
        hit2 = model.id2 == x
        hit1 = (model.id1 == x) & ~hit2
        both = model.share2 + model.share1
        put(slice(0, n), np.where(hit2, 0, np.where(hit1, model.share2, both)),
            np.where(hit2, model.share2, np.where(hit1, model.share1, _TOTAL - both)), _TOTAL_BITS)
        new = np.flatnonzero(~(hit2 | hit1))
        if len(new):
            upper, lower = x[new] >> 8, x[new] & 255
            at = new * 257 + upper
            start = sums[at]
            share = sums[at + 1] - start
            put(new, (start << 8) + lower * share, share, _TOTAL_BITS + 8)
            counts[new * 256 + upper] += _STEP
        model.learn(x, hit2, hit1)
    for shift in (32, 16, 0):
        out[place] = (low >> shift) & 0xFFFF
        place += 1
    words = out.reshape(lanes, width)
    for j in range(int((place - row).max()) - 1, 0, -1):
        words[:, j - 1] += words[:, j] >> 16
        words[:, j] &= 0xFFFF
    packed = words.astype("<u2")
    return [packed[i, :n].tobytes() for i, n in enumerate((place - row).tolist())]


def decode_blocks(blocks: list[bytes], tokens: int) -> np.ndarray:
    """The stream of ``tokens`` ids that the blocks hold."""
    if not tokens:
        return np.empty(0, np.int64)
    lanes = len(blocks)
    tall = min(BLOCK, tokens)
    left_over = tokens - (lanes - 1) * BLOCK
    width = max(map(len, blocks)) // 2 + 5
    words = np.zeros((lanes, width), np.int64)
    for i, b in enumerate(blocks):
        words[i, :len(b) // 2] = np.frombuffer(b, "<u2")
    value = (words[:, 0] << 32) + (words[:, 1] << 16) + words[:, 2]
    words = words.ravel()
    place = np.arange(lanes) * width + 3
    span = np.full(lanes, _FULL - 1, np.int64)
    model = _Model(lanes)
    stream = np.zeros((BLOCK, lanes), np.int64)
    sums, counts = model.sums.ravel(), model.counts.ravel()

    def take(who, part: np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        v, s, p = value[who] - part * start, part * share, place[who]
        while True:
            short = s < _MIN
            if not short.any():
                break
            v = np.where(short, (v << 16) + words[p], v)
            s = np.where(short, s << 16, s)
            p = p + short
        value[who], span[who], place[who] = v, s, p

    for t in range(tall):
        n = lanes if t < left_over else lanes - 1
        model.predict(n)
        who = slice(0, n)
        part = span[who] >> _TOTAL_BITS
        at = np.minimum(value[who] // part, _TOTAL - 1)
        both = model.share2 + model.share1
        hit2 = at < model.share2
        hit1 = (at < both) & ~hit2
        take(who, part, np.where(hit2, 0, np.where(hit1, model.share2, both)),
             np.where(hit2, model.share2, np.where(hit1, model.share1, _TOTAL - both)))
        x = np.where(hit2, model.id2, model.id1).astype(np.int64)
        new = np.flatnonzero(~(hit2 | hit1))
        if len(new):
            part = span[new] >> (_TOTAL_BITS + 8)
            at = np.minimum(value[new] // part, (_TOTAL << 8) - 1)
            base = new * 257
            for step in (128, 64, 32, 16, 8, 4, 2, 1):
                base = np.where(sums[base + step] <= at >> 8, base + step, base)
            start = sums[base]
            share = sums[base + 1] - start
            lower = (at - (start << 8)) // share
            take(new, part, (start << 8) + lower * share, share)
            upper = base - new * 257
            counts[new * 256 + upper] += _STEP
            x[new] = (upper << 8) + lower
        stream[t, :n] = x
        model.learn(x, hit2, hit1)
    return stream.T.ravel()[:tokens]


def pack_frame(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    table = np.array([(len(b), zlib.crc32(b)) for b in blocks], "<u4").reshape(-1, 2)
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = (np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(sizes, "<i8").tobytes() + table.tobytes())
    return struct.pack(_HEAD, _MAGIC, len(doc_ids), len(blocks), zlib.crc32(body)) + body + b"".join(blocks)


def unpack_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and the token stream; a damaged frame is an error."""
    magic, docs, n_blocks, check = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    end = at + docs * 17 + n_blocks * 8
    if magic != _MAGIC or zlib.crc32(data[at:end]) != check:
        raise ValueError("damaged frame header")
    ids, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    table = np.frombuffer(data, "<u4", 2 * n_blocks, at + 17 * docs).reshape(-1, 2)
    blocks = []
    for size, crc in table.tolist():
        blocks.append(data[end:end + size])
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError("damaged block")
        end += size
    return [None if n else i for i, n in zip(ids.tolist(), null.tolist())], sizes, decode_blocks(blocks, int(sizes.sum()))


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, path: str | None = None) -> None:
    """Encode every text, append ``end_id`` and write frames to ``folder``, in ascending order of ids. Runs jobs."""
    spark = docs.sparkSession
    get = load(spark, path)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, names, done, number = get(), ["part", "frame", "tokens", "data"], 0, 0
        owners: list[int | None] = []
        parts: list[bytes] = []
        part = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, number, owners, parts
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
            data = pack_frame(owners, [len(p) // 4 for p in parts], ids)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                                              pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names)
            done, number, owners, parts = 0, number + 1, [], []
            return row

        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            owner = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            s = 0
            while s < len(texts):
                stop, chars = s, 0
                while stop < len(texts) and chars < SLICE_CHARS:
                    chars += len(texts[stop])
                    stop += 1
                for k, packed in enumerate(encode_texts(texts[s:stop], store), s):
                    owners.append(owner[k])
                    parts.append(packed + tail)
                    done += len(packed) // 4 + 1
                    if done >= FRAME_TOKENS:
                        yield flush()
                s = stop
        if owners:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(run, "part int, frame int, tokens bigint, data binary").write.mode("overwrite").option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's packed ids and how many ids stand before it in all files."""
    frames = spark.read.schema("part int, frame int, tokens bigint, data binary").parquet(folder)
    sizes = frames.select("part", "frame", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("own"))
    before = parts.select("part", F.coalesce(F.sum("own").over(  # one row per range of ids
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(before, "part").select(
        "part", "frame", (F.col("inside") + F.col("earlier")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                owners, counts, ids = unpack_frame(batch.column(3)[k].as_py())
                ends = np.cumsum(counts)
                packed = ids.astype("<u4").tobytes()
                cuts = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * len(owners), pa.int32()), pa.array([batch.column(1)[k].as_py()] * len(owners), pa.int32()),
                     pa.array(owners, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([packed[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["part", "frame", "doc_id", "inner", "n_tokens", "ids"])

    found = frames.mapInArrow(run, "part int, frame int, doc_id bigint, inner bigint, n_tokens bigint, ids binary")
    return found.join(F.broadcast(offsets), ["part", "frame"]).select(  # a row per two million ids
        "doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids")
