"""Fuzzy line deduplication: of lines that say the same, one occurrence stays.

Lines are normalised (lower case, ASCII punctuation as space, white space joined).
Equal normalised lines are one node. Each node has a 64-bit SimHash of its
distinct words, a word weighing its letters (8 at most). Two SimHashes that differ
in at most 3 bits agree in two of five blocks, so nodes meet in a join on pairs of
blocks. A changed word moves more bits than that, so nodes also meet on bands of
minima over their letter n-grams, and every pair that meets is verified by edit
similarity of the normalised lines (at least 0.8). With a ``radius`` there are no
bands, and only pairs within so many bits are verified. Verified pairs connect
nodes, and of all occurrences of a connected group the first by document id, then
by line number stays. Bands are drawn by hash: a pair may be missed, and the README
gives the share that is found.

Most keys belong to one line only. They are never rows: tasks send packed keys by
buckets of bounded size, and only keys that several lines have come out of a bucket.

Lines without words (blank ones, and those of punctuation only) take no part and
stay. All others can equal another; lines of fewer than FUZZY_CHARS characters,
which one edit takes below the edit similarity, are no more than that. A
document whose every line goes has the empty text and ``dropped = lines``. Null
text stays null. Documents without an id come last in the order. Rows that are
equal in id and text count as one document: they keep the same lines. Other
columns stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pooltide.llm.edits import distances
from pooltide.llm.tables import components, discard, written

MIN_WORDS, FUZZY_CHARS, BITS, SIMILARITY = 1, 5, 3, 0.8
#: Bands of a line, minima in each, and the letters of an n-gram: the short ones for lines of at most SHORT
#: characters, the long ones from SIMILARITY * SHORT on, so that lines of similar length have a kind in common.
BANDS, MINIMA, SHORT, GRAM_SHORT, GRAM_LONG = 48, 3, 40, 3, 8
#: Rounds of comparison with one node of each key, before the rest is compared pairwise.
ROUNDS = 4
#: Lengths of a class, the longest over the shortest, and how many classes apart two lines of near length may be.
LENGTH_STEP = 1.04
NEAR_CLASSES = int(np.ceil(np.log(1 / SIMILARITY) / np.log(LENGTH_STEP)))
#: Widths of the blocks of a SimHash.
BLOCKS = (13, 13, 13, 13, 12)
#: Words a worker remembers before it forgets all of them; words whose weights are summed together.
MAX_WORDS, SLICE_WORDS = 100_000, 50_000
#: Longer lines are compared by Spark's own edit distance, which needs no table of their letters.
LONG_CHARS = 1 << 16
#: Keys of a bucket, about; letters of lines whose keys are sent together, and of those whose words and n-grams are one array; lines a task remembers to have sent.
BUCKET_KEYS, SLICE_LETTERS, PART_LETTERS, MAX_SEEN = 1 << 19, 1 << 20, 1 << 18, 200_000
#: Bits of the filter for documents that hold lines to be compared: 1 MB, however many there are.
FILTER_BITS = 1 << 23
_PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def split_lines(text: str) -> list[list[bytes]]:
    """Words of each normalised line."""
    return [line.split() for line in text.lower().encode().translate(_PUNCTUATION).split(b"\n")]


def letters_of(words: list[bytes]) -> np.ndarray:
    """Characters of each word or line, none of them empty: the bytes that begin one in UTF-8."""
    text = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.add.reduceat((text & 0xC0) != 0x80, np.cumsum(sizes) - sizes, dtype=np.int64) if words else sizes


class SimHasher:
    """Weighted bits of words as rows of one array, and SimHashes of lines from them."""

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.bits, self.weight = np.zeros((MAX_WORDS, 64), np.uint8), np.zeros(MAX_WORDS, np.int64)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
        if len(self.row) + len(new) > MAX_WORDS:
            self.row = {}
            missing, new = np.arange(len(words)), list(dict.fromkeys(words))
            if len(new) > len(self.bits):
                self.bits, self.weight = np.zeros((len(new), 64), np.uint8), np.zeros(len(new), np.int64)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, new)), ">u8").astype("<u8")
        first = len(self.row)
        held = slice(first, first + len(new))
        self.weight[held] = np.minimum(letters_of(new), 8)
        self.bits[held] = np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * self.weight[held, None].astype(np.uint8)
        self.row.update(zip(new, range(first, first + len(new))))
        rows[missing] = np.fromiter(map(self.row.__getitem__, map(words.__getitem__, missing.tolist())), np.int64, len(missing))
        return rows

    def of(self, lines: list[list[bytes]]) -> np.ndarray:
        """SimHash of each line (none of them empty); a bit is set where it has more than half of the distinct words' weight."""
        if not lines:
            return np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        rows = self._rows([w for words in lines for w in words])
        distinct = np.sort(np.repeat(np.arange(len(lines)) << 32, sizes) | rows)
        distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])]
        line, rows = distinct >> 32, distinct & 0xFFFFFFFF
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        # Counters side by side in words of 64 bits are added at once; none runs over into the next.
        counter = np.uint16 if sizes.max() < 4000 else np.uint32
        sums = np.add.reduceat(self.bits[rows].astype(counter).view(np.uint64), starts, axis=0).view(counter)
        whole = np.add.reduceat(self.weight[rows], starts)
        return np.packbits(2 * sums.astype(np.int64) > whole[:, None], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def bands(lines: list[bytes], letters: int) -> np.ndarray:
    """Keys of the BANDS bands of each line: minima over its n-grams, which are dealt by hash over all minima of all bands at once."""
    text = np.frombuffer(b" " * letters + (b" " * letters).join(lines) + b" " * letters, np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    value = np.zeros(len(text) - letters + 1, np.uint64)
    for i in range(letters):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value += text[i:len(value) + i]
        value += np.uint64(1)
    windows = sizes + letters - 1  # those that hold a letter of the line
    line = np.repeat(np.arange(len(lines)), windows)
    first = np.cumsum(sizes + letters) - sizes - letters + 1
    drawn = _mixed(value[np.arange(len(line)) + np.repeat(first - np.cumsum(windows) + windows, windows)])
    bins, none = BANDS * MINIMA, np.uint64(2**64 - 1)
    least = np.full(len(lines) * bins, none)
    np.minimum.at(least, line * bins + ((drawn >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64),
                  _mixed(drawn + np.uint64(0x9E3779B97F4A7C15)))
    least = least.reshape(-1, bins)
    # A minimum without n-grams takes over from the last one before it that has some, the first ones from the end.
    source = np.maximum.accumulate(np.where(least != none, np.arange(bins), -1), axis=1)
    least = np.take_along_axis(least, np.where(source < 0, source[:, -1:], source), axis=1)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for turn in range(MINIMA):
        keys = _mixed(keys + least[:, turn * BANDS:(turn + 1) * BANDS] + np.uint64(1))
    return keys


def line_keys(lines: list[bytes], chars: np.ndarray, simhash: np.ndarray, banded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines (64 bits, mixed) and the line of each: pairs of SimHash blocks and, if ``banded``, bands of the n-grams its length wants."""
    starts = np.cumsum([0, *BLOCKS[:-1]]).tolist()
    parts = [(simhash.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << w) - 1) for at, w in zip(starts, BLOCKS)]
    keys = [(parts[i] << np.uint64(17)) | (parts[j] << np.uint64(4)) | np.uint64(n) for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    owner = [np.arange(len(lines))] * len(keys)
    if banded:
        for kind, (letters, wanted) in enumerate(((GRAM_SHORT, chars <= SHORT), (GRAM_LONG, chars >= SIMILARITY * SHORT))):
            rows = np.flatnonzero(wanted)
            if len(rows):
                number = np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(kind * BANDS)  # keys of 64 bits: those of blocks are met by chance only
                keys.append(_mixed(bands([lines[r] for r in rows], letters) + number * np.uint64(0x9E3779B97F4A7C15)).ravel())
                owner.append(np.repeat(rows, BANDS))
    return _mixed(np.concatenate(keys)), np.concatenate(owner)


def length_classes(chars: np.ndarray) -> np.ndarray:
    """Lengths of lines in a byte each: those of near length are at most NEAR_CLASSES apart, the longest are one class."""
    return np.minimum(np.log(np.maximum(chars, 1)) / np.log(LENGTH_STEP), 255).astype(np.uint8)


def with_near_length(group: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether another row of the same group may have a near length: in order of length, one of the two beside it."""
    order = np.lexsort((classes, group))
    group, classes = group[order], classes[order].astype(np.int64)
    near = (group[1:] == group[:-1]) & (classes[1:] - classes[:-1] <= NEAR_CLASSES)
    out = np.zeros(len(order), bool)
    out[order] = (np.append(near, False) | np.append(False, near))[:len(order)]
    return out


def shared_keys(docs: DataFrame, banded: bool, n_lines: int) -> tuple[DataFrame, DataFrame]:
    """(key, num): the keys that several lines have, with the lines' numbers, and the table to discard after it. Most keys are one line's and never become rows.

    A task sends its keys packed as 32 bits of the key, ``number_bytes`` of the line's number
    and a byte for its length, one binary a bucket; a bucket holds BUCKET_KEYS or so and is
    sorted in one task. Lines that meet nobody of near length at a key leave there. A key of
    another line by chance only costs a comparison.
    """
    buckets = 1 << max(0, (n_lines * (BANDS + 10) // BUCKET_KEYS).bit_length())
    width = number_bytes(n_lines)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    pair = np.dtype([("key", "<u4"), ("num", "<i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = SimHasher()
        seen: set[bytes] = set()
        said: list[bytes] = []
        letters = 0

        def flush() -> pa.RecordBatch:
            chars = letters_of(said)
            ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)))
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PART_LETTERS, ends[-1], PART_LETTERS)) + 1, len(said))).tolist()
            parts = [(a, line_keys(said[a:z], chars[a:z], hasher.of([j.split() for j in said[a:z]]), banded)) for a, z in zip([0, *cuts], cuts)]
            keys, owner = np.concatenate([k for _, (k, _) in parts]), np.concatenate([o + a for a, (_, o) in parts])
            nums = np.array([line_number(xxhash.xxh3_128_digest(j)) for j in said], np.int64)
            keep = chars[owner] >= FUZZY_CHARS
            keys, owner = keys[keep], owner[keep]
            bucket = (keys >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.int64) if buckets > 1 else np.zeros(len(keys), np.uint16)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty((len(keys), 4 + width + 1), np.uint8)
            packed[:, :4] = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]
            packed[:, 4:-1] = nums.astype("<i8").view(np.uint8).reshape(-1, 8)[owner[order], :width]
            packed[:, -1] = length_classes(chars)[owner[order]]
            there, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:].tolist(), len(packed)]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(
                [packed[a:z].tobytes() for a, z in zip(first.tolist(), ends)], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for value in batch.column(0):
                for words in split_lines(value.as_py()):
                    if len(words) >= MIN_WORDS:
                        line = b" ".join(words)
                        digest = xxhash.xxh3_128_digest(line)
                        if digest not in seen:
                            if len(seen) >= MAX_SEEN:
                                seen.clear()
                            seen.add(digest)
                            said.append(line)
                            letters += len(line)
                            if letters >= SLICE_LETTERS:
                                yield flush()
                                said, letters = [], 0
        if said:
            yield flush()

    def find(bucket: tuple, table: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(-1, 4 + width + 1)
        num = np.zeros((len(packed), 8), np.uint8)
        num[:, :width] = packed[:, 4:-1]
        pairs, classes = np.empty(len(packed), pair), packed[:, -1]
        pairs["key"], pairs["num"] = np.ascontiguousarray(packed[:, :4]).view("<u4").ravel(), num.view("<i8").ravel()
        order = np.argsort(pairs["key"])
        sorted_keys = pairs["key"][order]
        same = sorted_keys[1:] == sorted_keys[:-1]
        several = order[np.append(same, False) | np.append(False, same)]
        pairs, classes = pairs[several], classes[several]
        order = np.lexsort((classes, pairs["num"], pairs["key"]))
        pairs, classes = pairs[order], classes[order]
        # Two lines of one number may differ in length, so the number goes only if all of its lengths do.
        other = np.append(True, (pairs["key"][1:] != pairs["key"][:-1]) | (pairs["num"][1:] != pairs["num"][:-1]))[:len(pairs)]
        distinct = other | np.append(True, classes[1:] != classes[:-1])[:len(pairs)]
        pairs, classes, other = pairs[distinct], classes[distinct], other[distinct]
        near = with_near_length(pairs["key"], classes)
        if len(pairs):
            near = np.logical_or.reduceat(near, np.flatnonzero(other))
            pairs = pairs[other][near]
        same = pairs["key"][1:] == pairs["key"][:-1]
        several = (np.append(same, False) | np.append(False, same))[:len(pairs)]
        pairs = pairs[several]
        starts = np.flatnonzero(np.append(True, pairs["key"][1:] != pairs["key"][:-1])) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(pairs)))
        mixed = _mixed(pairs["num"].astype(np.uint64) + np.uint64(1))
        folds = [np.repeat(f.reduceat(m, starts), sizes).view(np.int64) if len(pairs) else np.zeros(0, np.int64)
                 for f, m in ((np.bitwise_xor, mixed), (np.add, _mixed(mixed + np.uint64(1))))]
        return pa.table({"key": (pairs["key"].astype(np.int64) | (bucket[0].as_py() << 32)), "num": pairs["num"], "fold": folds[0], "fold2": folds[1]})

    packed = docs.where("text IS NOT NULL").select("text").mapInArrow(run, "bucket int, packed binary")
    found = written(packed.groupBy("bucket").applyInArrow(find, "key bigint, num bigint, fold bigint, fold2 bigint"), "line-keys")
    # Near copies share most of their keys: of keys with the same lines (128 bits of their numbers folded) one is enough.
    one = found.groupBy("fold", "fold2").agg(F.min("key").alias("key")).select("key")
    keyed = written(found.join(one, "key", "left_semi").select("key", "num"), "one-key-each")
    discard(found)
    return keyed, keyed


def line_number(digest: bytes) -> int:
    """The first half of a line's digest; two lines of one number are both looked at."""
    return int.from_bytes(digest[:8], "little", signed=True)


def number_bytes(n_lines: int) -> int:
    """The lowest bytes of a line's number that are sent. Of one line in 32 at most another has the same, which costs a comparison;
    two that are similar have the same by a chance of 1 in 2 ** 32 or less."""
    return min(8, max(4, -(-(max(n_lines, 1).bit_length() + 5) // 8)))


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))


def occurrences(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """(row, doc, line, node, num, simhash, chars) of every line that takes part, from (row, doc, text); ``simhash`` is 0 unless ``hashed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = SimHasher()
        names = ["row", "doc", "line", "node", "num", "simhash", "chars"]
        for batch in batches:
            held: list[list[bytes]] = []
            at: list[tuple[int, int]] = []
            words = 0

            def flush() -> pa.RecordBatch:
                joined = [b" ".join(w) for w in held]
                take = pa.array([a for a, _ in at], pa.int64())
                digests = list(map(xxhash.xxh3_128_digest, joined))
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array([n for _, n in at], pa.int32()),
                     pa.array(digests, pa.binary()), pa.array(map(line_number, digests), pa.int64()), pa.array(hasher.of(held) if hashed else np.zeros(len(held), np.int64), pa.int64()),
                     pa.array([len(j.decode("utf-8", "replace")) for j in joined], pa.int32())], names)

            for i, value in enumerate(batch.column(2)):
                for n, line in enumerate(split_lines(value.as_py())):
                    if len(line) >= MIN_WORDS:
                        held.append(line)
                        at.append((i, n))
                        words += len(line)
                        if words >= SLICE_WORDS:
                            yield flush()
                            held, at, words = [], [], 0
            if held:
                yield flush()

    return docs.where("text IS NOT NULL").select("row", "doc", "text").mapInArrow(
        run, "row bigint, doc bigint, line int, node binary, num bigint, simhash bigint, chars int")


def flagged(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether a row's key may be among the wanted keys, by a bitmap of FILTER_BITS bits, so its size is bounded."""
    bits = wanted.select(F.pmod(wanted_key, F.lit(FILTER_BITS)).alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("__bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("__bits"))
    with_bit = df.withColumn("__b", F.pmod(key, F.lit(FILTER_BITS))).withColumn("__bucket", F.expr("bitmap_bucket_number(__b)"))
    byte = "CAST(conv(hex(substring(__bits, CAST(bitmap_bit_position(__b) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return with_bit.join(F.broadcast(bits), "__bucket", "left").withColumn(flag, F.expr(
        f"coalesce(shiftright({byte}, CAST(bitmap_bit_position(__b) % 8 AS INT)) & 1 = 1, false)")).drop("__b", "__bucket", "__bits")


def in_filter(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of ``df`` whose key may be among the wanted keys."""
    return flagged(df, key, wanted, wanted_key, "__may").where("__may").drop("__may")


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, said): normalised lines of ``wanted`` (node, row, line)."""
    lines = wanted.groupBy("row").agg(F.collect_list(F.struct("line", "node")).alias("lines"))  # lines of one document
    rows = in_filter(docs.select("row", "text"), F.col("row"), wanted, F.col("row")).join(lines, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, said = [], []
            for text, want in zip(batch.column(0), batch.column(1)):
                split = split_lines(text.as_py())
                for w in want.as_py():
                    node.append(w["node"])
                    said.append(b" ".join(split[w["line"]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(said, pa.string())], ["node", "said"])

    return rows.select("text", "lines").mapInArrow(run, "node binary, said string").groupBy("node").agg(F.max("said").alias("said"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, sa, sb, most) those within ``most`` edits, and unchanged those of more than LONG_CHARS characters."""
    for batch in batches:
        left, right, most = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy()
        short = np.fromiter((max(len(x), len(y)) <= LONG_CHARS for x, y in zip(left, right)), bool, len(left))
        rows = np.flatnonzero(short)
        close = rows[distances([left[r] for r in rows], [right[r] for r in rows], most[rows]) <= most[rows]]
        for kept, said in ((close, False), (np.flatnonzero(~short), True)):
            part = batch.take(pa.array(kept))
            none = pa.nulls(len(kept), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(part.column(i) if said else none for i in (2, 3)), part.column(4)], batch.schema.names)


def similar_lines(nodes: DataFrame, docs: DataFrame, radius: int | None = None) -> DataFrame:
    """Verified pairs (a, b) that connect all similar nodes (node, num, row, line, simhash, chars, n) that meet.

    Nodes of a key are first compared with its commonest node, then, in ROUNDS - 1
    further rounds, with one drawn by hash, each time only across components; what
    is still apart is compared pairwise. So copies of one line give a few pairs
    each, and no pair that could connect two components is left out.
    """
    near = f"least(ca, cb) >= {SIMILARITY}D * greatest(ca, cb)" + ("" if radius is None else f" AND bit_count(ha ^ hb) <= {radius}")
    n_lines = nodes.count()
    keyed, stored = shared_keys(docs, radius is None, n_lines)
    sent = number_bytes(n_lines)
    num = F.col("num") if sent == 8 else F.col("num").bitwiseAND(F.lit((1 << 8 * sent) - 1))
    crowded = written(keyed.join(nodes.where(F.col("chars") >= FUZZY_CHARS).select(
        num.alias("num"), F.col("node").alias("a"), F.col("simhash").alias("ha"), F.col("chars").alias("ca"), F.col("n").alias("na")), "num").drop("num"), "crowded")
    discard(stored)
    if radius is None:
        # In order of length, the nearest length of a key's nodes stands beside.
        beside = {"cb": "lag(ca) OVER (PARTITION BY key ORDER BY ca, a)", "cc": "lead(ca) OVER (PARTITION BY key ORDER BY ca, a)"}
        close = written(crowded.withColumns({c: F.expr(x) for c, x in beside.items()}).where(
            f"cb >= {SIMILARITY}D * ca OR ca >= {SIMILARITY}D * cc").drop("cb", "cc"), "close")
    else:
        other = crowded.select("key", F.col("a").alias("b"), F.col("ha").alias("hb"), F.col("ca").alias("cb"))
        close = written(crowded.alias("x").join(other.alias("y"), F.expr(f"x.key = y.key AND a <> b AND {near}"), "left_semi"), "close")
    discard(crowded)
    ends = close.select(F.col("a").alias("node")).distinct()
    said = written(_line_texts(docs, nodes.join(ends, "node").select("node", "row", "line")), "said")
    tested: DataFrame | None = None
    links: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        nonlocal tested, links
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "line-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        both = (pairs.join(said.select(F.col("node").alias("a"), F.col("said").alias("sa")), "a")
                .join(said.select(F.col("node").alias("b"), F.col("said").alias("sb")), "b")
                .withColumn("most", F.expr(f"CAST(floor({round(1 - SIMILARITY, 6)} * greatest(length(sa), length(sb))) AS INT)")))
        # Verified pairs come back without their lines; those of long lines still have them.
        fresh = written(both.select("a", "b", "sa", "sb", "most").mapInArrow(_verified, "a binary, b binary, sa string, sb string, most int").where(
            "sa IS NULL OR levenshtein(sa, sb, most) >= 0").select("a", "b"), "line-links")
        links = fresh if links is None else links.unionByName(fresh)

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of the keys whose nodes are still in several components, with their component."""
        own = rows.drop("own").join(components(links).select(F.col("node").alias("a"), F.col("component").alias("own")), "a", "left")
        own = own.withColumn("own", F.coalesce("own", "a"))
        # The one pair of a key with two nodes is behind us.
        mixed = own.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("nodes")).where(
            "low < high AND nodes > 2").select("key")
        return written(own.join(mixed, "key"), "apart")

    left = close.withColumn("own", F.col("a"))
    for turn in range(ROUNDS):
        rank = F.col("na") if turn == 0 else F.xxhash64("a", F.lit(turn))
        centre = left.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "a", "ha", "ca", "own")).alias("c")).select(
            "key", F.col("c.a").alias("b"), F.col("c.ha").alias("hb"), F.col("c.ca").alias("cb"), F.col("c.own").alias("other_own"))
        compare(left.join(centre, "key").where(f"own <> other_own AND {near}").select("a", "b"))
        before, left = left, apart(left)
        discard(before)
        if left.isEmpty():
            break
    else:
        second = left.select("key", F.col("a").alias("b"), F.col("ha").alias("hb"), F.col("ca").alias("cb"), F.col("own").alias("other_own"))
        compare(left.join(second, "key").where(f"own < other_own AND {near}").select("a", "b"))
    for table in (said, left, tested):
        discard(table)
    return links


def duplicate_lines(docs: DataFrame, radius: int | None = None) -> DataFrame:
    """(row, lines): numbers of the lines of each document (row, doc, text) that go."""
    held = written(occurrences(docs, radius is not None), "occurrences")
    nodes = written(held.groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc", F.lit(2**63 - 1)).alias("doc"), "row", "line")).alias("first"), F.count("*").alias("n"),
        F.min("num").alias("num"), F.min("simhash").alias("simhash"), F.min("chars").alias("chars")), "line-nodes")
    links = written(similar_lines(nodes.select("node", "num", "first.row", "first.line", "simhash", "chars", "n"), docs, radius), "line-links")
    groups = components(links)
    joined = nodes.join(groups, "node")
    best = joined.groupBy("component").agg(F.min("first").alias("best"))
    linked = joined.select("node", "component").join(best, "component").select("node", "best")
    alone = nodes.where("n > 1").join(groups, "node", "left_anti").select("node", F.col("first").alias("best"))
    stays = linked.unionByName(alone)
    gone = held.join(stays, "node").where("NOT (row = best.row AND line = best.line)")
    out = written(gone.groupBy("row").agg(F.collect_set("line").alias("lines")), "gone-lines")  # lines of one document
    for table in (held, nodes):
        discard(table)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and how many: ``lines`` and ``dropped`` (long). Runs jobs.

    ``radius`` None compares all lines that meet; a number only those whose
    SimHashes differ in at most so many bits (5 blocks: 3 at most).
    """
    slim = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    gone = duplicate_lines(slim, radius)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("lines", "dropped")),
                           T.StructField("lines", T.LongType()), T.StructField("dropped", T.LongType())])
    stay = schema.names[:-2]
    # Only documents that may lose a line are dealt by their key; the others stay where they are.
    rows = flagged(docs.select(*stay).withColumn("__row", row_key(doc_id, text)), F.col("__row"), gone, F.col("row"), "__may")
    lists = gone.select(F.col("row").alias("__row"), F.col("lines").alias("__gone"))
    joined = rows.where("__may").join(lists, "__row", "left").select(*stay, "__gone").unionByName(
        rows.where("NOT __may").select(*stay, F.lit(None).cast("array<int>").alias("__gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for value, out in zip(batch.column(batch.schema.get_field_index(text)), batch.column(batch.num_columns - 1)):
                t, bad = value.as_py(), set(out.as_py() or ())
                split = t.split("\n") if t is not None else []
                lines.append(len(split))
                dropped.append(len(bad))
                texts.append("\n".join(x for n, x in enumerate(split) if n not in bad) if bad else t)
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(batch.schema.get_field_index(n)) for n in stay]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
