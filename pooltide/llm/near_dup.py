"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function gives every shingle a value; a document's sketch is its k
smallest values. Inverted lists of retained values propose pairs, the sketch of
the union estimates their similarity, and the full shingle sets decide.

Which lists are read. Two documents of similarity s = 0.75 share each of the
smallest k values of their union with chance s, so of 64 values fewer than 32
agree about once in 10^6 such pairs (less often above s). A document whose sketch
has fewer than 32 values that others retain too (small sets: three quarters of
their values, exactly) has no partner and is left out. For the rest the full sets
are listed, exactly: a document needs three quarters of its values in other sets
too, and it is enough to list the rarest of them. With values ordered by how many
sets hold them, two sets that share t values share one of the first
(shared - t + 1) of either, and where they first do, what is left of both lists
must still hold t values. So passages that many unlike documents share are
listed only by documents made of little else.

Large groups. Copies with equal sets are one node. In each list the most central
set (its values are the most widely held) is compared with all others; then,
for members of lists that are still in several components, a second centre is
compared; what is left is compared pairwise across components only. Every pair
proposed by a list is thereby compared or already connected. Long lists of the
last step are dealt in chunks to several tasks.

Null text, empty text and text without words give an empty set: linked with
nothing, its own component, kept. A null id cannot name a component: such rows
stay, with null component, and are kept. Rows that repeat an id are judged each
by its own text. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pooltide.llm.tables import components, discard, written

WORDS, KEEP, PERCENT = 5, 64, 75
#: Least share of the union's sketch that both must hold for the full sets to be compared.
ESTIMATE = 0.5
#: Shared values of a pair of full sketches (see above); sets of up to EXACT values reach no further than the sketch.
NEED, EXACT = 32, 48
#: Members of a list that are compared pairwise in one task.
CHUNK = 256
#: Words whose hash a worker remembers before it forgets all of them.
MAX_WORDS = 250_000
_ODD, _SHIFTS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(1))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hash by word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_values(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct values (63 bits) of the runs of ``size`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.int64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    run = min(size, len(words))
    value = np.full(len(words) - run + 1, np.uint64(run))
    for i in range(run):
        value = value * _ODD + each[i:len(words) - run + 1 + i]
    value = (value ^ (value >> _SHIFTS[0])) * _MIX[0]
    value = (value ^ (value >> _SHIFTS[1])) * _MIX[1]
    return np.unique((value ^ (value >> _SHIFTS[2])) >> _SHIFTS[3]).astype(np.int64)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, size: int, keep: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of every row: set size, 128-bit digest of the set, its smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, digest, flat, ends = [], [], [], [0]
            for value in batch.column(1):
                values = shingle_values(words_of(value.as_py()), hashes, size)
                n.append(len(values))
                digest.append(xxhash.xxh3_128_digest(values.tobytes()))
                flat.append(values[:keep])
                ends.append(ends[-1] + len(flat[-1]))
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), sketch],
                ["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, digest binary, sketch array<bigint>")


def _full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(node, values): full sets of the nodes, from their documents' texts."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).cast("string").alias("text")).join(
        nodes.select("node", "digest"), "node").select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            node, flat, ends = [], [], [0]
            for k, value in enumerate(batch.column(2)):
                values = shingle_values(words_of(value.as_py()), hashes, size)
                if xxhash.xxh3_128_digest(values.tobytes()) == batch.column(1)[k].as_py():
                    node.append(batch.column(0)[k].as_py())
                    flat.append(values)
                    ends.append(ends[-1] + len(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))],
                ["node", "values"])

    return rows.mapInArrow(run, "node bigint, values array<bigint>")


def _estimate(one: str, other: str, keep: int) -> str:
    """Share of the union's sketch that both sketches hold, as SQL."""
    union = f"slice(array_sort(array_union({one}, {other})), 1, {keep})"
    return f"size(array_intersect(array_intersect({one}, {other}), {union})) / size({union})"


def _shared(values: DataFrame, need: str) -> DataFrame:
    """(node, n, shared, need) of nodes with at least ``need`` values that other nodes hold too; rarest first.

    ``values`` is (node, n, value); what is gathered for a node are its own values.
    """
    held = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    return (values.join(held, "value").groupBy("node", "n")
            .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
            .withColumn("need", F.expr(need)).where("size(shared) >= need"))


class _Comparison:
    """Pairs of nodes: estimated by sketches, confirmed on full sets."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int, keep: int) -> None:
        self.nodes, self.sets, self.percent, self.keep = nodes, sets, percent, keep
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        """Compare distinct ``pairs`` (a, b) that were not compared before, with a < b."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        sketches = self.nodes.select("node", "sketch")
        likely = (pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
                  .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
                  .where(F.expr(f"{_estimate('sa', 'sb', self.keep)} >= {ESTIMATE}")).select("a", "b"))
        sets = self.sets
        common = (likely.join(sets.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b")
                  .join(sets.select(F.col("node").alias("a"), F.col("values").alias("va")), "a")
                  .select("a", "b", F.expr("size(array_intersect(va, vb))").alias("both"), F.expr("size(va) + size(vb)").alias("all")))
        fresh = written(common.where(f"100 * both >= {self.percent} * (all - both)").select("a", "b"), "links")
        self.links = fresh if self.links is None else self.links.unionByName(fresh)

    def labelled(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the lists that reach over several components, with their component; and all components."""
        groups = components(self.links)
        own = lists.join(groups.withColumnRenamed("component", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
        mixed = own.groupBy("value").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("members"))
        return written(own.join(mixed.where("low < high").select("value", "members"), "value"), "lists"), groups


def _reach(n: str, left: str, other_n: str, other_left: str, percent: int) -> str:
    """Can two sets that share a value be similar enough, given how many widely held values stand from it on?

    It holds at the first value they share for all pairs that are linked: they
    share at least percent / (100 + percent) of the sum of their sizes.
    """
    return f"{100 + percent} * least({left}, {other_left}) >= {percent} * ({n} + {other_n})"


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, keep: int = KEEP,
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked are documents with 100 * |A and B| >= percent * |A or B| over their
    shingle sets; a component is named by its smallest id, which is kept.
    Runs jobs: lists, comparisons and components are written tables.
    """
    need, exact = round(NEED * keep / KEEP), round(EXACT * keep / KEEP)
    rows = written(shingle_sets(docs, doc_id, text, size, keep), "sets")
    nodes = written(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    sketched = nodes.select("node", "n", F.explode("sketch").alias("value"))
    likely = _shared(sketched, f"CASE WHEN n <= {exact} THEN CAST(ceil(n * {percent} / 100) AS INT) ELSE {need} END")
    listed = written(nodes.join(likely.select("node"), "node"), "listed")
    sets = written(_full_sets(docs, listed, doc_id, text, size), "full")
    whole = sets.select("node", F.size("values").alias("n"), F.explode("values").alias("value"))
    lists = written(_shared(whole, f"CAST(ceil(n * {percent} / 100) AS INT)").select(
        "node", "n", F.expr("aggregate(shared, 0L, (s, x) -> s + x.df)").alias("central"), F.size("shared").alias("held"),
        F.expr("posexplode(slice(shared, 1, size(shared) - need + 1).value) AS (at, value)")).select(
        "node", "n", "central", "value", (F.col("held") - F.col("at")).alias("left")), "lists")
    compare = _Comparison(listed, sets, percent, keep)

    def centres(of: DataFrame) -> DataFrame:
        return of.groupBy("value").agg(F.max(F.struct("central", -F.col("node"), "n", "left")).alias("c")).select(
            "value", (-F.col("c.col2")).alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.left").alias("centre_left"))

    first = centres(lists)
    compare.add(lists.join(first, "value").where(f"node <> centre AND {_reach('n', 'left', 'centre_n', 'centre_left', percent)}")
                .select(F.col("node").alias("a"), F.col("centre").alias("b")))
    open_lists, groups = compare.labelled(lists)
    if not open_lists.isEmpty():
        first_own = open_lists.join(first, "value").where("node = centre").select("value", F.col("own").alias("first_own"))
        second = centres(open_lists.join(first_own, "value").where("own <> first_own"))
        compare.add(open_lists.join(second, "value").where(f"node <> centre AND {_reach('n', 'left', 'centre_n', 'centre_left', percent)}")
                    .select(F.col("node").alias("a"), F.col("centre").alias("b")))
        open_lists, groups = compare.labelled(lists)
    if not open_lists.isEmpty():
        full = open_lists.withColumn("chunks", F.expr(f"CAST(ceil(members / {CHUNK}) AS INT)"))
        one = full.select("value", F.expr("pmod(hash(node), chunks)").alias("chunk"), F.col("node").alias("a"),
                          F.col("n").alias("na"), F.col("left").alias("la"), F.col("own").alias("oa"))
        other = full.select("value", F.expr("explode(sequence(0, chunks - 1))").alias("chunk"), F.col("node").alias("b"),
                            F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("own").alias("ob"))
        compare.add(one.join(other, ["value", "chunk"]).where(f"oa < ob AND {_reach('na', 'la', 'nb', 'lb', percent)}").select("a", "b"))
        groups = components(compare.links)
    named = written(nodes.select("digest", "node").join(groups, "node", "left")
                    .select("digest", F.coalesce("component", "node").alias("component_id")), "named")
    for table in (lists, sets, nodes):
        discard(table)
    slim = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    return slim.join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.expr("CASE WHEN doc_id IS NOT NULL THEN CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END END").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are near copies of a kept one; all columns stay."""
    gone = near_duplicates(docs, doc_id, text, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("bigint") == F.col("__gone"), "left_anti")
