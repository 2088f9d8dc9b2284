"""Ranked lexical search with a length-stratified index.

A text's length enters its score only through a whole number, the normaliser m.
Texts of equal m form a stratum, and within one a term's postings are sorted by
how often it occurs (tf), so that the impact of a tf is computed once for all of
them. The largest impact of each term bounds what a stratum can give to an item;
an item visits strata by falling bound and stops where the bound is below its last
place. Segments of bounded size are indexed and searched where they are read: only
statistics and best places travel, never postings.

Statistics (texts, lengths, how many texts hold a term) cover all rows. The items
stand on the driver in blocks of bounded size, each searched in one pass; every
term of a block is indexed, whatever its frequency. All numbers are whole numbers,
but for the logarithm of a term's weight.

Null and empty texts count as no document; a null id is kept and comes last among
ties. Ids must be whole numbers. Repeated documents each take a place; repeated
items are each answered. Items without terms, or without a match, have no rows.
Only the named columns are read, so extra columns do no harm. Empty tables give
empty results. Texts are read whole, one at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Postings of a segment; the last text of a segment may exceed it.
SEGMENT_POSTINGS = 1 << 20
#: Bytes of item texts that are searched together, about.
BLOCK_BYTES = 4 << 20
#: Places of one item are first cut to ``k`` within so many groups of tasks.
GROUPS = 64
#: Whole numbers up to here are exact as doubles.
_EXACT = 1 << 53


def _word_table() -> bytes:
    """A-Z to a-z, other bytes outside words to blanks; digits, letters and all beyond ASCII stay."""
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in (*range(48, 58), *range(97, 123)):
        table[c] = c
    for c in range(65, 91):
        table[c] = c + 32
    return bytes(table)


_TABLE = _word_table()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or "").encode().translate(_TABLE).split()


class Items:
    """A block of items over a shared numbering of their terms."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        counts = [Counter(terms_of(t)) for t in texts]
        self.ids = ids
        self.number: dict[bytes, int] = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        self.full = [i for i, c in enumerate(counts) if c]
        sizes = [len(counts[i]) for i in self.full]
        self.start = np.cumsum([0, *sizes])
        self.terms = np.fromiter((self.number[t] for i in self.full for t in counts[i]), np.int64, int(self.start[-1]))
        self.repeats = np.fromiter((n for i in self.full for n in counts[i].values()), np.int64, int(self.start[-1]))


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Stratum:
    """Texts of equal normaliser: postings by term, then by falling tf."""

    def __init__(self, m: int, ids: np.ndarray, no_id: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        order = np.lexsort((doc, -tf, term))
        term, tf = term[order], tf[order]
        self.ids, self.no_id, self.doc = ids, no_id, doc[order]
        kinds, which = np.unique(tf, return_inverse=True)
        impacts = np.array([1000000000 * t // (1000 * t + 12 * m) for t in kinds.tolist()], np.int64)
        self.impact = impacts[which]
        head = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.terms, self.start = term[head], np.append(head, len(term))
        #: A term's largest impact stands first.
        self.largest = self.impact[head]

    def scores(self, terms: np.ndarray, weights: np.ndarray, bound: int) -> np.ndarray:
        """The score of every text of the stratum for the terms of one item."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        at, weights = at[hit], weights[hit]
        first = self.start[at]
        sizes = self.start[at + 1] - first
        ends = np.cumsum(sizes)
        places = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        parts = np.repeat(weights, sizes) * self.impact[places]
        if bound < _EXACT:
            return np.bincount(self.doc[places], parts, len(self.ids)).astype(np.int64)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.doc[places], parts)
        return out


class Search:
    """The best ``k`` texts of each item among the segments seen so far."""

    def __init__(self, items: Items, df: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        self.items, self.n_docs, self.n_terms, self.k = items, n_docs, n_terms, k
        self.weights = items.repeats * term_weights(df, n_docs)[items.terms]
        none = np.zeros(0, np.int64)
        self.best = [(none, none.astype(bool), none)] * len(items.full)
        self.visited = self.strata = 0

    def normaliser(self, n: int) -> int:
        return 75 + 25 * n * self.n_docs // self.n_terms

    def add(self, ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Index a segment, texts with their postings, and search it for every item."""
        sizes, which = np.unique(lengths, return_inverse=True)
        m = np.array([self.normaliser(n) for n in sizes.tolist()], np.int64)[which]
        order = np.argsort(m, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, no_id, m, doc = ids[order], no_id[order], m[order], place[doc]
        by_doc = np.argsort(doc, kind="stable")
        doc, term, tf = doc[by_doc], term[by_doc], tf[by_doc]
        head = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        tail = np.append(head[1:], len(m))
        upto = np.searchsorted(doc, np.append(head, len(m)))
        strata = [Stratum(int(m[a]), ids[a:b], no_id[a:b], doc[p:q] - a, term[p:q], tf[p:q])
                  for a, b, p, q in zip(head.tolist(), tail.tolist(), upto.tolist(), upto[1:].tolist()) if q > p]
        self.search(strata)

    def search(self, strata: list[Stratum]) -> None:
        items, largest = self.items, np.zeros(len(self.items.number), np.int64)
        bounds = np.zeros((len(strata), len(items.full)), np.int64)
        for s, stratum in enumerate(strata):
            largest[stratum.terms] = stratum.largest
            bounds[s] = np.add.reduceat(self.weights * largest[items.terms], items.start[:-1])
            largest[stratum.terms] = 0
        self.strata += bounds.size
        for i in range(len(items.full)):
            mine = slice(items.start[i], items.start[i + 1])
            terms, weights, bound = items.terms[mine], self.weights[mine], bounds[:, i]
            for s in np.argsort(-bound, kind="stable").tolist():
                if bound[s] < max(self.least(i), 1):
                    break
                self.visited += 1
                self.take(i, strata[s], strata[s].scores(terms, weights, int(bound[s])))

    def least(self, i: int) -> int:
        """The score below which a text has no place."""
        scores = self.best[i][0]
        return int(scores[-1]) if len(scores) >= self.k else 1

    def take(self, i: int, stratum: Stratum, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= max(self.least(i), 1))
        if len(good):
            score, no_id, ids = (np.concatenate(pair) for pair in zip(self.best[i], (scores[good], stratum.no_id[good], stratum.ids[good])))
            order = np.lexsort((ids, no_id, -score))[:self.k]
            self.best[i] = score[order], no_id[order], ids[order]


def statistics(docs: DataFrame, text: str, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and for each term of the items how many documents hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(items.number)  # BLOCK_BYTES of texts, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        n_docs = n_terms = 0
        df = np.zeros(len(number), np.int64)
        for batch in batches:
            for value in batch.column(0):
                words = terms_of(value.as_py())
                if words:
                    n_docs += 1
                    n_terms += len(words)
                    held = set(map(number.get, words))
                    held.discard(None)
                    df[list(held)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()),
                                          pa.array([n_docs, n_terms, *df[some].tolist()], pa.int64())], ["term", "n"])

    sums = {r.term: r.n for r in docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(len(items.number))], np.int64)


def _places(docs: DataFrame, doc_id: str, text: str, items: Items, id_type, k: int) -> DataFrame:
    """(part, item, item_id, doc_id, score): the best ``k`` of each task for each item of a block."""
    n_docs, n_terms, df = statistics(docs, text, items)
    shared = docs.sparkSession.sparkContext.broadcast((items, df))
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, df = shared.value
        number = items.number
        search = Search(items, df, n_docs, n_terms, k)
        ids: list[int | None] = []
        lengths: list[int] = []
        sizes: list[int] = []
        term: list[int] = []
        tf: list[int] = []

        def close() -> None:
            if term:
                known = np.array([i is None for i in ids])
                search.add(np.array([i or 0 for i in ids], np.int64), known, np.array(lengths, np.int64),
                           np.repeat(np.arange(len(ids)), sizes), np.array(term, np.int64), np.array(tf, np.int64))
            for x in (ids, lengths, sizes, term, tf):
                x.clear()

        for batch in batches:
            for own, value in zip(batch.column(0), batch.column(1)):
                words = terms_of(value.as_py())
                held = Counter(map(number.get, words))
                held.pop(None, None)
                if held:
                    ids.append(own.as_py())
                    lengths.append(len(words))
                    sizes.append(len(held))
                    term.extend(held.keys())
                    tf.extend(held.values())
                    if len(term) >= SEGMENT_POSTINGS:
                        close()
        close()
        for full, (score, no_id, found) in zip(items.full, search.best):
            if len(score):
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([full] * n, pa.int64()), pa.array([items.ids[full]] * n, kind),
                     pa.array(found, pa.int64(), mask=no_id), pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text)
    return rows.mapInArrow(run, f"item bigint, item_id {id_type.simpleString()}, doc_id bigint, score bigint").withColumn(
        "part", F.spark_partition_id() % GROUPS)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first, ties by id. Reads the documents twice a block."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(size // block_bytes)
    id_type = asked.schema["item_id"].dataType
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        block = Items([r.item_id for r in rows], [r.text for r in rows])
        if block.full:
            first = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
            near = _places(docs, doc_id, text, block, id_type, k).withColumn(
                "place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*first))).where(F.col("place") <= k)
            best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first))).where(
                F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
            out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id bigint, score bigint")
    return out
