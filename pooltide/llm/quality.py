"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed words, word shapes and pairs of shapes, weighted by
log counts and by the inverse document frequency over all documents. A bounded
number of labelled texts (PER_CLASS of each label, those whose id hashes lowest)
spans a latent space by a truncated singular value decomposition. Their vectors
are broadcast, every document's exact cosine products with all of them are taken
block by block, and the nearest vote for their label with their similarity.

Null, empty and unknown texts (no weight in any feature the labels span) get
score 0.5. The score uses the text alone. Labels that are null, or of documents
that are not there, are ignored; without any label every score is 0.5. Repeated
rows are scored each. Extra columns stay. Whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pooltide.llm.tables import written

#: Labelled texts of each label, neighbours that vote, dimensions, documents scored together.
PER_CLASS, NEIGHBOURS, DIMENSIONS, BLOCK = 2_000, 15, 48, 512
#: Buckets of words, of shapes and of pairs of shapes.
WORD_BUCKETS, SHAPE_BUCKETS, PAIR_BUCKETS = 4_096, 512, 1_536
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS + PAIR_BUCKETS + 2
#: Words a worker remembers before it forgets all of them; characters of texts whose new words are worked out together.
MAX_WORDS, SLICE_CHARS = 400_000, 1 << 20
_RUNS = re.compile(r"(.)\1+")


class _Kinds(dict):
    """For ``str.translate``: capital, small and other letters and digits by one sign each, other signs as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "x" if c.isalpha() else c
        return kind


class _ShapeBuckets(dict):
    """Bucket of a shape (runs of the same kind shortened to two) by the kinds of a word, of which there are far fewer than words."""

    def __missing__(self, kinds: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[kinds] = zlib.crc32(_RUNS.sub(r"\1\1", kinds).encode()) % SHAPE_BUCKETS
        return value


class WordFeatures:
    """Buckets of words and of their shapes, packed into one number each; the new words of several texts are worked out together."""

    def __init__(self) -> None:
        self.kinds, self.shapes = _Kinds(), _ShapeBuckets()
        self.plain = bytes(ord(self.kinds[code]) if code < 128 else 0 for code in range(256))
        self.packed: dict[str, int] = {}

    def _work_out(self, words: list[str]) -> dict[str, int]:
        joined = "\n".join(words)  # words hold no white space
        kinds = joined.encode().translate(self.plain).decode() if joined.isascii() else joined.translate(self.kinds)
        lower, shapes = joined.lower().encode().split(b"\n"), map(self.shapes.__getitem__, kinds.split("\n"))
        return dict(zip(words, [zlib.crc32(low) % WORD_BUCKETS * SHAPE_BUCKETS + s for low, s in zip(lower, shapes)])) if words else {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Packed buckets of each text's words, in order."""
        used = list(set().union(*texts))
        own = dict(zip(used, map(self.packed.get, used)))  # a small dictionary stays in the processor's cache
        new = [word for word, value in own.items() if value is None]
        fresh = self._work_out([w for w in new if w.isascii()]) | self._work_out([w for w in new if not w.isascii()])
        own |= fresh
        if len(self.packed) > MAX_WORDS:
            self.packed = {}
        self.packed |= fresh
        return [np.fromiter(map(own.__getitem__, words), np.int64, len(words)) for words in texts]


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """``texts`` in order, cut where BLOCK texts or SLICE_CHARS characters are full; a longer text is whole."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SLICE_CHARS or i - start + 1 == BLOCK:
            yield texts[start:i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def features(texts: list[str | None], known: WordFeatures) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the buckets that occur, ascending, and log counts."""
    for part in slices(texts):
        for packed in known.of([(text or "").split() for text in part]):
            if not len(packed):
                yield np.empty(0, np.int64), np.empty(0, np.float32)
                continue
            w, s = np.divmod(packed, SHAPE_BUCKETS)
            same = np.count_nonzero(w[1:] == w[:-1])
            pairs = (s[:-1] * 769 + s[1:] * 31) % PAIR_BUCKETS
            counts = np.bincount(np.concatenate((w, WORD_BUCKETS + s, WORD_BUCKETS + SHAPE_BUCKETS + pairs)), minlength=BUCKETS)
            counts[-1], counts[-2] = same, len(packed)
            at = np.flatnonzero(counts)
            yield at, np.log1p(counts[at]).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many of all documents hold each bucket (one row per bucket reaches the driver), and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, rows = WordFeatures(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at, _ in features(batch.column(0).to_pylist(), known):
                total[at] += 1
            rows += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([rows, *total[at].tolist()], pa.int64())],
                                         ["bucket", "n"])

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, rows = np.zeros(BUCKETS), 0
    for r in found.collect():
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, rows


def _svd(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by a randomized range finder."""
    rng = np.random.default_rng(11)
    width = min(dimensions + 16, *matrix.shape)
    basis = np.linalg.qr(matrix @ rng.standard_normal((matrix.shape[1], width)).astype(np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
    return np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:dimensions].T.astype(np.float32)


class Model:
    """Projection of weighted buckets, and unit vectors of labelled texts with their labels."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        matrix = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (at, weight) in enumerate(rows):
            matrix[i, at] = weight * idf[at]
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix /= np.where(norm > 0, norm, 1)
        self.projection = (_svd(matrix, DIMENSIONS) * idf[:, None]).astype(np.float32)
        vectors = (matrix / np.maximum(idf, 1e-9)) @ self.projection
        size = np.linalg.norm(vectors, axis=1)
        some = size > 1e-9
        self.vectors = (vectors[some] / size[some, None]).astype(np.float32)
        self.labels = labels[some].astype(np.float64)

    def scores(self, texts: list[str | None], known: WordFeatures) -> np.ndarray:
        v = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for i, (at, weight) in enumerate(features(texts, known)):
            v[i] = weight @ self.projection[at]
        size = np.linalg.norm(v, axis=1)
        out = np.full(len(texts), 0.5)
        some = size > 1e-9
        if some.any() and len(self.labels):
            near = (v[some] / size[some, None]) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            # Equally near vectors vote together, so rounding does not pick among them.
            least = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
            row, voter = np.nonzero(near >= least - 1e-5)
            vote = np.maximum(near[row, voter], 1e-6).astype(np.float64) ** 4
            for_one, all_votes = (np.bincount(row, votes, len(near)) for votes in (vote * self.labels[voter], vote))
            out[some] = np.clip(for_one / all_votes, 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS) -> Model | None:
    """Fit on ``labels`` (doc_id, 0 or 1), at most ``per_class`` rows of each label; None without any."""
    named = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    named = named.groupBy("id").agg(F.max("y").alias("y")).join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi")
    one, zero = (named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (1, 0))
    chosen = written(one.unionByName(zero), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            got = list(features(batch.column(1).to_pylist(), known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                ["y", "at", "weight"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.max("t").alias("t")).select("y", "t", F.xxhash64("id").alias("h"), "id")
    rows = texts.select("y", "t").mapInArrow(run, "y int, at array<bigint>, weight array<float>").toArrow()  # at most 2 * per_class rows
    if not rows.num_rows:
        return None
    df, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    at, weight = rows.column("at").to_pylist(), rows.column("weight").to_pylist()
    return Model(idf, [(np.array(a, np.int64), np.array(w, np.float32)) for a, w in zip(at, weight)], rows.column("y").to_numpy())


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: 0 to 1, higher where label 1 is likelier."""
    if model is None:
        return docs.withColumn(into, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != into), T.StructField(into, T.DoubleType())])
    stay = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            parts = [shared.value.scores(texts[s:s + BLOCK].to_pylist(), known) for s in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in stay), pa.array(np.concatenate(parts) if parts else [], pa.float64())],
                schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
