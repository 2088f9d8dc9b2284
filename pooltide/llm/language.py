"""Language identification by fusing evidence: text, declared markup language, address suffix and host.

Text. Letter trigrams (lower case, everything else one space) are hashed into
buckets; every labelled language, however rare, has smoothed log likelihoods fitted
on at most PER_LANGUAGE of its texts (those whose id hashes lowest). Only buckets
that a language has are stored. Trigrams of a text are
not independent, so its evidence is the mean log likelihood times a bounded number
of trigrams. ``und`` (no known language) is the flat distribution over buckets.

Declared language. Over all rows it is counted how often each declared value
comes with texts of each language; those smoothed shares are its likelihood.

Address. Expected counts of languages, from the text alone, are summed by host,
by address suffix and over all rows. A host's prior is its counts smoothed by its
suffix's prior, which is smoothed by that of all rows. A row's own count is taken
out of its host's. Counts are sums, combined before they are shuffled.

A row gets the language of the largest posterior; it is accepted if that is not
``und`` and has at least half of the probability. Rows without letters are judged
by declared value and address alone; without those too, by the share of languages
over all rows. A null host or declared value is no evidence; a host without a
suffix has the prior of all rows above it. Repeated rows count each. Other columns
stay. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pooltide.llm.tables import written

BUCKETS, PER_LANGUAGE = 1 << 15, 300
#: Stored (bucket, language) entries of a model at most, 8 bytes each; more is an error, never a smaller model.
MAX_ENTRIES = 1 << 26
#: Trigrams that count as independent evidence at most; weight of the prior above in counts.
TRIGRAMS, SMOOTH = 40, 5.0
UNKNOWN = "und"
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams of a text."""
    words = (text or "").lower().encode().translate(_LETTERS).split()
    if not words:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    return (((b[:-2] * 1_000_003 + b[1:-1]) * 1_000_003 + b[2:]) * 2_654_435_761 >> 17).astype(np.int64)


class TextModel:
    """Log likelihoods of buckets by language; the last language is ``und``."""

    def __init__(self, languages: list[str], of: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        """From counts ``n`` of buckets in the languages numbered ``of``."""
        self.languages = [*languages, UNKNOWN]
        sums = np.bincount(of, weights=n, minlength=len(languages))
        #: A bucket that a language lacks has ``base``; those it has add ``more``, ordered by bucket.
        self.base = np.append(np.log(0.1 / (sums + 0.1 * BUCKETS)), -math.log(BUCKETS))
        order = np.argsort(bucket, kind="stable")
        self.first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.of, self.more = of[order].astype(np.int32), np.log((n[order] + 0.1) / 0.1).astype(np.float32)

    def evidence(self, text: str | None) -> np.ndarray:
        at = trigrams(text)
        if not len(at):
            return np.zeros(len(self.languages))
        times = np.bincount(at, minlength=BUCKETS)
        seen = np.flatnonzero(times)
        sizes = self.first[seen + 1] - self.first[seen]
        entry = np.arange(sizes.sum()) + np.repeat(self.first[seen] - np.cumsum(sizes) + sizes, sizes)
        more = np.bincount(self.of[entry], weights=self.more[entry] * np.repeat(times[seen], sizes), minlength=len(self.languages))
        return (self.base + more / len(at)) * min(len(at), TRIGRAMS)


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id") -> TextModel:
    """Fit on rows with a text and a language: every language, PER_LANGUAGE rows of each."""
    rows = labelled.select(F.col(language).alias("language"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h")).where(
        f"language IS NOT NULL AND language <> '{UNKNOWN}' AND t IS NOT NULL")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = total.setdefault(language, np.zeros(BUCKETS, np.int64))
                # A long text counts as much as any other, so that it does not set the tone alone.
                at = trigrams(text.as_py())
                own += np.minimum(np.bincount(at, minlength=BUCKETS), 20)
        for language, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())],
                                             ["language", "bucket", "n"])

    sample = ranked.where(F.col("rank") <= PER_LANGUAGE).select("language", "t")
    found = sample.mapInArrow(run, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = written(found, "trigrams")
    entries = counts.count()
    if entries > MAX_ENTRIES:
        raise ValueError(f"{entries} trigram counts of all languages are more than {MAX_ENTRIES}; lower PER_LANGUAGE")
    # In order, so that sums of floats repeat.
    table = counts.toArrow().sort_by([("language", "ascending"), ("bucket", "ascending")])  # MAX_ENTRIES at most
    of = table.column("language").combine_chunks().dictionary_encode()
    return TextModel(of.dictionary.to_pylist(), of.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                     table.column("bucket").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64))


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def page_language(html: Column) -> Column:
    """Language that the page's markup declares."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1), F.lit(""))


def address_host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def address_suffix(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.0-9]+)$", 1), F.lit(""))


def identify(rows: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, host: str | None = None) -> DataFrame:
    """``rows`` without ``text``, with (language, posterior, accepted). Runs a job: the evidence is a written table."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = model.languages
    stay = [f for f in rows.schema.fields if f.name != text and f.name not in ("language", "posterior", "accepted")]
    given = {"__declared": F.lower(F.substring_index(F.col(declared).cast("string"), "-", 1)) if declared else F.lit(None).cast("string"),
             "__host": F.col(host).cast("string") if host else F.lit(None).cast("string")}
    schema = T.StructType([*stay, *(T.StructField(n, T.StringType()) for n in given), T.StructField("__seen", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [shared.value.evidence(v.as_py()) for v in batch.column(0)]
            flat = pa.array(np.concatenate(seen) if seen else [], pa.float64())
            ends = pa.array(np.arange(len(seen) + 1) * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(ends, flat)], schema.names)

    source = rows.select(F.col(text).cast("string").alias("__text"), *(F.col(f.name) for f in stay), *(c.alias(n) for n, c in given.items()))
    e = written(source.mapInArrow(run, schema), "evidence")
    e = e.withColumn("__suffix", address_suffix(F.col("__host")))
    e = e.withColumn("__top", F.array_max("__seen"))
    e = e.withColumn("__own", F.expr("transform(__seen, x -> exp(x - __top))"))
    e = e.withColumn("__own", F.expr("transform(__own, x -> x / aggregate(__own, 0D, (s, y) -> s + y))"))

    own = [F.sum(F.get("__own", F.lit(i))).alias(f"s{i}") for i in range(len(names))]
    sums = F.array(*(F.col(f"s{i}") for i in range(len(names))))
    total = e.agg(*own).select(sums.alias("g")).select(F.expr("transform(g, x -> (x + 1) / (aggregate(g, 0D, (s, y) -> s + y) + size(g)))").alias("g"))
    top = total.collect()[0]["g"]  # one number per language; null over an empty table
    share = F.array(*(F.lit(1 / len(names) if x is None else float(x)) for x in top))

    def smoothed(counts: str, above: str) -> Column:
        return F.expr(f"zip_with({counts}, {above}, (c, p) -> (greatest(c, 0D) + {SMOOTH} * p) / (greatest(aggregate({counts}, 0D, (s, y) -> s + y), 0D) + {SMOOTH}))")

    suffixes = e.where("__suffix IS NOT NULL").groupBy("__suffix").agg(*own).select("__suffix", sums.alias("__by_suffix"))
    hosts = e.where("__host IS NOT NULL").groupBy("__host").agg(*own).select("__host", sums.alias("__by_host"))
    hosts = hosts.withColumn("__suffix", address_suffix(F.col("__host"))).join(suffixes, "__suffix", "left").withColumn("__all", share)
    hosts = hosts.withColumn("__above", F.coalesce(smoothed("__by_suffix", "__all"), "__all")).select("__host", "__by_host", "__above")
    said = (e.where("__declared IS NOT NULL").groupBy("__declared").agg(*own).select("__declared", sums.alias("__by_declared")))
    kinds = said.agg(F.count("*").alias("k"), *(F.sum(F.get("__by_declared", F.lit(i))).alias(f"s{i}") for i in range(len(names)))).collect()[0]
    norm = F.array(*(F.lit(float(kinds[f"s{i}"] or 0) + 0.5 * (kinds["k"] or 1)) for i in range(len(names))))
    said = said.withColumn("__norm", norm).select(
        "__declared", F.expr("zip_with(__by_declared, __norm, (c, n) -> ln((c + 0.5D) / n))").alias("__said"))

    joined = e.join(hosts, "__host", "left").join(said, "__declared", "left").withColumn("__all", share)
    joined = joined.withColumn("__less", F.expr("zip_with(__by_host, __own, (c, o) -> c - o)"))
    joined = joined.withColumn("__prior", F.coalesce(smoothed("__less", "__above"), "__all"))
    joined = joined.withColumn("__sum", F.expr(
        "zip_with(zip_with(__seen, __prior, (x, p) -> x + ln(p)), coalesce(__said, array_repeat(0D, size(__seen))), (x, d) -> x + d)"))
    joined = joined.withColumn("__best", F.array_max("__sum"))
    posterior = F.expr("1 / aggregate(__sum, 0D, (s, x) -> s + exp(x - __best))")
    language = F.get(F.array(*(F.lit(n) for n in names)), (F.array_position("__sum", F.col("__best")) - 1).cast("int"))
    return joined.select(*(f.name for f in stay), language.alias("language"), posterior.alias("posterior")).withColumn(
        "accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= 0.5))


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns stay. The text model is fitted on ``declared``.

    A language of which no text has letters has no model; rows that declare one stay.
    """
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string"), F.col(declared).cast("string"), F.col(host).cast("string"))
    model = fit(docs, text, declared, doc_id)
    slim = docs.select(key.alias("__row"), text, declared, host)
    bad = identify(slim, model, text, declared, host).where(
        ~F.col("accepted") & F.coalesce(F.col(declared).isin(model.languages), F.lit(True))).select("__row").distinct()
    return docs.withColumn("__row", key).join(bad, "__row", "left_anti").drop("__row")
