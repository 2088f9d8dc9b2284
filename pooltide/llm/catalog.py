"""Registered queries of this package and, where SQL can express them, the SQL they are checked against.

A query applies one operator with its production parameters to a whole table and
derives digest columns from the operator's output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pooltide.llm import (ann, bpe, chat, decontaminate, importance, language, lexical, line_dedup, near_dup, pieces, quality,
                          token_counts, token_store)
from pooltide.operators.staging import staging_dir

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens above which a document does not fit a training window.
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.decode(bpe.encode(docs).drop("text"))
    return back.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM shingles),
each AS MATERIALIZED (SELECT doc_id, unnest(list_transform(s, lambda x: md5_number(x))) AS v FROM shingles),
held AS MATERIALIZED (SELECT v FROM each GROUP BY v HAVING count(*) > 1),
likely AS MATERIALIZED (
  SELECT doc_id, n FROM each JOIN held USING (v) JOIN sizes USING (doc_id) GROUP BY doc_id, n HAVING 100 * count(*) >= 75 * n
), few AS MATERIALIZED (SELECT doc_id, n, v FROM each JOIN likely USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM few a JOIN few b ON a.v = b.v AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), smallest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN smallest USING (doc_id)
"""

def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, labels.where(~out))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: A conversation of control strings, formatted besides the table's.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL_TEXT))
    events = log.union(more).withColumns({"kind": F.lit("message"), "ref": F.lit(None).cast("bigint")})
    back = chat.read_back(chat.format_chats(events, seq="turn"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


OP10_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)
), sized AS (
  SELECT *, 32 + length(regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS size FROM log
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "lines", "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "similarity", "start_word", "end_word")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_dir(spark)}/pooltide/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), folder)
    return token_store.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language and source) and web pages (markup language, suffix and host) in one run."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("bigint")
    both = docs.select("doc_id", none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")).unionByName(
        pages.select(none.alias("doc_id"), "page_id", language.page_text(F.col("html")).alias("text"),
                     language.page_language(F.col("html")).alias("declared"), language.address_host(F.col("url")).alias("host")))
    return language.identify(both, language.fit(docs), "text", "declared", "host")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
norms AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, corpus),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return importance.resample(spark, docs, target, buckets=10000, max_words=1, percent=10, min_words=20, seed=2024).select(
        "doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM steps WHERE k < 8
), crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
features AS (
  SELECT 'doc' AS kind, doc_id AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'item', item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), held AS MATERIALIZED (SELECT kind, id, w, count(*) AS n FROM features GROUP BY ALL),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM held)),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2), lambda i: CAST(
    (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'doc'), 0) AS s, coalesce(sum(n) FILTER (kind = 'item'), 0) AS t
  FROM held JOIN hashed USING (w) GROUP BY bucket
), totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(big_s + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST(big_t + 10000 AS DOUBLE)))) AS gain FROM counts, totals
), sums AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM held JOIN hashed USING (w) JOIN gains USING (bucket) WHERE kind = 'doc' GROUP BY id
), noise AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i: CAST(
    instr('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1 AS BIGINT))), lambda a, d: a * 16 + d) AS h FROM documents
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM noise LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * fit) // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs).drop("text"))
    return back.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_store": op4_token_store,
    "op5_nearest": op5_nearest,
    "op6_language": op6_language,
    "op7_near_dup": op7_near_dup,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_lexical": op11_lexical,
    "op12_importance": op12_importance,
    "op13_pieces": op13_pieces,
}
ORACLE: dict[str, str] = {"op7_near_dup": OP7_SQL, "op10_chat": OP10_SQL, "op11_lexical": OP11_SQL, "op12_importance": OP12_SQL}
