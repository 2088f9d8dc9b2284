"""Lexical search, importance resampling and merge-type pieces against brute force, with the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pooltide.llm import importance, lexical, pieces

DOCS = "doc_id bigint, text string, score string, item_id string"
RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", ",", "."]) for _ in range(n))


def texts_of(seed, n=120):
    rng = random.Random(seed)
    out = [None, "", "  ... ", "É É é Straße 日本 日本", "ONE one One", "x" * 700 + " tail", prose(rng, 3000)]
    out += [prose(rng, rng.choice([3, 19, 20, 60, 200])) for _ in range(n)]
    out += [out[9]] * 5  # copies tie
    out += [out[9].upper()]
    return out


def docs_of(spark, texts):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


# Lexical search


def brute_search(docs, items, k):
    """docs: (id, text); items: (id, text). The contract's formula, row by row."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                    for w in words(text) if c[w])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_search_equals_brute_force(spark):
    texts = texts_of(1)
    rng = random.Random(2)
    items = [(1, texts[20]), (2, prose(rng, 40)), (2, "one É 日本 " + VOCAB[0]), (None, VOCAB[3]), (4, None), (5, "!!"), (6, "unheardof"),
             (7, " ".join([VOCAB[1]] * 30)), (8, texts[9])]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    df = docs_of(spark, texts).union(spark.createDataFrame([(None, texts[9], "", ""), (12, texts[9], "", "")], DOCS))
    pairs = [*enumerate(texts), (None, texts[9]), (12, texts[9])]
    want = sorted(brute_search(pairs, items, 20), key=str)
    for block_bytes in (lexical.BLOCK_BYTES, 400):  # one block of items, then several
        got = [tuple(r) for r in lexical.search(spark, df, asked, block_bytes=block_bytes).collect()]
        assert sorted(got, key=str) == want
    assert lexical.search(spark, df.limit(0), asked).count() == 0
    assert lexical.search(spark, df, asked.limit(0)).count() == 0


def segments(texts, ids, items, k, size):
    """The index alone: segments of ``size`` texts, searched one after the other."""
    held = [(i, Counter(w for w in lexical.terms_of(t) if w in items.number), len(lexical.terms_of(t))) for i, t in zip(ids, texts)]
    lengths = [n for _, _, n in held if n]
    df = np.array([sum(w in c for _, c, _ in held) for w in items.number], np.int64)
    search = lexical.Search(items, df, len(lengths), sum(lengths), k)
    held = [h for h in held if h[1]]
    for a in range(0, len(held), size):
        part = held[a:a + size]
        search.add(np.array([i for i, _, _ in part]), np.zeros(len(part), bool), np.array([n for _, _, n in part]),
                   np.repeat(np.arange(len(part)), [len(c) for _, c, _ in part]),
                   np.array([items.number[w] for _, c, _ in part for w in c]), np.array([n for _, c, _ in part for n in c.values()]))
    return search


def test_segments_agree_and_bounds_skip_strata():
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([30, 60, 90, 120, 300])) for _ in range(600)]
    passage = " ".join(rng.choice(VOCAB) for _ in range(30))
    texts += [passage + " " + prose(rng, 5) for _ in range(30)]
    items = lexical.Items([1, 2], [passage, VOCAB[5]])
    runs = [segments(texts, range(len(texts)), items, 20, size) for size in (1000, 100, 7)]
    for best in zip(*(r.best for r in runs)):
        assert all((a[0] == best[0][0]).all() and (a[2] == best[0][2]).all() for a in best)
    assert runs[0].visited < runs[0].strata
    want = brute_search(list(enumerate(texts)), [(1, passage), (2, VOCAB[5])], 20)
    assert [(i, s) for _, _, i, s in want] == [(i, s) for score, _, ids in runs[2].best for s, i in zip(score.tolist(), ids.tolist())]


def test_scores_beyond_exact_doubles():
    one = lexical.Stratum(100, np.arange(2), np.zeros(2, bool), np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([3, 9, 1]))
    terms, weights = np.array([0, 1, 5]), np.array([2**40 + 1, 3, 7])
    assert (one.scores(terms, weights, 1 << 60) == [(2**40 + 1) * (3 * 10**9 // 4200), (2**40 + 1) * (9 * 10**9 // 10200) + 3 * (10**9 // 2200)]).all()


# Importance resampling


@pytest.mark.parametrize("block", [4, 64])
def test_crc_of_spans(block):
    rng = random.Random(block)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, block - 1, block, block + 1, 2 * block, 1000]))) for _ in range(200)]
    sizes = np.array([len(s) for s in spans])
    table = importance.PositionTable(block)
    found = table.crc32(np.frombuffer(b"".join(spans), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert found.tolist() == [zlib.crc32(s) for s in spans]


def brute_resample(docs, target, buckets, max_words, percent, min_words):
    def found(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    of = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for *_, f in of for b in f), Counter(b for x in target for b in found(x)[1])
    big_s, big_t = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in s}
    rows = []
    for i, n, f in of:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[:len(fit) * percent // 100], 1):
        r[5] = rank
    return rows


@pytest.mark.parametrize("max_words, percent", [(1, 10), (3, 50), (2, 100)])
def test_resampling_equals_brute_force(spark, max_words, percent):
    texts = texts_of(7)
    target = [prose(random.Random(9), 40), None, "one"]
    df = docs_of(spark, texts).union(spark.createDataFrame([(None, texts[9], "", ""), (12, texts[9], "", "")], DOCS))
    got = importance.resample(spark, df, spark.createDataFrame([(t,) for t in target], "text string"), 500, max_words, percent)
    want = brute_resample([*enumerate(texts), (None, texts[9]), (12, texts[9])], target, 500, max_words, percent, 20)
    assert sorted((list(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_slices_do_not_change_features():
    import pyarrow as pa

    column, table = pa.array(texts_of(3) + [""]), importance.PositionTable()
    runs = []
    for limit in (1, 500, 1 << 20):
        rows = [[] for _ in range(3)]
        for data, offsets in importance.slices(column.slice(2), limit):
            for n, (found, first) in enumerate(importance.features(data, offsets, table, 1000, 3)):
                rows[n] += [found[a:b].tolist() for a, b in zip(first, first[1:])]
        runs.append(rows)
    assert runs[0] == runs[1] == runs[2] and len(runs[0][0]) == len(column) - 2


def test_resampling_of_empty_tables(spark):
    empty, some = docs_of(spark, ["a"]).limit(0), docs_of(spark, [None, "a b", prose(random.Random(1), 30)])
    assert importance.resample(spark, empty, some).count() == 0
    rows = importance.resample(spark, some, empty.select("text"), percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in rows) == [(0, 0, None), (1, 2, None), (2, 30, 1)]


# Pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


ODD = [None, "", " ", "  lead", "tail  ", "a\n\nb\tc\r\n", "▁▁x", "日本語 and é😀", "<s>no</s><unk><0x41>", "\x00\x1c　​", "12,345.67", "x" * 5000,
       "ab" * 3000, "it's (so)…", "ﬁ ½²"]


def test_pieces_equal_the_library(spark, library):
    rng = random.Random(3)
    parts = ["the", "'re", "'", " ", "  ", "\n", "12", "é", "!", "...", "日", "</s>", "▁", "\x1c", "ing", "▁the", "😀"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(25)) for _ in range(300)] + [prose(rng, 400)] + ["again"] * 3
    df = docs_of(spark, texts).withColumnRenamed("score", "ids").withColumnRenamed("item_id", "decoded")
    done = pieces.decode(pieces.encode(df))
    rows = done.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want)
    assert pieces.differences(done).count() == 0
    assert pieces.differences(done.selectExpr("doc_id", "concat(text, 'x') AS text", "ids", "decoded")).count() == len(texts) - 1
    bare = pieces.encode(df, ends=False).where("doc_id = 1").first()
    assert len(bare.ids) == 0
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0


def test_any_ids_decode_as_in_the_library(library):
    words = pieces.Vocabulary(open(pieces.default_path(), "rb").read())
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(190, 259), rng.randrange(32000), 28705, 259]) for _ in range(rng.randrange(8))]
        assert words.text_of(np.array(ids, int)) == library.decode(ids), ids


def test_words_are_cut_only_where_no_piece_spans():
    words = pieces.Vocabulary(open(pieces.default_path(), "rb").read())
    for piece in words.ids:
        assert words.cut.findall(piece) == [piece]
    text = "▁▁▁a1b,c\n▁(é)日\t▁"
    assert "".join(words.cut.findall(text)) == text
    whole = [p for p in words.merge(text)]
    assert whole == [p for w in words.cut.findall(text) for p in words.merge(w)]
