"""Every operator against brute force on small rows, with the cases its docstring defines."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pooltide.llm import ann, bpe, chat, decontaminate, language, line_dedup, near_dup, quality, tables, token_counts, token_store

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "It's we'll 'sX  two\t\n", "É日本 ½ 12ab", "<|endoftext|>x<|endoftext|>", "x" * 3000, "ab" * 2000, "  \r\n end "]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_and_counts_equal_the_library(spark, library):
    rng = random.Random(3)
    parts = ["the", "'re", "'", " ", "  ", "\n", "12", "é", "!", "...", "日", "<|endoftext|>", " ", "\x1c"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(20)) for _ in range(200)] + [prose(300)]
    df = docs_of(spark, texts).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts.token_counts(bpe.decode(bpe.encode(df))).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert got[i].decoded == (t or "") and got[i].n_tokens == len(want) and got[i].n_bytes == len((t or "").encode())
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0 and token_counts.token_counts(df.limit(0)).count() == 0


def test_code_points_split_as_in_the_library(library):
    from pooltide.llm.vocab import CharClasses, split_words

    classes = CharClasses()
    for first in (0, 0x300, 0x1c80, 0xa7c0, 0x10d40, 0x1f300):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}\n" for c in range(first, first + 400))
        assert split_words(text, classes) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_token_files_round_trip(spark, library, tmp_path):
    texts = ODD + [prose(50), prose(50)]
    df = docs_of(spark, texts).union(spark.createDataFrame([(None, "no id", "en", "s", 5), (3, "again", "en", "s", 5)], DOCS))
    token_store.write(df, f"{tmp_path}/t")
    got = token_store.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 0
        at += r.n_tokens
        if r.doc_id not in (None, 3):
            assert ids[:-1] == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    token_store.write(df.limit(0), f"{tmp_path}/e")
    assert token_store.read(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("n", [1, 1024, 1025, 9000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.zeros(n, int), rng.integers(0, 3, n), np.minimum(rng.zipf(1.3, n), 50000)):
        blocks = token_store.encode_blocks(ids)
        assert (token_store.decode_blocks(blocks, n) == ids).all()
    frame = bytearray(token_store.pack_frame([1], [n], ids))
    frame[-1] ^= 1
    with pytest.raises(ValueError):
        token_store.unpack_frame(bytes(frame))


def brute_components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = [prose(rng.choice([6, 40, 120]), rng) for _ in range(6)]
    texts = ["", "a b", "A B", "lone words here now"] + base
    for _ in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        texts.append(" ".join(words))
    shared = prose(40, rng)
    texts += [shared + " " + prose(30, rng) for _ in range(20)]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = brute_components(len(texts), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    df = docs_of(spark, texts).union(spark.createDataFrame([(None, texts[4], "en", "s", 1)], DOCS)).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    assert got[None].component_id is None and got[None].kept
    for i in range(len(texts)):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (want[i], len(sets[i]), want[i] == i)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in tables.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_edit_distances_of_many_pairs(spark):
    from pooltide.llm.edits import distances

    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("日本", "日"), ("😀" * 70, "😀" * 66 + "é")]
    for size in (1, 5, 63, 64, 65, 128, 129, 300) * 30:
        one = [rng.choice("abcé日 ") for _ in range(size)]
        other = list(one)
        for _ in range(rng.choice([0, 1, 3, 20, 90])):
            at = rng.randrange(len(other) + 1)
            other[at:at + rng.choice([0, 1])] = rng.choice(["", "x", "😀"])
        pairs.append(("".join(one), "".join(other)))
    want = [r.d for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string").selectExpr(
        "i", "levenshtein(x, y) AS d").orderBy("i").collect()]
    assert distances(*map(list, zip(*pairs))).tolist() == want


@pytest.mark.parametrize("radius, bucket_keys, long_chars", [(3, 1 << 19, 1024), (None, 500, 300)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, radius, bucket_keys, long_chars):
    monkeypatch.setattr(line_dedup, "BUCKET_KEYS", bucket_keys)
    monkeypatch.setattr(line_dedup, "LONG_CHARS", long_chars)
    rng = random.Random(4)
    lines = [prose(60, rng) for _ in range(8)]
    near = []
    for line in lines[:4]:
        for _ in range(6):
            words = line.split()
            words[rng.randrange(60)] = "qq"
            near.append(" ".join(words))
    texts = [None, "", "one two", "one two"] + ["\n".join(rng.sample(lines + near, 4) + ["", rng.choice(lines).upper() + "!!"]) for _ in range(25)]
    occ = [(i, n, " ".join(map(bytes.decode, w))) for i, t in enumerate(texts) if t is not None
           for n, w in enumerate(line_dedup.split_lines(t)) if len(w) >= line_dedup.MIN_WORDS]
    hasher = line_dedup.SimHasher()
    codes = [int(c) & (2**64 - 1) for c in hasher.of([said.encode().split() for _, _, said in occ])]

    @functools.cache
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def linked(a, b):
        x, y = occ[a][2], occ[b][2]
        most = max(len(x), len(y))
        return x == y or (radius is None or bin(codes[a] ^ codes[b]).count("1") <= radius) and min(len(x), len(y)) >= 0.8 * most and distance(x, y) <= 0.2 * most

    root = brute_components(len(occ), linked)
    gone = {(i, n) for k, (i, n, _) in enumerate(occ) if root[k] != k}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts).withColumn("lines", F.lit("clash")), radius=radius).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert got[i].text == want and got[i].dropped == sum(a == i for a, _ in gone)
    assert line_dedup.dedup_lines(docs_of(spark, texts).limit(0)).count() == 0


def test_line_dedup_finds_lines_of_edit_similarity(spark):
    rng = random.Random(12)
    groups = []
    for n in (8, 12, 20, 27, 40, 60) * 12:
        base = prose(n, rng).split()
        edited = list(base)
        for i in rng.sample(range(n), max(1, n // 10)):
            edited[i] = edited[i][:2] + "q" if rng.random() < 0.5 else edited[i][:-1] + "zz"
        groups.append((" ".join(base), " ".join(edited)))
    # No other two of these lines are alike; the edited words are changed by less than a fifth of their line.
    df = docs_of(spark, ["\n".join(a for a, _ in groups), "\n".join(b for _, b in groups)])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, radius=None).collect()}
    assert got[0].dropped == 0 and got[1].dropped >= 0.97 * len(groups)
    assert line_dedup.dedup_lines(df, radius=3).where("doc_id = 1").first().dropped < 0.5 * len(groups)
    assert line_dedup.dedup_lines(df.limit(0), radius=None).count() == 0


def test_line_dedup_takes_short_lines_and_lines_without_spaces(spark):
    said = "日本語の文章には空白がないので一行が一語になる"
    texts = [f"Home\nle treque\n{said}\n\n--", f"home!\nLe  treque\n{said}\n\n--", "ab\nac", f"{said[:-1]}た\nab"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts), radius=None).collect()}
    assert [got[i].text for i in range(4)] == [texts[0], "\n--", "ab\nac", ""]
    assert [got[i].dropped for i in range(4)] == [0, 3, 0, 2]


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(6)
    items = [prose(40, rng) for _ in range(5)] + ["too short", None, ""]
    edited = items[1].split()
    edited[5], edited[17] = "zz", "yy"
    del edited[30]
    texts = [None, "", prose(300, rng), prose(80, rng) + " " + items[0].upper() + ". " + prose(90, rng), " ".join(edited), "too short",
             items[2] + " " + items[3]] + [items[4]] * 12
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontaminate.contaminated(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(3, 0), (4, 1), (6, 2), (6, 3)} | {(7 + i, 4) for i in range(12)}
    assert next(r for r in got if r.doc_id == 3).similarity == 1.0
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, texts).limit(0), bench).count() == 0
    assert {r.doc_id for r in decontaminate.keep_clean(docs_of(spark, texts), bench).collect()} == {0, 1, 2, 5}


def test_decontamination_finds_large_groups_of_edited_copies(spark):
    rng = random.Random(16)
    words = prose(36, rng).split()
    edited = [f"zz{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
    own = [" ".join(edited) + " " + prose(3, rng) for _ in range(30)]
    texts = [" ".join(words)] + [" ".join(edited)] * 30 + own + [prose(20, rng) for _ in range(5)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words).upper())], "item_id bigint, text string")
    got = decontaminate.contaminated(docs_of(spark, texts), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, k) for i in range(61) for k in (1, 2)]
    assert {round(r.similarity, 2) for r in got if r.doc_id} == {0.71}


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(10, 16, rng.integers(4, 12)), rng.integers(10, 16, rng.integers(1, 30))) for _ in range(60)]
    got, _ = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    for score, (a, b) in zip(got, pairs):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert score == h.max()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[40:400] = v[40]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = ann.nearest_neighbours(df, "vec_id % 20 = 0", 20).toPandas()
    hit = 0
    for q in range(0, 1500, 20):
        s = (v.astype(float) * v[q].astype(float)).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 20 and own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, s[own.vec_id])
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        hit += len(set(best) & set(own.vec_id))
    assert len(got) == 1500 and hit / 1500 >= 0.9
    few = ann.nearest_neighbours(df.where("vec_id < 3"), "vec_id = 0", 20)
    assert few.count() == 2 and ann.nearest_neighbours(df.limit(0), "vec_id = 0", 20).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.held_out(F.col("doc_id"))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id bigint, text string")).withColumn("score", F.lit("clash"))
    scored = quality.score(more, quality.fit(docs, labels.where(~out)))
    rows = scored.join(labels, "doc_id").where(out).collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert right >= 0.95 * len(rows) > 0
    assert {r.score for r in scored.where("doc_id < 0").collect()} == {0.5}
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(docs.limit(0), None).count() == 0


def test_chats_fold_events_and_round_trip(spark):
    log = [
        ("a", 1, "message", None, "user", "x < y <|im_end|> <\\|b"), ("a", 2, "message", None, "assistant", "Hel"), ("a", 3, "delta", None, None, "lo"),
        ("a", 4, "message", None, "user", "more"), ("a", 5, "edit", 1, None, "[INST] edited </s>"), ("a", 6, "message", None, "assistant", "bad"),
        ("a", 7, "regenerate", None, None, None), ("a", 8, "delta", None, None, "good"), ("a", 9, "delta", None, None, " é"),
        ("b", 1, "message", None, None, None), (None, None, None, None, "assistant", "\\[INST] <"), ("b", 2, "delta", 1, "x", "!"),
    ]
    df = spark.createDataFrame(log, "conv_id string, seq bigint, kind string, ref bigint, role string, text string").withColumn("turn", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got["a"].turns] == [
        ("user", "[INST] edited </s>"), ("assistant", "Hello"), ("user", "more"), ("assistant", "good é")]
    assert got["a"].loss_text == "Hellogood é" and got["a"].formatted.count("<|im_end|>") == 4 and "</s>" not in got["a"].formatted
    assert [(t.role, t.text) for t in got["b"].turns] == [("", "!")] and got["b"].loss_text == ""
    assert got[None].loss_text == "\\[INST] <"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language_fuses_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    rows = [(1, None, "de", "a.example.de"), (2, "", None, None), (3, "the of and thing that with", "fr", "h"), (4, "χψω φυτ ξζη ωψχ", None, None),
            (5, "x" * 200_000, "en-US", None)]
    rows += [(100 + i, r.text, r.lang, "h.example.org") for i, r in enumerate(docs.where("lang = 'es'").limit(40).collect())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("language", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(df, model, "text", "lang", "source").collect()}
    assert all(got[100 + i].language == "es" and got[100 + i].accepted for i in range(40))
    assert got[3].language == "en" and got[4].language == language.UNKNOWN and not got[4].accepted
    assert len(got) == 45
    assert language.identify(df.limit(0), model, "text", "lang", "source").count() == 0
    assert language.keep_known(docs).count() == docs.count()



def test_every_labelled_language_has_a_model(spark):
    rows = []
    for k in range(70):
        rng = random.Random(1000 + k)
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(30)]
        for _ in range(1 if k >= 66 else 2 if k >= 64 else 4):
            rows.append((len(rows), " ".join(rng.choice(own) for _ in range(80)), f"l{k:02}", "h.example.org", 1))
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    assert model.languages == [f"l{k:02}" for k in range(70)] + [language.UNKNOWN]
    got = language.identify(docs.select("doc_id", "text", F.col("lang").alias("label")), model).collect()
    assert all(r.language == r.label and r.accepted for r in got) and len(got) == len(rows)
    digits = spark.createDataFrame([(-1, "12 34", "zz", None, 5)], DOCS)
    assert language.keep_known(docs.union(digits)).count() == len(rows) + 1
    assert language.fit(docs.limit(0)).languages == [language.UNKNOWN]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    rng = random.Random(9)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [prose(100, rng), prose(100, rng)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[:5] == docs.columns, name
        docs = tables.written(out, name)
    assert 0 < docs.count() and extra
    assert docs.where("decoded <> text").count() == 0
