"""SentencePiece encoding and decoding for vocabularies of merge type.

The symbols of a word wait on an agenda of neighbouring pairs, ordered by the
score of the piece that they would form, best first and left before right; taking
a pair may offer new ones, and pairs that have changed meanwhile are skipped.
Characters without a piece fall back to their bytes. ``differences`` holds the ids
against the sentencepiece library, Arrow batch by Arrow batch.

No merge can pass a place where two characters meet that stand side by side in no
piece. In these vocabularies such a place is before a blank, on either side of a
character that stands in no longer piece, and between letters and other signs; there
a text is cut into words, whose ids a worker remembers in bounded memory.

Null text counts as empty: only begin and end ids, if asked for. Extra columns stay;
an output column replaces an input column of the same name. Empty tables give empty
results, repeated rows are encoded each. Texts are encoded whole; a word of any
length costs n log n, and only one text's words are held at a time.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pooltide.llm.bpe import with_column
from pooltide.llm.vocab import MAX_FILE_BYTES, MAX_WORD_CHARS

#: Words a worker remembers before it forgets all of them.
MAX_WORDS = 500_000
#: The sign that stands for a blank in pieces.
BLANK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, merge order and special ids of a model file; refuses what the agenda below doesn't cover."""

    def __init__(self, file_bytes: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(file_bytes)
        trained, norm, kinds = model.trainer_spec, model.normalizer_spec, model.SentencePiece
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only vocabularies that leave texts as they are, behind a blank, are supported")
        if model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("vocabularies that rewrite decoded texts are not supported")
        self.pieces: list[str] = [p.piece for p in model.pieces]
        self.kinds: list[int] = [p.type for p in model.pieces]
        if {kinds.USER_DEFINED, kinds.UNUSED} & set(self.kinds):
            raise ValueError("pieces that are set by the user or unused are not supported")
        normal = [i for i, kind in enumerate(self.kinds) if kind == kinds.NORMAL]
        self.begin, self.end = trained.bos_id, trained.eos_id
        self.unknown_id, self.unknown = trained.unk_id, trained.unk_surface
        self.control = frozenset(i for i, kind in enumerate(self.kinds) if kind == kinds.CONTROL)
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.kinds[i] == kinds.BYTE}
        of_byte = {b: i for i, b in self.byte_of.items()}
        self.byte_ids: list[int] = [of_byte[b] for b in range(256)]
        self.ids: dict[str, int] = {self.pieces[i]: i for i in normal}
        #: Place of a piece by score, best first; pieces of equal score share one.
        scores = sorted({model.pieces[i].score for i in normal}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        self.places: dict[str, int] = {self.pieces[i]: place[model.pieces[i].score] for i in normal}
        self.cut = self._words()
        #: Text of each id where it doesn't depend on its neighbours; a byte beyond ASCII does.
        self.said: list[str] = ["" if i in self.control else chr(self.byte_of.get(i, 0)) if i in self.byte_of else p.replace(BLANK, " ")
                                for i, p in enumerate(self.pieces)]
        self.said[self.unknown_id] = self.unknown
        self.joint = np.array([self.byte_of.get(i, 0) > 127 for i in range(len(self.pieces))])

    def _words(self) -> re.Pattern:
        """Words between places that no piece spans.

        A run of blanks stays with what follows. Cut are the places before blanks, around
        signs of no longer piece, and between letters and others, each only if the pieces allow it.
        """
        longer = [p for p in self.ids if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            return re.compile(r"[\s\S]+")
        inside = set("".join(longer))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        letter = re.compile(r"[^\W\d_]").match
        if any(bool(letter(a)) != bool(letter(b)) for p in longer for a, b in zip(p, p[1:]) if a != BLANK):
            return re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]")
        return re.compile(f"{BLANK}*[^\\W\\d_]+|{BLANK}*(?:(?![{BLANK}{alone}])[\\W\\d_])+|{BLANK}+|[{alone}]")

    def merge(self, word: str) -> list[str]:
        """The pieces that a word's characters are joined to."""
        parts = list(word)
        n = len(parts)
        of, bits = self.places.get, n.bit_length()
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: Place by score of the pair that begins here; -1: none. An agenda entry of another place is stale.
        now = [of(a + b, -1) for a, b in zip(parts, parts[1:])]
        now.append(-1)
        agenda = [p << bits | i for i, p in enumerate(now) if p >= 0]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & mask
            if now[i] != entry >> bits:
                continue
            j = after[i]
            k = after[i] = after[j]
            parts[i] = own = parts[i] + parts[j]
            parts[j] = ""
            now[j] = now[i] = -1
            if k < n:
                before[k] = i
                now[i] = p = of(own + parts[k], -1)
                if p >= 0:
                    heappush(agenda, p << bits | i)
            h = before[i]
            if h >= 0:
                now[h] = p = of(parts[h] + own, -1)
                if p >= 0:
                    heappush(agenda, p << bits | h)
        return [p for p in parts if p]

    def word_ids(self, word: str) -> list[int]:
        ids: list[int] = []
        for piece in self.merge(word):
            known = self.ids.get(piece)
            if known is None:
                ids.extend(map(self.byte_ids.__getitem__, piece.encode()))
            else:
                ids.append(known)
        return ids

    def text_of(self, ids: np.ndarray) -> str:
        """Pieces as text: blanks for their sign but the first, byte pieces as UTF-8, begin and end ids as nothing."""
        joint, each = self.joint[ids], ids.tolist()
        if joint.any():
            turns = (np.flatnonzero(joint[1:] != joint[:-1]) + 1).tolist()
            said = "".join(bytes_as_text(bytes(map(self.byte_of.__getitem__, each[a:b]))) if joint[a]
                           else "".join(map(self.said.__getitem__, each[a:b]))
                           for a, b in zip([0, *turns], [*turns, len(each)]))
        else:
            said = "".join(map(self.said.__getitem__, each))
        first = next((i for i in each if i not in self.control), self.unknown_id)
        return said[1:] if first != self.unknown_id and self.pieces[first].startswith(BLANK) else said


def bytes_as_text(raw: bytes) -> str:
    """UTF-8 as text; each byte that belongs to no whole character becomes a replacement character of its own."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            size = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            try:
                out.append(raw[i:i + size].decode())
                i += size
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Packed ids by word."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = packed(self.vocabulary.word_ids(word))
        if len(word) <= MAX_WORD_CHARS:
            self[word] = ids
        return ids


def load(spark: SparkSession, path: str | None = None) -> Callable[[], dict]:
    """A function that gives workers one dictionary per model file: its bytes, the vocabulary, and their caches."""
    path = path or default_path()
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast({"file": f.read()})

    def get() -> dict:
        store = shared.value
        if "pieces" not in store:
            store["pieces"] = Vocabulary(store["file"])
        return store

    return get


def encode_text(text: str, store: dict) -> bytes:
    """Ids of a text without begin and end, as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    vocabulary: Vocabulary = store["pieces"]
    words = store.get("piece_words")
    if words is None or len(words) > MAX_WORDS:
        words = store["piece_words"] = _Words(vocabulary)
    return b"".join(map(words.__getitem__, vocabulary.cut.findall(BLANK + text.replace(" ", BLANK))))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, ends: bool = True) -> DataFrame:
    """Add ``ids``: the text's ids, packed as little-endian unsigned 32-bit integers (binary), with begin and end ids if ``ends``."""
    get = load(df.sparkSession, path)

    def rows(batch: pa.RecordBatch) -> pa.Array:
        store = get()
        vocabulary = store["pieces"]
        head, tail = ((i.to_bytes(4, "little") if ends and i >= 0 else b"") for i in (vocabulary.begin, vocabulary.end))
        return pa.array([head + encode_text(t.as_py() or "", store) + tail for t in batch.column(text)], pa.binary())

    return with_column(df, ids, T.BinaryType(), rows)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``text``: the packed ids as text; null ids give empty text."""
    get = load(df.sparkSession, path)

    def rows(batch: pa.RecordBatch) -> pa.Array:
        vocabulary: Vocabulary = get()["pieces"]
        return pa.array([vocabulary.text_of(np.frombuffer(p.as_py() or b"", "<u4")) for p in batch.column(ids)], pa.string())

    return with_column(df, text, T.StringType(), rows)


def differences(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None,
                ends: bool = True) -> DataFrame:
    """The rows of an encoded and decoded table whose ids or decoded text aren't the sentencepiece library's.

    Each Arrow batch of whole texts goes to the library in one call, on one thread.
    """
    get = load(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = get()
        if "library" not in store:
            import sentencepiece

            store["library"] = sentencepiece.SentencePieceProcessor(model_proto=store["file"])
        library = store["library"]
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            theirs = library.encode(texts, add_bos=ends, add_eos=ends, num_threads=1) if texts else []
            back = [library.decode(x) for x in theirs]
            ours, said = batch.column(ids).to_pylist(), batch.column(decoded).to_pylist()
            yield batch.filter(pa.array([np.array(x, "<u4").tobytes() != (a or b"") or y != b
                                         for x, y, a, b in zip(theirs, back, ours, said)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
