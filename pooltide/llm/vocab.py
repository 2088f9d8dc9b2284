"""Byte-level BPE vocabularies: reading the file, splitting text into pre-tokens, bounded memory of seen words.

The vocabulary is read on the driver and broadcast as the bytes of its file,
whose size is checked; workers parse it once and keep it between tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

#: Largest vocabulary file that is broadcast.
MAX_FILE_BYTES = 64 << 20
#: Words a worker remembers before it forgets all of them.
MAX_WORDS = 250_000
#: Longer pre-tokens are worked out anew each time they occur.
MAX_WORD_CHARS = 48

_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable_bytes() -> list[int]:
    return [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    """Letters of a byte-level vocabulary: printable bytes stand for themselves, the others follow from code 256 on."""
    own = _printable_bytes()
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class CharClasses:
    """Space, letter, number or other, by code point; filled for the code points that occur.

    Unicode versions differ in their newest letters, so the tokenizers library is
    asked: a sign joins a letter, a number or another sign before it, or none.
    """

    def __init__(self) -> None:
        self.table = np.full(0x110000, _UNKNOWN, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if (found == _UNKNOWN).any():
            from tokenizers.pre_tokenizers import ByteLevel

            spans_of = ByteLevel(add_prefix_space=False).pre_tokenize_str
            for code in np.unique(codes[found == _UNKNOWN]).tolist():
                spans = {span for _, span in spans_of(f"a{chr(code)}\n1{chr(code)}\n!{chr(code)}")}
                self.table[code] = (_LETTER if (0, 2) in spans else _NUMBER if (3, 5) in spans
                                    else _OTHER if (6, 8) in spans else _SPACE)
            found = self.table[codes]
        return found


def split_words(text: str, classes: CharClasses) -> list[str]:
    """Pre-tokens: runs of letters, numbers or other signs with the space before them, English endings, white space.

    White space before a word keeps all but its last character as one token; the
    last goes to the word if it is a plain space and stands alone otherwise.
    """
    n = len(text)
    if n < 2:
        return [text] if text else []
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes.of(codes)
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], change))
    run_kind = kind[starts]
    ends = np.append(change, n)
    mark = np.zeros(n + 1, bool)

    word = starts[run_kind != _SPACE]
    spaced = np.zeros(len(word), bool)
    spaced[word > 0] = codes[word[word > 0] - 1] == 32
    mark[word - spaced] = True

    space = run_kind == _SPACE
    first, last = starts[space], ends[space] - 1
    final = last == n - 1
    mark[first[final | (last > first)]] = True
    inner = last[~final]
    mark[inner[codes[inner] != 32]] = True

    quote = word[(codes[word] == 39) & ~spaced]
    quote = quote[quote + 1 < n]
    for at in quote[kind[quote + 1] == _LETTER].tolist():
        two = text[at + 1:at + 3]
        size = 2 if two in ("re", "ve", "ll") else 1 if two[:1] in ("s", "t", "m", "d") else 0
        if size:
            mark[at + 1] = False
            after = at + 1 + size
            if after < n and kind[after] == _LETTER:
                mark[after] = True
    mark[n] = True
    cuts = np.flatnonzero(mark).tolist()
    return list(map(text.__getitem__, map(slice, cuts, cuts[1:])))


class ByteBpe:
    """A parsed vocabulary: ids by byte and by merge, and the special strings that are matched inside texts."""

    def __init__(self, file_bytes: bytes) -> None:
        spec = json.loads(file_bytes)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        if pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("unsupported options of the byte-level pre-tokenizer")
        letters, vocab = byte_letters(), model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.pieces: list[bytes] = [b""] * self.size
        for piece, i in vocab.items():
            self.pieces[i] = bytes(map(letters.__getitem__, piece))
        by_byte = {letters[c]: vocab[c] for c in letters}
        self.byte_ids: list[int] = [by_byte[b] for b in range(256)]
        self.special: dict[str, int] = {}
        for token in spec.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens that look at their surroundings are not supported")
            self.special[token["content"]] = token["id"]
            self.pieces[token["id"]] = token["content"].encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = ([vocab[m[k]] for m in merges] for k in (0, 1))
        self.merged: list[int] = [vocab[a + b] for a, b in merges]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        #: Rank of a pair, by left * size + right.
        self.ranks: dict[int, int] = {}
        for rank, key in enumerate((self.left * self.size + self.right).tolist()):
            self.ranks.setdefault(key, rank)
        self.classes = CharClasses()

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special strings, each with the id of the special string after it."""
        if not any(s in text for s in self.special):
            return [(text, None)]
        import re

        out, at = [], 0
        for m in re.finditer("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), text):
            out.append((text[at:m.start()], self.special[m[0]]))
            at = m.end()
        return [*out, (text[at:], None)]

    def words(self, text: str) -> list[str]:
        return split_words(text, self.classes)


def load(spark: SparkSession, path: str | None = None) -> Callable[[], dict]:
    """A function that gives workers one dictionary per vocabulary, with the parsed vocabulary under ``bpe``.

    The dictionary lives as long as the worker, so it may also hold its caches.
    """
    path = path or default_path()
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast({"file": f.read()})

    def get() -> dict:
        store = shared.value
        if "bpe" not in store:
            store["bpe"] = ByteBpe(store["file"])
        return store

    return get
