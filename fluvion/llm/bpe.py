"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding: among the
vocabulary entries that end there (found by one pass of an automaton over all suffix matches), the one
that is compatible with the last token of the prefix before it. Two tokens are compatible when merging
their joint text by rank gives the two back. The unique last token of each prefix is stored; following
these pointers from the end gives the ids, the same as applying all merges by rank.

Pieces are the units of the byte-level pre-tokenizer. Encodings of pieces are remembered per worker up to a fixed
number of entries, which bounds memory and changes no result.

Defined results: null text counts as empty (no ids, empty decoded text). The string of an added token
is that token. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluvion.llm.common import text_or_empty

REMEMBERED = 500_000
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file, by its published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Remembered(dict):
    """A dictionary that makes what it lacks and starts anew when it is full."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = made = self.make(key)
        return made


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        raw = lambda t: self.id_of[bytes(letters[c] for c in t)]
        self.rank = {(raw(a), raw(b)): (r, self.id_of[bytes(letters[c] for c in a + b)]) for r, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        # a token counts only if merging its own bytes gives it back
        self.automaton = ahocorasick.Automaton()
        for i, t in self.bytes_of.items():
            if i not in self.added.values() and self._merged(t) == [i]:
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.compatible = _Remembered(self._compatible)
        self.piece = _Remembered(self._encode)
        self.word = _Remembered(lambda w: self._pieces(" " + w))
        self.first = _Remembered(self._pieces)
        self.split = regex.compile(_PIECES)
        self.space = regex.compile(r"\s")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _merged(self, text: bytes) -> list[int]:
        """Ids of a short byte string by repeated merging of the pair of lowest rank."""
        ids = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return self._merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]

    def _encode(self, piece: str) -> bytes:
        """Little-endian ids of one piece: the last token of every prefix, then the way back."""
        text = piece.encode("utf-8")
        n = len(text)
        whole = self.id_of.get(text)
        if n == 1:
            return whole.to_bytes(4, "little")
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(text.decode("latin-1")):
            ends[end].append(token)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        compatible = self.compatible
        for end in range(n):
            for size, token in ends[end]:
                start = end + 1 - size
                if start == 0 or (last[start] >= 0 and compatible[last[start], token]):
                    last[end + 1], length[end + 1] = token, size
                    break
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= length[at]
        return np.array(ids[::-1], "<u4").tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.split.findall(text)))

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        Where single spaces and line ends stand between signs, pieces end before each space and around
        each line end, so words can be looked up whole; any other spacing goes through the pattern.
        """
        out: list[bytes] = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words or (not line.isascii() or not line.isprintable()) and any(w.split() != [w] for w in words):
                return self._pieces(text)
            if i:
                out.append(self.piece["\n"])
            out.append(self.first[words[0]])
            out.extend(map(self.word.__getitem__, words[1:]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._ordinary(text) if text else b""
        parts = (self.added[p].to_bytes(4, "little") if p in self.added else self._ordinary(p) for p in self.cut.split(text) if p)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers in a binary column."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.encode(t.as_py()) for t in part.column(1)], pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the texts of a table of encoded documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(b.as_py()) for b in part.column(1)], pa.string())], ["doc_id", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them, in one pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts:
            n, a, b = [], [], []
            for t in part.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                b.append(sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
