"""Order-preserving packing of token streams into fixed windows by dynamic programming.

The documents of a partition form one stream in their order. Cuts fall at document or sentence
boundaries (and, inside sentences longer than a stretch, at stretches of tokens); the cuts chosen
minimise padding plus a penalty for each document cut in two. With prefix positions p, the best cost up
to boundary i is penalty(i) + WINDOW - p(i) + min over j in reach of (cost(j) + p(j)); the minimum is kept
in a monotone queue. What remains at the end of a partition fills one padded window or, if that costs
less, sequences of a power of two, which need no padding.

The stream is worked off in blocks of windows; the undecided end of a block opens the next one. Input
partitions are independent, so nothing is shuffled, and the memory of a task is bounded by a block plus its
longest document.

Defined results: null text counts as empty, so a document has at least its end token. Repeated rows are
packed each. Every id lies in exactly one piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluvion.llm.bpe import _byte_letters
from fluvion.llm.common import text_or_empty

WINDOW, END = 4096, 2
STRETCH = 512
#: penalties in tokens: a cut after a sentence, a cut inside one, one more sequence at the end
SENTENCE_CUT, INNER_CUT, TAIL_CUT = 8, 64, 64
BLOCK = 64 * WINDOW
#: words, and pieces of words, a worker remembers twice
REMEMBERED = 200_000


class _Kept(dict):
    """A dictionary that makes what it lacks; when it is full it goes on with what was asked for since it was last full."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = made
        return made


class Tokens:
    """Ids of texts by the tokenizers library, asked once per piece of a word where pieces are independent.

    The vocabulary drops white space and never merges across it or across the pieces its own pattern cuts words
    into, so a text of plain letters can be looked up word by word, and a new word piece by piece; any text with
    other characters or added tokens goes to the library whole.
    """

    #: control signs, other scripts and combining marks
    other = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fİɐ-\U0010ffff]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.word = _Kept(self._whole)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"]):
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
            letters = {b: c for c, b in _byte_letters().items()}
            model = self.library.model
            # a byte-level piece goes to the model as the letters that stand for its bytes
            self.piece = _Kept(lambda x: array("I", [t.id for t in model.tokenize(x if x.isascii() else "".join(map(letters.__getitem__, x.encode())))]).tobytes())
            self.word.make = lambda x: self.piece[x] if x.isalpha() else b"".join(map(self.piece.__getitem__, self.pieces(x)))
        ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        ends[[i for t, i in self.library.get_vocab().items() if re.fullmatch(r"[.!?…]+(</w>)?", t)]] = True
        self.sentence_end = ends

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text) or self.other.search(text) or any(t in text for t in self.added):
            return np.frombuffer(self._whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.word.__getitem__, text.lower().split())), "<u4")


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cuts(positions: list[int], penalties: list[int], final: bool, window: int = WINDOW) -> list[int]:
    """The chosen boundaries of a stream that begins at 0, in order, the last one included.

    ``positions`` are ascending boundaries, no two neighbours further apart than ``window``. If the
    stream goes on (``final`` false), the last cut is the best among the boundaries of the last window.
    """
    n = len(positions)
    at = [0, *positions]
    cost, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque(((0, 0),))
    for i in range(1, n + 1):
        p = at[i]
        while at[queue[0][1]] < p - window:
            queue.popleft()
        low, j = queue[0]
        cost[i] = penalties[i - 1] + window - p + low
        back[i] = j
        key = cost[i] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    i = n
    if not final:
        reach = at[n] - window
        k = n
        while k > 0 and at[k] > reach:
            if cost[k] < cost[i]:
                i = k
            k -= 1
    out = []
    while i:
        out.append(at[i])
        i = back[i]
    return out[::-1]


def _tail(length: int, window: int) -> list[int]:
    """Lengths of the last sequences: one that is padded, or powers of two if that costs less."""
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    best, cost = [length], 0 if length & (length - 1) == 0 else window - length
    for k in range(1, len(powers)):
        rest = sum(powers[k:])
        padded = 0 if rest & (rest - 1) == 0 else window - rest
        if k * TAIL_CUT + padded < cost:
            best, cost = [*powers[:k], rest], k * TAIL_CUT + padded
    return best


class _Stream:
    """Documents of one partition that are not packed yet, and the rows of those that are."""

    def __init__(self, sentence_end: np.ndarray, window: int):
        self.sentence_end, self.window = sentence_end, window
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, ids, first id not packed
        self.pending, self.sequence = 0, 0
        self.rows: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        self.docs.append((doc, ids, 0))
        self.pending += len(ids)

    def boundaries(self) -> tuple[list[int], list[int]]:
        places, costs, base = [], [], 0
        for _, ids, start in self.docs:
            rest = ids[start:]
            n = len(rest)
            inner = np.flatnonzero(self.sentence_end[np.minimum(rest[:-1], len(self.sentence_end) - 1)]) + 1
            edges = np.concatenate(([0], inner, [n]))
            gaps = np.diff(edges)
            if gaps.max() > STRETCH:
                long = np.concatenate([np.arange(a + STRETCH, b, STRETCH) for a, b in zip(edges[:-1], edges[1:]) if b - a > STRETCH])
            else:
                long = np.empty(0, np.int64)
            places_here = np.concatenate((inner, long, [n]))
            costs_here = np.concatenate((np.full(len(inner), SENTENCE_CUT), np.full(len(long), INNER_CUT), [0]))
            order = np.argsort(places_here, kind="stable")
            places.append(places_here[order] + base)
            costs.append(costs_here[order])
            base += n
        return np.concatenate(places).astype(np.int64).tolist(), np.concatenate(costs).astype(np.int64).tolist()

    def emit(self, lengths: list[int]) -> None:
        """Take sequences of these lengths off the front."""
        k = 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc, ids, start = self.docs[k]
                n = min(length - offset, len(ids) - start)
                piece = ids[start : start + n]
                self.rows.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset))
                offset += n
                if start + n == len(ids):
                    k += 1
                else:
                    self.docs[k] = (doc, ids, start + n)
            self.sequence += 1
            self.pending -= length
        del self.docs[:k]

    def pack(self, final: bool) -> None:
        if not self.pending:
            return
        ends = cuts(*self.boundaries(), final, self.window)
        lengths = np.diff([0, *ends]).tolist()
        if final:
            lengths[-1:] = _tail(lengths[-1], self.window)
        self.emit(lengths)


def packed(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece of a document; see the module text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        stream = _Stream(t.sentence_end, window)
        last = np.array([end], "<u4")

        def out() -> pa.RecordBatch:
            cols = list(zip(*stream.rows)) or [()] * 7
            stream.rows = []
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array([base + s for s in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = None
        for part in parts:
            id_type = part.schema.field(0).type
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                stream.add(doc, np.concatenate((t.ids(text.as_py()), last)))
                if stream.pending >= BLOCK:
                    stream.pack(final=False)
                    if len(stream.rows) > 4096:
                        yield out()
        stream.pack(final=True)
        if stream.rows:
            yield out()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
