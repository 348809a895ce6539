"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A letter n-gram is bound by multiplying its letters'
vectors, each rotated by its place; a text, and the training text of a language, is the bundle (sum)
of its n-grams' vectors. A text gets the language whose prototype has the largest cosine to it.

Training is linear: n-grams are counted per language over all training texts, combined map-side, and
the prototypes are bundled from those counts in Spark. Only the prototypes (languages times DIM
numbers) reach the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0. With nothing to learn
from, every text is ``und``. Ties go to the first language in order of name. Whole texts are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIM, N = 2048, 3
#: cosines of unrelated vectors of signs spread by 1 / sqrt(DIM) around 0; a score under three of that is noise
NOISE = 3 / DIM**0.5
_BATCH_CHARS = 1 << 20
#: n-grams whose vectors are held at once
_GRAMS = 1024
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    points = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.int64)
    table[points] = points
    return table


def grams(text: str) -> np.ndarray:
    """Letter n-grams of a text as integers: lower case, all else read as single spaces."""
    codes = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))].astype(np.int64)
    if len(codes) < N:
        return np.empty(0, np.int64)
    out = codes[: len(codes) - N + 1].copy()
    for i in range(1, N):
        out = (out << 21) | codes[i : len(codes) - N + 1 + i]
    return out


@lru_cache(maxsize=1 << 14)
def _letter(point: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=point))
    return (rng.integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.float32)


def gram_vectors(found: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram, one per row."""
    out = np.ones((len(found), DIM), np.float32)
    for place in range(N):
        letters, at = np.unique((found >> (21 * (N - 1 - place))) & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(_letter(int(c)), N - 1 - place) for c in letters])[at]
    return out


def _let_go() -> None:
    """A worker that has packed before still holds a tokenizer and its words; they make room."""
    packing = sys.modules.get("fluvion.llm.packing")
    if packing is not None:
        packing.tokens.cache_clear()


def _merged(found: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of several lists with the sums of their counts."""
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(n), len(keys)).astype(np.int64)


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts per language of a partition; the texts' n-grams are held for a bounded number of characters."""
    _let_go()
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held: dict[str, list[np.ndarray]] = {}

    def settle() -> None:
        for lang, lists in held.items():
            found, n = np.unique(np.concatenate(lists), return_counts=True)
            old = known.get(lang)
            known[lang] = _merged([old[0], found], [old[1], n]) if old else (found, n.astype(np.int64))
        held.clear()

    chars = 0
    for part in parts:
        for lang, text in zip(part.column(0), part.column(1)):
            found = grams(text.as_py())
            held.setdefault(lang.as_py(), []).append(found)
            chars += len(found)
            if chars >= _BATCH_CHARS:
                settle()
                chars = 0
    settle()
    for lang, (found, n) in known.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])


def _bundle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for part in parts:
        langs = np.array(part.column(0).to_pylist(), object)
        found, n = part.column(1).to_numpy(), part.column(2).to_numpy()
        for at in range(0, len(found), _GRAMS):
            vectors = gram_vectors(found[at : at + _GRAMS]).astype(np.float64)
            for lang in set(langs[at : at + _GRAMS]):
                mine = langs[at : at + _GRAMS] == lang
                sums[lang] = sums.get(lang, 0) + np.where(mine, n[at : at + _GRAMS], 0) @ vectors
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], ["lang", "at", "x"])


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of each language from a table of (lang, text); rows with a null in either are not used."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(_bundle, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["lang"], np.zeros(DIM))[r["at"]] = r["x"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def _predict(langs: list[str], profile: np.ndarray):
    def batch(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not langs:
            return names, scores
        lists = [grams(t) if t else np.empty(0, np.int64) for t in texts]
        rows = [i for i, g in enumerate(lists) if len(g)]
        if not rows:
            return names, scores
        each = [np.unique(lists[i], return_counts=True) for i in rows]
        found, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), [len(g) for g, _ in each])
        bundle = np.zeros((len(rows), DIM), np.float32)
        n = np.concatenate([c for _, c in each])
        order = np.argsort(at)
        row, at, n = row[order], at[order], n[order]
        for lo in range(0, len(found), _GRAMS):
            a, b = np.searchsorted(at, (lo, lo + _GRAMS))
            counts = np.zeros((len(rows), min(_GRAMS, len(found) - lo)), np.float32)
            counts[row[a:b], at[a:b] - lo] = n[a:b]
            bundle += counts @ gram_vectors(found[lo : lo + _GRAMS])
        wide = bundle.astype(np.float64)
        cosines = (wide @ profile) / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-300)
        best = cosines.argmax(axis=1)
        for i, k, b in zip(rows, range(len(rows)), best):
            names[i], scores[i] = langs[b], float(min(1.0, max(0.0, cosines[k, b])))
        return names, scores

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        for part in parts:
            lo = 0
            texts = part.column(part.num_columns - 1)
            while lo < part.num_rows:
                hi, chars, some = lo, 0, []
                while hi < part.num_rows and len(some) < 512 and (not some or chars < _BATCH_CHARS):
                    some.append(texts[hi].as_py())
                    chars += len(some[-1] or "")
                    hi += 1
                names, scores = batch(some)
                kept = [part.column(i).slice(lo, hi - lo) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(scores, pa.float64())], [*part.schema.names[:-1], "lang_pred", "score"])
                lo = hi

    return run


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of each row with ``lang_pred`` and ``score`` (cosine to its prototype, 0 to 1)."""
    langs = list(model)
    profile = np.stack([model[k] for k in langs], axis=1) if langs else np.empty((DIM, 0))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(langs, profile), f"{kinds}, lang_pred string, score double")
