"""Stages of the pipeline against plain-Python versions of them."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluvion.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def components(texts, limit=0.8):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if likeness(sets[a], sets[b]) >= limit:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def edited(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_texts():
    """Texts with copies between 0.6 and 1, chains, a dense group, short, empty and null texts."""
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    texts = []
    for _ in range(40):
        base = prose(r.randint(60, 300))
        texts += [base, *(edited(r, base, max(1, round(len(base.split()) * share))) for share in (0.005, 0.012, 0.02, 0.024, 0.03, 0.05))]
    chain = prose(200)
    for _ in range(12):
        texts.append(chain)
        chain = edited(r, chain, 3)
    hub = prose(150)
    texts += [edited(r, hub, 2) for _ in range(60)]
    return texts + ["one two", "One  TWO", "one two three", "", None, " ", prose(9000)]


def test_near_copies_are_those_of_brute_force(spark, near_texts):
    docs = table(spark, near_texts).repartition(3)
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    root = components(near_texts)
    pairs = [likeness(grams(a), grams(b)) for i, a in enumerate(near_texts[:280]) for b in near_texts[i - i % 7 : i]]
    assert sum(0.8 <= x < 0.95 for x in pairs) > 100 and sum(0.6 < x < 0.8 for x in pairs) > 50
    assert kept == sorted(set(root))


@pytest.mark.parametrize("block,grams", [(2048, 1 << 21), (7, 1 << 21), (16, 900)])
def test_near_copies_in_blocks(spark, near_texts, block, grams):
    """Slots that need many blocks and probes give the same components."""
    r = random.Random(11)
    base = " ".join(f"w{r.randrange(3000)}" for _ in range(120))
    # about 0.75 to 0.9 to each other: many parts that share slots
    texts = near_texts + [edited(r, base, n) for n in (1, 2, 3, 4) for _ in range(40)]
    docs = table(spark, texts + texts[:30]).repartition(3)
    found = nearcopies.near_copies(docs, block, grams).collect()
    assert len(found) == len(texts) + 30
    least = {}
    for x in found:
        least[x.root] = min(x.doc_id, least.get(x.root, x.doc_id))
    root = components(texts)
    assert {x.doc_id: least[x.root] for x in found} == dict(enumerate(root + root[:30]))


def test_texts_linked_by_simhash_share_a_slot(spark):
    """Fingerprints within four bits, also by way of others, are candidates without any min-hash band; texts without words are not."""
    prints = [0x5A5A5A5A5A5A5A5A, 0x5A5A5A5A5A5A5A5B, 0x5A5A5A5A5A5A5FAB, 0x1234567812345678, 0x1234567812345678, 0x0F0F0F0F0F0F0F0F, 0, 0]
    rows = [(i, 0 if fp == 0 else 9, fp, []) for i, fp in enumerate(prints)]
    found = nearcopies.with_simhash(spark.createDataFrame(rows, "node long, n long, fp long, slots array<long>")).collect()
    slots = {x.node: x.slots for x in found}
    assert len(found) == len(rows) and [len(slots[i]) for i in range(8)] == [1] * 6 + [0, 0]
    least = {i: min(j for j in range(6) if slots[j] == slots[i]) for i in range(6)}
    near = [[j for j in range(6) if (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(6)]
    root = list(range(6))
    for _ in range(6):
        root = [min(root[j] for j in near[i]) for i in range(6)]
    assert least == dict(enumerate(root)) and least[1] == 0 and least[4] == 3


def test_near_copies_of_no_rows(spark):
    assert nearcopies.near_copies(table(spark, [])).count() == 0
    assert [x.doc_id for x in nearcopies.near_copies(table(spark, ["a b"])).collect()] == [0]


def test_unknown_scripts_go_and_short_clean_texts_stay(spark):
    r = random.Random(5)
    prose = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    known = [prose(("ba", "du", "ki", "lor"), 150) for _ in range(60)] + ["ba du", "du", "kilor badu"]
    foreign = [" ".join("".join(chr(r.randint(a, b)) for _ in range(r.randint(2, 9))) for _ in range(120)) for a, b in ((0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x9000)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "aa" if i < len(known) else None, "s", len(t)) for i, t in enumerate(known + foreign)], SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept >= set(range(len(known)))
    assert len(kept) - len(known) <= 3


@pytest.mark.parametrize("score,kept", [(0.0, []), (0.03, [38, 39]), (0.9, [38, 39, 40, 41, 400])])
def test_the_noise_bound_holds_from_forty_letters_on(spark, monkeypatch, score, kept):
    """Below, any likeness keeps a text: its few n-grams cannot reach the bound."""
    monkeypatch.setattr(corpus_pipeline.language, "predict", lambda docs, model, keep: docs.select(*keep, F.lit("aa").alias("lang_pred"), F.lit(score).alias("score")))
    docs = spark.createDataFrame([(n, "1 " + "é" * n + "?", "aa", "s", n) for n in (38, 39, 40, 41, 400)], SCHEMA)
    assert sorted(x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()) == kept


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    r = random.Random(6)
    a, b, c = (" ".join(f"w{r.randrange(3000)}" for _ in range(120)) for _ in range(3))
    near = [edited(r, b, 1) for _ in range(4)]
    rows = [(1, a), (None, edited(r, a, 1)), (None, b), *((None, t) for t in near), (7, c), (7, " ".join(c.split()[::-1])), (8, edited(r, c, 1)), (7, c), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    kept = sorted(((x.doc_id or 0, x.text or "") for x in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert len(kept) == 5 and (1, a) in kept and (0, "") in kept
    assert {t for i, t in kept if i == 7} == {c, " ".join(c.split()[::-1])}
    assert sum(t in {b, *near} for _, t in kept) == 1


def test_a_dense_slot_holds_its_links_in_strips():
    """1,500 nodes, all near: two million links leave as one star, and are not held at once."""
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**62, 200))
    rows = [np.unique(np.concatenate((np.delete(base, r.choice(200, 3, False)), r.integers(0, 2**62, 3)))) for _ in range(1500)]
    n = len(rows)
    whole = {"slot": np.zeros(n, np.int64), "block": np.full(n, -1, np.int32), "salt": np.zeros(n, np.int32), "probe": np.zeros(n, bool), "part": np.arange(n) + 5, "node": np.arange(n) + 5}
    table = pa.table({k: pa.array(v) for k, v in whole.items()} | {"grams": pa.array(rows, pa.list_(pa.int64()))})
    tracemalloc.start()
    found = nearcopies._compared(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(found["b"].to_pylist(), found["a"].to_pylist())) == [(5, i + 5) for i in range(1, n)]
    # two matrices of 1,500 x 1,500 and the strips
    assert peak < 60e6
