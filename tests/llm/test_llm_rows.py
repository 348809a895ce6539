"""Conversations, shards, vectors, components and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fluvion.llm import chat, embeddings, graph, sharding
from fluvion.llm.queries import CONTROL

SF = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    odd = [CONTROL, "<|im_end|>\n", "<\\|im_end|>", "<\\\\|x|>", "<", "ends <|im_end|", "<|im_start|>user\nhi<|im_end|>\n", "", None, "a\\nb", "é🙂\n\n", "<|im_start|", "x" * 50000]
    roles = ["user", "assistant", None, "as\nsist", "b\\n", "<|im_end|>", "", "assistant"]
    r = random.Random(3)
    rows = [(c, t, r.choice(roles), r.choice(odd), "extra") for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "x", ""), (100, 1, "assistant", "b", ""), (100, 1, "assistant", "a", ""), (100, 1, "assistant", "a", ""), (100, None, "user", "first", "")]
    got = {x.conv_id: x for x in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).withColumn("loss", chat.under_mask(F.col("formatted"), chat.loss_spans(F.col("turns")))).collect()}
    for c in {x[0] for x in rows}:
        want = sorted(((-1 if t is None else t), role or "", text or "") for k, t, role, text, _ in rows if k == c)
        assert got[c].identical
        assert [(t.role, t.text) for t in got[c].turns] == [(b, d) for _, b, d in want]
        assert got[c].loss == "".join(d for _, b, d in want if b == "assistant")
        # no text holds a control string: every mark in the output belongs to the template
        assert got[c].formatted.count(chat.START) == got[c].formatted.count(chat.STOP) == len(want)
    assert [t.text for t in got[100].turns] == ["first", "a", "a", "b"]
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_has_the_probe(spark):
    x = entry.queries()["op7_chat"](spark, SF).where("conv_id = -1").first()
    assert (x.n_turns, x.loss_chars, x.loss_sha256) == (2, len(CONTROL), hashlib.sha256(CONTROL.encode()).hexdigest())
    assert x.turns_sha256 == hashlib.sha256(f"user\n{CONTROL}\nassistant\n{CONTROL}\n".encode()).hexdigest()


def test_shares_are_even_and_few_slots_move(spark):
    names = tuple(f"s{i}" for i in range(10))
    full = sharding.filled(names, 1009)
    assert max(map(full.count, range(10))) - min(map(full.count, range(10))) <= 1
    less = sharding.filled(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.filled(names, 1000)
    # the same by trying every permutation in full
    offset, step = ([sharding._number(s, k) for s in names] for k in ("offset", "step"))
    orders = [[(o % 1009 + j * (s % 1008 + 1)) % 1009 for j in range(1009)] for o, s in zip(offset, step)]
    owner: dict[int, int] = {}
    while len(owner) < 1009:
        for i, order in enumerate(orders):
            if len(owner) < 1009:
                owner[next(x for x in order if x not in owner)] = i
    assert [owner[i] for i in range(1009)] == full
    rows = spark.createDataFrame([(i, "clash") for i in [*range(500), 7, None, None]], "doc_id long, shard_name string")
    got = sharding.placed(rows, ["doc_id"], names, 1009).collect()
    assert len(got) == 503 and all(names[full[x.slot]] == x.shard for x in got)
    assert len({x.shard for x in got if x.doc_id is None}) == 1
    assert sharding.placed(rows.where("false"), ["doc_id"]).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)] + [(None, 3), (4, 4)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in root} == {k: find(k) for k in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("forest", [{}, {"group": 150, "sample": 400, "leaf": 40}])
def test_vectors(spark, forest):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    x = np.concatenate([base, *(base + rng.standard_normal(base.shape) * s for s in (0.05, 0.15, 0.25, 0.3))]).astype(np.float32)
    x = np.concatenate((x, x[:5], rng.standard_normal((400, 32)).astype(np.float32)))
    rows = [(i, v.tolist(), i % 40 % 2) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] * 32, 0), (n + 3, [None] + [1.0] * 31, 0), (n + 4, x[0].tolist(), None), (n + 5, [], 1), (n + 6, [float("inf")] * 32, 1), (n + 7, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **forest).collect()}
    assert len(got) == len(rows)
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = (u @ u.T >= 0.93) & (np.arange(n)[:, None] % 40 % 2 == np.arange(n)[None, :] % 40 % 2)
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(n))
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(n))
    assert found == near.sum() or forest
    for i in range(n, len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark):
    """Every stage keeps whole what it should and its decisions take effect, checked on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1, None, "en", "a", 0), (-2, "123 !!", "en", "a", 6), (-3, "", None, None, 0), (-4, "mail me at jo@example.org now", "en", "b", 29)], docs.schema)
    docs = docs.union(more).cache()
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "personal_data", "pack"]
    told = corpus_pipeline.language_id(spark, docs, SF).cache()
    assert told.columns == docs.columns and {r.doc_id for r in docs.subtract(told).collect()} == {-1, -2, -3}
    lined = corpus_pipeline.line_dedup(spark, told, SF).cache()
    assert lined.columns == docs.columns and lined.count() == told.count()
    assert lined.where("length(text) <> n_chars").count() == 0
    near = corpus_pipeline.near_dedup(spark, lined, SF).cache()
    assert near.subtract(lined).count() == 0 and near.count() == near.select("doc_id").distinct().count()
    again = corpus_pipeline.near_dedup(spark, near, SF)
    assert again.count() == near.count()
    clean = corpus_pipeline.personal_data(spark, near, SF).cache()
    assert clean.count() == near.count() and clean.where("text rlike 'example.(org|com)'").count() == 0
    packed = corpus_pipeline.pack(spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
