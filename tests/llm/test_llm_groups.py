"""Vectors in groups of near copies much larger than a leaf of the forest."""

import numpy as np

from fluvion.llm import embeddings


def test_large_groups_lose_no_link(spark):
    """4,000 vectors at cosine about 0.95 to each other, some repeated, beside a small group and noise."""
    rng = np.random.default_rng(2)
    group = rng.standard_normal(64) + rng.standard_normal((4000, 64)) * 0.23
    small = rng.standard_normal(64) + rng.standard_normal((30, 64)) * 0.2
    x = np.concatenate((group, small, rng.standard_normal((1500, 64)), group[:20])).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    print("recall", sum(got.values()) / near.sum(), near.sum())
    assert [got[i] for i in range(len(x))] == near.sum(1).tolist()
