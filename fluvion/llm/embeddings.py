"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors of a label are one class first. Each tree splits recursively at the median of a random
projection; the middle of every split spills to both sides. Classes that share a leaf are compared by
cosine in double precision; the pairs of a leaf leave it as stars of its connected parts, and the stars of all trees
make components. Links are then counted, not made, by comparing each component whole, in blocks of BLOCK classes: a
dense group much larger than a leaf loses no link of its members. A tree is grown in two steps: its top is
fitted on a bounded sample (SAMPLE vectors, chosen by hash) and routes every vector to a group of about GROUP
classes, so that a label with a third of all rows is spread over many tasks; inside a group it goes on
to leaves of LEAF classes. Every vector is indexed. Trees repeat until nearby pairs are unlikely to have been parted
in all of them; the tests measure recall against brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without a label, link with nothing; so do vectors of different lengths. Rows that share a vec_id are one
node; copies are counted as links without being paired. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluvion.llm.common import staged
from fluvion.llm.graph import components
from fluvion.llm.simhash import _stars

TREES, LEAF, SPILL = 16, 192, 0.06
SAMPLE, GROUP = 20_000, 8_000
BLOCK = 2048
COSINE = 0.93


def _direction(seed: tuple[int, ...], width: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).standard_normal(width)


def _split(x: np.ndarray, seed: tuple[int, ...]) -> tuple[np.ndarray, float, float, np.ndarray]:
    """A random direction, the limits of the spilled middle, and the projections of the rows."""
    w = _direction(seed, x.shape[1])
    proj = x @ w
    low, high = np.quantile(proj, (0.5 - SPILL, 0.5 + SPILL))
    return w, float(low), float(high), proj


def grow(x: np.ndarray, seed: tuple[int, ...], leaf: int) -> Iterator[np.ndarray]:
    """The row numbers in each leaf of one tree over the rows of ``x``."""
    todo = [(np.arange(len(x)), 1)]
    while todo:
        rows, node = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        _, low, high, proj = _split(x[rows], (*seed, node))
        left, right = rows[proj <= high], rows[proj >= low]
        if len(left) == len(rows) or len(right) == len(rows):
            # equal projections cannot be split: blocks of the node, each with each, stay exact
            for a in range(0, len(rows), leaf):
                for b in range(a, len(rows), leaf):
                    yield np.unique(np.concatenate((rows[a : a + leaf], rows[b : b + leaf])))
            continue
        todo += [(left, 2 * node), (right, 2 * node + 1)]


def _top(x: np.ndarray, seed: tuple[int, ...], rows_for: float, share: float) -> dict:
    """Splits of the top of a tree, fitted on a sample in which each vector stands for ``1 / share`` ones."""
    nodes, todo = {}, [(np.arange(len(x)), 1)]
    while todo:
        rows, node = todo.pop()
        if len(rows) / share <= rows_for or len(rows) < 8:
            continue
        w, low, high, proj = _split(x[rows], (*seed, node))
        left, right = rows[proj <= high], rows[proj >= low]
        if len(left) == len(rows) or len(right) == len(rows):
            continue
        nodes[node] = (w, low, high)
        todo += [(left, 2 * node), (right, 2 * node + 1)]
    return nodes


def _route(top: dict, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(group, row numbers) of the rows of ``x`` under the top of a tree."""
    out, todo = [], [(np.arange(len(x)), 1)]
    while todo:
        rows, node = todo.pop()
        if not len(rows):
            continue
        if node not in top:
            out.append((node, rows))
            continue
        w, low, high = top[node]
        proj = x[rows] @ w
        todo += [(rows[proj <= high], 2 * node), (rows[proj >= low], 2 * node + 1)]
    return out


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(rows: DataFrame) -> DataFrame:
    """(label, embedding, cid, size): the distinct usable vectors with their smallest id and number of ids."""
    ok = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(embedding, x -> x <> 0)"
    usable = rows.where(F.expr(ok)).select("label", "embedding", "vec_id")
    return usable.distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("vec_id").alias("size")).where("cid is not null")


def pairs(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect the pairs found, of the same label and at least the given cosine.

    ``vectors`` has label, embedding (finite, not zero) and cid, and is read twice: write it first.
    """
    keyed = vectors.select("label", F.size("embedding").alias("width"), "cid", "embedding")
    counts = {(r["label"], r["width"]): r["n"] for r in keyed.groupBy("label", "width").agg(F.count("*").alias("n")).where(F.col("n") > group).collect()}
    tops: dict[tuple, list[dict]] = {}
    if counts:
        total = sum(counts.values())
        share = min(1.0, sample / total)
        chosen = keyed.join(vectors.sparkSession.createDataFrame([(*k,) for k in counts], keyed.select("label", "width").schema), ["label", "width"]).where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < int(share * 1_000_000))
        held: dict[tuple, list] = {}
        for r in chosen.collect():  # about SAMPLE rows
            held.setdefault((r["label"], r["width"]), []).append(r["embedding"])
        for k, v in held.items():
            x = np.array(v, np.float64)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            tops[k] = [_top(x, (t,), group, share) for t in range(trees)]

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            labels, widths = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()
            for label, width in set(zip(labels.tolist(), widths.tolist())):
                mine = part.filter(pa.array((labels == label) & (widths == width)))
                x = _unit(mine.column(3))
                for t in range(trees):
                    for node, rows in _route(tops.get((label, width), [{}] * trees)[t], x):
                        some = mine.take(pa.array(rows))
                        n = some.num_rows
                        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, node, np.int64)), some.column(2), some.column(3)], ["label", "width", "tree", "node", "cid", "embedding"])

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        x = _unit(table.column("embedding"))
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows in grow(x, (key[2].as_py(), 1 + key[3].as_py()), leaf):
            near = np.triu(x[rows] @ x[rows].T >= cosine, 1)
            i, j = np.nonzero(near)
            if len(i):
                a, b = _stars(cid[rows[i]], cid[rows[j]])
                out_a.append(a)
                out_b.append(b)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.empty((2, 0), np.int64)
        both = both[:, both[0] != both[1]]
        return pa.table({"a": both[0], "b": both[1]})

    kind = keyed.schema["label"].dataType.simpleString()
    groups = keyed.mapInArrow(dealt, f"label {kind}, width int, tree int, node bigint, cid bigint, embedding array<float>")
    return groups.groupBy("label", "width", "tree", "node").applyInArrow(compared, "a bigint, b bigint").distinct()


def links(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(cid, others): for each class of (root, cid, size, embedding), the ids of other classes of its root within the cosine.

    Each block of a component meets each other one; small components share tasks.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    tasks = members.count() // block + 1
    dealt = members.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "cid", "size", "embedding", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other"))).alias("task"))

    def counted(table: pa.Table) -> pa.Table:
        root, low, high, mine, cid = (table.column(c).to_numpy() for c in ("root", "low", "high", "mine", "cid"))
        size = table.column("size").to_numpy().astype(np.float64)
        others = np.zeros(len(cid))
        order = np.lexsort((high, low, root))
        new = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        # lists of a task may differ in length between components, not within one
        vectors = table.column("embedding").combine_chunks()
        for rows in np.split(order, new):
            x = _unit(vectors.take(pa.array(rows)))
            left, right = mine[rows] == low[rows[0]], mine[rows] == high[rows[0]]
            a, b = rows[left], rows[right]
            for at in range(0, len(a), 512):
                near = (x[left][at : at + 512] @ x[right].T >= cosine).astype(np.float64)
                if low[rows[0]] == high[rows[0]]:
                    near[np.arange(len(near)), at + np.arange(len(near))] = 0
                else:
                    others[b] += size[a[at : at + 512]] @ near
                others[a[at : at + 512]] += near @ size[b]
        return pa.table({"cid": cid, "others": others.astype(np.int64)})

    return met.groupBy("task").applyInArrow(counted, "cid bigint, others bigint").groupBy("cid").agg(F.sum("others").alias("others"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, **forest) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), "label")
    known = staged(classes(rows), "classes")
    found = staged(pairs(known, cosine, **forest), "pairs")
    roots = components(found)
    sizes = known.groupBy("cid").agg(F.sum("size").alias("size"))
    # a root is not among the nodes
    linked = roots.union(roots.select("root", "root").distinct())
    members = staged(known.join(linked, known["cid"] == linked["node"]).select("root", "cid", "size", "embedding"), "members")
    named = sizes.join(links(members, cosine), "cid", "left").join(roots, sizes["cid"] == roots["node"], "left")
    named = named.select("cid", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    member = known.select("label", "embedding", "cid").join(named, "cid").select("label", "embedding", "n_links", "component_id")
    out = rows.join(member, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
