"""Near copies by the Jaccard similarity of word shingles, 0.8 or more.

Candidates come from SimHash, by op3's fingerprints and multi-index hashing over this stage's shingles, and from bands of
min-hashes; every candidate is verified on the shingles of its whole text, so that no pair below the limit links. Texts
whose fingerprints are linked at 4 bits or fewer share a slot. At similarity 0.8 two texts differ in about 10 of 64 SimHash
bits (20 in the tail), a radius at which no index over 64 bits is selective; BANDS bands of ROWS min-hashes add those
and miss a pair at exactly 0.8 with a chance of (1 - 0.8 ** 5) ** 40, about one in eight million.

Texts with equal shingle sets are one node. Slots that hold the same nodes as another one are left out. The nodes of a
slot meet in one task with their shingles, where a matrix product counts what all pairs share, and the links found leave
it as stars: no pairs are written. A slot too large for a task is dealt in blocks: first every node is compared with the
slot's smallest, which joins a dense group at a cost in proportion to its members; then only nodes outside the
slot's largest part visit every block. No cap on partners applies.

Defined results: null text counts as empty; texts without words are one node; a text of fewer words than a
shingle is one shingle; repeated rows are one row key; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fluvion.llm import simhash
from fluvion.llm.common import staged, text_or_empty
from fluvion.llm.graph import components
from fluvion.llm.simhash import _stars

WIDTH = 5
#: the limit as a fraction, so that it is compared in whole numbers
OVER, UNDER = 4, 5
BANDS, ROWS = 40, 5
#: nodes and shingles of a block
BLOCK, GRAMS = 2048, 1 << 21

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 512
#: columns of a dense piece, and rows whose links are gathered at once
_COLUMNS, _STRIP = 1024, 128


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the word shingles of one text, ascending."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :]
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())), "<u8", len(last)))


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=80))
    signs, odd = rng.integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
    return signs, odd | np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """The slot of a shingle set in each band, as signed 64-bit integers; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    signs, odd = _orders()
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[at : at + _CHUNK, None] ^ signs) * odd).min(axis=0))
    keys = [xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.astype("<u8").reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def row_key() -> Column:
    """A hash of doc_id and text by which a row and its copies are known."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def _sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for part in parts:
        nodes, sizes, prints, slots = [], [], [], []
        for text in part.column(2):
            found = shingles(text.as_py())
            nodes.append(xxh64_intdigest(found.tobytes()))
            sizes.append(len(found))
            prints.append(simhash.fingerprint(text.as_py(), WIDTH))
            slots.append(bands(found))
        made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(slots, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["row", "doc_id", "node", "n", "fp", "slots"])


def _with_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        grams = pa.array([shingles(text.as_py()).view(np.int64) for text in part.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), grams], ["node", "grams"])


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists and where each list begins, with the end."""
    lists = lists.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), ends


def _shared(values: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each list of ``left`` shares with each of ``right`` (numbers of lists): left x right, whole numbers."""
    rows = np.unique(np.concatenate((left, right)))
    flat = np.concatenate([values[ends[i] : ends[i + 1]] for i in rows])
    who = np.repeat(np.arange(len(rows), dtype=np.int32), ends[rows + 1] - ends[rows])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    del flat, order
    column = np.cumsum(new, dtype=np.int32) - 1
    often = (np.bincount(column) > 1)[column]
    # columns that only one list has are of no account
    who, column = who[often], np.cumsum(new[often], dtype=np.int32) - 1
    n = int(column[-1]) + 1 if len(column) else 0
    a, b = np.searchsorted(rows, left), np.searchsorted(rows, right)
    # whole numbers below 2 ** 24 are exact
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, n, _COLUMNS):
        x, y = np.searchsorted(column, (at, at + _COLUMNS))
        dense = np.zeros((len(rows), min(_COLUMNS, n - at)), np.float32)
        dense[who[x:y], column[x:y] - at] = 1
        out += dense[a] @ dense[b].T
    return out


def _links(values: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the parts of near lists of ``left`` and ``right``, as stars; those of a dense slot are never held at once."""
    both = _shared(values, ends, left, right)
    sizes = np.diff(ends)
    none = np.empty(0, np.int64)
    out = [(none, none)]
    for at in range(0, len(left), _STRIP):
        mine = left[at : at + _STRIP]
        near = (UNDER + OVER) * both[at : at + _STRIP].astype(np.int64) >= OVER * (sizes[mine][:, None] + sizes[right][None, :])
        i, j = np.nonzero(near & (part[mine][:, None] != part[right][None, :]))
        if len(i):
            out.append(_stars(part[mine[i]], part[right[j]]))
    a, b = (np.concatenate(x) for x in zip(*out))
    return _stars(a, b) if len(out) > 2 else (a, b)


def _compared(table: pa.Table) -> pa.Table:
    """Links of the slots (block -1) and blocks of slots of one task; in a block the probes meet the others."""
    key = np.stack([table.column(c).to_numpy() for c in ("slot", "block", "salt")])
    part, probe = table.column("part").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
    values, ends = _flat(table.column("grams"))
    order = np.lexsort(key[::-1])
    new = np.flatnonzero((np.diff(key[:, order]) != 0).any(axis=0)) + 1
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for rows in np.split(order, new):
        asks = rows[probe[rows]]
        held = rows[~probe[rows]]
        left = held if key[1, rows[0]] < 0 else asks
        out.append(_links(values, ends, left, held, part) if len(left) and len(held) else out[0])
    a, b = (np.concatenate(x) for x in zip(*out))
    return pa.table({"a": a, "b": b})


def _near_first(table: pa.Table) -> pa.Table:
    """The nodes near the smallest of their slot, which stands first."""
    values, ends = _flat(table.column("grams"))
    node = table.column("node").to_numpy()
    head = int(np.flatnonzero(table.column("head").to_numpy(zero_copy_only=False))[0])
    first = np.sort(values[ends[head] : ends[head + 1]])
    at = np.minimum(np.searchsorted(first, values), len(first) - 1)
    both = np.add.reduceat(np.concatenate((first[at] == values, [False])), np.minimum(ends[:-1], len(values))).astype(np.int64)
    sizes = np.diff(ends)
    near = (UNDER * both >= OVER * (sizes + len(first) - both)) & (node != node[head])
    return pa.table({"a": np.full(int(near.sum()), node[head]), "b": node[near]})


def _blocks(count: str, total: str, block: int, grams: int) -> Column:
    return F.ceil(F.greatest(F.col(count) / block, F.col(total) / grams)).cast("int")


def links(nodes: DataFrame, grams_of: DataFrame, block: int = BLOCK, grams: int = GRAMS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of nodes at the limit, from one row (node, n, slots) per node, and (node, grams)."""
    dealt = nodes.select("node", "n", F.explode("slots").alias("slot"))
    sizes = dealt.groupBy("slot").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("node").alias("least"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("m > 1")
    # of slots with the same nodes one is enough
    sizes = sizes.groupBy("m", "total", "least", "x", "y").agg(F.min("slot").alias("slot"))
    shared = staged(dealt.join(sizes.select("slot", "m", "least", _blocks("m", "total", block, grams).alias("blocks")), "slot"), "shared-slots")
    held = staged(grams_of.join(shared.select("node").distinct(), "node", "left_semi"), "candidate-shingles")

    total = shared.agg(F.sum("n")).first()[0] or 0
    tasks = int(total // grams) + 1
    shape = ["task", "slot", "block", "salt", "probe", "part", "node"]
    zero = F.lit(-1).alias("block"), F.lit(0).alias("salt"), F.lit(False).alias("probe")
    small = shared.where("blocks = 1").select(F.pmod(F.xxhash64("slot"), F.lit(tasks)).alias("task"), "slot", *zero, F.col("node").alias("part"), "node")

    large = shared.where("blocks > 1")
    spread = large.withColumn("salt", F.pmod(F.xxhash64("node", "slot"), F.col("blocks")).cast("int"))
    # the smallest node of a slot stands before each share of its nodes
    shares = spread.select("least", "salt").distinct()
    seen = spread.where("node <> least").select("least", "salt", F.lit(False).alias("head"), "node").distinct().union(shares.select("least", "salt", F.lit(True).alias("head"), F.col("least").alias("node")))
    stars = staged(seen.join(held, "node").groupBy("least", "salt").applyInArrow(_near_first, "a bigint, b bigint"), "star-links")
    parts = components(stars).withColumnRenamed("root", "part")
    placed = staged(large.select("slot", "node", "blocks").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "placed")
    by_part = placed.groupBy("slot", "part").agg(F.count("*").alias("k"))
    chief = by_part.groupBy("slot").agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("m"))
    mixed = chief.where("top.k < m").select("slot", F.col("top.part").alias("chief"), F.ceil((F.col("m") - F.col("top.k")) / block).cast("int").alias("salts"))
    met = placed.join(mixed, "slot").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = met.where("part <> chief").select("slot", F.explode(every("blocks")).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("probe"), "part", "node")
    tabled = met.select("slot", F.col("mine").alias("block"), F.explode(every("salts")).alias("salt"), F.lit(False).alias("probe"), "part", "node")
    crossed = asked.union(tabled).withColumn("task", F.xxhash64("slot", "block", "salt"))
    rows = small.select(*shape).union(crossed.select(*shape)).join(held, "node")
    found = rows.groupBy("task").applyInArrow(_compared, "a bigint, b bigint")
    return stars.union(found)


def with_simhash(nodes: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """The nodes (node, n, fp, slots), those whose fingerprints are linked within ``distance`` bits with one more slot in common."""
    prints = nodes.where("n > 0").select("fp").distinct()
    roots = staged(components(simhash.links(prints, distance)).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    slot = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    slots = F.when(F.col("n") > 0, F.concat("slots", F.array(slot))).otherwise(F.col("slots"))
    return nodes.join(roots, "fp", "left").withColumn("slots", slots).drop("root")


def near_copies(docs: DataFrame, block: int = BLOCK, grams: int = GRAMS) -> DataFrame:
    """(row, doc_id, root): the component of every row of ``docs``; ``row`` is its `row_key`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row_key().alias("row"), "doc_id", text_or_empty().alias("text"))
    sketches = staged(rows.mapInArrow(_sketched, f"row bigint, doc_id {kind}, node bigint, n bigint, fp bigint, slots array<bigint>"), "sketches")
    # copies are one node from here on, put together map-side
    nodes = staged(sketches.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("slots").alias("slots")), "shapes")
    nodes = staged(with_simhash(nodes), "nodes")
    # shingles may be wanted of nodes in a slot with others
    slots = nodes.select("node", "row", F.explode("slots").alias("slot"))
    crowded = slots.groupBy("slot").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("slot")
    named = slots.join(crowded, "slot", "left_semi").select("node", "row").distinct()
    texts = rows.join(named, "row").select("node", "text").dropDuplicates(["node"])
    found = links(nodes, texts.mapInArrow(_with_grams, "node bigint, grams array<bigint>"), block, grams)
    roots = components(found).withColumnRenamed("node", "member")
    return sketches.join(roots, sketches["node"] == roots["member"], "left").select("row", "doc_id", F.coalesce("root", "node").alias("root"))
