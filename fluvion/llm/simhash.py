"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed in Arrow batches; equal ones are one node from then on. Two 64-bit
fingerprints that differ in at most four bits differ in at most one bit of some of three segments. Each
fingerprint therefore enters three tables under its segment values and probes each with the ball of
radius one (set bits cleared: of two values one bit apart, one has the bit set). What meets in a table
slot is verified on all 64 bits.

Slots are worked through in sorted batches with bounded memory. Verified pairs exist only inside a
chunk of a batch and leave it as stars of its connected parts, so a dense group costs links in
proportion to its members, never all its pairs. Slots with very many members are dealt out as
blocks of tabled members times blocks of probes, which loses no pair. No cap on partners applies.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like
any other; rows with a null doc_id get the component of their fingerprint; repeated rows are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluvion.llm.common import staged, text_or_empty
from fluvion.llm.graph import components

SHINGLE, DISTANCE = 4, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_BLOCK = 4096
_PAIRS = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :]
    total, ones = len(last), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        cut = slice(at, at + (1 << 16))
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[cut].tolist(), last[cut].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = [fingerprint(t.as_py(), width) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(batches, f"doc_id {kind}, fp bigint")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected parts of a list of links, as one link from each member to its part's smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _verified(slot: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within slots; rows are sorted by slot, tabled members (probe 0) before probes."""
    begins = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(slot)])))
    tabled = np.add.reduceat(probe == 0, begins).astype(np.int64)
    first, count = np.repeat(begins, sizes), np.repeat(tabled, sizes)
    # a tabled member meets those tabled before it, a probe meets all that are tabled
    count = np.where(probe == 0, np.arange(len(slot)) - first, count)
    rows = np.flatnonzero(count)
    total = np.concatenate(([0], np.cumsum(count[rows])))
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, "right")) - 1)
        n = count[rows[lo:hi]]
        left = np.repeat(rows[lo:hi], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[left]
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= distance
        a, b = fp[left[near]], fp[right[near]]
        keep = a != b
        if keep.any():
            yield _stars(a[keep], b[keep])
        lo = hi


def _match(distance: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for part in parts:
            cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, block, salt, probe, fp = cols
            new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            # a slot that goes on in the next batch keeps its tabled members; probes are done with
            done = slice(0, len(key))
            slot = np.zeros(len(key), np.int64)
            slot[new] = 1
            seen = np.cumsum(slot)
            for a, b in _verified(seen[done], fp, probe, distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            tail = np.arange(cut, len(key))
            tail = tail[probe[cut:] == 0]
            held = [c[tail] for c in cols] if len(tail) else None

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = _BLOCK) -> DataFrame:
    """(a, b): links that connect every two distinct fingerprints within ``distance`` (at most 5) bits.

    ``nodes`` has one long column ``fp``. Each link joins fingerprints of one connected part; together
    they have exactly the components of all pairs within the distance.
    """
    value = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    tables = F.array(
        *(
            x
            for j, (at, width) in enumerate(SEGMENTS)
            for x in (
                F.struct((F.lit(j << 22) + value(at, width)).alias("key"), F.lit(0).alias("probe")),
                *(F.when(value(at, width).bitwiseAND(F.lit(1 << i)) != 0, F.struct((F.lit(j << 22) + value(at, width) - F.lit(1 << i)).alias("key"), F.lit(1).alias("probe"))) for i in range(width)),
            )
        )
    )
    rows = nodes.select("fp", F.explode(F.array_compact(tables)).alias("x")).select("fp", "x.key", "x.probe")
    sizes = rows.groupBy("key").agg(F.sum(1 - F.col("probe")).alias("n_tabled"), F.sum("probe").alias("n_probes"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    hot = staged(sizes.where(f"n_tabled > 0 and (n_tabled > {block} or n_probes > {16 * block})").select("key", parts("n_tabled").alias("blocks"), F.ceil((F.col("n_tabled") + F.col("n_probes")) / (16 * block)).cast("int").alias("salts")), "hot-slots")
    dealt = rows.join(hot, "key", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "salts": F.coalesce("salts", F.lit(1))})
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    salt = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("salts")).cast("int")
    # in its own block a tabled member is a partner for each salt; in the blocks after it, it is a probe
    as_table = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(mine.alias("block"), s.alias("salt"), F.lit(0).alias("probe")))
    as_probe = lambda blocks: F.transform(blocks, lambda b: F.struct(b.alias("block"), salt.alias("salt"), F.lit(1).alias("probe")))
    single = (F.col("blocks") == 1) & (F.col("salts") == 1)
    plain = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("salt"), F.col("probe")))
    spread = F.when(single, plain).when(F.col("probe") == 1, as_probe(every)).otherwise(F.concat(as_table, as_probe(F.filter(every, lambda b: b > mine))))
    flat = dealt.select("key", "fp", F.explode(spread).alias("y")).select("key", "y.block", "y.salt", "y.probe", "fp")
    sorted_ = flat.repartition("key", "block", "salt").sortWithinPartitions("key", "block", "salt", "probe")
    return sorted_.mapInArrow(_match(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, for every row of ``docs``."""
    prints = staged(fingerprints(docs, width), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), distance))
    # the root is a fingerprint; the component's id is the smallest document of all its fingerprints
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    member = staged(member, "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(member.join(named, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")
