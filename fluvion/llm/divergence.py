"""Divergence of the sources of a language, with terms as fixed-width digests until their text is needed.

A task tallies its terms by (lang, source) in bounded tables; what is shuffled for counting is fixed in width: a
64-bit key of the source, a 64-bit digest of the term and two numbers. A term is kept where enough documents of its language hold it. The kept digests
alone then meet their strings: the least and the greatest string of a digest differ exactly if terms collide in it, and the
occurrences of such a digest are counted anew by the string itself (`split`). Text is joined back to what is returned.

Two sources are compared over all kept terms of their language without pairing sources per term: the terms are dealt
in buckets, each becomes a dense row over two blocks of sources, and a bucket leaves one sum per pair of
sources. Terms that neither block holds are added by their number. All arithmetic is in whole numbers.

Defined results: null text, lang and source count as ''; a row is a document, so repeated rows count each; extra
columns are ignored. A source without terms is compared like any other; a language without kept terms has
value 0 for its pairs and no term rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvion.llm.common import staged

MIN_DOCS, TOP = 10, 10
#: entries a task holds before it hands them on; sources of a block; kept terms of a bucket
HELD, BLOCK, BUCKET = 400_000, 64, 16_384

#: A-Z become a-z; what is no letter and no byte of a longer character becomes a blank
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def digests(found: list[bytes], bits: int = 64) -> np.ndarray:
    """Signed digests of terms; fewer bits than 64 serve to try collisions."""
    from xxhash import xxh64_intdigest

    return (np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)) & np.uint64((1 << bits) - 1)).view(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _keys(seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g")


def sources(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, l, g): every source of a language with two fixed-width keys, and the seed by which no two keys meet."""
    groups = staged(_source(docs).select("lang", "source").distinct(), "groups")
    for seed in range(100):
        keyed = groups.select("lang", "source", *_keys(seed))
        x = keyed.agg(*(F.count_distinct(F.struct(*c)).alias("_".join(c)) for c in (["lang"], ["l"], ["lang", "source"], ["g"]))).first()
        if x["lang"] == x["l"] and x["lang_source"] == x["g"]:
            return staged(keyed, "sources"), seed
    raise AssertionError("keys of 64 bits met a hundred times")


def tallies(docs: DataFrame, seed: int = 0, bits: int = 64, named: bool = False, most: int = HELD) -> DataFrame:
    """(g, digest, n, docs): occurrences and documents of each term, in parts; with ``named`` also ``term``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for g, (n, seen) in held.items():
                found, size = list(n), len(n)
                columns = [np.full(size, g), digests(found, bits), np.fromiter(n.values(), np.int64, size), np.fromiter(map(seen.__getitem__, found), np.int64, size)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *([pa.array(found, pa.binary()).cast(pa.string())] if named else [])], names)
            held.clear()

        for part in parts:
            for g, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                found = terms(text)
                n, seen = held.setdefault(g, (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                seen.update(set(found))
                size += len(n)
                if size > most:
                    yield from out()
                    size = 0
        yield from out()

    names = ["g", "digest", "n", "docs", *(["term"] if named else [])]
    return _source(docs).select(_keys(seed)[1], "text").mapInArrow(run, "g bigint, digest bigint, n bigint, docs bigint" + (", term string" if named else ""))


def strings(docs: DataFrame, seed: int = 0, bits: int = 64, most: int = HELD) -> DataFrame:
    """(l, digest, term): the terms of each language, each at least once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for key, words in held.items():
                found = list(words)
                columns = [pa.array(np.full(len(found), key)), pa.array(digests(found, bits)), pa.array(found, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["l", "digest", "term"])
            held.clear()

        for part in parts:
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                words = held.setdefault(key, set())
                size -= len(words)
                words.update(terms(text))
                size += len(words)
                if size > most:
                    yield from out()
                    size = 0
        yield from out()

    return _source(docs).select(_keys(seed)[0], "text").mapInArrow(run, "l bigint, digest bigint, term string")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, groups: DataFrame, seed: int, min_docs: int = MIN_DOCS, bits: int = 64, most: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Kept terms as (l, digest, split, term, total) and their counts as (l, g, digest, split, n).

    ``split`` is the term where its digest is shared with another term of the language, else empty.
    """
    langs = groups.select("g", "l")
    counts = staged(_summed(tallies(docs, seed, bits, most=most), "g", "digest"), "term-counts").join(langs, "g")
    often = staged(_summed(counts, "l", "digest").where(F.col("docs") >= min_docs).select("l", "digest", F.col("n").alias("total")), "often")
    named = strings(docs, seed, bits, most).join(often.select("l", "digest"), ["l", "digest"], "left_semi")
    named = staged(named.groupBy("l", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "named")
    alone = often.join(named.where("low = high"), ["l", "digest"]).select("l", "digest", F.lit("").alias("split"), F.col("low").alias("term"), "total")
    mine = counts.join(alone.select("l", "digest"), ["l", "digest"], "left_semi").select("l", "g", "digest", F.lit("").alias("split"), "n")
    shared = named.where("low <> high").select("l", "digest")
    if not shared.isEmpty():
        again = tallies(docs, seed, bits, True, most).join(langs, "g").join(shared, ["l", "digest"], "left_semi")
        again = staged(_summed(again, "l", "g", "digest", "term"), "split-counts")
        parted = _summed(again, "l", "digest", "term").where(F.col("docs") >= min_docs)
        alone = alone.union(parted.select("l", "digest", F.col("term").alias("split"), "term", F.col("n").alias("total")))
        mine = mine.union(again.join(parted.select("l", "digest", "term"), ["l", "digest", "term"], "left_semi").select("l", "g", "digest", F.col("term").alias("split"), "n"))
    return staged(alone, "kept-terms"), staged(mine, "kept-counts")


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), by long division so that no product leaves 64 bits."""
    bottom = f"greatest({total} + 2 * {size}, 1)"
    quotient, rest = "0L", f"({count} + 2)"
    for _ in range(3):
        rest = f"({rest} * 1000)"
        quotient, rest = f"({quotient} * 1000 + {rest} div {bottom})", f"({rest} % {bottom})"
    return F.expr(f"1 + {quotient}")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _bucket_sums(block: int):
    def run(table: pa.Table) -> pa.Table:
        """Sums of distances over the terms of one bucket, for each pair of sources of two blocks."""
        idx, p = table.column("idx").to_numpy(), table.column("p").to_numpy()
        head = table.column("head").to_numpy(zero_copy_only=False)
        order = np.argsort(idx[head])
        who, base = idx[head][order], p[head][order]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        keys = table.filter(pa.array(~head)).select(["digest", "split"])
        ids = keys.column("digest").to_numpy()
        split = keys.column("split").combine_chunks().dictionary_encode()
        code = split.indices.to_numpy() if isinstance(split, pa.DictionaryArray) else np.concatenate([c.indices.to_numpy() for c in split.chunks]) if split.num_chunks else np.empty(0, np.int64)
        ranked = np.lexsort((code, ids))
        new = np.ones(len(ids), bool)
        new[1:] = (np.diff(ids[ranked]) != 0) | (np.diff(code[ranked]) != 0)
        term = np.cumsum(new) - 1
        n_terms = int(new.sum())
        column, value = np.searchsorted(who, idx[~head][ranked]), p[~head][ranked]
        sums = np.zeros((len(who), len(who)), np.int64)
        for at in range(0, n_terms, 4096):
            a, b = np.searchsorted(term, (at, at + 4096))
            dense = np.tile(base, (min(4096, n_terms - at), 1))
            dense[term[a:b] - at, column[a:b]] = value[a:b]
            for k in range(len(who)):
                gap = dense - dense[:, k : k + 1]
                sums[k] += (gap * gap // (dense + dense[:, k : k + 1])).sum(axis=0)
        x, y = np.nonzero(who[:, None] < who[None, :])
        if low != high:
            apart = (who[x] // block == low) & (who[y] // block == high)
            x, y = x[apart], y[apart]
        n = len(x)
        return pa.table({"l": np.full(n, table.column("l")[0].as_py()), "a": who[x], "b": who[y], "part": sums[x, y], "seen": np.full(n, n_terms, np.int64)})

    return run


def pair_values(who: DataFrame, counts: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(l, source_a, source_b, value) for sources numbered a < b, from (l, source, idx, v, p0) and (l, idx, v, digest, split, p)."""
    blocks = who.groupBy("l").agg(F.expr(f"max(idx) div {block}").alias("last"))
    buckets = F.expr(f"v div {bucket}")
    met = lambda rows: rows.join(blocks, "l").withColumn("mine", F.expr(f"idx div {block}")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    shape = ["l", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "bucket", "head", "idx", "p", "digest", "split"]
    heads = met(who).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets)))
    heads = heads.select("*", F.lit(True).alias("head"), F.col("p0").alias("p"), F.lit(0).cast("long").alias("digest"), F.lit("").alias("split")).select(*shape)
    rows = met(counts).withColumn("bucket", F.pmod(F.xxhash64("digest"), buckets + 1)).withColumn("head", F.lit(False)).select(*shape)
    sums = heads.union(rows).groupBy("l", "low", "high", "bucket").applyInArrow(_bucket_sums(block), "l bigint, a bigint, b bigint, part bigint, seen bigint")
    sums = sums.groupBy("l", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    one, two = (who.select("l", F.col("idx").alias(k), F.col("source").alias(f"source_{k}"), F.col("p0").alias(f"p_{k}"), "v") for k in ("a", "b"))
    both = sums.join(one, ["l", "a"]).join(two.drop("v"), ["l", "b"])
    return both.select("l", "source_a", "source_b", (F.col("part") + (F.col("v") - F.col("seen")) * distance("p_a", "p_b")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64, most: int = HELD, **deal: int) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others, and the terms that set it apart."""
    groups, seed = sources(docs)
    kept, counts = vocabulary(docs, groups, seed, min_docs, bits, most)
    sizes = kept.groupBy("l").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    who = groups.join(totals, "g", "left").join(sizes, "l", "left").fillna(0, ["total", "v", "lang_total"])
    who = who.withColumns({"idx": (F.row_number().over(Window.partitionBy("l").orderBy("source")) - 1).cast("long"), "p0": share("0", "total", "v")})
    who = staged(who, "numbered-sources")
    placed = counts.join(who.drop("l"), "g").withColumn("p", share("n", "total", "v"))

    pairs = staged(pair_values(who, placed.select("l", "idx", "v", "digest", "split", "p"), **deal), "source-pairs")
    langs = groups.select("l", "lang").distinct()
    both = pairs.union(pairs.select("l", "source_b", "source_a", "value")).toDF("l", "source", "item", "value").join(langs, "l")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    near = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    own = placed.join(kept.select("l", "digest", "split", F.col("total").alias("in_lang")), ["l", "digest", "split"])
    own = own.withColumn("q", share("in_lang", "lang_total", "v")).where("p > q").withColumn("value", distance("p", "q"))
    # ranks by value keep all ties of the last place; only these get their text, which decides ties
    first = own.withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("place") <= top)
    told = first.select("lang", "source", "l", "digest", "split", "value").join(kept.select("l", "digest", "split", F.col("term").alias("item")), ["l", "digest", "split"])
    apart = told.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return near.union(apart)
