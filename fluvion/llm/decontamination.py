"""Benchmark decontamination on a distributed positional inverted index.

The documents of a task are written as segments of a bounded number of words: for each term of a segment its
positions, and for each document where it begins. Positions of a segment run over its documents, with one free place
between two of them. A document longer than a segment goes on in the next one, which repeats its last words,
so that no match is lost at a border.

A query is a list of terms with offsets. The index tells how often each test term occurs; the terms of a query are
ordered from the rarest, and a query visits only the segments that hold its two rarest terms. There its matches
are the positions of the rarest term, less its offset, that survive the lists of the other terms one after the
other (phrase), or the shortest spans that hold all its terms (proximity). Postings and queries of a segment
meet in one task; nothing is broadcast by demand and no pairs of documents and queries are made.

Defined results: null text has no words and null items no windows; rows of ``docs`` are documents, so repeated rows
and ids count each; an item without an id marks words but is not listed; extra columns are ignored; empty
tables give no matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvion.llm.common import staged, text_or_empty

WIDTH = 10
#: words of a segment
SEGMENT = 1 << 20

#: A-Z become a-z; what is no digit, letter or byte of a longer character becomes a blank
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def word_array(text: Column) -> Column:
    """The same words as a column."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(_PATTERN), F.lit(0))


class _Segment:
    """Documents of one segment, while it is filled."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.begins: list[tuple[int, object, int, int, int | None]] = []  # document, its id, place, first word, its words
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.size = 0

    def add(self, doc: int, doc_id: object, found: list[bytes], skip: int, n_words: int | None) -> None:
        self.begins.append((doc, doc_id, self.size, skip, n_words))
        self.codes.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.size += len(found) + 1

    def batches(self, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        def batch(n: int, **given: pa.Array) -> pa.RecordBatch:
            kinds = {"segment": pa.int64(), "term": pa.string(), "steps": pa.list_(pa.int32()), "doc": pa.int64(), "doc_id": id_type, "place": pa.int32(), "skip": pa.int64(), "n_words": pa.int64()}
            given["segment"] = pa.array(np.full(n, number, np.int64))
            return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(n, t)) for k, t in kinds.items()], list(kinds))

        doc, doc_id, place, skip, n_words = zip(*self.begins)
        yield batch(len(doc), doc=pa.array(doc, pa.int64()), doc_id=pa.array(doc_id, id_type), place=pa.array(place, pa.int32()), skip=pa.array(skip, pa.int64()), n_words=pa.array(n_words, pa.int64()))
        if not self.terms:
            return
        codes = np.concatenate(self.codes)
        at = np.concatenate([np.arange(p, p + len(c), dtype=np.int32) for p, c in zip(place, self.codes)])
        at = at[np.argsort(codes, kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(self.terms))))).astype(np.int32)
        # steps are small numbers, which pack better than places
        steps = np.diff(at, prepend=np.int32(0))
        steps[ends[:-1]] = at[ends[:-1]]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(steps))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        for a in range(0, len(terms), 1 << 16):
            some = terms.slice(a, 1 << 16)
            yield batch(len(some), term=some, steps=lists.slice(a, 1 << 16))


def postings(docs: DataFrame, overlap: int = WIDTH - 1, segment: int = SEGMENT) -> DataFrame:
    """The index: rows of terms (segment, term, steps) and of documents (segment, doc, doc_id, place, skip, n_words).

    ``steps`` are the first position of the term and the distances from each to the next. ``doc`` is a key of the row; a document has one row with ``n_words`` and one more for each segment it goes on
    in, where ``skip`` of its words stand before the segment. Keys belong to the partitions of ``docs``: write the index before use.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = doc = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        now, id_type = _Segment(), None
        for part in parts:
            id_type = part.schema.field(0).type
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                found = words(text)
                skip = 0
                while True:
                    piece = found[skip : skip + segment] if len(found) > segment else found
                    now.add(doc, doc_id, piece, skip, len(found) if skip == 0 else None)
                    if now.size >= segment:
                        yield from now.batches(number, id_type)
                        number, now = number + 1, _Segment()
                    if skip + segment >= len(found):
                        break
                    skip += segment - overlap
                doc += 1
        if now.begins:
            yield from now.batches(number, id_type)

    if segment <= overlap:
        raise ValueError("a segment must be longer than what it repeats")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"segment bigint, term string, steps array<int>, doc bigint, doc_id {kind}, place int, skip bigint, n_words bigint"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, terms): every ``width`` consecutive words of an item; an item of fewer words, but not none, is one window."""
    found = items.select("item_id", word_array(text_or_empty()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return found.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("terms")).distinct()


def _phrase(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Places where the terms stand at their offsets; the first list is the rarest."""
    found = lists[0] - offsets[0]
    for other, offset in zip(lists[1:], offsets[1:]):
        at = np.searchsorted(other, found + offset)
        found = found[other[np.minimum(at, len(other) - 1)] == found + offset]
        if not len(found):
            break
    return found


def _cover(lists: list[np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the shortest spans of at most ``within`` words that hold every term."""
    rare = lists[0]
    last = np.unique(np.concatenate(lists))
    at = np.searchsorted(rare, last, "right") - 1
    last = last[(at >= 0) & (last - rare[np.maximum(at, 0)] < within)]
    first = last.copy()
    for other in lists:
        at = np.searchsorted(other, last, "right") - 1
        first = np.minimum(first, np.where(at >= 0, other[np.maximum(at, 0)], last - within))
    ok = last - first < within
    first, last = first[ok], last[ok]
    # of spans that begin together the first is the shortest
    new = np.concatenate(([True], first[1:] != first[:-1])) if len(first) else np.empty(0, bool)
    return first[new], last[new]


def _merged(who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Row numbers that open a run of overlapping or touching spans; rows are sorted by (who, begin)."""
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + who * wide)
    new = np.ones(len(who), bool)
    new[1:] = begin[1:] + who[1:] * wide > reach[:-1]
    return np.flatnonzero(new)


def _searched(within: int | None):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.schema.field("item_id").type
        none = pa.table({"doc": pa.array([], pa.int64()), "item_id": pa.array([], names), "begin": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        docs = left.filter(left.column("term").is_null())
        listed = left.filter(left.column("term").is_valid())
        place = docs.column("place").to_numpy()
        order = np.argsort(place)
        place, doc, skip = place[order], docs.column("doc").to_numpy()[order], docs.column("skip").to_numpy()[order]
        lists = listed.column("steps").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        flat = lists.flatten().to_numpy().astype(np.int64)
        before = np.concatenate(([0], np.cumsum(flat)))[ends[:-1]]
        flat = np.cumsum(flat) - np.repeat(before, np.diff(ends))
        rows = {t: i for i, t in enumerate(listed.column("term").to_pylist())}
        out: list[tuple[np.ndarray, np.ndarray, int]] = []
        for number, plan in enumerate(right.column("plan").to_pylist()):
            at = [rows.get(x["term"]) for x in plan]
            if None in at:
                continue
            found = [flat[ends[i] : ends[i + 1]] for i in at]
            if within is None:
                first = _phrase(found, [x["offset"] for x in plan])
                last = first + (len(plan) - 1)
            else:
                first, last = _cover(found, within)
                same = np.searchsorted(place, first, "right") == np.searchsorted(place, last, "right")
                first, last = first[same], last[same]
            if len(first):
                out.append((first, last, number))
        if not out:
            return none
        first, last = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in (0, 1))
        query = np.concatenate([np.full(len(x[0]), x[2]) for x in out])
        items = right.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        item = items.indices.to_numpy()[query]
        order = np.lexsort((first, item))
        first, last, item = first[order], last[order], item[order]
        # documents lie apart, so runs of an item never join two of them
        opens = _merged(item.astype(np.int64), first, last + 1)
        end = np.maximum.reduceat(last + 1, opens)
        first, item = first[opens], item[opens]
        mine = np.searchsorted(place, first, "right") - 1
        shift = skip[mine] - place[mine]
        return pa.table({"doc": doc[mine], "item_id": items.dictionary.take(pa.array(item)), "begin": first + shift, "end": end + shift})

    return run


def search(index: DataFrame, queries: DataFrame, within: int | None = None) -> DataFrame:
    """(doc, item_id, begin, end): words of documents that lie in matches of the queries, as merged spans.

    ``queries`` has item_id and terms. Without ``within`` the terms must follow one another (phrase); with it,
    every term must lie in a span of at most so many words (proximity). Spans are merged within a segment, so those
    of a document in several segments may overlap. Matches may be as long as what the index repeats, and one word more.
    """
    kept = staged(queries.where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()), "queries")
    each = kept.select("query", F.posexplode("terms").alias("offset", "term"))
    if within is not None:
        each = each.groupBy("query", "term").agg(F.min("offset").alias("offset"))
    tested = index.where("term is not null").join(each.select("term").distinct(), "term", "left_semi").select("segment", "term", "steps")
    tested = staged(tested, "test-postings")
    often = tested.groupBy("term").agg(F.sum(F.size("steps")).alias("n"))
    # a query with a term that never occurs has no match
    plans = each.join(often, "term", "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("plan"))
    plans = staged(kept.select("query", "item_id").join(plans.where("plan[0].n > 0"), "query"), "plans")
    held = tested.select("segment", "term")
    rarest = plans.select("item_id", F.transform("plan", lambda x: F.struct(x["term"].alias("term"), x["offset"].alias("offset"))).alias("plan"))
    visits = rarest.withColumn("term", F.col("plan")[0]["term"]).join(held, "term").drop("term")
    visits = visits.withColumn("term", F.coalesce(F.get("plan", F.lit(1))["term"], F.col("plan")[0]["term"])).join(held, ["segment", "term"], "left_semi").drop("term")
    shape = ["segment", "term", "steps", "doc", "place", "skip"]
    begins = index.where("term is null").select(*shape)
    left = begins.unionByName(tested, allowMissingColumns=True).select(*shape)
    kind = queries.schema["item_id"].dataType.simpleString()
    return left.groupBy("segment").cogroup(visits.groupBy("segment")).applyInArrow(_searched(within), f"doc bigint, item_id {kind}, begin bigint, end bigint")


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_words, n_hit, items): for each document its words, those inside a window of an item, and the items' ids."""
    index = staged(postings(docs, width - 1, segment), "postings")
    spans = staged(search(index, windows(items, width)), "spans")
    before = F.max("end").over(Window.partitionBy("doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.select("doc", "item_id", F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("begin", F.coalesce(before, "begin"))).alias("new"))
    hits = new.groupBy("doc").agg(F.sum("new").alias("n_hit"), F.collect_set("item_id").alias("items"))
    rows = index.where("n_words is not null").select("doc", "doc_id", "n_words")
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.join(hits, "doc", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))
