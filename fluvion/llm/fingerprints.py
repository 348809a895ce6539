"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is read as units: pieces of up to PIECE letters or digits, begun anew at each word, single characters of scripts
without word spaces, single signs. Short texts and texts without spaces so have anchors too. A k-mer is ``k`` consecutive units; its inner substrings are the runs of ``s`` units in it, ordered by
hash. A k-mer is chosen (a closed syncmer) when its smallest inner substring is its first or its last.
The choice looks at nothing outside the k-mer, so an edit changes only the anchors it touches.

The fingerprint is the sorted list of the smallest anchor hashes: ``size`` of them, or one in SHARE if that is more, so that it
grows with the text. Its likeness to another estimates the Jaccard similarity of the two anchor sets, from 0 to 1, on as many
hashes as both are sure to hold.

Defined results: null text counts as empty; an empty text has an empty fingerprint, alike (1.0) only to
another empty one; a text without any anchor has the hash of the whole text as its only one. Equal
texts have equal fingerprints. Texts are never cut; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvion.llm.common import let, staged, text_or_empty

K, S, SIZE = 5, 2, 64
PIECE, SHARE = 4, 8

_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNITS = rf"[{_DENSE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_DENSE}]]{{1,{PIECE}}}|[^\s\p{{L}}\p{{M}}\p{{N}}]"


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Hash of each closed syncmer of the text at its position; null where the k-mer is not chosen."""
    inner = k - s

    def chosen(grams: Column) -> Column:
        def at(first: Column, i: Column) -> Column:
            edge = F.least(first, F.get(grams, i + inner))
            between = [F.get(grams, i + j) for j in range(1, inner)]
            middle = F.least(*between) if len(between) > 1 else between[0]
            covering = [first, *(F.get(grams, i + j) for j in range(s, inner, s)), F.get(grams, i + inner)]
            return F.when(edge <= middle, F.hash(*covering))

        return F.transform(F.slice(grams, F.lit(1), F.greatest(F.size(grams) - inner, F.lit(0))), at)

    def grams(units: Column) -> Column:
        n = F.greatest(F.size(units) - (s - 1), F.lit(0))
        return F.transform(F.slice(units, F.lit(1), n), lambda u, i: F.xxhash64(u, *(F.get(units, i + j) for j in range(1, s))))

    return let(let(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), grams), chosen)


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """The smallest distinct anchor hashes, ascending: ``size``, or one in SHARE of all if that is more."""
    found = F.sort_array(F.array_distinct(F.array_compact(anchors(text, k, s))))
    whole = F.when(text == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    kept = lambda a: F.slice(a, F.lit(1), F.greatest(F.lit(size), F.ceil(F.size(a) / SHARE).cast("int")))
    return let(found, lambda a: F.when(F.size(a) > 0, kept(a)).otherwise(whole))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of two sketches: the share both hold of the smallest of their union.

    A sketch of fewer than ``size`` hashes holds all of its text; so both know the smallest of the union as far as the shorter reaches.
    """
    reach = F.greatest(F.least(F.size(a), F.size(b)), F.lit(size))
    least = F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), reach)
    shared = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(least, shared))


def written(a: Column) -> Column:
    """A sketch as text: eight lower-case hex digits per anchor."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8)))), "")


def positions(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, anchor, position): every anchor of every text with the index of its first unit."""
    return docs.select("doc_id", F.posexplode(anchors(text_or_empty(), k, s)).alias("position", "anchor")).where("anchor is not null").select("doc_id", "anchor", "position")


def alignments(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional matching of two anchor tables: for each pair of documents, the anchors they share by offset.

    Join only tables whose anchors are selective (a stated query set against a corpus); equal anchors
    meet by hash join, and each pair and offset is counted map-side first.
    """
    r = right.select(F.col("doc_id").alias("other_id"), "anchor", F.col("position").alias("other_position"))
    return left.join(r, "anchor").groupBy("doc_id", "other_id", (F.col("position") - F.col("other_position")).alias("offset")).agg(F.count("*").alias("n_anchors"))


BINS, BLOCK_ROWS = 64, 256


def _blocks(docs: DataFrame) -> tuple[Column, Column]:
    """Expressions (bin, block): intervals of doc_id of about ``BLOCK_ROWS`` rows, in ascending order.

    ``BINS`` quantiles fetched to the driver make the bins, each cut evenly; null ids have block -1.
    """
    cuts = [i / BINS for i in range(BINS)]
    row = docs.agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("top"), F.percentile_approx("doc_id", cuts, 1000).alias("q"), F.min("doc_id").alias("low")).first()
    if not row["n"]:
        return F.lit(-1), F.lit(-1).cast("long")
    lows = sorted({row["low"], *row["q"]})
    per_bin = max(1.0, row["n"] / len(lows) / BLOCK_ROWS)
    tops = [*lows[1:], row["top"] + 1]
    widths = [max(1.0, (t - low) / per_bin) for low, t in zip(lows, tops)]
    id_ = F.col("doc_id")
    which = sum(((id_ >= F.lit(x)).cast("int") for x in lows[1:]), F.lit(0))
    inside = F.floor((id_.cast("double") - F.get(F.array(*map(F.lit, map(float, lows))), which)) / F.get(F.array(*map(F.lit, widths)), which))
    return F.when(id_.isNull(), -1).otherwise(which), F.when(id_.isNull(), F.lit(-1).cast("long")).otherwise(which.cast("long") * (1 << 40) + inside)


def with_followers(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows and a window in which ``lead`` gives the next row in descending doc_id; after the last comes the first.

    Rows are ordered inside blocks of doc_id (`_block`); the top rows of the next lower block join each block as
    guests (`_guest` = 1, to be dropped afterwards). Only one row per block goes through the tables that link blocks. Equal ids are ordered by
    text, null ids come last.
    """
    bin_, block = _blocks(docs)
    placed = docs.withColumn("_bin", bin_).withColumn("_block", block)
    table = staged(placed.groupBy("_bin", "_block").agg(F.max("doc_id").alias("_head")), "blocks")
    first = table.groupBy("_bin").agg(F.min("_block").alias("_first"))
    # one row per bin, at most BINS + 1
    every = Window.partitionBy(F.lit(0)).orderBy("_bin")
    after = first.select("_bin", F.coalesce(F.lead("_first").over(every), F.min("_first").over(every)).alias("_after"))
    chain = table.join(after, "_bin").select(F.col("_block"), F.col("_head"), F.coalesce(F.lead("_block").over(Window.partitionBy("_bin").orderBy("_block")), F.col("_after")).alias("_receiver"))
    chain = staged(chain, "chain")
    own = placed.select(F.col("_block"), F.lit(0).alias("_guest"), *docs.columns)
    on = (placed["_block"] == chain["_block"]) & placed["doc_id"].eqNullSafe(chain["_head"])
    guests = placed.join(chain, on).select(F.col("_receiver").alias("_block"), F.lit(1).alias("_guest"), *(placed[c] for c in docs.columns))
    return own.union(guests), Window.partitionBy("_block").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness.

    The edited form replaces the last half (floor of the length over two) by as many code points of the
    next document's beginning, in descending doc_id. Texts move once, with their sketches, to the block
    that orders them.
    """
    rows, order = with_followers(docs.select("doc_id", text_or_empty().alias("text")))
    rows = rows.withColumn("_sketch", sketch(F.col("text"), k, s, size))
    rows = rows.select("*", F.lead("text").over(order).alias("_next"), F.lead("_sketch").over(order).alias("_next_sketch")).where("_guest = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "_sketch", "_next_sketch", edited.alias("_edited"))
    both = rows.select("*", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), sketch(F.col("_edited"), k, s, size).alias("_edited_sketch"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("_sketch")).alias("fingerprint"),
        written(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch"), size).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch"), size).alias("near_next"),
    )
