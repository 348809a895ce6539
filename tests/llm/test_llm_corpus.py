"""Source divergence, decontamination and whitening against plain versions of them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluvion.llm import decontamination, divergence, whitening

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIGITS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def audit(docs, min_docs, top):
    lang_terms, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        found = words(text, LETTERS)
        groups.add((lang or "", source or ""))
        lang_terms[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    rows = []
    for lang, source in groups:
        kept = [t for t, n in lang_terms[lang].items() if n >= min_docs]
        v = len(kept)
        mine = {g: sum(counts[g][t] for t in kept) for g in groups if g[0] == lang}
        p = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        me = (lang, source)
        pairs = [(sum(f(p(counts[me][t], mine[me]), p(counts[o][t], mine[o])) for t in kept), o[1]) for o in mine if o != me]
        own = []
        for t in kept:
            a, b = p(counts[me][t], mine[me]), p(sum(counts[o][t] for o in mine), sum(mine.values()))
            if counts[me][t] and a > b:
                own.append((f(a, b), t))
        for part, found, most in (("pair", pairs, None), ("term", own, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            rows += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(rows)


@pytest.mark.parametrize("bits", [64, 5])
def test_divergence_is_that_of_brute_force(spark, bits):
    """With digests of five bits nearly every term collides and is counted by its string."""
    r = random.Random(1)
    pool = ["The", "the", "of", "OF", "été", "ÉTÉ", "naïve", "日本", "a b", "don't", "x", "y", "z1z", " ", "mot"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(r.choice(["en", "en", "fr", None]), r.choice(["s1", "s2", "s3", "s10", "é", None, "t", "hot", "hot", "hot"]), " ".join(r.choice(pool[: r.randint(2, 35)]) for _ in range(r.randint(0, 40)))) for _ in range(300)]
    docs += [("en", "s1", None), ("en", "empty", ""), ("de", "only", "ein wort"), ("de", "other", None), docs[0], docs[0], ("en", "long", "lang " * 20000 + "wa")]
    rows = spark.createDataFrame([(i, *d, "clash") for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, term string").repartition(3)
    got = sorted(tuple(x) for x in divergence.audit(rows, 10, 10, bits, most=50, block=3, bucket=7).collect())
    assert got == audit(docs, 10, 10)
    assert {x[1] for x in got if x[0] == "de"} == {"only", "other"}


def test_divergence_of_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_stay_whole_beyond_64_bits(spark):
    for n, total, size in [(0, 0, 1), (10**14, 3 * 10**15, 10**9), (9 * 10**14, 9 * 10**14, 1), (7, 120, 3)]:
        df = spark.createDataFrame([(n, total, size)], "n long, total long, size long")
        assert df.select(divergence.share("n", "total", "size")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * size)


def hits(docs, items, width):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text, DIGITS)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[i : i + width])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text, DIGITS), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    found |= wins[tuple(w[i : i + m])]
        out.append((str(doc_id), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    pool = ["The", "a", "of", "x1", "é", "2020", "Über", "日本"]
    prose = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(pool) for _ in range(n))
    items = [(i, prose(r.randint(4, 25))) for i in range(30)] + [(30, "a"), (31, ""), (None, prose(12)), (32, None), (3, prose(9)), (33, "never ever seen words of this kind at all in here"), (34, "é é é é é é é é é é é é")]
    docs = [(i, prose(r.randint(0, 60))) for i in range(120)]
    docs += [(200 + i, prose(20) + " " + items[i % 30][1].upper().replace("É", "é").replace("Ü", "ü") + "!" + prose(30)) for i in range(60)]
    docs += [(500, None), (501, "  "), (None, items[2][1]), (502, items[2][1]), (502, items[2][1]), (503, prose(3000) + items[5][1] + prose(900)), (504, "é " * 700)]
    return docs, items


@pytest.mark.parametrize("segment", [1 << 21, 64])
def test_contamination_is_that_of_brute_force(spark, corpus, segment):
    """Segments of 64 words cut long documents, with matches over the borders."""
    docs, items = corpus
    rows = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int").repartition(3)
    tests = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, terms string")
    for width in (10, 3):
        got = sorted((str(x.doc_id), x.n_words, x.n_hit, sorted(map(str, x["items"]))) for x in decontamination.contaminated(rows, tests, width, segment).collect())
        assert got == hits(docs, items, width)


def test_contamination_of_empty_tables(spark, corpus):
    docs, items = corpus
    rows = spark.createDataFrame(docs[:5], "doc_id long, text string")
    tests = spark.createDataFrame(items[:5], "item_id long, text string")
    got = decontamination.contaminated(rows, tests.limit(0)).collect()
    assert len(got) == 5 and all(x.n_hit == 0 and x["items"] == [] for x in got)
    assert decontamination.contaminated(rows.limit(0), tests).count() == 0


@pytest.mark.parametrize("segment", [1 << 21, 64])
def test_proximity_is_that_of_brute_force(spark, segment):
    r = random.Random(9)
    docs = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 150)))) for i in range(80)]
    queries = [(0, ["a", "b", "c"]), (1, ["p"]), (2, ["a", "a", "d"]), (3, ["a", "zz"]), (4, ["n", "o", "p", "m"]), (5, [])]
    within = 7
    index = decontamination.staged(decontamination.postings(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), within - 1, segment), "index")
    found = decontamination.search(index, spark.createDataFrame(queries, "item_id long, terms array<string>"), within)
    names = {x.doc: x.doc_id for x in index.where("n_words is not null").collect()}
    got = defaultdict(set)
    for x in found.collect():
        got[names[x.doc], x.item_id] |= set(range(x.begin, x.end))
    want = defaultdict(set)
    for doc, text in docs:
        w = text.split()
        for item, terms in queries:
            if not terms:
                continue
            holds = lambda a, b: set(terms) <= set(w[a:b])  # noqa: E731, B023
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + within) + 1):
                    if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1):
                        want[doc, item] |= set(range(a, b))
    assert got == want and len(want) > 60


def whitened(x, k):
    """Plain numpy, in extended precision where it is cheap."""
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(np.float64) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    return ((n * x - s) ** 2).sum(1), centred @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening_is_that_of_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)  # several blocks
    rng = np.random.default_rng(7)
    c = (rng.standard_normal((700, 12)) * np.linspace(0.2, 3, 12)).astype(np.float32)
    odd = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0, 2.0])]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(c)] + [(0, c[0].tolist(), "x"), (None, c[1].tolist(), "x")] + [(*o, "x") for o in odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, idx string").repartition(5)
    got = whitening.whitened(table, 5).collect()
    x = np.floor(64 * np.concatenate((c, c[:2])).astype(np.float64)).astype(np.int64) + 1_000_000
    deviation, w, explained = whitened(x, 5)
    assert len(got) == 702 * 5 and {g.n for g in got} == {702}
    mine = np.full((702, 5), np.nan)
    for g in got:
        row = 701 if g.vec_id is None else g.vec_id
        mine[row, g.component - 1] = g.whitened
        assert g.deviation == deviation[row]
        assert abs(g.explained - explained[g.component - 1]) < 1e-9
        assert 0 <= g.identity_error < 1e-9
    mine[700] = mine[0]
    signs = np.sign((mine * w).sum(0))
    assert np.abs(mine * signs - w).max() < 1e-8


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], schema)).collect()
    assert len(flat) == 18
    for x in flat:
        assert (x.whitened is None) == (x.component == 2) and abs(x.explained - (x.component == 1)) < 1e-12 and x.identity_error < 1e-9
