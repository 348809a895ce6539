"""Text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluvion.llm import bpe, fingerprints, language, lines, packing, pii, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, slot int, line string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "er", "on", "an", "re", "ing", "é", "ß")) for _ in range(r.randint(1, 4))) for _ in range(n))


BASE = words(1, 60)
TEXTS = [
    None, "", " ", "\n\n", "a", "Über  straße\tx\r\ny ", BASE, BASE, BASE.replace("th", "TH", 2), BASE + " tail", words(2, 400), words(3, 9) + "\n" + words(4, 9),
    "<|endoftext|> mid <|endoftext|><|endoftext|>", "don't I'll we've 3.14 x²  $$$ 漢字かな é    🙂 İΣ", "aaaa" * 500, "1 2 3 " * 3000, words(5, 6000), "\x1c\x1d a\x00b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None, "clash", 1, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_edited_texts_and_likeness(spark, docs, none):
    unique = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(unique).collect()}
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    for i, t in texts.items():
        after = texts[i - 1 if i else len(TEXTS) - 1]
        h = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == sha(t[: len(t) - h] + after[:h])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[7].near_next == 1.0
    assert got[0].fingerprint == "" == got[1].fingerprint and got[1].near_next == 1.0
    assert got[10].near_edited > 0.2 and got[10].near_next < 0.1
    assert fingerprints.edited_fingerprints(none).count() == 0
    # repeated rows and null ids have a next row too
    assert fingerprints.edited_fingerprints(docs).count() == docs.count()


def test_closed_syncmers(spark):
    units = [w[i : i + 4] for w in BASE.split() for i in range(0, len(w), 4)]
    found = spark.createDataFrame([(BASE,)], "text string").select(fingerprints.anchors(F.col("text")).alias("a")).first()["a"]
    grams = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(units, units[1:]))], "i int, a string, b string").select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()
    h = [r.h for r in grams]
    for i in range(len(units) - 4):
        inner = h[i : i + 4]
        assert (found[i] is not None) == (min(inner) in (inner[0], inner[-1]))


def test_short_and_unbroken_texts_have_anchors(spark):
    """Likeness against the Jaccard similarity of whole anchor sets, on short, unbroken and long texts."""
    r = random.Random(9)
    run = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    long = words(30, 9000)
    a = run(100_000)
    short = "the cat sat on the mat, said who"
    edits = " ".join(w if i % 60 else f"new{i}" for i, w in enumerate(long.split()))
    pairs = [(a, a[:50_000] + run(50_000)), (short, short[:24] + "somewhere"), (long, edits), (long, words(31, 9000)), (short, short), (long, long[:400])]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    sets = df.select("i", *(F.array_distinct(F.array_compact(fingerprints.anchors(F.col(c)))).alias(c) for c in "xy")).collect()
    exact = {row.i: len(set(row.x) & set(row.y)) / len(set(row.x) | set(row.y)) for row in sets}
    made = df.select("i", *(fingerprints.sketch(F.col(c)).alias(c) for c in "xy"))
    got = {row.i: (row.n, len(row.x)) for row in made.select("*", fingerprints.likeness(F.col("x"), F.col("y")).alias("n")).collect()}
    for i, want in exact.items():
        assert abs(got[i][0] - want) < 0.08, (i, got[i], want)
    assert got[0][0] > 0.25 and got[1][0] > 0.15 and 0.7 < got[2][0] < 1 and got[3][0] < 0.1 and got[4][0] == 1
    assert got[0][1] > 1000 and got[2][1] > 500 and got[1][1] < 64


def test_alignments_find_a_shared_passage(spark):
    """Anchors of a passage meet at one offset, wherever it stands."""
    passage = words(40, 60)
    docs = spark.createDataFrame([(1, words(41, 300) + " " + passage + " " + words(42, 200)), (2, words(43, 50)), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(10, words(44, 30) + " " + passage)], "doc_id long, text string")
    met = fingerprints.alignments(fingerprints.positions(asked), fingerprints.positions(docs)).orderBy(F.desc("n_anchors")).collect()
    units = lambda t: sum(-(-len(w) // 4) for w in t.split())
    assert (met[0].doc_id, met[0].other_id, met[0].offset) == (10, 1, units(words(44, 30)) - units(words(41, 300)))
    assert met[0].n_anchors > 0.3 * units(passage) and all(x.n_anchors < 4 for x in met[1:])


def test_next_over_many_blocks(spark):
    ids = random.Random(3).sample(range(-(10**6), 10**9), 3000) + [2**62, -(2**62)]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    placed, order = fingerprints.with_followers(rows)
    got = {r.doc_id: r.n for r in placed.select("*", F.lead("text").over(order).alias("n")).where("_guest = 0").collect()}
    ids.sort(reverse=True)
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_simhash_components(spark, docs, none):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    got = simhash.near_duplicates(docs).collect()
    want = {i: fp(t) for i, t in enumerate(TEXTS)}
    root = dict.fromkeys(want)
    for i in want:
        root[i] = i
    for _ in want:
        for a in want:
            for b in want:
                if bin(want[a] ^ want[b]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % 2**64, r.component_id) == (want[r.doc_id], root[r.doc_id])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
def test_hamming_links_lose_nothing(spark, block):
    """Dense groups, chains and random values; small blocks make every slot of a group a hot one."""
    r = random.Random(7)
    centre = [r.getrandbits(64) for _ in range(4)]
    values = {c ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for c in centre for _ in range(120)} | {r.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    values = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long").repartition(3), block=block).collect()
    assert len(links) < 80 * len(values)
    mine = {v: v for v in values}
    for a, b in links:
        assert find(a) == find(b)
        x, y = a, b
        while mine[x] != x:
            x = mine[x]
        while mine[y] != y:
            y = mine[y]
        mine[max(x, y)] = min(x, y)
    for v in values:
        x = v
        while mine[x] != x:
            x = mine[x]
        assert x == find(v)


def test_bpe_is_the_library(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = bpe.round_trip(docs, path).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = t.encode((TEXTS[r.doc_id] or "") if r.doc_id is not None else "no id", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))
    assert bpe.decoded(bpe.encoded(docs.where("doc_id = 13"), path), path).first()["text"] == TEXTS[13]
    assert bpe.round_trip(none, path).count() == 0


def test_bpe_on_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c, r = Tokenizer.from_file(path), bpe.Codec(path), random.Random(5)
    for _ in range(600):
        s = "".join(r.choice("ab the\n\t 'sé漢1.!<|endoftext|> \x1fx") for _ in range(r.randint(0, 60)))
        assert np.frombuffer(c.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_word_tokens_on_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, c, r = Tokenizer.from_file(path), packing.Tokens(path), random.Random(6)
    for _ in range(600):
        s = "".join(r.choice("ab THE\n\t 'sÉß漢1.!́İΣ \x1fx\x85") for _ in range(r.randint(0, 60)))
        assert c.ids(s).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_packing_is_whole(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = docs.dropDuplicates(["doc_id"]).coalesce(2)
    got = packing.packed(rows, path).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by.items():
        ids = np.array(t.encode((TEXTS[doc] or "") if doc is not None else "no id", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert len(by) == len(TEXTS) + 1
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert packing.packed(none, path).count() == 0


def test_cuts_cost_no_more_than_any_other():
    r = random.Random(2)
    for _ in range(40):
        places = sorted(r.sample(range(1, 60), 9)) + [60]
        places = sorted({*places, 12, 24, 36, 48})
        costs = [r.randint(0, 5) for _ in places]
        price = dict(zip(places, costs))
        cost = lambda ends: sum(price[b] + 16 - (b - a) for a, b in zip([0, *ends], ends))

        def ways(at):
            if at == 60:
                yield []
            for b in places:
                if at < b <= at + 16:
                    for rest in ways(b):
                        yield [b, *rest]

        assert cost(packing.cuts(places, costs, True, 16)) == min(map(cost, ways(0)))


def test_language(spark, docs, none):
    r = random.Random(1)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    tongue = {"aa": ("ba", "du", "ki"), "bb": ("lor", "mes", "ti"), "cc": ("ñu", "ño", "szt")}
    train = spark.createDataFrame([(k, make(v, 200)) for k, v in tongue.items() for _ in range(3)] + [(None, "x"), ("dd", None)], "lang string, text string")
    model = language.prototypes(train)
    assert list(model) == ["aa", "bb", "cc"]
    told = language.predict(spark.createDataFrame([(k, make(v, 12)) for k, v in tongue.items() for _ in range(20)], "k string, text string"), model, ["k"]).collect()
    assert sum(x.k == x.lang_pred for x in told) >= 58 and all(0 <= x.score <= 1 for x in told)
    odd = {x.doc_id: x for x in language.predict(docs, model, ["doc_id"]).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3, 15)] == ["und"] * 5 and odd[0].score == 0.0
    assert language.prototypes(none) == {} and {x.lang_pred for x in language.predict(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_language_is_that_of_plain_vectors(spark):
    """Bind, bundle and cosine written out, over a training table; held-out labels are never read."""
    r = random.Random(12)
    prose = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    tongues = {"aa": ("ba", "dé", "ki"), "bb": ("lor", "mes", "ba"), "cc": ("ñu", "lor", "szt")}
    train = [(k, prose(v, r.randint(1, 40))) for k, v in tongues.items() for _ in range(8)] + [("aa", "12"), ("bb", None)]
    texts = [prose(v, n) for v in tongues.values() for n in (1, 2, 30)] + ["Ba, DÉ!  ki", "", None, "7", "x"]

    def vector(text):
        total = np.zeros(language.DIM)
        line = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        line = re.sub(" +", " ", line)
        for i in range(len(line) - 2):
            bound = np.ones(language.DIM)
            for place in range(3):
                bound = bound * np.roll(language._letter(ord(line[i + place])), 2 - place)
            total += bound
        return total if any(c.isalpha() for c in text or "") else np.zeros(language.DIM)

    bundles = {k: sum(vector(t) for lang, t in train if lang == k) for k in tongues}
    model = language.prototypes(spark.createDataFrame(train, "lang string, text string").repartition(3))
    for k, v in bundles.items():
        assert np.allclose(model[k], v / np.linalg.norm(v), atol=1e-6)
    got = {x.i: x for x in language.predict(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model, ["i"]).collect()}
    for i, t in enumerate(texts):
        v = vector(t)
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = {k: v @ b / np.linalg.norm(v) / np.linalg.norm(b) for k, b in bundles.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i].lang_pred == best and abs(got[i].score - max(0.0, cosine[best])) < 1e-5


def test_held_out_labels_are_not_learned(spark, tmp_path):
    """The query's answers stay the same whatever the labels of held-out documents say."""
    r = random.Random(13)
    prose = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(12))
    rows = [(i, prose((("ba", "du"), ("lor", "mes"))[i % 2]), ("aa", "bb")[i % 2], "s", 1) for i in range(60)]
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)]
    told = []
    for name, wrong in (("a", None), ("b", "zz")):
        changed = [(i, t, wrong if wrong and out[i] else lang, s, n) for i, t, lang, s, n in rows]
        spark.createDataFrame(changed, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        told.append(sorted(map(tuple, queries.QUERIES["op5_language"](spark, str(tmp_path / name)).collect())))
    assert told[0] == told[1] and [x[1] for x in told[0]] == out and {x[2] for x in told[0]} == {"aa", "bb"}


def test_lines(spark, none):
    rows = [(i, f"top {i}\n  Shared line \n\nlow {i}" + ("\nnear" if i < 3 else ""), f"site{i % 9}") for i in range(12)]
    rows += [(20, None, "x"), (21, "", None), (22, "Shared line\nShared line", None), rows[5]]
    got = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    assert got[5].text == "top 5\n\nlow 5" and (got[5].n_lines, got[5].n_removed) == (4, 1)
    assert got[22].text == "" and got[20].text == "" and got[21].n_lines == 1
    assert lines.deduplicated(none).count() == 0


def test_line_limit_is_exact(spark):
    rows = [(s * 100 + i, f"l{i}", f"site{s}") for i in range(4, 40) for s in range(i)]
    keyed = lines._keyed(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source")
    hashes = {spark.range(1).select(F.xxhash64(F.lit(f"l{i}"))).first()[0]: i for i in range(4, 40)}
    for least in (8, 20):
        assert sorted(hashes[r.h1] for r in lines.boilerplate(keyed, least).collect()) == list(range(least, 40))


PERSONAL = [
    "mail a.b@x.org, c@d.e.f. g@h @i.j k@l.m_n@o.p", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 9" * 2, "4111 1111 1111 1111 4111-1111-1111-1112 " + "7" * 40,
    "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +49...", "é🙂 x@y.zz 漢 +44 20 7946 0958", "a" * 30000 + "@b.c", "1 " * 20000, "9" * 30000, "x@" * 5000 + "y.z" * 2000,
    "call tel 555-010-1234 or phone (555) 010 9999; order 123-456-7890", "write to jo [at] site [dot] org",
]


def test_personal_data(spark, docs, none):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = lambda: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    r = random.Random(4)
    texts = PERSONAL + ["".join(r.choice(["1", "4111111111111111", "2", ".", "+", "@", "a", " ", "-", "(", ")", "b.c", "\n", "é"]) for _ in range(40)) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    model = pii.fit(rows)
    assert model.weights and set(model.reliability) == {(k, lab) for k in pii.KINDS for lab in pii.LABELERS}
    got = pii.spans(rows, model, ["doc_id", "text"]).select("text", pii.listed("base").alias("b"), pii.listed("all").alias("a")).collect()
    for x in got:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, x.text or "") if len(x.text) < 40000 and good(k, m.group())] if len(x.text or "") < 25000 else None
        if want is not None:
            assert x.b == ",".join(want), x.text
        assert set(filter(None, x.b.split(","))) <= set(x.a.split(","))
    assert pii.fit(none) == pii.Model() and pii.spans(none, pii.Model(), ["doc_id"]).count() == 0
    hidden = pii.masked(rows.where(F.col("text").startswith("é🙂")), model).first()["text"]
    assert hidden.startswith("é🙂 [EMAIL] 漢 [PHONE]")
