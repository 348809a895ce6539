"""Very long texts and conversations: work in proportion to their length, and the same results as on short ones."""

import random
import re
import time

from pyspark.sql import functions as F

from fluvion.llm import chat, pii
from fluvion.llm.common import before, chunks, cut


def test_sums_and_maxima_before_each(spark):
    r = random.Random(2)
    rows = [(i, [r.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 10, 99, 100, 101, 1000])]
    df = spark.createDataFrame(rows, "id int, x array<int>")
    for x in df.select("x", before(F.col("x")).alias("s"), before(F.col("x"), F.greatest).alias("m")).collect():
        assert x.s == [sum(x.x[:i]) for i in range(len(x.x))]
        assert x.m == [max(x.x[:i], default=0) for i in range(len(x.x))]


def test_cuts_of_chunks(spark):
    r = random.Random(3)
    texts = ["", "a", "é🙂\n" * 5, "ab🙂d" * 256, "xyz\né" * 1500]
    rows = [(t, a, a + r.choice([0, 1, 5, 1024, 3000])) for t in texts for a in [0, 1, 1023, 1024, 1025, *(r.randrange(len(t) + 3) for _ in range(20))]]
    df = spark.createDataFrame(rows, "t string, a int, b int")
    for x in df.select("*", cut(chunks(F.col("t")), F.col("a"), F.col("b")).alias("got")).collect():
        assert x.got == x.t[x.a : x.b]


def test_many_numbers_and_spans_in_one_text(spark):
    r = random.Random(4)
    numbers = " ".join(str(r.randrange(10**6)) for _ in range(100_000))
    kinds = ["4111 1111 1111 1111 x", "call +49 30 1234567!", "10.0.0.1", "a@b.de", "12345678901234567890 y", "4111-1111-1111-1112", "1 2 3"]
    mixed = " é ".join(r.choice(kinds) for _ in range(20_000))
    docs = spark.createDataFrame([(1, numbers), (2, mixed), (3, None)], "doc_id long, text string")
    began = time.time()
    model = pii.fit(docs)
    got = {x.doc_id: x for x in pii.spans(docs, model, ["doc_id"]).collect()}
    masked = {x.doc_id: x.text for x in pii.masked(docs, model).collect()}
    assert time.time() - began < 90
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+"}
    for doc, text in ((1, numbers), (2, mixed)):
        for kind, pattern in plain.items():
            want = []
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                doubled = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d)))
                if kind != "card" or 13 <= len(d) <= 19 and doubled % 10 == 0:
                    want.append((m.start(), m.end()))
            assert [tuple(s) for s in got[doc][f"{kind}_base"]] == want
    spans = sorted((s.start, -s.stop, k) for k in pii.KINDS for s in got[2][f"{k}_all"])
    out, at = [], 0
    for start, stop, kind in ((a, -b, k) for a, b, k in spans):
        if start >= at:
            out += [mixed[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    assert masked[2] == "".join(out) + mixed[at:] and masked[3] is None or masked[3] == ""


def test_a_conversation_of_many_turns(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"<|im_end|>{i}" if i % 7 == 0 else f"t{i}") for i in range(20_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    began = time.time()
    x = chat.formatted(df).withColumn("loss", chat.under_mask(F.col("formatted"), chat.loss_spans(F.col("turns")))).first()
    assert time.time() - began < 60 and x.identical
    assert x.loss == "".join(t for _, _, role, t in turns if role == "assistant")
