"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns with validators give the base spans, which always stay. Looser patterns propose more
candidates of the same kinds. Labelers (strict pattern, checksum or range, gazetteer, context before, counter-
context, edges) vote yes, no or nothing on every candidate. Candidates are counted by kind, votes and
length class, a table bounded by the number of vote patterns whatever the corpus; on it,
expectation-maximisation estimates each labeler's reliability per kind and a logistic classifier is trained
on the resulting labels. The classifier then decides every candidate that is not a base span.

Defined results: null text counts as empty and has no spans. Positions are code points, ends exclusive.
Candidates that overlap a base span of their kind, or an earlier candidate, are dropped. With nothing to
learn from, only base spans are found. Whole texts are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.llm.common import before, chunks, cut, let, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They match what the plain forms in the comments match; runs are possessive and begin where a
# run begins, so that matching is linear and uses no stack on long texts.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+; a run of fewer than 13 digits would be dropped, wherever in it a match began
    "card": r"[0-9](?=(?:[\x20-]?[0-9]){12})(?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]{0,2}[(\[{]at[)\]}][ ]{0,2}[A-Za-z0-9-]{1,63}(?:[ ]{0,2}(?:[(\[{]dot[)\]}]|\.)[ ]{0,2}[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9])[0-9]{1,3}\[\.\][0-9]{1,3}\[\.\][0-9]{1,3}\[\.\][0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}[ ./-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z.-])",
}
#: a text can hold a match only if it holds this
_NEEDS = {"email": "@", "phone": "+"}

_CONTEXT = {
    "email": r"mail|contact|kontakt|correo|courriel|write|reach",
    "ip": r"\bip\b|address|adresse|host|server|serveur|servidor|login|client",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|\btel|call|mobile|cell|fax|whatsapp|\bsms|anruf|rufen|appel|llam|móvil|handy",
}
_COUNTER = r"(?:version|isbn|issn|doi|invoice|order|item|sku|serial|figure|table|page|section|chapter|rechnung|facture|factura|§|\bno\.?|#)\s*$"
_GAZETTEER = {
    # common top-level domains
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl|be|mx|ar|ca|au)$",
    # issuer prefixes of payment cards
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)",
    # reserved and unassigned first numbers do not belong to hosts
    "ip": r"^(?!0|127\.|22[4-9]|23[0-9]|24[0-9]|25[0-9])",
    # country codes and trunk prefixes
    "phone": r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|0)",
}
LABELERS = ("strict", "validator", "gazetteer", "context", "counter", "edges")
_LEFT, _LENGTHS = 32, 6


def located(text: Column, pattern: str) -> Column:
    """Array of (start, match) of the leftmost non-overlapping matches of a pattern in a text."""
    none = F.array().cast("array<struct<start:int,match:string>>")

    def with_places(matches: Column) -> Column:
        # a gap before each match, and one after the last
        sizes = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("match")))

        def placed(sized: Column) -> Column:
            begins = F.zip_with(sized, before(F.transform(sized, lambda x: x["gap"] + x["match"])), lambda x, at: at + x["gap"])
            return F.zip_with(F.slice(begins, F.lit(1), F.size(matches)), matches, lambda start, match: F.struct(start.alias("start"), match.alias("match")))

        return F.when(F.size(matches) > 0, let(sizes, placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_places)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of up to 19 digits holds."""
    n = F.length(number)

    def term(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i))
    return total % 10 == 0




def valid(kind: str, match: Column) -> Column:
    """The condition a base match must meet."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)$"))
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, stop) of the base spans of one kind."""
    found = F.filter(located(text, BASE[kind]), lambda m: valid(kind, m["match"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), spans).otherwise(none) if kind in _NEEDS else spans


def _loose_matches(text: Column, kind: str) -> Column:
    found = located(text, LOOSE[kind])
    if kind != "email":
        return found
    none = F.array().cast("array<struct<start:int,match:string>>")
    return F.when(text.rlike(r"[(\[{]at[)\]}]"), found).otherwise(none)


def _votes(parts: Column, kind: str, start: Column, match: Column, strict: bool) -> Column:
    """The votes (1, -1 or 0) of all labelers on one candidate of a text in `chunks`, with its length class."""
    left = F.lower(cut(parts, F.greatest(start - _LEFT, F.lit(0)), start))
    after = cut(parts, start + F.length(match), start + F.length(match) + 1)
    pm = lambda cond: F.when(cond, 1).otherwise(-1)
    key = digits(match) if kind in ("card", "phone") else F.regexp_replace(F.lower(match), r"[\[\](){} ]|dot", "") if kind == "email" else match
    numbers = digits(match)
    sound = {
        "email": lambda: match.rlike(r"(?i)[a-z]{2,24}$"),
        "ip": lambda: match.contains(":") | valid("ip", F.regexp_replace(match, r"[\[\]]", "")),
        "card": lambda: valid("card", match),
        "phone": lambda: F.length(numbers).between(9, 15),
    }[kind]()
    known = key.rlike(_GAZETTEER[kind])
    return F.struct(
        F.lit(1 if strict else 0).alias("strict"),
        pm(sound).alias("validator"),
        pm(known).alias("gazetteer"),
        F.when(left.rlike(_CONTEXT[kind]), 1).otherwise(0).alias("context"),
        F.when(left.rlike(_COUNTER), -1).otherwise(0).alias("counter"),
        F.when(left.rlike(r"[\p{L}0-9_/\\=-]$") | after.rlike(r"[\p{L}0-9_/\\=]"), -1).otherwise(1).alias("edges"),
        F.least(F.floor(F.length(match) / 4).cast("int"), F.lit(_LENGTHS - 1)).alias("length"),
    )


def _apart(base: Column, start: Column, stop: Column) -> Column:
    """Whether a span overlaps none of the sorted spans of ``base``: halving finds the last that begins before its end."""
    halves = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    begun = F.aggregate(halves, F.lit(0), lambda n, step: F.when((step <= F.size(base) - n) & (F.get(base, n + step - 1)["start"] < stop), n + step).otherwise(n))
    return let(begun, lambda n: (n == 0) | (F.get(base, n - 1)["stop"] <= start))


def candidates(text: Column, kind: str, base: Column) -> Column:
    """Array of (start, stop, votes) of the looser matches of a kind that overlap no base span of it."""
    stop = lambda m: m["start"] + F.length(m["match"])
    free = F.filter(_loose_matches(text, kind), lambda m: F.when(F.size(base) == 0, True).otherwise(_apart(base, m["start"], stop(m))))
    judged = lambda parts, found: F.transform(found, lambda m: F.struct(m["start"].alias("start"), stop(m).alias("stop"), _votes(parts, kind, m["start"], m["match"], False).alias("votes")))
    # most texts have none, and are not cut up
    return let(free, lambda found: F.when(F.size(found) > 0, let(chunks(text), lambda parts: judged(parts, found))))


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, one column per labeler, length, n): all candidates of the corpus, base spans among them, by their votes."""
    text = F.col("_text")
    rows = docs.select(text_or_empty().alias("_text"))
    rows = rows.select("_text", *(base_spans(text, k).alias(k) for k in KINDS))

    def group(kind: str) -> Column:
        judged = lambda parts, b: let(cut(parts, b["start"], b["stop"]), lambda m: F.struct(F.lit(kind).alias("kind"), _votes(parts, kind, b["start"], m, True).alias("v")))
        strict = F.when(F.size(kind) > 0, let(chunks(text), lambda parts: F.transform(kind, lambda b: judged(parts, b))))
        loose = F.transform(candidates(text, kind, F.col(kind)), lambda c: F.struct(F.lit(kind).alias("kind"), c["votes"].alias("v")))
        return F.array_compact(F.array(strict, loose))

    groups = [group(k) for k in KINDS]
    return rows.select(F.explode(F.flatten(F.concat(*groups))).alias("c")).select("c.kind", "c.v.*").groupBy("kind", *LABELERS, "length").agg(F.count("*").alias("n"))


@dataclass
class Model:
    """Reliabilities of the labelers and the weights of the span classifier."""

    reliability: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


def _features(row: dict) -> list[str]:
    """Names of the indicators that are on for a candidate."""
    votes = [f"{lab}={row[lab]}" for lab in LABELERS if lab != "strict" and row[lab]]
    return ["bias", f"kind={row['kind']}", *votes, f"{row['kind']}:length={row['length']}"]


def expectation_maximisation(rows: list[dict], rounds: int = 30) -> tuple[list[float], dict[tuple[str, str], tuple[float, float]]]:
    """Posterior of each vote pattern being a true span, and per (kind, labeler) how often it votes yes on true and on other candidates.

    A labeler that does not vote says nothing; add-one counts keep every rate inside (0, 1).
    """
    post = [1 / (1 + math.exp(-float(sum(r[lab] for lab in LABELERS)))) for r in rows]
    rates: dict[tuple[str, str], tuple[float, float]] = {}
    for _ in range(rounds):
        prior = {}
        for k in KINDS:
            mine = [(p, r) for p, r in zip(post, rows) if r["kind"] == k]
            n = sum(r["n"] for _, r in mine)
            prior[k] = (1 + sum(p * r["n"] for p, r in mine)) / (2 + n)
            for lab in LABELERS:
                cast = [(p, r) for p, r in mine if r[lab]]
                yes_true = sum(p * r["n"] for p, r in cast if r[lab] > 0)
                yes_other = sum((1 - p) * r["n"] for p, r in cast if r[lab] > 0)
                true = sum(p * r["n"] for p, r in cast)
                other = sum((1 - p) * r["n"] for p, r in cast)
                # labelers are taken to be better than chance: two yes (no) votes are assumed on true (other) candidates
                rates[k, lab] = ((yes_true + 2) / (true + 3), (yes_other + 1) / (other + 3))
        for i, r in enumerate(rows):
            odds = math.log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            for lab in LABELERS:
                if r[lab]:
                    a, b = rates[r["kind"], lab]
                    odds += math.log(a / b) if r[lab] > 0 else math.log((1 - a) / (1 - b))
            post[i] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post, rates


def trained(rows: list[dict], post: list[float], rounds: int = 400, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier on the candidates' features, fitted to their posteriors by gradient descent."""
    weights: dict[str, float] = {}
    speed: dict[str, float] = {}
    each = [(_features(r), p, math.log1p(r["n"])) for r, p in zip(rows, post)]
    total = sum(n for _, _, n in each) or 1.0
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, p, n in each:
            z = sum(weights.get(f, 0.0) for f in names)
            d = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) * n / total
            for f in names:
                slope[f] = slope.get(f, 0.0) + d
        for f, g in slope.items():
            g += decay * weights.get(f, 0.0)
            speed[f] = speed.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) - 0.5 * g / (math.sqrt(speed[f]) + 1e-9)
    return weights


def fit(docs: DataFrame) -> Model:
    """Reliabilities and classifier from all candidates of a corpus; only the table of vote patterns is fetched."""
    rows = [r.asDict() for r in vote_counts(docs).collect()]
    rows.sort(key=lambda r: (r["kind"], *(r[lab] for lab in LABELERS), r["length"]))
    if not rows:
        return Model()
    post, rates = expectation_maximisation(rows)
    return Model(rates, trained(rows, post))


def probability(model: Model, kind: str, votes: Column) -> Column:
    w = model.weights
    z = F.lit(w.get("bias", 0.0) + w.get(f"kind={kind}", 0.0))
    for lab in LABELERS:
        if lab != "strict":
            z = z + F.when(votes[lab] > 0, w.get(f"{lab}=1", 0.0)).when(votes[lab] < 0, w.get(f"{lab}=-1", 0.0)).otherwise(0.0)
    lengths = F.array(*(F.lit(w.get(f"{kind}:length={i}", 0.0)) for i in range(_LENGTHS)))
    return 1 / (1 + F.exp(-(z + F.get(lengths, votes["length"]))))


def spans(docs: DataFrame, model: Model, keep: list[str], least: float = 0.5) -> DataFrame:
    """The ``keep`` columns with, per kind, ``<kind>_base`` and ``<kind>_all``: arrays of (start, stop) in order of start."""
    text = F.col("_text")
    rows = docs.select(*keep, text_or_empty().alias("_text"))
    rows = rows.select(*keep, "_text", *(base_spans(text, k).alias(f"{k}_base") for k in KINDS))

    def all_of(kind: str) -> Column:
        base = F.col(f"{kind}_base")
        if not model.weights:
            return base
        chosen = F.filter(candidates(text, kind, base), lambda c: probability(model, kind, c["votes"]) >= least)
        added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))
        return let(added, lambda x: F.when(x.isNull() | (F.size(x) == 0), base).otherwise(F.array_sort(F.concat(base, x))))

    every = [all_of(k).alias(f"{k}_all") for k in KINDS]
    return rows.select("*", *every)


def listed(prefix: str) -> Column:
    """All spans of the kinds as text: kind:start:end, comma-joined, by kind, then start."""
    one = lambda kind: F.transform(f"{kind}_{prefix}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))
    return F.array_join(F.concat(*map(one, KINDS)), ",")


def masked(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets; overlapping spans become one."""
    found = spans(docs, model, [f"`{c}`" for c in docs.columns])
    named = lambda kind: F.transform(f"{kind}_all", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))
    all_ = F.array_sort(F.concat(*map(named, KINDS)))

    def replaced(spans_: Column, parts: Column) -> Column:
        done = before(F.transform(spans_, lambda s: s["stop"]), F.greatest)
        told = F.zip_with(spans_, done, lambda s, at: F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        last = F.array_max(F.transform(spans_, lambda s: s["stop"]))
        return F.concat(F.array_join(told, ""), cut(parts, last, F.length("_text")))

    new = let(all_, lambda a: F.when(F.size(a) > 0, let(chunks(F.col("_text")), lambda parts: replaced(a, parts))).otherwise(F.col("_text")))
    return found.select(*(new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
