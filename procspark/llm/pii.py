"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. A shape rule, a gazetteer and a context rule vote on each. Expectation
maximisation over the counts of vote patterns (a bounded table) estimates how reliable each
voter is, and its posteriors train the final span classifier. Spans that meet the fixed rules stay
in any case; the classifier decides on the others.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from procspark.llm.store import stash

#: The kinds in the order of the result, and the other kinds that are proposed.
KINDS = ("email", "ip", "card", "phone")
MORE = ("email_spelled", "phone_local", "name")

#: Patterns. Possessive repeats and the look-behinds only spare retries; they match what the plain forms match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "name": r"(?<![A-Za-z0-9])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "email_spelled": "at", "ip": "."}

#: Gazetteers: common top-level domains, card issuer prefixes, calling codes, given names.
DOMAINS = "com org net edu gov io co info biz de fr es it uk us eu ch at nl be pt pl ru cn jp br in ca au".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|30|6011|65|62)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
NAMES = ("James Mary John Maria Anna Peter Paul Michael Thomas Robert David Daniel Laura Sarah Julia Hans Klaus Pierre Marie "
         "Jean Sophie Carlos Juan Jose Ana Lucia Elena Marta Luis Antonio Emma Jack Alice George Martin Andreas").split()
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
CONTEXT = {
    "email": (r"mail|contact|kontakt|correo|courriel|write to", r"version"),
    "ip": (r"\bip\b|server|host|address|login|adresse", r"version|\bv$|section|\brelease"),
    "card": (r"card|visa|credit|karte|carte|tarjeta|payment|amex", r"isbn|order|serial|number of"),
    "phone": (r"tel|phone|call|fax|mobil|m[oó]vil|llame|handy|rufen", r"version|score"),
}
CONTEXT |= {"email_spelled": CONTEXT["email"], "phone_local": CONTEXT["phone"], "name": (r"name|signed|contact|dear", r"street|avenue")}
AROUND = 40
ROUNDS = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _holds(kind: str, m: Column) -> Column:
    """The fixed rule of a kind; false for kinds that have none."""
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _small_parts(m)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _shape(kind: str, m: Column) -> Column:
    """The regex voter."""
    if kind == "email":
        good = m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$")
    elif kind == "ip":
        good = _small_parts(m)
    elif kind == "card":
        good = _holds("card", m)
    elif kind == "phone":
        good = _holds("phone", m)
    elif kind == "email_spelled":
        good = m.rlike(r"[A-Za-z]{2,24}$")
    elif kind == "phone_local":
        good = m.rlike(r"^\(?[2-9]")
    else:
        good = m.rlike(r"[a-z] [A-Z][a-z]+$")
    return _vote(good, ~good)


def _listed(kind: str, m: Column) -> Column:
    """The gazetteer voter."""
    if kind in ("email", "email_spelled"):
        good = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
        return _vote(good, F.lit(False))
    if kind == "ip":
        return _vote(F.lit(False), m.rlike(RESERVED))
    if kind == "card":
        good = _digits(m).rlike(ISSUERS)
        return _vote(good, ~good)
    if kind == "phone":
        good = m.rlike(CALLING)
        return _vote(good, ~good)
    if kind == "name":
        good = F.regexp_extract(m, r"([A-Z][a-z]+)(?: [A-Z][a-z]+)?$", 1).isin(NAMES)
        return _vote(good, ~good)
    return F.lit(0)


def _said(kind: str, before: Column, after: Column) -> Column:
    """The context voter."""
    yes, no = CONTEXT[kind]
    near = F.lower(F.concat_ws(" ", F.substring(before, -AROUND, AROUND), F.substring(after, 1, AROUND // 2)))
    return _vote(near.rlike(yes), near.rlike(no))


#: What the classifier sees of a span besides the votes: a mark before it, a capital, digits as its larger part, an end of a clause after it.
LOOKS = ("marked", "capital", "digits", "ended")


def _look(m: Column, before: Column, after: Column) -> Column:
    """The ``LOOKS`` that hold, as bits."""
    bits = (F.substring(before, -2, 2).rlike("[:=(<\"']\\s?$"), m.rlike("[A-Z]"), F.length(_digits(m)) * 2 > F.length(m),
            F.substring(after, 1, 1).rlike(r"^[.,;!?)>\n]") | (F.length(after) == 0))
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_uid, id, kind, start, end, base, shape, listed, said, size, look) of every proposed span; a row of nulls for a text without.

    A text is cut at the matches of a pattern; the lengths of what lies between and of the matches, added up in order,
    are the places. Only these lengths and the votes are shuffled, the texts are not.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("id"), t.alias("t"))

    def where(kind: str, then: Column) -> Column:
        return F.when(F.contains("t", F.lit(NEEDS[kind])), then) if kind in NEEDS else then

    rows = rows.select("_uid", "id", "t", *[
        where(k, F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("_uid", "id", *[f"m_{k}" for k in PATTERNS], *[
        F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).alias(f"s_{k}") for k, p in PATTERNS.items()])

    def spans(kind: str) -> Column:
        s = F.col(f"s_{kind}")

        def one(m: Column, i: Column) -> Column:
            before, after = F.get(s, i), F.get(s, i + 1)
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(before).alias("gap"), F.length(m).alias("size"),
                            _holds(kind, m).alias("base"), _shape(kind, m).alias("shape"), _listed(kind, m).alias("listed"),
                            _said(kind, before, after).alias("said"), _look(m, before, after).alias("look"))

        return F.when(F.size(f"m_{kind}") > 0, F.transform(f"m_{kind}", one))

    found = F.concat(*[F.coalesce(spans(k), F.expr("array()")) for k in PATTERNS])
    some = F.lit(False)
    for k in PATTERNS:
        some |= F.coalesce(F.size(f"m_{k}") > 0, F.lit(False))
    rows = rows.select("_uid", "id", F.explode_outer(F.when(some, found)).alias("c")).select("_uid", "id", "c.*")
    run = Window.partitionBy("_uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(run)
    return rows.repartition("_uid").withColumn("end", end.cast("long")).select(
        "_uid", "id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "base", "shape", "listed", "said", "size", "look")


VOTERS = ("shape", "listed", "said")


def em(counts: dict[tuple, float], rounds: int = ROUNDS) -> tuple[dict[tuple, float], list[dict]]:
    """(posterior of each vote pattern, [chances of a vote given true, given false] by voter) of one kind.

    Patterns are tuples of votes -1, 0, 1. Smoothing holds a voter's yes and no to their side at the start, so the classes
    cannot trade places.
    """
    width = len(next(iter(counts)))
    total = sum(counts.values())
    prior = 0.5
    right = [{1: .6, 0: .3, -1: .1} for _ in range(width)]
    wrong = [{1: .1, 0: .3, -1: .6} for _ in range(width)]
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for v in counts:
            a = math.log(prior) + sum(math.log(right[i][x]) for i, x in enumerate(v))
            b = math.log(1 - prior) + sum(math.log(wrong[i][x]) for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(min(50, b - a)))
        mass = sum(n * post[v] for v, n in counts.items())
        prior = (mass + 1) / (total + 2)
        for i in range(width):
            for x, up, down in ((1, 3, 1), (0, 1, 1), (-1, 1, 3)):
                yes = sum(n * post[v] for v, n in counts.items() if v[i] == x)
                no = sum(n * (1 - post[v]) for v, n in counts.items() if v[i] == x)
                right[i][x] = (yes + up) / (mass + 5)
                wrong[i][x] = (no + down) / (total - mass + 5)
    return post, [{"true": r, "false": w} for r, w in zip(right, wrong)]


def _features(kind: str, votes: tuple, size: int, look: int = 0) -> list[str]:
    seen = [n for i, n in enumerate(LOOKS) if look >> i & 1]
    return [kind, *[f"{n}{v}" for n, v in zip(VOTERS, votes)], *[f"{kind}:{n}{v}" for n, v in zip(VOTERS, votes)], f"{kind}:size{size}",
            *[f"{kind}:{n}" for n in seen]]


def train(counts: dict[tuple, float], targets: dict[tuple, float], rounds: int = 300, rate: float = 0.5,
          penalty: float = 1e-3) -> dict[tuple, float]:
    """Chance of each pattern (kind, votes, size, look) from logistic regression on soft targets, by gradient steps.

    Patterns of one kind and vote have one target, so what the others of a kind that look alike are said to be moves
    a pattern on which the voters are at odds or silent.
    """
    names = {f: i for i, f in enumerate(sorted({f for k in counts for f in _features(*k)}))}
    x = np.zeros((len(counts), len(names)))
    for i, k in enumerate(counts):
        x[i, [names[f] for f in _features(*k)]] = 1
    n, want = np.array(list(counts.values())), np.array([targets[k] for k in counts])
    weight = np.zeros(len(names))
    chance = lambda: 1 / (1 + np.exp(-np.clip(x @ weight, -50, 50)))
    for _ in range(rounds):
        weight = weight * (1 - rate * penalty) + rate * (x.T @ (n * (want - chance()))) / n.sum()
    return dict(zip(counts, map(float, chance())))


def _size_class() -> Column:
    return F.when(F.col("size") < 10, 0).when(F.col("size") < 16, 1).when(F.col("size") < 30, 2).otherwise(3)


def span_chances(found: DataFrame) -> list[tuple]:
    """(kind, shape, listed, said, size class, look, chance) of every pattern that occurs: at most 7 * 27 * 4 * 16 rows."""
    counts = {(r.kind, (r.shape, r.listed, r.said), r.c, r.look): float(r.n) for r in found.where("kind is not null").groupBy(
        "kind", *VOTERS, _size_class().alias("c"), "look").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    targets = {}
    for kind in PATTERNS:
        votes: dict[tuple, float] = {}
        for (k, v, _, _), n in counts.items():
            if k == kind:
                votes[v] = votes.get(v, 0) + n
        if votes:
            post, _ = em(votes)
            targets |= {key: post[key[1]] for key in counts if key[0] == kind}
    return [(k, *v, c, look, p) for (k, v, c, look), p in train(counts, targets).items()]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and kind. ``spans`` has those of the fixed rules and
    those that the classifier adds where at least one voter is for them and none of the former overlaps. Null
    texts count as empty; an empty text has no spans; repeated rows give repeated results; other columns of docs are
    neither read nor returned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    found = stash(candidates(docs, id_col, text), "candidates")
    on = ["kind", *VOTERS, "c", "look"]
    rows = json.dumps([dict(zip([*on, "chance"], r)) for r in span_chances(found)])
    kinds = "array<struct<kind:string,shape:int,listed:int,said:int,c:int,look:int,chance:double>>"
    known = spark.range(1).select(F.inline(F.from_json(F.lit(rows), kinds)))
    # at most 12,096 rows
    scored = found.withColumn("c", _size_class()).join(F.broadcast(known), on, "left")
    backed = F.greatest(*VOTERS) > 0
    order = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("o"), "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    both = scored.groupBy("_uid", "id").agg(
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("base") & backed & (F.col("chance") >= 0.5), span))).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: x["s"]), ",")
    return both.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"),
                       line(F.array_sort(F.concat("base", free))).alias("spans"))
