"""Personal data by weak supervision, in DataFrame functions only: labelers vote, EM weighs them, a classifier decides spans.

Four base kinds are found by pattern and check, and always stay. Broader candidates (base patterns whose check fails, other
grouped numbers, titled names) get votes of three labelers: the shape's check, a gazetteer, and the words before the span.
Expectation-maximisation over the counts of vote patterns estimates the labelers' reliability. The posteriors train a
logistic classifier that doesn't see the votes of the words but the span and its surroundings themselves: kind, shape, list,
which words stand before, a colon or a line's beginning right before, what it is glued to, and whether its digits vary. All of these have few
values, so EM and classifier are fitted on a table of pattern counts that can't grow with the data. What the classifier gives
a probability above `SURE` is added, unless it touches a base span. No labeler has a veto.

Spans count code points, the end exclusive. Java's patterns are possessive where the base pattern can't give anything back,
so that no match recurses or backtracks over a long run. A span's surroundings are what stands between it and the matches of
its kind beside it, `CONTEXT` characters at most. Null texts count as empty; null doc_ids stay; repeated rows give
repeated rows; ties of start go by kind; extra columns are ignored; without candidates nothing is added; an empty table
gives no rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.common import cut

#: The base kinds in their order, and their patterns for Java.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+@._%-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}+(?![0-9A-Za-z@_%-])",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?+",
}
KINDS = tuple(PATTERNS)
#: A character that each match of the kind holds, and so each text with one.
HOLDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9].?[0-9]", "phone": r"\+[0-9]", "number": "[0-9][ .)-]", "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? "}
CONTEXT = 48
#: What the classifier must give a candidate, and the log odds of that: at even odds, card numbers that fail their check came in.
SURE = 0.9
ODDS = math.log(SURE / (1 - SURE))
#: Words before a span, by class: those right before it that name something else, then those on its line that name personal data.
WORDS = {
    "document": r"(?i)\b(?:version|isbn|issn|page|pages|chapter|figure|table|section|build|release|lines?)\b[^\p{L}\n]*$",
    "money": r"(?i)\b(?:price|total|order|invoice|sku|amount|sum)\b[^\p{L}\n]*$",
    "contact": r"(?i)\b(?:e-?mail|contact|call|phone|mobile|tel|fax|whatsapp|reach|address|ip)\b[^\n]*$",
    "identity": r"(?i)\b(?:ssn|social\x20security|passport|born|birth|name|signed)\b[^\n]*$",
    "payment": r"(?i)\b(?:account|iban|card|visa)\b[^\n]*$",
}
CLASSES = (None, *WORDS)
AGAINST = ("document", "money")
#: Gazetteers: top-level domains, card issuers' leading digits, area codes' first digit, given names.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
GIVEN = (
    "james", "mary", "john", "anna", "maria", "peter", "paul", "jean", "marie", "jose", "carmen", "hans", "klaus", "sofia", "luis", "michael",
    "david", "sarah", "laura", "thomas"
)
SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"
#: Numbers that are summed in one go. An aggregate copies its state at each step, so that of a long list must not be one list.
CHUNK = 128


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """For each of an array of numbers the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    summed = lambda v: F.aggregate(v, start, step)

    def chunked(v: Column) -> Column:
        every = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return F.transform(every, lambda c: summed(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))

    def joined(chunks: Column) -> Column:
        before = summed(F.transform(chunks, lambda c: c["at"]))["out"]
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c["out"], lambda x: x + b)))

    return F.when(F.size(values) > 0, _let(values, lambda v: _let(chunked(v), joined))).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, matches: Column) -> Column:
    """The spans (s, e, m, before, after) of a pattern's matches in a text, from the lengths of what stands between them."""
    n = F.size(matches)

    def of(gaps: Column) -> Column:
        around = F.zip_with(
            F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda g,
            h: F.struct(F.length(g).alias("g"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(h, F.lit(1)).alias("after"))
        )
        return F.zip_with(matches, around, lambda m, g: F.struct(m.alias("m"), F.length(m).alias("n"), g.alias("of")))

    def placed(steps: Column) -> Column:
        before = running(F.transform(steps, lambda x: x["n"] + x["of"]["g"]))
        return F.zip_with(
            steps, before, lambda x,
            at: F.struct(
                (at + x["of"]["g"]).alias("s"), (at + x["of"]["g"] + x["n"]).alias("e"), x["m"].alias("m"), x["of"]["before"].alias("before"),
                x["of"]["after"].alias("after")
            )
        )

    return F.when(n > 0, _let(_let(F.split(text, pattern, -1), of), placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = F.reverse(_digits(m))
    doubled = lambda c: F.when(c > 4, 2 * c - 9).otherwise(2 * c)
    values = F.transform(F.filter(F.split(d, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def checked(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(
            F.split(m, r"\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        )
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "number":
        return m.rlike(r"^(?:\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$")
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    """1 if a list knows it, -1 if a list rules it out, else 0."""
    if kind == "email":
        return F.when(F.lower(F.element_at(F.split(m, r"\."), -1)).isin(*DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(r"^0|^(?:[0-9]\.){3}[0-9]$"), -1).otherwise(F.when(m.rlike(r"^(?:10|127|172|192|1[0-9]{2}|2[01][0-9]|[1-9][0-9])\."), 1).otherwise(0))
    if kind == "card":
        return F.when(_digits(m).rlike(ISSUERS), 1).otherwise(-1)
    if kind in ("phone", "number"):
        return F.when(F.regexp_extract(m, r"\(([0-9]{3})\)", 1).rlike("^[2-9]"), 1).otherwise(F.when(_digits(m).rlike(r"^(?:19|20)[0-9]{2}|^(.)\1+$"), -1).otherwise(0))
    return F.when(F.lower(F.element_at(F.split(m, r"[\x20.]+"), 2)).isin(*GIVEN), 1).otherwise(0)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, spans: array of (s, k, e, base, and FEATURES) of all candidates, by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text, *(F.col(c).alias(f"keep_{c}") for c in keep if c != "text"),
        *([F.col("text").isNull().alias("keep_no_text")] if "text" in keep else [])
    )
    for kind in KINDS:
        some = F.when(F.col("text").rlike(HOLDS[kind]), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"m_{kind}", some)
    for kind in KINDS:
        out = out.withColumn(f"s_{kind}", located(F.col("text"), PATTERNS[kind], F.col(f"m_{kind}"))).drop(f"m_{kind}")

    def seen(kind: str, k: int) -> Column:
        def one(x):
            ok, before = checked(kind, x["m"]), x["before"]
            said = F.coalesce(*[F.when(before.rlike(p), i + 1) for i, p in enumerate(WORDS.values())], F.lit(0))
            led = F.when(before.rlike(r"[:=]\x20*$"), 1).when(before.rlike(r"(?:^|\n)\x20*$"), 2).otherwise(0)
            glued = before.rlike(r"[\p{L}\p{N}_#/.-]$") | x["after"].rlike(r"^[\p{L}\p{N}_/]")
            own = {
                "base": ok if kind in BASE else F.lit(False), "shape": F.when(ok, 1).otherwise(-1), "list": _gazetteer(kind, x["m"]), "said": said,
                "led": led, "glued": glued.cast("int"), "flat": _digits(x["m"]).rlike(r"^(.)\1*$|([0-9])\2{5}").cast("int")
            }
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), *(v.alias(c) for c, v in own.items()))

        return F.transform(f"s_{kind}", one)

    every = F.sort_array(F.concat(*[seen(kind, k) for k, kind in enumerate(KINDS)]))
    own = {c: F.when(~F.col("keep_no_text"), F.col("text")) if c == "text" else F.col(f"keep_{c}") for c in keep}
    return out.select("doc_id", *(v.alias(c) for c, v in own.items()), every.alias("spans"))


VOTES = ("shape", "list", "words")
#: What the classifier sees of a span and its surroundings besides the kind, and the values that have a weight each; shape and list count as numbers.
FEATURES = {"shape": None, "list": None, "said": range(1, len(CLASSES)), "led": (1, 2), "glued": (1,), "flat": (1,)}
WEIGHTS = [("k", k) for k in range(len(KINDS))] + [(f, v) for f, values in FEATURES.items() for v in (values or (None,))]


def votes_of(pattern: dict) -> tuple[int, int, int]:
    """The votes of the three labelers on a pattern of FEATURES: 1 for personal data, -1 against, 0 for none."""
    said = CLASSES[pattern["said"]]
    return pattern["shape"], pattern["list"], 0 if said is None else -1 if said in AGAINST else 1


def reliabilities(counts: list[tuple[tuple[int, ...], int, int]], rounds: int = 50) -> list[float]:
    """Posteriors of personal data for each (votes, kind, number): EM for one accuracy a labeler and one prior a kind.

    An abstaining labeler (0) says nothing; accuracies start at 0.8, so the labels' meaning is fixed, and keep within
    0.55 and 0.99."""
    right = [0.8] * len(VOTES)
    prior = {k: 0.5 for _, k, _ in counts}
    post = [0.5] * len(counts)
    for _ in range(rounds):
        for i, (votes, k, _) in enumerate(counts):
            odds = math.log(prior[k] / (1 - prior[k])) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right))
            post[i] = 1 / (1 + math.exp(-odds))
        for k in prior:
            n = sum(c for _, kk, c in counts if kk == k)
            prior[k] = min(0.95, max(0.05, sum(p * c for p, (_, kk, c) in zip(post, counts) if kk == k) / n))
        for j in range(len(VOTES)):
            cast = sum(c for v, _, c in counts if v[j])
            good = sum(c * (p if v[j] > 0 else 1 - p) for p, (v, _, c) in zip(post, counts) if v[j])
            right[j] = min(0.99, max(0.55, (good + 8) / (cast + 10)))
    return post


def _row(pattern: dict) -> list[float]:
    """The values of WEIGHTS for a pattern of FEATURES and k."""
    return [float(pattern[f] if v is None else pattern[f] == v) for f, v in WEIGHTS]


def fit(patterns: list[dict], numbers: list[int], post: list[float], rounds: int = 25, shrink: float = 1.0) -> list[float]:
    """A weight for each of WEIGHTS: a logistic classifier of patterns, trained on their posteriors by Newton steps."""
    if not patterns:
        return [0.0] * len(WEIGHTS)
    x, n, p = np.array([_row(q) for q in patterns]), np.array(numbers, float), np.array(post)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        now = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * now * (1 - now))[:, None]).T @ x + shrink * np.eye(len(w)), x.T @ (n * (p - now)) - shrink * w)
        w = w + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return w.tolist()


def learned(found: DataFrame) -> list[float]:
    """The classifier's weights from the spans of candidates(): only counts of patterns leave the executors, of which there can be a few thousand."""
    names = ["k", *FEATURES]
    rows = found.select(F.explode("spans").alias("c")).select("c.*").groupBy(*names).count().orderBy(*names).collect()
    patterns = [{f: r[f] for f in names} for r in rows]
    numbers = [r["count"] for r in rows]
    return fit(patterns, numbers, reliabilities([(votes_of(q), q["k"], n) for q, n in zip(patterns, numbers)]))


def detect(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, spans: array of (s, k, e, base) of the base spans and the accepted candidates, by start and kind."""
    found = cut(candidates(docs, keep), "candidates")
    weights = learned(found)

    def score(x):
        return reduce(lambda a, b: a + b, [F.lit(w) * x[f] if v is None else F.when(x[f] == v, w).otherwise(0.0) for w, (f, v) in zip(weights, WEIGHTS)])

    meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])

    def bounded(held: Column) -> Column:
        """Base spans by chunks with their bounds, so that a candidate is held against those of the chunks it reaches alone."""
        every = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        parts = F.transform(every, lambda c: F.slice(held, c * CHUNK + 1, F.lit(CHUNK)))
        of = lambda part: F.struct(F.array_min(F.transform(part, lambda y: y["s"])).alias("s"), F.array_max(F.transform(part, lambda y: y["e"])).alias("e"), part.alias("of"))
        return F.when(F.size(held) > 0, F.transform(parts, of)).otherwise(F.array().cast("array<struct<s:int,e:int,of:array<struct<s:int,e:int>>>>"))

    def kept(bounds: Column) -> Column:
        touches = lambda x: F.exists(bounds, lambda c: meets(x, c) & F.exists(c["of"], lambda y: meets(x, y)))
        return F.filter("spans", lambda x: x["base"] | ((score(x) > ODDS) & ~touches(x)))

    held = F.transform(F.filter("spans", lambda x: x["base"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    stays = _let(_let(held, bounded), kept)
    slim = F.transform(stays, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base")))
    return found.select("doc_id", *keep, slim.alias("spans"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    base = F.filter("spans", lambda x: x["base"])

    def of_kind(k: int) -> Column:
        # the lambda has one parameter: a second one would be the element's place
        return F.size(F.filter("spans", lambda x: x["base"] & (x["k"] == k))).cast("long")

    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return detect(docs).select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, as its first kind's name in brackets."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        cut_ = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(name, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], cut_).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
