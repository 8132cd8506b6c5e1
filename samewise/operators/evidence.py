"""Graph signals: evidence beside the names, itemised, for pairs whose score leaves doubt.

Six signals may raise a score from 0.70 up to but not at 0.90; the raise of all together is bounded. Each is a column
expression over a raw count, so the boosts need no join but the one with the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.operators import registry
from samewise.operators.graph import written
from samewise.operators.kinds import small

#: The scores in doubt, the most that all signals add, and the days within which two records count as first seen together.
DOUBT, MOST, DAYS = (0.70, 0.90), 0.20, (15, 30)
#: Of each signal, what it counts and what it adds: by steps (one, two or more), or each and at most.
STEPS = {"B2": ("code_fragments", 0.08, 0.12), "B3": ("amount_matches", 0.10, 0.15), "B4": ("shared_domains", 0.05, 0.08)}
EACH = {"B1": ("shared_persons", 0.05, 0.10), "B6": ("shared_nodes", 0.025, 0.10)}
APART = ("days_apart", 0.05, 0.03)
RAW = ("shared_persons", "code_fragments", "amount_matches", "shared_domains", "days_apart", "shared_nodes")


def _applied(signal: str) -> tuple[Column, Column]:
    """(raw value, what it adds); a missing count is 0, and missing days add nothing."""
    if signal in EACH:
        raw, each, most = EACH[signal]
        n = F.coalesce(raw, F.lit(0))
        return n, F.least(F.lit(most), each * n)
    if signal in STEPS:
        raw, one, two = STEPS[signal]
        n = F.coalesce(raw, F.lit(0))
        return n, F.when(n >= 2, two).when(n == 1, one).otherwise(0.0)
    raw, close, near = APART
    return F.col(raw), F.when(F.col(raw) <= DAYS[0], close).when(F.col(raw) <= DAYS[1], near).otherwise(0.0)


def boosted(scores: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """scores (entity_id, canonical_id, score) with the score raised, `boost`, and `items`: signal, raw value and what it added, B1 to B6.

    held: entity_id, canonical_id and the columns RAW; pairs without a row have no evidence. Without it the scores' own columns RAW count."""
    doubt = (F.col("score") >= DOUBT[0]) & (F.col("score") < DOUBT[1])
    items = []
    for signal in ("B1", "B2", "B3", "B4", "B5", "B6"):
        raw, adds = _applied(signal)
        items.append(F
            .struct(F.lit(signal).alias("signal"), raw.cast("double").alias("raw"), F.when(doubt, adds).otherwise(0.0).alias("applied")))
    rows = scores if held is None else scores.join(held.select("entity_id", "canonical_id", *RAW), ["entity_id", "canonical_id"], "left")
    rows = rows.withColumn("items", F.array(*items))
    # the sum in the items' order, in one expression
    boost = F.least(F.lit(MOST), sum((F.col("items")[i]["applied"] for i in range(len(items))), F.lit(0.0)))
    return rows.withColumn("boost", boost).withColumn("score", F.least(F.lit(1.0), F.col("score") + F.col("boost"))).drop(*RAW)


def _domain(email: Column) -> Column:
    text = F.lower(F.trim(email))
    return F.when(F.contains(text, F.lit("@")), F.split_part(text, F.lit("@"), F.lit(2)))


def _asked(pairs: DataFrame) -> DataFrame:
    return pairs.select("entity_id", "canonical_id").distinct()


def _set(rows: DataFrame, key: str, on: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(key, kind), (kind, its set of values of `on`): keys that hold the same values are of one kind."""
    sets = written(rows.where(F.col(on).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(on)).alias("values")))
    kinds = written(sets.select("values").distinct().withColumn(kind, F.monotonically_increasing_id()))
    return sets.join(kinds, "values").select(key, kind), kinds.withColumnRenamed("values", f"{kind}_values")


def _shared(mine: str, theirs: str) -> Column:
    """How many values the sets of a row's two kinds share."""
    return F.coalesce(F.size(F.array_intersect(f"{mine}_values", f"{theirs}_values")), F.lit(0)).cast("long")


def _counted(pairs: DataFrame, left: DataFrame, right: DataFrame, on: str, name: str) -> DataFrame:
    """pairs with how many distinct values of `on` its entity (left) and its canonical (right) share; a pair stays one row throughout."""
    (mine, left_sets), (theirs, right_sets) = _set(left, "entity_id", on, "mine"), _set(right, "canonical_id", on, "theirs")
    rows = _asked(pairs).join(theirs, "canonical_id", "left").join(mine, "entity_id", "left")
    rows = rows.join(small(left_sets), "mine", "left").join(small(right_sets), "theirs", "left")
    return rows.select("entity_id", "canonical_id", _shared("mine", "theirs").alias(name))


def shared_domains(pairs: DataFrame, entities: DataFrame, refs: DataFrame) -> DataFrame:
    """B4: e-mail domains of an entity that the references of a canonical have too."""
    theirs = refs.select("canonical_id", _domain(registry.text_field(F.col("external_fields"), "email")).alias("domain"))
    return _counted(pairs, entities.select("entity_id", _domain(F.col("email")).alias("domain")), theirs, "domain", "shared_domains")


def _fragments(codes: DataFrame, memos: DataFrame) -> tuple[DataFrame, DataFrame]:
    pieces = lambda c: F.filter(F.split(F.upper(F.col(c)), "[^A-Z0-9]+"), lambda x: F.length(x) >= 3)
    return codes.select("entity_id", F.explode(pieces("code")).alias("fragment")), memos.select("canonical_id", F.explode(pieces("memo")).alias("fragment"))


def code_fragments(pairs: DataFrame, codes: DataFrame, memos: DataFrame) -> DataFrame:
    """B2: fragments of an entity's project codes (entity_id, code), of three characters or more, that a canonical's memos (canonical_id, memo) hold as words."""
    return _counted(pairs, *_fragments(codes, memos), "fragment", "code_fragments")


def _totals(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, here: total by period), (canonical_id, periods, totals); periods are numbers."""
    sums = [written(rows.where("period is not null").groupBy(key, "period").agg(F.sum("amount").alias("total")))
        for rows, key in ((left, "entity_id"), (right, "canonical_id"))]
    known = small(written(sums[0].select("period").union(sums[1].select("period")).distinct().withColumn("at", F.monotonically_increasing_id())))
    mine, theirs = (rows.join(known, "period") for rows in sums)
    here = mine.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "total"))).alias("here"))
    there = theirs.groupBy("canonical_id").agg(F.collect_list(F.struct("at", "total")).alias("of"))
    return here, there.select("canonical_id", F.col("of.at").alias("periods"), F.col("of.total").alias("totals"))


def _agreed(share: float, most: float) -> Column:
    there = lambda i: F.col("totals")[i]
    near = lambda i: F.abs(F.try_element_at("here", F.col("periods")[i]) - there(i)) <= F.least(F.lit(most), share * F.abs(there(i)))
    agreed = F.filter(F.sequence(F.lit(0), F.size("totals") - 1), near)
    return F.coalesce(F.size(agreed), F.lit(0)).cast("long")


def amount_matches(pairs: DataFrame, left: DataFrame, right: DataFrame, share: float = 0.02, most: float = 500.0) -> DataFrame:
    """B3: periods in which an entity's total (entity_id, period, amount) and a canonical's (canonical_id, period,
    amount) agree within the tolerance.

    Each side is summed by period and gathered by key, so that a pair stays one row and takes its canonical's periods along."""
    here, there = _totals(left, right)
    rows = _asked(pairs).join(there, "canonical_id", "left").join(here, "entity_id", "left")
    return rows.select("entity_id", "canonical_id", _agreed(share, most).alias("amount_matches"))


def _seen(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("seen").alias(name))


def days_apart(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """B5: days between the first sight of an entity (entity_id, seen) and of a canonical (canonical_id, seen); null where one was never seen."""
    asked = _asked(pairs).join(_seen(left, "entity_id", "first"), "entity_id", "left").join(_seen(right, "canonical_id", "began"), "canonical_id", "left")
    return asked.select("entity_id", "canonical_id", F.abs(F.date_diff("first", "began")).alias("days_apart"))


def raw_counts(pairs: DataFrame, codes: DataFrame, memos: DataFrame, left: DataFrame, right: DataFrame, share: float = 0.02, most: float = 500.0) -> DataFrame:
    """code_fragments(), amount_matches() and days_apart() at once: a pair meets all of its canonical, then all of its entity."""
    codes, memos = _fragments(codes, memos)
    (mine, left_sets), (theirs, right_sets) = _set(codes, "entity_id", "fragment", "mine"), _set(memos, "canonical_id", "fragment", "theirs")
    here, there = _totals(left, right)
    of_canonical = _seen(right, "canonical_id", "began").join(there, "canonical_id", "left").join(theirs, "canonical_id", "full")
    of_entity = _seen(left, "entity_id", "first").join(here, "entity_id", "left").join(mine, "entity_id", "full")
    rows = _asked(pairs).join(written(of_canonical), "canonical_id", "left").join(written(of_entity), "entity_id", "left")
    rows = rows.join(small(left_sets), "mine", "left").join(small(right_sets), "theirs", "left")
    return rows.select("entity_id", "canonical_id", _shared("mine", "theirs").alias("code_fragments"), _agreed(share, most).alias("amount_matches"),
        F.abs(F.date_diff("first", "began")).alias("days_apart"))
