"""Scores of all entities and canonicals that share a signal, without a cap, as blocks of a kind of entities and a kind of canonicals.

Entities of the same name, category and own canonicals score the same with a canonical; canonicals of the same name and aliases score the same
with an entity, but that an entity's own canonical is a kind by itself, as it is no candidate. So a block is whole: each of its
entities meets each of its canonicals with one score. Blocks grow with the different names, not with the rows, and no row for a pair comes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.similarity import grams, grams_jaccard, string_metrics
from samewise.operators import kinds, matching, registry
from samewise.operators.graph import written
from samewise.operators.kinds import beside
from samewise.operators.scoring import ALIAS_THRESHOLD, SHORT_CODE, flipped, short_code, weights_of


@dataclass(frozen=True)
class Blocks:
    """left: entity_id, left (kind); right: canonical_id, right (kind); scores: left, right, score."""

    left: DataFrame
    right: DataFrame
    scores: DataFrame

    def best(self, most: int) -> DataFrame:
        """entity_id, canonical_id, score: the `most` best canonicals of each entity, by score, then id.

        Of a kind only the first `most` ids can be among them."""
        first = lambda rows, by, *order: rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= most).drop("nth")
        heads = written(first(self.right.distinct(), "right", "canonical_id"))
        met = self.scores.join(beside(heads), "right").groupBy("left", "canonical_id").agg(F.max("score").alias("score"))
        best = written(first(met, "left", F.desc("score"), "canonical_id"))
        return self.left.join(beside(best), "left").select("entity_id", "canonical_id", "score")


def _kinds(rows: DataFrame, key: str, alike: tuple, kind: str) -> tuple[DataFrame, DataFrame]:
    """(key, kind), (kind and what its keys have alike), written."""
    rows = written(rows)
    of = written(rows.select(*alike).distinct().withColumn(kind, F.monotonically_increasing_id()))
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"of.{c}")) for c in alike]
    return written(rows.alias("rows").join(beside(of).alias("of"), same).select(f"rows.{key}", f"of.{kind}")), of


def _short(name: Column) -> Column:
    return F.coalesce(F.length(name) <= SHORT_CODE, F.lit(False))


def blocks(entities: DataFrame, canon: DataFrame, aliases: DataFrame, refs: DataFrame, least: float, tenant: str | None = None) -> Blocks:
    """All candidates of entities that score `least` or more (above 0), with scoring.score()'s scores without graph evidence and cosines."""
    none = F.array().cast("array<string>")
    own = matching.own_canonicals(entities, refs).groupBy("entity_id").agg(F.array_sort(F.collect_set("canonical_id")).alias("own"))
    asked = entities.where("entity_id is not null").select("entity_id", F.col("normalized_name").alias("entity_name"), F.col("category").alias("source_category"))
    asked = asked.distinct().join(own, "entity_id", "left").withColumn("own", F.coalesce("own", none))
    left, lefts = _kinds(asked, "entity_id", ("entity_name", "source_category", "own"), "left")
    owned = written(lefts.select(F.explode("own").alias("canonical_id")).distinct().withColumn("owned", F.col("canonical_id")))
    others = registry.other_aliases(canon, aliases, tenant).groupBy("canonical_id").agg(F.array_sort(F.collect_set("value")).alias("others"))
    known = registry.of_tenant(canon, tenant).where("canonical_id is not null").select("canonical_id", "canonical_name").distinct()
    known = known.join(others, "canonical_id", "left").withColumn("others", F.coalesce("others", none)).join(beside(owned), "canonical_id", "left")
    right, rights = _kinds(known, "canonical_id", ("canonical_name", "others", "owned"), "right")

    values = rights.select("right", F.explode(F.array_union(F.array("canonical_name"), "others")).alias("value")).where("value <> ''")
    met = kinds.Met(lefts.select("left", "entity_name"), values, matching.all_marks)
    barred = lefts.select("left", F.explode("own").alias("owned")).join(rights.select("right", "owned"), "owned").select("left", "right")
    pairs = met.keys().select("left", "right").join(beside(written(barred)), ["left", "right"], "left_anti")

    # names that are measured: a stands for a name and category of entities, b for a name of canonicals
    spelled = [F.col("entity_name").eqNullSafe(F.col("a_name")), F.col("source_category").eqNullSafe(F.col("a_category"))]
    a = written(lefts.select(F.col("entity_name").alias("a_name"), F.col("source_category").alias("a_category")).distinct().select("*", grams(F.col("a_name")).alias("x"),
        _short(F.col("a_name")).alias("a_short"), F.monotonically_increasing_id().alias("a")))
    b = rights.groupBy(F.col("canonical_name").alias("b_name")).agg(F.max(_short(F.col("canonical_name")) | F.exists("others", _short)).alias("b_short"))
    b = written(b.select("*", grams(F.col("b_name")).alias("y"), F.monotonically_increasing_id().alias("b")))
    of_left = written(lefts.join(beside(a), spelled).select("left", "a"))
    of_right = written(rights.join(beside(b), F.col("canonical_name").eqNullSafe(F.col("b_name"))).select("right", "b"))
    rows = written(pairs.join(beside(of_left), "left").join(beside(of_right), "right"))
    full = (F.trim("a_name") != "") & (F.trim("b_name") != "")

    # a, right: an alias is close enough; each name and alias are compared once
    told = rights.select("right", "canonical_name", F.explode("others").alias("value"))
    v = written(told.select("value").distinct().withColumn("v", F.monotonically_increasing_id()))
    told = written(told.where(F.lower(F.trim("value")) != F.lower(F.trim("canonical_name"))).join(beside(v), "value").select("right", "v"))
    near = rows.select("a", "right").join(beside(told), "right").select("a", "v").repartition(met.n, "a", "v").distinct()
    near = near.join(beside(a.select("a", "a_name")), "a").join(beside(v), "v").where("trim(a_name) <> ''").withColumn("m", string_metrics("token_set", "jaro_winkler")("a_name", "value"))
    near = written(near.where(F.greatest("m.token_set", "m.jaro_winkler") > ALIAS_THRESHOLD).select("a", "v"))
    boosted = written(near.join(beside(told), "v").select("a", "right").distinct())

    # the dearest metric is left to pairs that can still reach `least` by it
    w = weights_of(F.col("a_category"), flipped(F.col("a_category")))
    up = written(boosted.join(of_right, "right").select("a", "b").distinct().withColumn("up", F.lit(True)))
    names = rows.select("a", "b").repartition(met.n, "a", "b").distinct().join(beside(up), ["a", "b"], "left")
    names = names.join(beside(a), "a").join(beside(b), "b").where(full).withColumn("jaccard", grams_jaccard(F.col("x"), F.col("y")))
    names = names.withColumn("m", string_metrics("token_sort", "token_set", "jaro_winkler")("a_name", "b_name")).withColumn("w", w)
    begun = F.col("w.token_sort") * F.col("m.token_sort") / 100.0 + F.col("w.token_set") * F.col("m.token_set") / 100.0
    ended = lambda rest: rest + F.col("w.jaro_winkler") * F.col("m.jaro_winkler") / 100.0 + F.col("w.jaccard") * F.col("jaccard")
    most = ended(begun + F.col("w.partial")) + F.when(F.col("up"), F.col("w.alias_boost")).otherwise(0.0) + F.when(F.col("a_short") | F.col("b_short"), F.col("w.abbreviation")).otherwise(0.0)
    names = names.where(most >= least - 1e-9).withColumn("p", string_metrics("partial")("a_name", "b_name"))
    measured = written(names.select("a", "b", ended(begun + F.col("w.partial") * F.col("p.partial") / 100.0).alias("weighed"), F.col("w.alias_boost").alias("boost"),
        F.col("w.abbreviation").alias("code"), (F.col("a_short") | F.col("b_short")).alias("short")))

    out = written(rows.join(measured.hint("shuffle_hash"), ["a", "b"]).join(boosted.withColumn("near", F.lit(True)), ["a", "right"], "left"))
    coded = out.where("short").select("left", "right").join(beside(lefts), "left").join(beside(rights), "right")
    coded = coded.where(short_code(F.col("entity_name"), F.col("canonical_name"), F.col("others"), F.col("source_category"), flipped(F.col("source_category"))))
    out = out.join(beside(written(coded.select("left", "right", F.lit(True).alias("coded")))), ["left", "right"], "left")
    total = F.col("weighed") + F.when(F.col("near"), F.col("boost")).otherwise(0.0) + F.when(F.col("coded"), F.col("code")).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    return Blocks(left, right, written(out.select("left", "right", score.alias("score")).where(F.col("score") >= least)))
