"""Pairwise scores of entities and candidates, from string metrics, an alias boost, a short-code bonus and graph evidence."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.similarity import string_metrics, tokens, trigram_jaccard
from samewise.operators import registry
from samewise.operators.graph import written
from samewise.operators.kinds import beside, small


@dataclass(frozen=True)
class Weights:
    token_sort: float = 0.25
    token_set: float = 0.25
    partial: float = 0.15
    jaro_winkler: float = 0.10
    jaccard: float = 0.10
    alias_boost: float = 0.15
    abbreviation: float = 0.0
    profile_id: str = "default_v1"


#: The profiles, the boost's threshold, the short code's length, and the graph bonuses (a neighbour, at most).
DEFAULT = Weights()
PROFILES = {("accounting", "psa"): Weights(abbreviation=0.20, profile_id="psa_accounting_v1"),
    ("psa", "accounting"): Weights(abbreviation=0.20, profile_id="psa_accounting_v1")}
ALIAS_THRESHOLD, SHORT_CODE = 85.0, 4
PERSON_BONUS, NEIGHBOUR_BONUS = (0.05, 0.10), (0.025, 0.10)


def weights_of(source: Column, target: Column) -> Column:
    """The weights of a pair of categories as a struct."""

    def struct(w: Weights) -> Column:
        return F.struct(*[F.lit(getattr(w, f.name)).alias(f.name) for f in fields(w)])

    return F.coalesce(*[F.when((source == s) & (target == t), struct(w)) for (s, t), w in PROFILES.items()], struct(DEFAULT))


def flipped(category: Column) -> Column:
    """The category a candidate is taken to have: the other one of accounting and psa."""
    return F.when(category == "accounting", "psa").when(category == "psa", "accounting").otherwise(category)


def alias_boosts(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """entity_name, canonical_id of pairs (entity_name, canonical_id, canonical_name) of which an alias (others: canonical_id, value) is close enough."""
    near = pairs.join(others,
        "canonical_id").where(F.lower(F.trim("value")) != F.lower(F.trim("canonical_name")))
    scored = near.select("entity_name", "value").where("entity_name <> ''").distinct().withColumn("m",
        string_metrics("token_set", "jaro_winkler")("entity_name", "value")).where(F
        .greatest("m.token_set", "m.jaro_winkler") > ALIAS_THRESHOLD)
    return near.join(scored.select("entity_name", "value"), ["entity_name", "value"], "left_semi").select("entity_name",
        "canonical_id").distinct()


def abbreviates(code: Column, name: Column) -> Column:
    """Whether a code of 1 to 4 characters begins a token of the name or is its initials."""
    c, words = F.lower(F.trim(code)), tokens(F.lower(F.trim(name)))
    initials = F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")
    short = (F.length(code) > 0) & (F.length(code) <= SHORT_CODE)
    return F.coalesce(short & (c != "") & (F.size(words) > 0) & (F.exists(words, lambda t: F.startswith(t, c)) | (initials == c)),
        F.lit(False))


def short_code(entity: Column, candidate: Column, aliases: Column, source: Column, target: Column) -> Column:
    """The short-code bonus: between accounting and psa, with the code on the psa side."""
    mixed = ((source == "accounting") & (target == "psa")) | ((source == "psa") & (target == "accounting"))
    by_alias = F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: abbreviates(a, entity))
    return mixed & (((source == "psa") & abbreviates(entity, candidate))
        | ((target == "psa") & (abbreviates(candidate, entity) | by_alias)))


def score(pairs: DataFrame, entities: DataFrame, canon: DataFrame, aliases: DataFrame, edges: DataFrame, tenant: str | None = None,
    resolved: DataFrame | None = None, cosines: DataFrame | None = None, cosine_weight: float = 0.0) -> DataFrame:
    """entity_id, canonical_id, the signals, bonuses, weight_profile_id, category_pair and score of pairs (entity_id, canonical_id).

    resolved: entity_id, source_canonical_id of entities that already have a canonical, which alone get graph evidence.
    cosines: entity_id, canonical_id, cosine of embeddings, which count by cosine_weight; 0 where there is none.
    Candidates that the registry doesn't know are left out. Entities of the same name, category and canonical have the same signals with a
    candidate, so all but cosines is worked out for each of these kinds, and each distinct pair of names is measured once."""
    own = entities.select("entity_id", F.col("normalized_name").alias("entity_name"), F.col("category").alias("source_category"))
    if resolved is None:
        own = own.withColumn("source_canonical_id", F.lit(None).cast("string"))
    else:
        own = own.join(resolved.select("entity_id", "source_canonical_id"), "entity_id", "left")
    own = written(own)
    alike = ("entity_name", "source_category", "source_canonical_id")
    kinds = written(own.select(*alike).distinct().withColumn("kind", F.monotonically_increasing_id()))
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"kinds.{c}")) for c in alike]
    own = written(own.alias("own").join(kinds.alias("kinds"), same).select("own.entity_id", "kind"))
    said = written(pairs.select("entity_id", "canonical_id").distinct().join(beside(own), "entity_id"))
    names = registry.of_tenant(canon, tenant).select("canonical_id", "canonical_name")
    # candidates are few beside the registry: they go to it, and what follows reads the candidates' names alone
    rows = names.join(beside(written(said.select("kind", "canonical_id").distinct())), "canonical_id").join(beside(kinds), "kind")
    rows = written(rows.withColumn("target_category", flipped(F.col("source_category"))))
    known = written(rows.select("canonical_id", "canonical_name").distinct())
    near = written(registry.other_aliases(beside(known), aliases))
    full = (F.trim("entity_name") != "") & (F.trim("canonical_name") != "")
    measured = rows.where(full).select("entity_name", "canonical_name").distinct().withColumn("m",
        string_metrics()("entity_name", "canonical_name"))
    measured = measured.withColumn("jaccard", trigram_jaccard(F.col("entity_name"), F.col("canonical_name")))
    boosts = alias_boosts(rows.where(full).select("entity_name", "canonical_id", "canonical_name").distinct(),
        near).withColumn("boost", F.lit(True))
    others = near.groupBy("canonical_id").agg(F.collect_set("value").alias("aliases"))
    rows = rows.join(measured, ["entity_name", "canonical_name"], "left").join(boosts, ["entity_name", "canonical_id"],
        "left").join(others, "canonical_id", "left")
    if resolved is None:
        rows = rows.withColumn("shared", F.lit(0)).withColumn("shared_persons", F.lit(0))
    else:
        asked = rows.where("source_canonical_id is not null").select(F.col("source_canonical_id").alias("left_id"),
            F.col("canonical_id").alias("right_id"))
        counts = registry.shared_neighbours(asked, edges, canon,
            tenant).withColumnsRenamed({"left_id": "source_canonical_id", "right_id": "canonical_id"})
        rows = rows.join(counts, ["source_canonical_id", "canonical_id"], "left").na.fill(0, ["shared", "shared_persons"])
    rows = rows.withColumn("w", weights_of(F.col("source_category"), F.col("target_category"))).withColumn("full", full)
    zero = lambda c: F.when(F.col("full"), c).otherwise(F.lit(0.0))
    rows = rows.select(
        "kind", "canonical_id",
            *(zero(F.col(f"m.{k}")).alias(k) for k in ("token_sort", "token_set", "partial", "jaro_winkler")),
            zero(F.col("jaccard")).alias("jaccard"),
        (F.col("full") & F.coalesce("boost", F.lit(False))).alias("alias_boost"),
            (F.col("full")
            & short_code(F.col("entity_name"), F.col("canonical_name"), F.col("aliases"), F.col("source_category"),
            F.col("target_category"))).alias("abbreviation"),
        zero(F.least(F.lit(PERSON_BONUS[1]), PERSON_BONUS[0] * F.col("shared_persons"))).alias("person_bonus"),
            zero(F.least(F.lit(NEIGHBOUR_BONUS[1]), NEIGHBOUR_BONUS[0] * F.col("shared"))).alias("neighbour_bonus"),
        "w", "full", "source_category", "target_category",
    )
    weighed = F.col("w.token_sort") * F.col("token_sort") / 100.0 + F.col("w.token_set") * F.col("token_set") / 100.0 + F.col("w.partial") * F.col("partial") / 100.0 + F.col("w.jaro_winkler") * F.col("jaro_winkler") / 100.0 + F.col("w.jaccard") * F.col("jaccard")
    total = weighed + F.when(F.col("alias_boost"), F.col("w.alias_boost")).otherwise(0.0) + F.when(F.col("abbreviation"),
        F.col("w.abbreviation")).otherwise(0.0) + F.col("person_bonus") + F.col("neighbour_bonus")
    told = rows.withColumn("total", total).withColumn("weight_profile_id", F.col("w.profile_id")).withColumn("category_pair",
        F.concat_ws(":", "source_category", "target_category")).drop("w", "source_category", "target_category")
    # told holds all signals of a kind: its rows say how large it is, its file doesn't
    out = said.join(beside(written(told)), ["kind", "canonical_id"])
    if cosines is None:
        out = out.withColumn("cosine", F.lit(0.0))
    else:
        out = out.join(cosines.groupBy("entity_id", "canonical_id").agg(F.max("cosine").alias("cosine")), ["entity_id", "canonical_id"],
            "left").na.fill(0.0, ["cosine"])
    out = out.withColumn("cosine", zero(F.col("cosine")))
    score = zero(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("total") + cosine_weight * F.col("cosine"))))
    return out.select("entity_id", "canonical_id", "token_sort", "token_set", "partial", "jaro_winkler", "jaccard", "cosine", "alias_boost", "abbreviation",
        "person_bonus", "neighbour_bonus", score.alias("score"), "weight_profile_id", "category_pair")
