"""Deterministic anchors and blocking. Entities: entity_id, normalized_name, entity_category, source, source_id, email, employee_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions.similarity import tokens, trigrams
from samewise.operators import kinds, registry
from samewise.operators.graph import written

#: Confidences and the number of candidates.
ALIAS_CEILING, EMAIL_CONFIDENCE, EMPLOYEE_CONFIDENCE, MOST_CANDIDATES = 0.99, 0.99, 1.0, 50


def _single(hits: DataFrame, kind: str) -> DataFrame:
    """entity_id, struct of the hit where an entity has exactly one; more are a collision and match nothing."""
    own = hits.groupBy("entity_id", "canonical_id").agg(F.max("confidence").alias("confidence"))
    one = own.groupBy("entity_id").agg(F.count("*").alias("n"), F.first("canonical_id").alias("canonical_id"),
        F.first("confidence").alias("confidence")).where("n = 1")
    return one.select("entity_id", F.struct("canonical_id", "confidence", F.lit(kind).alias("match_key_type")).alias(kind))


def deterministic(entities: DataFrame, canon: DataFrame, aliases: DataFrame, refs: DataFrame, tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id, confidence, match_key_type: by alias, else e-mail, else employee id; nulls where none is unique."""
    people = entities.where("entity_category = 'person'")
    by_alias = registry.alias_hits(entities, canon, aliases, tenant).withColumn("confidence",
        F.least(F.col("confidence"), F.lit(ALIAS_CEILING)))
    persons = canon.where("entity_category = 'person'").select("canonical_id")
    by_email = registry.email_hits(people, canon, refs, tenant).join(persons, "canonical_id", "left_semi").withColumn("confidence",
        F.lit(EMAIL_CONFIDENCE))
    by_id = registry.employee_hits(people, canon, refs, tenant).withColumn("confidence", F.lit(EMPLOYEE_CONFIDENCE))
    out = entities.select("entity_id")
    for hits, kind in ((by_alias, "alias"), (by_email, "email"), (by_id, "employee_id")):
        out = out.join(_single(hits, kind), "entity_id", "left")
    return out.select("entity_id", F.coalesce("alias", "email", "employee_id").alias("hit")).select("entity_id", "hit.*")


def _signalled(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, signal: the distinct tokens and trigrams of each key's names."""
    return rows.where(F.trim(name) != "").select(key, F.explode(F.array_distinct(all_marks(F.col(name)))).alias("signal")).distinct()


def signals(entities: DataFrame, canon: DataFrame, aliases: DataFrame, tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id, signal: tokens and trigrams that the entity's name shares with a canonical's names."""
    index = _signalled(registry.seeds(canon, aliases, tenant), "canonical_id", "value")
    return _signalled(entities, "entity_id", "normalized_name").join(index, "signal").select("entity_id", "canonical_id", "signal")


def token_marks(name):
    return F.transform(tokens(name), lambda t: F.concat(F.lit("token:"), t))


def trigram_marks(name):
    return F.transform(trigrams(name), lambda t: F.concat(F.lit("trigram:"), t))


def all_marks(name):
    return F.concat(token_marks(name), trigram_marks(name))


def met(entities: DataFrame, canon: DataFrame, aliases: DataFrame, marks=token_marks, tenant: str | None = None) -> kinds.Met:
    """Entities and canonicals whose names share a token, or a trigram, by kinds of names."""
    return kinds.Met(entities.select("entity_id", "normalized_name"), registry.names(canon, aliases, tenant).select("canonical_id", "value"), marks)


def own_canonicals(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """entity_id, canonical_id: canonicals that already hold the entity's record."""
    own = entities.select("entity_id", "source", F.col("source_id").alias("external_id"))
    return own.join(refs.select("canonical_id", "source", "external_id"), ["source", "external_id"]).select("entity_id",
        "canonical_id").distinct()


def candidates(entities: DataFrame, canon: DataFrame, aliases: DataFrame, refs: DataFrame, tenant: str | None = None,
    most: int = MOST_CANDIDATES, most_bytes: int = 64 << 20) -> DataFrame:
    """entity_id, canonical_id, blocking_signals: the first `most` canonicals by id that share a signal, but for the entity's own.

    Keys of the same names share the same signals, so kinds of names meet, and a kind of entities gets its first canonicals once: `most`,
    and as many more as the entity with most canonicals of its own has. An entity takes its kind's list but for its own canonicals. Pairs
    of keys come where they are read; they are neither shuffled nor sorted, and signals that nobody reads aren't joined."""
    everyone = entities.where("entity_id is not null").select("entity_id", "normalized_name")
    seeds = registry.names(canon, aliases, tenant).where("canonical_id is not null").select("canonical_id", "value")
    found = kinds.Met(everyone, seeds, all_marks)
    own = written(own_canonicals(entities, refs).groupBy("entity_id").agg(F.collect_set("canonical_id").alias("own")))
    more = own.agg(F.coalesce(F.max(F.size("own")), F.lit(0))).first()[0]
    near = written(found.lists(most + more))
    rows = found.left.repartition(found.n, "entity_id").join(own, "entity_id", "left")
    few = kinds.small(near, most_bytes)
    if few is near:
        few = near.repartition(found.n, "left_kind").hint("shuffle_hash")
    others = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ~F.array_contains(F.coalesce("own", F.array().cast("array<string>")), F.col("ids")[i]))
    rows = rows.join(few, "left_kind").select("entity_id", "ids", "signals", F.explode(F.slice(others, 1, most)).alias("at"))
    return rows.select("entity_id", F.col("ids")[F.col("at")].alias("canonical_id"), F.col("signals")[F.col("at")].alias("blocking_signals"))
