"""Reads of the canonical registry: aliases, anchors, references, neighbours and same-as links, all set-oriented.

Frames: canon (canonical_id, tenant_id, canonical_name, entity_type, entity_category), aliases (canonical_id, value, source,
category, confidence), refs (canonical_id, source, category, external_id, external_fields), edges (source_node, target_node,
relationship). A tenant of None filters nothing; else only canonicals of that tenant count, on both ends of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.operators.graph import written
from samewise.operators.kinds import beside, parts


def of_tenant(canon: DataFrame, tenant: str | None) -> DataFrame:
    return canon if tenant is None else canon.where(F.col("tenant_id") == tenant)


def _within(rows: DataFrame, canon: DataFrame, tenant: str | None, *keys: str) -> DataFrame:
    if tenant is None:
        return rows
    ids = of_tenant(canon, tenant).select("canonical_id")
    for k in keys:
        rows = rows.join(ids.withColumnRenamed("canonical_id", k), k, "left_semi")
    return rows


def names(canon: DataFrame, aliases: DataFrame, tenant: str | None = None) -> DataFrame:
    """canonical_id, value, confidence: names and aliases as they come, repeated ones too; a null confidence is 1."""
    own = of_tenant(canon, tenant).select("canonical_id", F.col("canonical_name").alias("value"), F.lit(1.0).alias("confidence"))
    other = _within(aliases, canon, tenant, "canonical_id").select("canonical_id", "value",
        F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    return own.unionByName(other).where("value <> ''")


def seeds(canon: DataFrame, aliases: DataFrame, tenant: str | None = None) -> DataFrame:
    """canonical_id, value, confidence: names and aliases, the highest confidence of each; a null confidence is 1."""
    return names(canon, aliases, tenant).groupBy("canonical_id", "value").agg(F.max("confidence").alias("confidence"))


def alias_hits(entities: DataFrame, canon: DataFrame, aliases: DataFrame, tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id, confidence: names equal to the entity's normalized_name."""
    named = entities.select("entity_id", F.col("normalized_name").alias("value"))
    return named.join(seeds(canon, aliases, tenant), "value").select("entity_id", "canonical_id", "confidence")


def text_field(payload: Column, *path: str) -> Column:
    """A string under a path of a JSON text; null for bad JSON, other kinds and missing keys."""
    return text_under(F.try_parse_json(payload), *path)


def text_under(value: Column, *path: str) -> Column:
    """A string under a path of a variant; null for other kinds and missing keys."""
    at = "$." + ".".join(path)
    return F.when(F.schema_of_variant(F.try_variant_get(value, at, "variant")) == "STRING", F.try_variant_get(value, at, "string"))


def scalar_field(payload: Column, *path: str) -> Column:
    """A non-null scalar under a path of a JSON text, as text."""
    return F.try_variant_get(F.try_parse_json(payload), "$." + ".".join(path), "string")


def email_hits(entities: DataFrame, canon: DataFrame, refs: DataFrame, tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id: references whose e-mail equals the entity's, trimmed and in lower case."""
    own = entities.select("entity_id", F.lower(F.trim("email")).alias("email")).where("email <> ''")
    rows = _within(refs.where(F.col("external_fields").contains('"email"')), canon, tenant, "canonical_id")
    anchors = rows.select("canonical_id",
        F.lower(F.trim(text_field(F.col("external_fields"), "email"))).alias("email")).where("email <> ''").distinct()
    return own.join(anchors, "email").select("entity_id", "canonical_id")


def employee_hits(entities: DataFrame, canon: DataFrame, refs: DataFrame, tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id: references whose employee id equals the entity's, trimmed, case kept."""
    own = entities.select("entity_id", F.trim("employee_id").alias("employee_id")).where("employee_id <> ''")
    rows = _within(refs.where(F.col("external_fields").contains('"employee_id"')), canon, tenant, "canonical_id")
    anchors = rows.select("canonical_id",
        F.trim(scalar_field(F.col("external_fields"), "employee_id")).alias("employee_id")).where("employee_id <> ''").distinct()
    return own.join(anchors, "employee_id").select("entity_id", "canonical_id")


def other_aliases(canon: DataFrame, aliases: DataFrame, tenant: str | None = None) -> DataFrame:
    """canonical_id, value: aliases that are neither empty nor the canonical name."""
    names = of_tenant(canon, tenant).select("canonical_id", "canonical_name")
    return aliases.select("canonical_id", "value").join(names,
        "canonical_id").where("value <> '' and value <> canonical_name").select("canonical_id", "value").distinct()


def neighbours(edges: DataFrame, canon: DataFrame, tenant: str | None = None, n: int | None = None) -> DataFrame:
    """node, neighbour: distinct, in both directions; n: partitions, by node, which they are made distinct in."""
    rows = _within(edges, canon, tenant, "source_node", "target_node")
    both = rows.select(F.col("source_node").alias("node"), F.col("target_node").alias("neighbour"))
    both = both.union(rows.select("target_node", "source_node"))
    return (both if n is None else both.repartition(n, "node")).distinct()


def shared_neighbours(pairs: DataFrame, edges: DataFrame, canon: DataFrame, tenant: str | None = None) -> DataFrame:
    """left_id, right_id, shared, shared_persons of pairs (left_id, right_id); pairs that share none get 0."""
    n = parts(edges)
    near = neighbours(edges, canon, tenant, n)
    asked = written(pairs.select("left_id", "right_id").distinct())
    # a number of partitions that is asked for is not cut down by bytes, so that a task sorts its share of rows alone
    left = asked.repartition(n, "left_id").join(near.withColumnRenamed("node", "left_id"), "left_id")
    # of right nodes only the neighbours are looked at, not those of every node
    right = near.join(beside(written(asked.select(F.col("right_id").alias("node")).distinct())), "node", "left_semi").withColumnRenamed("node", "right_id")
    at = (n, "right_id", "neighbour")
    both = left.repartition(*at).join(right.repartition(*at).hint("merge"), ["right_id", "neighbour"])
    kinds = canon.select(F.col("canonical_id").alias("neighbour"), (F.col("entity_category") == "person").alias("person")).hint("merge")
    counts = both.join(kinds, "neighbour", "left").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"),
        F.count_if("person").alias("shared_persons"))
    return asked.join(counts, ["left_id", "right_id"], "left").na.fill(0, ["shared", "shared_persons"])


def same_as(edges: DataFrame, canon: DataFrame, tenant: str | None = None) -> DataFrame:
    """low, high: distinct pairs of different nodes with a SAME_AS edge in either direction."""
    rows = _within(edges.where("relationship = 'SAME_AS' and source_node <> target_node"), canon, tenant, "source_node", "target_node")
    return rows.select(F.least("source_node", "target_node").alias("low"),
        F.greatest("source_node", "target_node").alias("high")).distinct()


def with_references(canon: DataFrame, refs: DataFrame) -> DataFrame:
    """canon with system_references: a JSON object by source, null without references; of one source the last external_id stands."""
    one = refs.groupBy("canonical_id", "source").agg(F.max(F.struct("external_id", "category", "external_fields")).alias("r"))
    entry = F.struct("source",
        F.struct(F.col("r.category").alias("category"), F.col("r.external_fields").alias("external_fields"),
        F.col("r.external_id").alias("external_id")).alias("of"))
    held = one.groupBy("canonical_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("system_references"))
    return canon.join(held, "canonical_id", "left")


def violations(canon: DataFrame, aliases: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, key: rows that break the store's keys, checks and references."""
    ids = canon.select("canonical_id")

    def orphans(rows: DataFrame, key: str, rule: str) -> DataFrame:
        # each key is looked for once, however many rows have it
        return rows.select(F.col(key).alias("canonical_id")).distinct().join(ids, "canonical_id",
            "left_anti").select(F.lit(rule).alias("rule"), F.col("canonical_id").alias("key"))

    def doubled(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
        return rows.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"))

    kinds = canon.where("entity_category not in ('organization', 'person')").select(F.lit("entity_category").alias("rule"),
        F.col("canonical_id").alias("key"))
    parts = [orphans(aliases, "canonical_id", "alias_orphan"), orphans(refs, "canonical_id", "reference_orphan"),
        orphans(edges, "source_node", "edge_orphan"), orphans(edges, "target_node", "edge_orphan"),
        doubled(canon, ["canonical_id"], "canonical_unique"), doubled(aliases, ["canonical_id", "value", "source"], "alias_unique"),
        doubled(refs, ["source", "external_id"], "reference_unique"), kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
