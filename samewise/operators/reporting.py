"""Reports: receivables, coverage, automatic matches, approvals, audit and connector status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tolerance of a receivable, as a share of what is invoiced and at most.
TOLERANCE = (0.02, 500.0)


def receivables(labor: DataFrame, invoices: DataFrame) -> DataFrame:
    """canonical_id, labor, invoiced, variance, tolerance, status: each fact is summed before they meet, so that none fans out.

    labor, invoices: canonical_id, amount."""
    left = labor.groupBy("canonical_id").agg(F.sum("amount").alias("labor"))
    right = invoices.groupBy("canonical_id").agg(F.sum("amount").alias("invoiced"))
    rows = left.join(right, "canonical_id", "full").na.fill(0.0, ["labor", "invoiced"])
    rows = rows.withColumn("variance", F.col("labor") - F.col("invoiced")).withColumn("tolerance",
        F.least(F.lit(TOLERANCE[0]) * F.col("invoiced"), F.lit(TOLERANCE[1])))
    return rows.withColumn("status",
        F.when(F.abs("variance") <= F.col("tolerance"), "MATCHED").when(F.col("variance") > 0, "UNBILLED").otherwise("OVERBILLED"))


def coverage(canon: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities, covered (with aliases of two categories or more), coverage: one row."""
    wide = aliases.groupBy("canonical_id").agg(F.countDistinct("category").alias("n")).where("n >= 2").select("canonical_id")
    flagged = canon.select("canonical_id").distinct().join(wide.withColumn("wide", F.lit(1)), "canonical_id", "left")
    return flagged.agg(F.count("*").alias("entities"), F.coalesce(F.sum("wide"), F.lit(0)).alias("covered")).withColumn("coverage",
        F.try_divide("covered", "entities"))


def automatic(decisions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """resolved, automatic, rate over the decisions (action, decided_at) of the last `days` days: one row."""
    recent = decisions.where((F.col("decided_at") > now - F.expr(f"interval {days} days")) & (F.col("decided_at") <= now))
    return recent.agg(F.count("*").alias("resolved"),
        F.count_if(F.col("action") == "AUTO_APPROVE").alias("automatic")).withColumn("rate", F.try_divide("automatic", "resolved"))


def browse(canon: DataFrame, aliases: DataFrame, text: str | None = None) -> DataFrame:
    """canonical_id, canonical_name, n_aliases, categories of canonicals whose name or alias holds the text."""
    held = aliases.groupBy("canonical_id").agg(F.countDistinct("value").alias("n_aliases"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max(F.contains(F.lower("value"), F.lit((text or "").lower()))).alias("hit"))
    rows = canon.select("canonical_id", "canonical_name").join(held, "canonical_id", "left")
    if text:
        rows = rows.where(F.contains(F.lower("canonical_name"), F.lit(text.lower())) | F.col("hit"))
    return rows.select("canonical_id", "canonical_name", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"),
        F.coalesce("categories", F.lit("")).alias("categories"))


def pending(dispositions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the approval queue: by score, then entity."""
    return dispositions.where("action = 'QUEUE_FOR_REVIEW'").orderBy(F.desc("top_score"), "entity_id").offset(offset).limit(limit)


def decided(dispositions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """entity_id, canonical_id, disposition, ready for resolution, of the queue's entities that have a verdict.

    verdicts: entity_id, verdict (approve, reject, correct), canonical_id (of a correction). A verdict
    on what isn't queued, or of another kind, decides nothing."""
    rows = dispositions.where("action = 'QUEUE_FOR_REVIEW'").join(verdicts
        .where(F.col("verdict").isin("approve", "reject", "correct"))
        .select("entity_id", "verdict", F.col("canonical_id").alias("other")), "entity_id")
    return rows.select("entity_id",
        F.when(F.col("verdict") == "correct", F.col("other")).otherwise(F.col("top_match")).alias("canonical_id"),
        F.when(F.col("verdict") == "reject", "rejected").otherwise("confirmed").alias("disposition"))


def audit(log: DataFrame, start, end, actor: str | None = None, category: str | None = None) -> DataFrame:
    """The log's rows from start to end, both included, of an actor and category if given, newest first."""
    rows = log.where(F.col("at").between(F.lit(start), F.lit(end)))
    for column, value in (("actor", actor), ("category", category)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("at"))


def connector_status(log: DataFrame) -> DataFrame:
    """category, last_sync, n_entities, n_errors of a sync log (category, at, entity_id, error)."""
    return log.groupBy("category").agg(F.max("at").alias("last_sync"), F.countDistinct("entity_id").alias("n_entities"),
        F.count("error").alias("n_errors"))


def summary(dispositions: DataFrame, matches: DataFrame) -> DataFrame:
    """kind, name, n: entities by action and by kind of deterministic match."""
    actions = dispositions.groupBy(F.col("action").alias("name")).agg(F.count("*").alias("n")).select(F.lit("action").alias("kind"),
        "name", "n")
    kinds = matches.where("match_key_type is not null").groupBy(F.col("match_key_type").alias("name")).agg(F.count("*")
        .alias("n")).select(F.lit("match").alias("kind"), "name", "n")
    return actions.unionByName(kinds)
