"""The whole match, a stage after another, each kept under its name in the run's folder, so that a run that was stopped goes on there.

A stage's table is put in place by one rename (sources.commits): a stage that is there is whole, and the list of them is the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import assess, blocks, disposition, matching, resolution, scoring
from samewise.operators.graph import written
from samewise.operators.kinds import beside
from samewise.sources import commits

DONE = "done"
STAGES = ("entities", "anchored", "left", "candidates", "scores", "placed", "assessed", "results", "nodes", "references", "aliases", "edges", "training", "calls", "audit")
SIGNALS = ("token_sort", "token_set", "partial", "jaro_winkler", "jaccard", "cosine", "alias_boost", "abbreviation", "person_bonus", "neighbour_bonus", "weight_profile_id")


class Run:
    """A run of named stages in a folder; `made` are those that this process worked out."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []

    def finished(self) -> list[str]:
        return [s for s in STAGES if commits.has_batch(self.spark, f"{self.folder}/{s}", DONE)]

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; build() is asked for it only if it isn't there."""
        at = f"{self.folder}/{name}"
        if not commits.has_batch(self.spark, at, DONE):
            commits.append_once(build(), at, DONE)
            self.made.append(name)
        return self.spark.read.parquet(f"{at}/batch={DONE}")


def match(run: Run, entities: DataFrame, canon: DataFrame, aliases: DataFrame, refs: DataFrame, edges: DataFrame, at: str, actor: str = "pipeline",
    tenant: str | None = None, client: Callable[[str], dict] = assess.offline) -> dict[str, DataFrame]:
    """All stages by name. entities: normalized. at: the time of the run, for the audit log.

    results: entity_id, canonical_id (of the match, or of the new node), confidence, match_type (deterministic, scored, llm, new), action,
    signal_breakdown (JSON of the best candidate's signals), reasoning. A pair that a model was asked about is queued for review, whatever it
    said. What is certain or approved is resolved, and so is what matches nothing; what is queued waits for a verdict."""
    out: dict[str, DataFrame] = {}

    def stage(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        out[name] = run.stage(name, build)
        return out[name]

    own = stage("entities", lambda: entities)
    anchored = stage("anchored", lambda: matching.deterministic(own, canon, aliases, refs, tenant).where("canonical_id is not null"))
    left = stage("left", lambda: own.join(anchored, "entity_id", "left_anti"))
    pairs = stage("candidates", lambda: matching.candidates(left, canon, aliases, refs, tenant))
    scores = stage("scores", lambda: scoring.score(pairs, left, canon, aliases, edges, tenant))
    placed = stage("placed", lambda: disposition.dispose(left, scores, edges, canon, tenant))
    asked = stage("assessed", lambda: assess.assess(assess.prompts(placed, left, canon, aliases, refs, tenant), client))
    results = stage("results", lambda: _results(anchored, placed, asked, scores, own))
    said = results.where("action in ('MATCHED', 'AUTO_APPROVE', 'NO_MATCH')").select("entity_id", F.when(F.col("match_type") != "new", F.col("canonical_id")).alias("canonical_id"),
        F.when(F.col("match_type") == "new", "new").otherwise("confirmed").alias("disposition"))
    made = resolution.resolve(said, own, aliases, edges, scores)
    for name in ("nodes", "references", "aliases", "edges", "training"):
        stage(name, lambda name=name: made[name])
    stage("calls", lambda: assess.training_rows(asked, tenant))
    stage("audit", lambda: resolution.audit_rows(said, at, actor, "matching"))
    return out


def _results(anchored: DataFrame, placed: DataFrame, asked: DataFrame, scores: DataFrame, entities: DataFrame) -> DataFrame:
    sure = anchored.select("entity_id", "canonical_id", "confidence", F.lit("deterministic").alias("match_type"), F.lit("MATCHED").alias("action"),
        F.to_json(F.struct("match_key_type", "confidence")).alias("signal_breakdown"), F.lit(None).cast("string").alias("reasoning"))
    parts = [c for c in SIGNALS if c in scores.columns]
    # an entity's best candidate alone is told of
    best = beside(written(placed.where("top_match is not null").select("entity_id", "top_match")))
    told = written(scores.withColumnRenamed("canonical_id", "top_match").join(best, ["entity_id", "top_match"]).select("entity_id", "top_match",
        F.to_json(F.struct(*parts)).alias("signal_breakdown")))
    llm, none = F.col("action") == "LLM_FALLBACK", F.col("action") == "NO_MATCH"
    rows = placed.join(beside(told), ["entity_id", "top_match"], "left").join(asked.select("entity_id", "reasoning"), "entity_id", "left")
    rows = rows.join(entities.select("entity_id", resolution.canonical_id(F.col("source"), F.col("source_id")).alias("new_id")), "entity_id")
    rest = rows.select("entity_id", F.when(none, F.col("new_id")).otherwise(F.col("top_match")).alias("canonical_id"), F.when(~none, F.col("top_score")).alias("confidence"),
        F.when(none, "new").when(llm, "llm").otherwise("scored").alias("match_type"), F.when(llm, "QUEUE_FOR_REVIEW").otherwise(F.col("action")).alias("action"),
        "signal_breakdown", F.when(llm, F.col("reasoning")).alias("reasoning"))
    return sure.unionByName(rest)


def decided(entities: DataFrame, canon: DataFrame, aliases: DataFrame, refs: DataFrame, edges: DataFrame, tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id, match_type and action as in match()'s results, but that all canonicals that share a signal are candidates.

    An action depends on the two best candidates alone, which come from blocks of kinds, so nothing is capped and no row for a pair is made."""
    own = written(entities)
    anchored = written(matching.deterministic(own, canon, aliases, refs, tenant).where("canonical_id is not null"))
    left = written(own.join(anchored, "entity_id", "left_anti"))
    # what scores less than the fallback band is no match, and no conflict
    scores = blocks.blocks(left, canon, aliases, refs, disposition.FALLBACK, tenant).best(2)
    placed = disposition.dispose(left, scores, edges, canon, tenant)
    llm, none = F.col("action") == "LLM_FALLBACK", F.col("action") == "NO_MATCH"
    rows = placed.join(left.select("entity_id", resolution.canonical_id(F.col("source"), F.col("source_id")).alias("new_id")), "entity_id")
    rest = rows.select("entity_id", F.when(none, F.col("new_id")).otherwise(F.col("top_match")).alias("canonical_id"), F.when(none, "new").when(llm, "llm").otherwise("scored").alias("match_type"),
        F.when(llm, "QUEUE_FOR_REVIEW").otherwise(F.col("action")).alias("action"))
    sure = anchored.select("entity_id", "canonical_id", F.lit("deterministic").alias("match_type"), F.lit("MATCHED").alias("action"))
    return written(sure.unionByName(rest))


def counts(results: DataFrame) -> DataFrame:
    """kind (total, action, match_type), name, n."""
    one = lambda kind, c: results.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return one("total", F.lit("entities")).unionByName(one("action", F.col("action"))).unionByName(one("match_type", F.col("match_type")))
