"""Redacted assessment of entities in the fallback band, by a client that is handed in; none talks to a network here.

A client is a function of a prompt that gives a mapping with match, confidence, reasoning and signals. Whatever it says, an
entity is queued for review and keeps its score."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import redaction as R
from samewise.functions.similarity import tokens
from samewise.operators import registry
from samewise.operators.graph import written
from samewise.operators.kinds import beside
from samewise.operators.scoring import flipped

CALLS = 50
ANSWER = "entity_id string, status string, match boolean, confidence double, reasoning string, signals array<string>, response_json string"


def offline(prompt: str) -> dict:
    """A client for tests and dry runs: no match, no confidence."""
    return {"match": False, "confidence": 0.0, "reasoning": "offline", "signals": []}


def text_of(value, keys: tuple[str, ...]) -> str | None:
    """The first non-blank string under any of the keys of an object, or of the objects under them, at any depth."""
    for k in keys if isinstance(value, dict) else ():
        held = value.get(k)
        found = held if isinstance(held, str) and held.strip() else text_of(held, keys)
        if found is not None:
            return found
    return None


@cache
def _texts(keys: tuple[str, ...]):
    @F.pandas_udf("string")
    def found(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: None if p is None else text_of(json.loads(p), keys))

    return found


def first_text(payload: Column, keys: tuple[str, ...]) -> Column:
    """text_of() a parsed JSON object, in Arrow batches: no expression of Catalyst goes to any depth."""
    return _texts(keys)(F.to_json(payload))


def prompts(dispositions: DataFrame, entities: DataFrame, canon: DataFrame, aliases: DataFrame, refs: DataFrame,
    tenant: str | None = None) -> DataFrame:
    """entity_id, canonical_id, category_pair, redacted_prompt, prompt_sha256, forbidden, status (ready
    or blocked_leak) of the fallback band.

    A prompt that holds a forbidden token, as a name's word may also be one of the template, is blocked, not sent."""
    todo = dispositions.where("action = 'LLM_FALLBACK'").select("entity_id", F.col("top_match").alias("canonical_id"),
        F.col("top_score").alias("score"))
    names = registry.of_tenant(canon, tenant).select("canonical_id", "canonical_name",
        F.col("entity_category").alias("candidate_category"), F.col("entity_type").alias("candidate_type"))
    todo = written(todo)
    # few canonicals are asked about beside those that are known
    wanted = beside(written(todo.select("canonical_id").distinct()))
    names, refs = written(names.join(wanted, "canonical_id", "left_semi")), refs.join(wanted, "canonical_id", "left_semi")
    payload = F.col("parsed")
    fields = {"candidate_role": R.ROLE_KEYS, "candidate_project": R.PROJECT_KEYS, "candidate_email": R.EMAIL_KEYS,
        "candidate_employee": R.EMPLOYEE_KEYS}
    held = refs.withColumn("parsed", F.try_parse_json("external_fields")).select("canonical_id", "source", "external_id",
        *(first_text(payload, keys).alias(k) for k, keys in fields.items())).groupBy("canonical_id").agg(
        *(F.min_by(k, F.when(F.col(k).isNotNull(), F.struct("source", "external_id")))
            .alias(k) for k in ("candidate_role", "candidate_project")),
        F.array_union(F.collect_set("candidate_email"), F.collect_set("candidate_employee")).alias("candidate_tokens"),
    )
    known = registry.other_aliases(beside(names), aliases).groupBy("canonical_id").agg(F.collect_set("value").alias("other"))
    rows = todo.join(entities.withColumn("raw_record", F.try_parse_json("raw_record")), "entity_id").join(beside(names),
        "canonical_id").join(beside(written(held)), "canonical_id", "left").join(beside(written(known)), "canonical_id", "left")
    raw = F.col("raw_record")
    empty = F.array().cast("array<string>")
    other = F.coalesce("other", empty)
    forbidden = F.concat(F.array("normalized_name", "display_name", "email", first_text(raw, R.EMPLOYEE_KEYS), "canonical_name"),
        tokens(F.col("normalized_name")), tokens(F.col("canonical_name")), other, F.flatten(F.transform(other, tokens)),
        F.coalesce("candidate_tokens", empty))
    forbidden = F.array_sort(F.array_distinct(F.filter(forbidden, lambda t: t.isNotNull() & (F.length(F.trim(t)) >= R.LEAST_TOKEN))))
    person = (F.col("entity_category") == "person") | (F.col("candidate_category") == "person")
    shared, total = R.overlap(F.col("normalized_name"), F.col("canonical_name"))
    target = flipped(F.col("category"))
    role = first_text(raw, R.ROLE_KEYS)
    kinds = F.when(person, role).otherwise(F.col("entity_category")), F.when(person,
        F.col("candidate_role")).otherwise(F.col("candidate_type"))
    shapes = R.class_shape(first_text(raw, R.CLASS_KEYS)), R.project_shape(F.col("candidate_project"))
    text = R.prompt(person, F.col("category"), target, *kinds, *shapes,
        R.inverted(F.col("normalized_name"), F.col("canonical_name")), shared, total, F.col("score"))
    rows = rows.select("entity_id", "canonical_id", "score", F.concat_ws(":", F.col("category"), target).alias("category_pair"),
        text.alias("redacted_prompt"), forbidden.alias("forbidden"))
    status = F.when(R.leak(F.col("redacted_prompt"), F.col("forbidden")).isNotNull(), "blocked_leak").otherwise("ready")
    return rows.withColumn("prompt_sha256", F.sha2("redacted_prompt", 256)).withColumn("status", status)


def valid(answer: object) -> bool:
    """Whether a client's answer has the right keys and kinds."""
    if not isinstance(answer, dict) or not {"match", "confidence", "reasoning", "signals"} <= answer.keys():
        return False
    c = answer["confidence"]
    return isinstance(answer["match"], bool) and isinstance(c, (int, float)) and not isinstance(c,
        bool) and 0 <= c <= 1 and isinstance(answer["reasoning"], str) and isinstance(answer["signals"],
        list) and all(isinstance(s, str) for s in answer["signals"])


def assess(ready: DataFrame, client: Callable[[str], dict] = offline, calls: int = CALLS) -> DataFrame:
    """prompts() with status (ok, redacted_leak, invalid_response, blocked_leak, over_budget), the answer, and the action.

    The first `calls` prompts that may be sent, by entity, are sent; the budget is a feature, and what is over it says so."""
    allowed = ready.where("status = 'ready'").orderBy("entity_id").limit(calls).select("entity_id", "redacted_prompt", "forbidden")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                said = client(r.redacted_prompt)
                if not valid(said):
                    out.append((r.entity_id, "invalid_response", None, None, None, None, None))
                    continue
                low = said["reasoning"].lower()
                leaked = any(t.strip().lower() in low for t in r.forbidden)
                kept = {"confidence": float(said["confidence"]), "match": said["match"],
                    "reasoning": R.PLACEHOLDER if leaked else said["reasoning"], "signals": list(said["signals"])}
                out.append((r.entity_id, "redacted_leak" if leaked else "ok", kept["match"], kept["confidence"], kept["reasoning"],
                    kept["signals"], json.dumps(kept, sort_keys=True)))
            yield pd.DataFrame(out, columns=["entity_id", "status", "match", "confidence", "reasoning", "signals", "response_json"])

    # the budget's few prompts go to one task, as a client may count or pace its calls
    answers = allowed.repartition(1).mapInPandas(ask, ANSWER).withColumnRenamed("status", "answer")
    status = F.when(F.col("status") != "ready", F.col("status")).otherwise(F.coalesce("answer", F.lit("over_budget")))
    return ready.join(answers, "entity_id", "left").withColumn("status", status).drop("answer").withColumn("action",
        F.when(F.col("status").isin("ok", "redacted_leak"), "QUEUE_FOR_REVIEW").otherwise("LLM_FALLBACK"))


def training_rows(assessed: DataFrame, tenant: str | None = None) -> DataFrame:
    """The append-only rows of answered calls: call_id, tenant_id, category_pair, redacted_prompt, prompt_sha256, llm_response_json."""
    own = assessed.where("response_json is not null")
    return own.select(F.sha2(F.concat_ws("|", "entity_id", "prompt_sha256"), 256).alias("call_id"),
        F.lit(tenant).cast("string").alias("tenant_id"), "category_pair", "redacted_prompt", "prompt_sha256",
        F.col("response_json").alias("llm_response_json"))
