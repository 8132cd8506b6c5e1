"""The ten operators as queries over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from samewise.llm import jaccard, langid, lengths, lexicon, packing, partitions, pii, quality, search, secrets, templates, toxicity, vectors
from samewise.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed", "kept", "distance")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.rewritten(table(spark, sf_dir, "clicks"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.count(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_secrets, op3_lines, op4_jaccard, op5_bpe, op6_embeddings, op7_langid, op8_pii, op9_quality, op10_packing, op11_search,
    op12_partitions, op13_tokens
)} | {"pipeline": corpus_pipeline.run}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Scores of all pairs of an item and a document that share a term, by the formula alone.
SEARCH_SQL = f"""with d as (select row_number() over () as r, doc_id, {_TERMS} as terms from documents),
  sized as (select r, doc_id, len(terms) as n, terms from d where len(terms) > 0),
  whole as (select count(*) as n_docs, sum(n)::bigint as n_terms from sized),
  tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(terms) as term from sized) group by all),
  asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
  df as (select term, count(*) as df from tf where term in (select term from asked) group by term),
  weights as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1)))::bigint as w from df, whole),
  impacts as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) as impact from tf join weights using (term), whole),
  scores as (select item_id, r, doc_id, sum(impact)::bigint as score from asked join impacts using (term) group by all having sum(impact) > 0)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id, r)::int as rank from scores) where rank <= 50"""
ORACLES: dict[str, str] = {"op11_search": SEARCH_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
