"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the last return the columns of documents
(doc_id, text, lang, source, n_chars). Stages handle nulls, empty and long texts, repeated rows, empty tables and extra
columns as the operators they call say; extra columns are left out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import jaccard, langid, packing, pii, templates
from samewise.llm.common import crc_mod, cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MOST = 1_000_000  # keys that are broadcast at most


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, n_chars counted anew from the text."""
    return df.select("doc_id", F.col(text).cast("string").alias("text"), "lang", "source", F.length(F.col(text).cast("string")).cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned: what has no letter, so no language, goes; a null lang becomes the predicted one.

    Learned from the documents of the table whose crc32(doc_id) modulo 5 is not 0."""
    source = table(spark, sf_dir, "documents")
    profiles = langid.learn(source.where(crc_mod("doc_id", 5) != 0))
    named = langid.classify(docs, profiles, ["doc_id", "text", "lang", "source"])
    if not profiles.langs:
        return _documents(named)
    return _documents(named.where(F.col("lang_pred") != langid.UND).withColumn("lang", F.coalesce("lang", "lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; a document of such lines alone goes."""
    done = templates.clean(docs.select(*COLUMNS))
    return _documents(done.where((F.col("n_lines_dropped") == 0) | (F.length(F.trim("text")) > 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least doc_id (of several rows of that id, the one of least text hash).

    Documents are told apart by doc_id and text, as ids may be shared, and groups by the operator's key; of rows that repeat both
    one stays. What shares no n-gram set, and a document without an id, is in no group and stays, whatever its id."""
    body = F.xxhash64("text").alias("body")
    rows = docs.select(*COLUMNS)
    found = jaccard.join(rows.withColumn("body", body), keep=("body",)).where("class_key is not null")
    found = cut(found.select("class_key", "doc_id", "body"), "found")
    first = found.groupBy("class_key").agg(F.min(F.struct("doc_id", "body")).alias("first"))
    # a row for each document of a group of several but the first
    several = found.join(first, "class_key").where(F.struct("doc_id", "body") != F.col("first")).select(F.col("doc_id").alias("id"), F.col("body").alias("of")).distinct()
    repeated = found.groupBy(F.col("doc_id").alias("id"), F.col("body").alias("of")).count().where("count > 1").select("id", "of")

    def among(keys: DataFrame, how: str, left: DataFrame) -> DataFrame:
        # copies are few beside texts: their keys are broadcast up to a million, so that no text moves
        known = F.broadcast(keys) if keys.limit(MOST + 1).count() <= MOST else keys
        return left.join(known, F.col("doc_id").eqNullSafe(F.col("id")) & body.eqNullSafe(F.col("of")), how)

    repeated, gone = cut(repeated, "repeated"), cut(several, "gone")
    left = among(gone, "left_anti", rows)
    return _documents(among(repeated, "left_anti", left).unionByName(among(repeated, "left_semi", left).dropDuplicates(["doc_id", "text"])))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind in brackets."""
    rows = docs.select(*COLUMNS)
    found = pii.detect(rows, keep=("text", "lang", "source"))
    return _documents(found.withColumn("text", pii.redacted(F.col("text"), F.col("spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("best-fit packing", pack)]

#: Line dedup and the stages after it need iteration and fitted models, which SQL can't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
