"""Language identification by rank-order profiles: out-of-place distance between most frequent n-grams.

Letters only, lower case; words are set off by boundaries; n-grams of 1 to 3 letters that cross no boundary. A text's
`size` most frequent n-grams, ties by code, are compared to each language's; a missing one costs `size`. A null text or
one without a letter is `und` with score 0; whole texts of any length count; repeated rows give repeated rows; extra
columns stay out; rows without lang teach nothing; where nothing is learned, all is `und`; an empty table gives no rows."""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, crc_mod, tidy

LETTERS_END = 0x33000  # no letter has a higher code point
UND = "und"
PARTS = 64


@cache
def folded() -> np.ndarray:
    """By code point: its lower-case letter's, or 0 if it is none."""
    out = np.zeros(LETTERS_END + 1, np.int64)
    for c in range(LETTERS_END):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams' codes and counts, most frequent first."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    c = folded()[np.minimum(raw, LETTERS_END)]
    c = np.concatenate([[0], c, [0]])
    c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a letter has 18 bits, a boundary is 0; bits 60 and 61 tell the lengths apart
    two = ((c[:-1] << 18) | c[1:]) | 1 << 60
    three = (((c[:-2] << 36) | (c[1:-1] << 18) | c[2:]) | 1 << 61)[c[1:-1] != 0]
    codes, counts = np.unique(np.concatenate([c[c != 0], two, three]), return_counts=True)
    best = np.argsort(-counts, kind="stable")[:size]
    return codes[best], counts[best]


def count_grams(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """lang, gram, n over all rows of docs (lang, text), summed in each task first."""

    def run(batches):
        held: dict = defaultdict(int)

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array(held.values(), pa.int64())],
                names=["lang", "gram", "n"]
            )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                codes, counts = grams(text.as_py(), 1 << 62)
                for g, n in zip(codes.tolist(), counts.tolist()):
                    held[lang, g] += n
                if len(held) > most:
                    yield out()
                    held.clear()
        yield out()

    return docs.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """codes: all profiles' n-grams, sorted; ranks[i, j]: place of codes[i] in language j, `size` where it has none."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(by_lang)
        self.codes = np.array(sorted({g for x in by_lang.values() for g in x}), np.int64)
        self.ranks = np.full((len(self.codes), len(self.langs)), size, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(by_lang[lang], np.int64)), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties by name, and 1 less the share of the largest distance that there can be."""
        codes = grams(text, self.size)[0] if text else ()
        if not len(codes) or not self.langs:
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == codes)[:, None], self.ranks[at], self.size)
        far = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(codes))[:, None])).sum(0)
        j = int(far.argmin())
        return self.langs[j], float(1 - far[j] / (self.size * len(codes)))


def learn(docs: DataFrame, size: int = 400) -> Profiles:
    """Profiles of docs' languages (lang, text), from all rows: n-grams are summed in each task before they are dealt.

    A language's profile is its `size` most frequent n-grams; languages are few, so profiles are collected. Each of `PARTS` parts
    of a language's n-grams gives its own most frequent ones first, so that no task ranks all of a language's."""
    bounded_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = count_grams(known).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))

    def best(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)

    ranked = best(best(counts, "lang", "part"), "lang")
    by = defaultdict(list)
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["place"])):  # `size` rows a language
        by[r["lang"]].append(r["gram"])
    return Profiles(by, size)


def classify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, then lang_pred and score."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    own = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def run(batches):
        for b in batches:
            found = [sent.value.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*b.schema.names[:-1], "lang_pred", "score"]
            )

    return own.mapInArrow(tidy(run), (schema + ", " if keep else "") + "lang_pred string, score double")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents whose crc32 modulo 5 is not 0."""
    profiles = learn(docs.where(crc_mod("doc_id", 5) != 0))
    return classify(docs.withColumn("held_out", crc_mod("doc_id", 5) == 0), profiles, ["doc_id", "held_out"])
