"""Vectors of names from hashed subword n-grams: an abbreviation shares the beginnings of its words with the full name.

A name's grams are its words and their 3- to 5-character parts, `<` before and `>` after each word. A gram adds 1 or -1 to one of SIZE
dimensions, both by its MD5. Dimensions that many names use count less: weights are fitted by one aggregation over the registry and are
SIZE numbers. Vectors are of length 1, so their product is the cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.similarity import tokens
from samewise.operators.graph import written

SIZE, SHORTEST, LONGEST = 512, 3, 5


def grams(name: Column) -> Column:
    """The distinct grams of a name; none for null or a name without words."""
    marked = F.transform(tokens(name), lambda w: F.concat(F.lit("<"), w, F.lit(">")))

    def parts(n: int) -> Column:
        none = F.array().cast("array<string>")
        of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
        return F.flatten(F.transform(marked, lambda w: F.when(F.length(w) >= n, of(w)).otherwise(none)))

    every = [parts(n) for n in range(SHORTEST, LONGEST + 1)]
    return F.array_distinct(F.concat(marked, *every))


def dimension(gram: Column) -> Column:
    return (F.conv(F.substring(F.md5(gram.cast("binary")), 1, 6), 16, 10).cast("long") % SIZE).cast("int")


def sign(gram: Column) -> Column:
    return F.when(F.substring(F.md5(gram.cast("binary")), 7, 1) < "8", 1.0).otherwise(-1.0)


def fitted(names: DataFrame) -> list[float]:
    """The weight of each dimension, ln((1 + names) / (1 + names that use it)), over rows of names (name), each distinct one once."""
    distinct = names.where("name is not null").select("name").distinct()
    used = distinct.select(F.explode(F.array_append(F.array_distinct(F.transform(grams(F.col("name")), dimension)), F.lit(-1))).alias("at"))
    counts = {r["at"]: r["count"] for r in used.groupBy("at").count().collect()}  # SIZE + 1 rows
    n = counts.get(-1, 0)
    logs = names.sparkSession.range(1).select(*(F.log((1.0 + n) / (1.0 + F.lit(float(counts.get(d, 0))))).alias(f"w{d}") for d in range(SIZE))).first()
    return [float(x) for x in logs]


@cache
def place(gram: str) -> tuple[int, float]:
    """dimension() and sign() of a gram."""
    code = hashlib.md5(gram.encode()).hexdigest()
    return int(code[:6], 16) % SIZE, 1.0 if code[6] < "8" else -1.0


def vector(own: Column, weights: Sequence[float]) -> Column:
    """The unit vector (array<double> of SIZE) of an array of grams; null if it has none, or if all its weights cancel out.

    In Arrow batches: Catalyst would work out the sums anew for each dimension."""
    known = np.array(weights)

    @F.pandas_udf("array<double>")
    def built(lists: pd.Series) -> pd.Series:
        out = []
        for some in lists:
            x = np.zeros(SIZE)
            for g in some if some is not None else ():
                at, by = place(g)
                x[at] += by
            x *= known
            length = np.sqrt((x * x).sum())
            out.append(x / length if length > 0 else None)
        place.cache_clear()  # a memo of one batch
        return pd.Series(out, dtype=object)

    return built(own)


def of_registry(seeds: DataFrame) -> DataFrame:
    """vec_id, grams: all grams of a canonical's names, worked out once for each set of names. seeds: canonical_id, value."""
    named = written(seeds.groupBy(F.col("canonical_id").alias("vec_id")).agg(F.array_sort(F.collect_set("value")).alias("names")))
    every = F.sort_array(F.array_distinct(F.flatten(F.transform("names", grams))))
    spelled = named.select("names").distinct().select("names", every.alias("grams")).where(F.size("grams") > 0)
    return named.join(spelled, "names").select("vec_id", "grams")


def of_entities(entities: DataFrame) -> DataFrame:
    """query_id, grams of entities (entity_id, normalized_name)."""
    return entities.select(F.col("entity_id").alias("query_id"), F.sort_array(grams(F.col("normalized_name"))).alias("grams"))
