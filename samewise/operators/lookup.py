"""Fuzzy search by name: a deletion-neighbourhood index of the words of names and aliases.

A search finds a name if each of its words has a word of the name within so many edits. Two words within d edits share a string that
each gives by leaving out d characters at most, so words meet by equality on those strings, in one shuffle, and only what meets is
measured. A name is then looked up by one word of the search alone, the one that fewest names hold: a search costs what its rarest word
costs, and a word that a third of all names hold is never expanded. What is found is ranked by the partial ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.similarity import string_metrics, tokens
from samewise.operators.graph import written


HEAD = 10


def edits(length: Column) -> Column:
    """The edits that a word of a search may be off by: none up to 3 characters, one up to 7, two beyond."""
    return F.when(length <= 3, 0).when(length <= 7, 1).otherwise(2)


def deletions(word: Column, most: Column) -> Column:
    """The strings that a word's beginning gives by leaving out up to `most` (2 at most) characters, itself included, each once.

    An edit takes at most one character from what the beginnings of two words have in common, so beginnings of HEAD characters will do."""
    word = F.substring(word, 1, HEAD)
    out = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.when((most >= 1) & (F.length(word) > 0), out(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when(
        most >= 2, F.flatten(F.transform(once, lambda w: F.when(F.length(w) > 0, out(w)).otherwise(F.array().cast("array<string>"))))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


class Names:
    """A stored index of names: their words with the names that hold them, how many do, and the words by what deletions leave.

    names: canonical_id, value. Values that differ by case alone are one; nulls and empty values are left out."""

    def __init__(self, names: DataFrame):
        rows = names.select("canonical_id", F.lower(F.trim("value")).alias("value")).where("value <> ''").distinct()
        self.names = written(rows.select("canonical_id", "value", F.array_distinct(tokens(F.col("value"))).alias("words")))
        self.postings = written(self.names.select(F.explode("words").alias("word"), "value").distinct())
        self.words = written(self.postings.groupBy("word").agg(F.count("*").alias("n_names")))
        # as many as the longest word of a search that it may be near to allows
        left_out = edits(F.length("word") + 2 - (F.length("word") < 6).cast("int"))
        self.deletions = written(self.words.select("word", "n_names", F.explode(deletions(F.col("word"), left_out)).alias("left")))

    def search(self, searches: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
        """search_id, canonical_id, value (of its names the best), score (partial ratio, `least` or more), position: the k best canonicals.

        searches: search_id, text. Ties by canonical_id, among a canonical's names by value; a search without words finds nothing."""
        asked = written(searches.select("search_id", F.lower(F.trim("text")).alias("text")).where("text <> ''").distinct())
        # a text is looked up once, however many searches have it
        words = written(asked.select("text").distinct().select("text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("asked")))
        off = edits(F.length("asked"))
        distinct = written(words.select("asked").distinct().select("asked", off.alias("most")))
        left = distinct.select("asked", "most", F.explode(deletions(F.col("asked"), F.col("most"))).alias("left"))
        met = left.join(self.deletions, "left").select("asked", "most", "word", "n_names").distinct()
        near = written(met.where(F.levenshtein("asked", "word") <= F.col("most")).select("asked", "word", "n_names"))
        # of each text the word that fewest names hold; a text of which a word is near to none has no row there and finds nothing
        cost = near.groupBy("asked").agg(F.sum("n_names").alias("cost"))
        costs = words.join(cost, "asked", "left")
        whole = Window.partitionBy("text")
        rarest = costs.withColumn("lacks", F.max(F.col("cost").isNull()).over(whole)).where(~F.col("lacks"))
        rarest = rarest.withColumn("nth", F.row_number().over(whole.orderBy("cost", "asked"))).where("nth = 1").select("text", "asked")
        found = rarest.join(near.select("asked", "word"), "asked").join(self.postings, "word").select("text", "value").distinct()
        # the other words of the text, against the words of the names that are left
        each = found.withColumn("own", F.explode(F.array_distinct(tokens(F.col("text")))))
        in_name = F.exists(F.split("value", r"(?U)\s+"), lambda w: F.levenshtein(F.col("own"), w) <= edits(F.length("own")))
        all_in = each.groupBy("text", "value").agg(F.min(in_name).alias("all_in")).where("all_in").select("text", "value")
        scored = all_in.withColumn("score", string_metrics("partial")("text", "value")["partial"]).where(F.col("score") >= least)
        # the k best canonicals are among the first k of each value, as the first k of a value stand before its others
        nth = F.row_number().over(Window.partitionBy("value").orderBy("canonical_id"))
        held = written(self.names.select("canonical_id", "value").withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"))
        best = written(_best(scored.join(held, "value"), "text", k).drop("position"))
        return _best(asked.join(best, "text"), "search_id", k).select("search_id", "canonical_id", "value", "score", "position")


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Of each `by` the k best canonicals with their best value, and their position."""
    even = F.round("score", 6)  # scores are compared with six places
    own = F.row_number().over(Window.partitionBy(by, "canonical_id").orderBy(even.desc(), "value"))
    rows = rows.select(by, "canonical_id", "value", "score").withColumn("own", own).where("own = 1").drop("own")
    place = F.row_number().over(Window.partitionBy(by).orderBy(even.desc(), "canonical_id"))
    return rows.withColumn("position", place).where(F.col("position") <= k)
