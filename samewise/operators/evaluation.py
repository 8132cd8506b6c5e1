"""How good a grouping is against the truth: pairwise and B-cubed precision and recall, from counts of what the two groupings share.

Neither looks at pairs of items: an item's groups are joined once, the rest are sums over the groups' sizes, so a giant group costs a
row. Sums are of 128-bit decimals, so counts of pairs are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: str) -> Column:
    n = F.col(n).cast("decimal(19,0)")
    return F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("decimal(38,0)")


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_items, pairs_found, pairs_true, pairs_right, pair_precision, pair_recall, bcubed_precision, bcubed_recall.

    found, truth: item, group. Items of the truth count; one without a group, or that was found in none, is a group of its own. Of an
    item's several groups the least counts. A measure without anything to measure is null."""
    one = lambda df, name: df.where("item is not null").groupBy("item").agg(F.min("group").alias(name))
    rows = one(truth, "t").join(one(found, "f"), "item", "left")
    alone = lambda c: F.when(F.col(c).isNull(), F.struct(F.lit(True).alias("alone"), F.col("item").cast("string").alias("name"))).otherwise(F.struct(F.lit(False).alias("alone"), F.col(c).cast("string").alias("name")))
    cells = rows.groupBy(alone("f").alias("f"), alone("t").alias("t")).agg(F.count("*").alias("n"))
    by_found = cells.groupBy("f").agg(F.sum("n").alias("nf"))
    by_true = cells.groupBy("t").agg(F.sum("n").alias("nt"))
    sized = cells.join(by_found, "f").join(by_true, "t")
    square = F.col("n").cast("double") * F.col("n")
    both = sized.agg(_pairs("n").alias("pairs_right"), F.sum("n").alias("n_items"), F.sum(square / F.col("nf")).alias("p"), F.sum(square / F.col("nt")).alias("r"))
    out = both.crossJoin(by_found.agg(_pairs("nf").alias("pairs_found"))).crossJoin(by_true.agg(_pairs("nt").alias("pairs_true")))  # a row each
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(count("n_items"), count("pairs_found"), count("pairs_true"), count("pairs_right"), rate("pairs_right", "pairs_found").alias("pair_precision"),
        rate("pairs_right", "pairs_true").alias("pair_recall"), rate("p", "n_items").alias("bcubed_precision"), rate("r", "n_items").alias("bcubed_recall"))


def by_kind(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, n, n_matched, n_right of matches (item, group, null for none) against truth (item, group, kind), items of each kind."""
    rows = truth.join(matched.select("item", F.col("group").alias("found")), "item", "left")
    right = F.coalesce(F.col("found") == F.col("group"), F.lit(False))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("found").alias("n_matched"), F.count_if(right).alias("n_right"))
