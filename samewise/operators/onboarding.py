"""Clusters for guided onboarding: pairs of a cold start gathered around centres, each with a proposal for whoever decides.

Pairs are taken by falling score. The first pair of two free nodes makes one of them, the one of more transactions, a centre; a free
node of a pair with a centre joins it; a pair with a node that joined another centre says nothing more. So every member is linked to
its centre itself, and a chain of weak pairs isn't one cluster.

That scan is run in rounds over all pairs at once. A pair may be taken when it is the first of those left at each of its free nodes,
since nothing before it can then change them; pairs that can say nothing more are left out. The result is the scan's.

Where pairs are blocks, each of whose nodes meets each of the other side with one score, the free nodes of a kind have the same first
pair but for themselves. So rounds go over blocks, and the pairs themselves, which grow with the square, are never made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.graph import discard, written

#: The least score of a pair, and of a cluster to review, and of one to confirm.
LEAST, REVIEW, CONFIRM = 0.40, 0.70, 0.85


def centred(pairs: DataFrame, weights: DataFrame, rounds: int = 200) -> DataFrame:
    """node, centre, score (of the pair that brought it, null for centres).

    pairs: a, b, score; loops and nulls are left out, of repeated pairs the best score counts. weights: node, weight; none is 0."""
    ordered = pairs.where("a <> b and score is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    live = ordered.groupBy("a", "b").agg(F.max("score").alias("score"))
    for end in ("a", "b"):
        heavy = weights.groupBy(F.col("node").alias(end)).agg(F.max("weight").alias(f"w{end}"))
        live = live.join(heavy, end, "left").na.fill(0.0, [f"w{end}"])
    live = written(live.withColumn("place", F.struct(-F.col("score"), "a", "b")).withColumns({"ra": F.lit(False), "rb": F.lit(False)}))  # ra, rb: is a centre
    taken = []
    for _ in range(rounds):
        if live.limit(1).count() == 0:
            break
        # the first pair at each free node
        ends = live.where("not ra").select(F.col("a").alias("node"), "place").unionByName(live.where("not rb").select(F.col("b").alias("node"), "place"))
        first = ends.groupBy("node").agg(F.min("place").alias("first"))
        seen = live.join(
            first.select(F.col("node").alias("a"), F.col("first").alias("fa")), "a", "left"
        ).join(first.select(F.col("node").alias("b"), F.col("first").alias("fb")), "b", "left")
        now = seen.where((F.col("ra") | (F.col("fa") == F.col("place"))) & (F.col("rb") | (F.col("fb") == F.col("place"))))
        centre = F.when(F.col("ra"), F.col("a")).when(F.col("rb"), F.col("b")).when(F.col("wb") > F.col("wa"), F.col("b")).otherwise(F.col("a"))
        made = now.select(centre.alias("centre"), F.when(centre == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), "score")
        made = written(made)
        taken.append(made)
        members, centres = made.select("node"), made.select(F.col("centre").alias("node")).distinct()
        left = live
        for end in ("a", "b"):
            is_centre = centres.select(F.col("node").alias(end), F.lit(True).alias("is"))
            left = left.join(members.withColumnRenamed("node", end), end, "left_anti").join(is_centre, end, "left")
            left = left.withColumn(f"r{end}", F.col(f"r{end}") | F.coalesce("is", F.lit(False))).drop("is")
        before, live = live, written(left.where("not (ra and rb)"))
        discard(before)
    else:
        raise RuntimeError(f"centres haven't settled in {rounds} rounds")
    none = pairs.select(F.col("a").alias("node"), F.col("a").alias("centre"), F.col("score").cast("double").alias("score")).where("false")
    for made in taken:
        none = none.unionByName(made.select("node", "centre", F.col("score").cast("double").alias("score")))
    return none.unionByName(none.select(F.col("centre").alias("node"), "centre", F.lit(None).cast("double").alias("score")).distinct())


def centred_blocks(first: DataFrame, second: DataFrame, blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """centred() of all pairs of blocks (a, b, score), where a is a kind of `first` (node, kind) and b one of `second` (node, kind).

    Each node is of one kind, and a pair of kinds has one score; nodes of `first` must sort before those of `second`. Each round takes the
    first of all pairs that are left at least, so there is no bound on rounds."""
    # kinds of both sides have numbers of their own, and a node's rank says its place among all
    nodes = first.select("node", (F.col("kind") * 2).alias("kind"), F.lit(True).alias("ahead")).unionByName(second.select("node", (F.col("kind") * 2 + 1).alias("kind"), F.lit(False).alias("ahead")))
    heavy = weights.groupBy("node").agg(F.max("weight").alias("weight"))
    nodes = written(nodes.join(heavy, "node", "left").na.fill(0.0, ["weight"]).orderBy("node").withColumn("rank", F.monotonically_increasing_id()))
    live = nodes.select("rank", "kind", "ahead", "weight", F.lit(False).alias("centre"))
    left = blocks.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b"), "score")
    taken: list[DataFrame] = []
    while True:
        # the first node of each kind that is no member, and how many are free
        heads = live.groupBy("kind").agg(F.min("rank").alias("rank"), F.count_if(~F.col("centre")).alias("free")).join(live.drop("kind", "ahead"), "rank")
        heads = written(heads.join(live.select("kind", "ahead").distinct(), "kind"))
        of = lambda end: heads.select(F.col("kind").alias(end), F.col("rank").alias(f"{end}_first"), (F.col("free") > 0).alias(f"{end}_free"))
        before, left = left, written(left.select("a", "b", "score").join(of("a"), "a").join(of("b"), "b").where("a_free or b_free"))
        discard(before)
        if left.limit(1).count() == 0:
            discard(heads)
            break
        # of each kind with free nodes the best score, then the first node that has it
        ends = left.where("a_free").select(F.col("a").alias("kind"), "score", F.col("b_first").alias("other")).unionByName(left.where("b_free").select(F.col("b").alias("kind"), "score", F.col("a_first").alias("other")))
        top = ends.groupBy("kind").agg(F.max("score").alias("top"))
        best = ends.join(top, "kind").where("score = top").groupBy("kind").agg(F.min("other").alias("other"), F.max("score").alias("score"))
        own = heads.select("kind", "ahead", F.col("rank").alias("head"), F.col("centre").alias("head_centre"), F.col("weight").alias("head_weight"))
        other = heads.select(F.col("rank").alias("other"), F.col("kind").alias("other_kind"), F.col("centre").alias("other_centre"), F.col("weight").alias("other_weight"))
        best = written(best.join(own, "kind").join(other, "other"))
        # free nodes whose first pair is with a centre join it; two free nodes that are each other's first make a centre
        joins = live.where("not centre").join(best.where("other_centre").select("kind", "score", F.col("other").alias("to")), "kind").select("rank", "to", "score")
        back = best.where("not ahead").select(F.col("kind").alias("other_kind"), F.col("other_kind").alias("kind"))
        both = best.where("ahead and not head_centre and not other_centre").join(back, ["kind", "other_kind"])
        later = F.col("other_weight") > F.col("head_weight")
        both = both.select(F.when(later, F.col("head")).otherwise(F.col("other")).alias("rank"), F.when(later, F.col("other")).otherwise(F.col("head")).alias("to"), "score")
        made = written(joins.unionByName(both))
        taken.append(made)
        centres = made.select(F.col("to").alias("rank"), F.lit(True).alias("is")).distinct()
        now = live.join(made.select("rank"), "rank", "left_anti").join(centres, "rank", "left").withColumn("centre", F.col("centre") | F.coalesce("is", F.lit(False))).drop("is")
        before, live = live, written(now)
        for gone in (before, heads, best):
            discard(gone)
    named = lambda c: nodes.select(F.col("rank").alias(c), F.col("node").alias(f"{c}_node"))
    told = nodes.where("false").select("rank", F.col("rank").alias("to"), F.col("weight").alias("score"))
    for made in taken:
        told = told.unionByName(made.select("rank", "to", F.col("score").cast("double").alias("score")))
    told = written(told.join(named("rank"), "rank").join(named("to"), "to").select(F.col("rank_node").alias("node"), F.col("to_node").alias("centre"), "score"))
    return told.unionByName(told.select(F.col("centre").alias("node"), "centre", F.lit(None).cast("double").alias("score")).distinct())


def proposals(pairs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """proposed() of the clusters of pairs that score `least` or more."""
    return proposed(centred(pairs.where(F.col("score") >= least), weights(nodes)), nodes)


def weights(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.col("volume").cast("double").alias("weight"))


def proposed(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each cluster of centred() or centred_blocks(), the most urgent first by `priority`.

    cluster (its centre), proposed_name (the name that most of its transactions go by), aliases (the other names, by category),
    n_members, confidence (mean score of its pairs), n_assess (pairs below REVIEW, which a model may be asked about), action (confirm,
    review or assess; nothing is ever approved here), volume, priority (by volume, then confidence, then cluster).
    nodes: node, name, category, volume; a node without a row has no name and no volume."""
    told = nodes.groupBy("node").agg(F.max(F.struct("volume", "name", "category")).alias("of"))
    placed = written(placed)
    rows = placed.join(told, "node", "left").select("centre", "node", "score", "of.name", "of.category", F.coalesce(F.col("of.volume"), F.lit(0.0)).cast("double").alias("volume"))
    # names are summed before a cluster gathers them: a name for each of its spellings, not for each of its members
    by_name = rows.where("name is not null").groupBy("centre", "name", "category").agg(F.sum("volume").alias("volume"))
    own = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("volume"), "name", "category"))
    top = by_name.withColumn("nth", own).where("nth = 1").select("centre", F.col("name").alias("proposed_name"))
    others = by_name.join(top, "centre").where("name <> proposed_name").select("centre", "category", "name").distinct()
    aliases = others.groupBy("centre").agg(F.sort_array(F.collect_set(F.concat_ws(": ", "category", "name"))).alias("aliases"))
    sums = rows.groupBy("centre").agg(
        F.count("*").alias("n_members"), F.avg("score").alias("confidence"), F.count_if(F.col("score") < REVIEW).alias("n_assess"),
        F.sum("volume").alias("volume")
    )
    action = F.when(F.col("confidence") >= CONFIRM, "confirm").when(F.col("confidence") >= REVIEW, "review").otherwise("assess")
    out = sums.join(top, "centre", "left").join(aliases, "centre", "left").withColumn("action", action)
    out = out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumnRenamed("centre", "cluster")
    # ranks without one task for all: clusters sorted by range, numbered within, each range beginning where those before it end
    return _numbered(out).select("cluster", "proposed_name", "aliases", "n_members", "confidence", "n_assess", "action", "volume", "priority")


def _numbered(clusters: DataFrame) -> DataFrame:
    """clusters with priority, from 1."""
    order = (F.col("volume").desc(), F.col("confidence").desc(), F.col("cluster"))
    spark = clusters.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(clusters.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # a number for each task
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    known = spark.createDataFrame(starts, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(known), "part").withColumn("priority", (F.col("before") + within).cast("long"))
