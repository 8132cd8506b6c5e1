"""Embedding near-duplicates: coarse inverted lists, residual product-quantisation codes, exact rerank, components.

Every vector is filed under its nearest coarse centre with a code of its residual and that code's error. A neighbour that is
filed under another centre has crossed the plane halfway between the two centres. How far a vector may be from such a plane for its
list to be probed is `slack`, as a share of the farthest that a neighbour can be: 1 finds every link, and by default it is the
least that finds `recall` of the links of a sample and of pairs made up at the very threshold, so it follows from the data and
their dimensions. Of two lists the one of lower number asks the other, so each pair is met once and counts for both.

In a list, asymmetric table distances less the filed vector's error are lower bounds, so that what
they leave out is no link; the rest is reranked by exact cosine in double precision. Equal vectors are joined first and
counted by multiplicity. Links are counted in place, and only a star of each block's links leaves it, so that a group of m
vectors sends m rows a block, not its m * m pairs.

Vectors that are null, zero, or hold null or non-finite components, link with nothing and stand alone; vectors of other
lengths are compared among their own length; a null vec_id stands alone; repeated rows count as vectors of their own; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.common import cut
from samewise.llm.graph import components, local_roots

SUBSPACES = 8
CODES = 64
#: Rows of a block: a list longer than this is compared block against block, in tasks of their own.
BLOCK = 4096
#: Queries that a block meets at once.
TURN = 32768


#: Rows that are held against all centres at once.
ROWS = 512
#: Lists at most: centres and their distances to ROWS vectors stay small on the driver and in each task.
MOST_LISTS = 16_384


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + ROWS], c).argmin(1) for i in range(0, len(x), ROWS)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centres and residual codebooks for unit vectors of one length, fitted on a sample."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = _kmeans(sample, lists, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, p], CODES, rng) for p in self.parts]
        self.slack = 1.0

    def crossings(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By vector: its list, and by centre how far the plane between that and its own centre is."""
        d2 = _squares(x, self.centres)
        own = d2.argmin(1)
        apart = np.sqrt(_squares(self.centres[own], self.centres))
        return own, (d2 - d2[np.arange(len(x)), own][:, None]) / 2 / np.maximum(apart, 1e-12)

    def calibrate(self, sample: np.ndarray, threshold: float, recall: float, pairs: int = 4_000, seed: int = 3) -> None:
        """The slack with which `recall` of the sample's links, and of as many made-up pairs at the threshold, are met."""
        rng = np.random.default_rng(seed)
        some = sample[rng.permutation(len(sample))[:pairs]]
        aside = rng.normal(size=some.shape)
        aside -= (aside * some).sum(1)[:, None] * some
        size = np.sqrt((aside * aside).sum(1))[:, None]
        made = threshold * some + math.sqrt(1 - threshold**2) * aside / np.maximum(size, 1e-12)
        sets = [(some[size[:, 0] > 1e-9], made[size[:, 0] > 1e-9])]
        left, right = [], []
        for i in range(0, len(some), ROWS):
            a, b = np.nonzero(some[i : i + ROWS] @ sample.T >= threshold)
            keep = rng.permutation(len(a))[: pairs // 8]  # of a crowd's links some
            left.append(some[i + a[keep]])
            right.append(sample[b[keep]])
        sets.append((np.concatenate(left), np.concatenate(right)))
        r = math.sqrt(2 - 2 * threshold)
        shares = []
        for x, y in sets:
            found = np.zeros(len(x))
            for i in range(0, len(x), ROWS):
                of_x, far_x = self.crossings(x[i : i + ROWS])
                of_y, far_y = self.crossings(y[i : i + ROWS])
                rows = np.arange(len(of_x))
                found[i : i + ROWS] = np.where(of_x == of_y, 0, np.where(of_x < of_y, far_x[rows, of_y], far_y[rows, of_x])) / r
            if len(found):
                shares.append(float(np.quantile(found, recall, method="higher")))
        self.slack = min(1.0, 1.02 * max(shares, default=1.0) + 1e-6)

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance from each vector to what its code stands for."""
        rest = x - self.centres[own]
        codes, error = np.zeros((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            d = (rest[:, p] ** 2).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * rest[:, p] @ b.T
            codes[:, j] = d.argmin(1)
            error += ((rest[:, p] - b[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, x: np.ndarray, centre: int) -> np.ndarray:
        """By query, subspace and code: squared distance from the query's part to the centre plus that code."""
        rest = x - self.centres[centre]
        out = np.full((len(x), len(self.parts), CODES), np.inf)
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, j, : len(b)] = (rest[:, p] ** 2).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * rest[:, p] @ b.T
        return out


def _linkable(vectors: DataFrame) -> Column:
    v = F.col("embedding")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda e: e != 0), F.lit(False))


def units(column) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = np.stack([np.asarray(v, float) for v in column])
    x = x / np.abs(x).max(1)[:, None]  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1))[:, None]


def _filed(classes: DataFrame, index, threshold: float) -> DataFrame:
    """rep, embedding, copies, with their list, code, the code's error and the lists to probe: its own, and those of higher number behind a near plane."""
    r = math.sqrt(2 - 2 * threshold) + 1e-9  # chord of the threshold

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ix = index.value
            x = units(b.column("embedding").to_pylist())
            own, probes = np.zeros(len(x), np.int64), []
            numbers = np.arange(len(ix.centres))
            for i in range(0, len(x), ROWS):
                near, far = ix.crossings(x[i : i + ROWS])
                own[i : i + ROWS] = near
                asks = (far <= ix.slack * r + 1e-9) & (numbers[None] >= near[:, None])
                at, lists = np.nonzero(asks)
                probes += np.split(lists, np.cumsum(np.bincount(at, minlength=len(near)))[:-1])
            codes, error = ix.code(x, own)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rep"), b.column("embedding"), b.column("copies"), pa.array(own.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))
                ],
                names=["rep", "embedding", "copies", "cell", "code", "error", "probes"]
            )

    own = classes.select("rep", "embedding", "copies")
    return own.mapInArrow(run, f"rep long, embedding {own.schema['embedding'].dataType.simpleString()}, copies long, cell int, code binary, error double, probes array<int>")


class Tasks:
    """Lists dealt to groups of about BLOCK vectors; a longer list is a group of its own, in blocks. A group's queries come in turns."""

    def __init__(self, members: dict[int, int], lists: int):
        self.group, self.blocks, self.turns = np.full(lists, -1, np.int64), [], []
        held = 0
        for k in sorted(members):
            if not self.blocks or held + members[k] > BLOCK:
                self.blocks.append(1)
                held = 0
            self.group[k] = len(self.blocks) - 1
            held += members[k]
            self.blocks[-1] = math.ceil(held / BLOCK)

    def asked(self, batches):
        """Rows of (grp, n): how many vectors ask each group, summed in each task."""
        n = np.zeros(len(self.blocks), np.int64)
        for b in batches:
            for lists in b.column("probes"):
                of = self.group[lists.values.to_numpy()]
                n[np.unique(of[of >= 0])] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["grp", "n"])

    def take_turns(self, asked: dict[int, int]) -> None:
        self.turns = [math.ceil(asked.get(g, 0) / TURN) or 1 for g in range(len(self.blocks))]

    def queries(self, batches):
        """Rows of (grp, block, turn, asker, asked, own, times, lists): a vector for each group in which it probes a list."""
        for b in batches:
            reps, probes, cells, copies = (b.column(c).to_pylist() for c in ("rep", "probes", "cell", "copies"))
            rows = []
            for i, (rep, lists) in enumerate(zip(reps, probes)):
                lists = np.array([k for k in lists if self.group[k] >= 0], np.int64)
                of = self.group[lists]
                for g in np.unique(of).tolist():
                    turn = _dealt(rep, self.turns[g])
                    own = lists[of == g].tolist()
                    rows += [(g, block, turn, rep, i, cells[i], copies[i], own) for block in range(self.blocks[g])]
                if len(rows) >= 4096 or i == len(reps) - 1:
                    g, block, turn, rep_, at, cell, times, own = zip(*rows) if rows else [()] * 8
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(g, pa.int32()), pa.array(block, pa.int32()), pa.array(turn, pa.int32()), pa.array(rep_, pa.int64()),
                            b.column("embedding").take(pa.array(at, pa.int32())), pa.array(cell, pa.int32()), pa.array(times, pa.int64()),
                            pa.array(own, pa.list_(pa.int32()))
                        ],
                        names=["grp", "block", "turn", "asker", "asked", "own", "times", "lists"]
                    )
                    rows = []


def _dealt(rep: int, parts: int) -> int:
    return (rep * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % parts


def _compare(index, threshold: float):
    """A function from a turn of queries and a block of filed vectors to (rep, n, root) rows."""
    r = math.sqrt(2 - 2 * threshold) + 1e-9

    def run(queries: pd.DataFrame, filed: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        if not len(queries) or not len(filed):
            return none
        ix = index.value
        x, y = units(queries["asked"]), units(filed["embedding"])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in filed["code"]])
        most = ((r + filed["error"].to_numpy()) ** 2 + 1e-4).astype(np.float32)
        qid, fid, copies, cell = queries["asker"].to_numpy(), filed["rep"].to_numpy(), filed["copies"].to_numpy(), filed["cell"].to_numpy()
        times, home = queries["times"].to_numpy(), queries["own"].to_numpy()
        size = queries["lists"].map(len).to_numpy()
        asks, asker = np.concatenate(queries["lists"].to_numpy()), np.repeat(np.arange(len(x)), size)
        left, right = [], []
        for c in np.unique(cell):
            those, own = asker[asks == c], np.flatnonzero(cell == c)
            for i in range(0, len(those), 512):
                q = those[i : i + 512]
                t = ix.tables(x[q], int(c)).astype(np.float32)
                far = sum(t[:, j][:, codes[own, j]] for j in range(codes.shape[1]))
                a, b = np.nonzero(far <= most[own][None])
                for k in range(0, len(a), 65536):
                    u, v = q[a[k : k + 65536]], own[b[k : k + 65536]]
                    once = (home[u] != c) | (qid[u] < fid[v])  # in the vectors' own list both would ask
                    u, v = u[once], v[once]
                    ok = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
                    left.append(u[ok])
                    right.append(v[ok])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        if not len(a):
            return none
        ids, at = np.unique(np.concatenate([qid[a], fid[b]]), return_inverse=True)  # sorted, so the least place is the least id
        root = ids[local_roots(at[: len(a)], at[len(a) :], len(ids))]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, at[: len(a)], copies[b])
        np.add.at(n, at[len(a) :], times[a])
        return pd.DataFrame({"rep": ids, "n": n, "root": root})

    return run


def _linked(classes: DataFrame, index, threshold: float) -> DataFrame:
    """rep, n, root: links counted block by block, and a star of each block's linked vectors. index: broadcast."""
    filed = cut(_filed(classes, index, threshold), "filed")
    lists = len(index.value.centres)
    members = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}  # a row for each list: MOST_LISTS at most
    tasks = Tasks(members, lists)
    asked = filed.select("probes").mapInArrow(tasks.asked, "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    tasks.take_turns({r["grp"]: r["n"] for r in asked.collect()})  # a row for each group of lists
    queries = filed.select("rep", "embedding", "probes", "cell", "copies").mapInArrow(
        tasks.queries,
        f"grp int, block int, turn int, asker long, asked {filed.schema['embedding'].dataType.simpleString()}, own int, times long, lists array<int>"
    )
    of = lambda values: F.element_at(F.lit([int(v) for v in values]), F.col("grp") + 1)
    group = F.element_at(F.lit([int(g) for g in tasks.group]), F.col("cell") + 1)
    dealt = filed.select("rep", "embedding", "copies", "cell", "code", "error", group.alias("grp"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), of(tasks.blocks)).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), (of(tasks.turns) - 1).cast("int")))
    )
    return queries.groupBy("grp", "block", "turn").cogroup(dealt.groupBy("grp", "block", "turn")).applyInPandas(_compare(index, threshold), "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample_rows: int = 20_000, slack: float | None = None, recall: float = 0.998) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    sample_rows: about how many vectors the index is fitted on at most; all are filed. slack: how far beyond a plane lists are
    probed, as a share of the farthest that a neighbour can be; 1 finds every link, None is the least that finds `recall` of
    the links that the sample shows."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if own.schema["embedding"].dataType.simpleString() != "array<float>":
        own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    links = _linkable(own) & F.col("vec_id").isNotNull()
    ready = own.where(links)
    classes = cut(ready.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    sizes = {r["d"]: (r["n"], r["rows"]) for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).collect()}  # a row for each length of vectors
    found = spark.createDataFrame([], "rep long, n long, root long")
    for d, (n, _) in sorted(sizes.items()):
        of_length = classes.where(F.size("embedding") == d)
        drawn = of_length.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < math.ceil(min(1.0, sample_rows / n) * (1 << 20)))
        sample = units([r["embedding"] for r in drawn.orderBy("rep").collect() or of_length.limit(1).collect()])
        index = Index(sample, min(MOST_LISTS, len(sample), math.ceil(2 * math.sqrt(n))))
        if slack is None:
            index.calibrate(sample, threshold, recall)
        else:
            index.slack = slack
        found = found.unionByName(_linked(of_length, spark.sparkContext.broadcast(index), threshold))
    found = cut(found, "links")
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = classes.join(counted, "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = cut(by_class.select("embedding", F.coalesce("n", F.lit(0)).alias("n"), "copies", F.coalesce("component", "rep").alias("component")), "classes")
    # vectors of a thousandth of all rows or more are a thousand at most: their rows don't meet in one task
    common = F.col("copies") >= max(2, math.ceil(sum(rows for _, rows in sizes.values()) / 1_000))
    columns = ["vec_id", (F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id")]
    hot = F.broadcast(by_class.where(common))
    of_row = ready.join(hot, "embedding").select(*columns).unionByName(ready.join(
        hot.select("embedding"), "embedding", "left_anti"
    ).join(by_class.where(~common), "embedding").select(*columns))
    alone = own.where(~links).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_row.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
