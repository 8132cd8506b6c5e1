"""Jaccard join of documents on word n-grams: MinHash banding, verified on the full n-gram sets.

Words are what stands between the six ASCII white-space characters, as they are. A text's set holds a 64-bit hash of every
five words in a row; a text of fewer words has one n-gram, all of its words; a null text or one without words has none and
links with nothing. Equal sets (copies) form one class, compared once.

Bands are counted first, and only classes that share one have their sets built and moved. Classes that bands chain together are
dealt together, small chains many to a task, larger ones in blocks, so that a set moves once or a few times. Chains grow
without bound where texts are many, so those of more than `GIANT` classes are dealt by their bands: a pair is verified in the
first band that it shares, and a band that many share is compared block against block. In each case those pairs that share a band
are verified, whole, and no others. Links are counted where they are found, and a star of each block's links leaves it.

Rows with a null doc_id, or without words, come back alone with no link; rows of the same doc_id are documents of their own
that share an id; extra columns are ignored, or passed on if named; an empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, cut, release
from samewise.llm.graph import components, local_roots

WIDTH = 5
#: Classes of a block at most; and of a chain that is compared whole, beside others.
BLOCK, SMALL = 1024, 128
#: Bytes of n-grams that a block holds, about.
BYTES = 32 << 20
#: Blocks that a chain of more than SMALL classes is cut into at least, so that no task has all of it.
PARTS = 8
#: Classes of a chain beyond which it is dealt by bands.
GIANT = 16_384
U = np.uint64


def plan_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest false candidates, that find a pair at the threshold with `recall`."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach this recall")


class Hashes(dict):
    """64-bit hashes of words, `most` at once."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = Hashes()


def _tidied(run):
    """run, and then the worker's hashes and free memory given back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release(_hashes)

    return wrapped


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - WIDTH + 1)
    total = np.zeros(n, np.uint64) + U(len(h) if len(h) < WIDTH else WIDTH)
    for k in range(min(WIDTH, len(h))):
        total = _mixed(total + h[k : k + n])
    return np.unique(total)


class Bands:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * U(2) + U(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A hash for each band of the MinHash signature."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max)
        for i in range(0, len(grams), 2048):
            low = np.minimum(low, (_mixed(grams[i : i + 2048])[:, None] * self.a[None] + self.b[None]).min(0))
        out = np.arange(1, self.bands + 1).astype(np.uint64)
        for part in low.reshape(self.bands, self.rows).T:
            out = _mixed(out + part)
        return out.view(np.int64)


def _signed(docs: DataFrame, bands: Bands, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, key (of the n-gram set; null without words), bands, size (n-grams), and the columns `keep` as keep_0 and so on."""

    def run(batches):
        for b in batches:
            keys, hashes, size = [], [], []
            for t in b.column(1):
                g = shingles(t.as_py())
                size.append(len(g))
                keys.append(xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63) if len(g) else None)
                hashes.append(bands.of(g) if len(g) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(size, pa.int64()), *b.columns[2:]],
                names=["doc_id", "key", "bands", "size", *b.schema.names[2:]]
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)))
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in own.schema.fields[2:])
    return own.mapInArrow(_tidied(run), "doc_id long, key long, bands array<long>, size long" + more)


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _with_sets(docs: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """key and sorted n-gram set, each key once, of the texts whose doc_id is in wanted (doc_id); the wanted are broadcast if they are `most` at most."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = own.join(_small(wanted, most), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63) if len(g) else None for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())],
                names=["key", "grams"]
            )

    # a text may come again under its id, in any number of rows
    return picked.mapInArrow(_tidied(run), "key long, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))


def _verify(threshold: float):
    """A function from a block pair's rows to (key, n, root): links by class, and the least class its links reach in the block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # of a block held against itself, or of chains beside each other, each class comes once; by bands, once a band
        two = rows["low"].iloc[0] != rows["high"].iloc[0]  # a block of no classes may be one of the two
        rows = rows.drop_duplicates(["key", "band", "side"] if two else ["key", "band"])
        by_band, band = rows["kind"].iloc[0] == BANDED, rows["band"].to_numpy()
        keys, side, copies = rows["key"].to_numpy(), rows["side"].to_numpy(), rows["copies"].to_numpy()
        bands = np.stack(rows["bands"].to_numpy())
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        size = np.array([len(g) for g in sets])
        left, right = [], []
        if len(sets) > 1:
            flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
            codes = np.unique(flat, return_inverse=True)[1]
            flag = np.zeros(int(codes.max()) + 1, np.int32)
            for i in range(len(sets)):
                same = bands == bands[i]
                shared = same.any(1)
                if by_band:  # in the first band that both have, and in no other
                    shared &= (band == band[i]) & (bands[i][same.argmax(1)] == band[i])
                shared &= (side > side[i]) if two else (np.arange(len(sets)) > i)
                js = np.flatnonzero(shared)
                js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i])]
                if not len(js):
                    continue
                mine = codes[start[i] : start[i] + size[i]]
                flag[mine] = 1
                if len(js) * 4 > len(sets):
                    both = np.add.reduceat(flag[codes], start)[js]
                else:
                    both = np.array([flag[codes[start[j] : start[j] + size[j]]].sum() for j in js])
                flag[mine] = 0
                js = js[both >= threshold * (size[i] + size[js] - both)]
                left.append(np.full(len(js), i))
                right.append(js)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        if not len(a):
            return pd.DataFrame({"key": [], "n": [], "root": []}).astype("int64")
        order = np.argsort(keys, kind="stable")  # so that the least place is the least key
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        root = keys[order][local_roots(place[a], place[b], len(keys))][place]
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        linked = np.unique(np.concatenate([a, b]))
        return pd.DataFrame({"key": keys[linked], "n": n[linked], "root": root[linked]})

    return run


CHAINS, BLOCKS, BANDED = 0, 1, 2
DEALT = "struct<kind:int,group:long,band:long,low:int,high:int,side:int>"


def _blocks(classes: Column, grams: Column) -> Column:
    """How many blocks so many classes, of so many n-grams, are cut into."""
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(grams * 8 / BYTES), F.when(classes > SMALL, F.least(F.lit(PARTS), F.ceil(classes / SMALL))).otherwise(1)).cast("int")


def _to_blocks(kind: int, group: Column, band: Column) -> Column:
    """The pairs of blocks, of `blocks` in all, that a class of block `own` is in."""

    def pair(k):
        return F.struct(
            F.lit(kind).alias("kind"), group.alias("group"), band.alias("band"), F.least("own", k).alias("low"), F.greatest("own", k).alias("high"),
            F.when(F.col("own") <= k, 0).otherwise(1).alias("side")
        )

    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)


def _together(kind: int, part: Column, of: Column, band: Column) -> Column:
    """One of `of` groups that hold many chains or bands each."""
    return F.struct(
        F.lit(kind).alias("kind"), F.pmod(F.xxhash64(part), of).alias("group"), band.alias("band"), F.lit(-1).alias("low"), F.lit(-1).alias("high"),
        F.lit(0).alias("side")
    )


def _groups(rows: DataFrame) -> int:
    """Groups of about BLOCK classes and BYTES for all of rows (size)."""
    n, grams = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1, math.ceil(n / BLOCK), math.ceil(grams * 8 / BYTES))


def _dealt(grouped: DataFrame, crowded: DataFrame, most: int) -> DataFrame:
    """key, copies, bands, and where each class is compared: kind, group, band, low, high, side. grouped: classes with their component."""
    none = F.lit(0).cast("long")
    sized = grouped.groupBy("component").agg(F.count("*").alias("m"), F.sum("size").alias("grams"))
    large = cut(sized.withColumn("blocks", _blocks(F.col("m"), F.col("grams"))).where("blocks > 1").select("component", "m", "blocks"), "chains")
    placed = cut(grouped.join(_small(large, most), "component", "left"), "chains")
    alone = placed.where("blocks is null")
    whole = alone.select("key", "copies", "bands", _together(CHAINS, F.col("component"), F.lit(_groups(alone)), none).alias("to"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own")
    middle = placed.where(F.col("m") <= GIANT).select("key", "copies", "bands", "component", "blocks", own)
    middle = middle.select("key", "copies", "bands", F.explode(_to_blocks(BLOCKS, F.col("component"), none)).alias("to"))
    out = whole.unionByName(middle)
    giant = placed.where(F.col("m") > GIANT)
    if giant.limit(1).count():
        by_band = cut(giant.select("key", "copies", "bands", "size", F.explode("bands").alias("band")).join(_small(crowded.select("band"), most), "band", "left_semi"), "by-band")
        hot = cut(
            by_band.groupBy("band").agg(
                F.count("*").alias("m"), F.sum("size").alias("grams")
            ).withColumn("blocks", _blocks(F.col("m"), F.col("grams"))).where("blocks > 1").select("band", "blocks"),
            "hot-bands"
        )
        by_band = by_band.join(_small(hot, most), "band", "left")
        cool = by_band.where("blocks is null")
        out = out.unionByName(cool.select("key", "copies", "bands", _together(BANDED, F.col("band"), F.lit(_groups(cool)), F.col("band")).alias("to")))
        hotter = by_band.where("blocks is not null").select("key", "copies", "bands", "band", "blocks", own)
        out = out.unionByName(hotter.select("key", "copies", "bands", F.explode(_to_blocks(BANDED, F.col("band"), F.col("band"))).alias("to")))
    return out.select("key", "copies", "bands", F.col("to").cast(DEALT).alias("to")).select("key", "copies", "bands", "to.*")


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995, most_broadcast: int = 1_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of docs: doc_id, class_id (least doc_id that links reach, itself included), copy_of (least doc_id of equal set), n_links
    (other documents linked directly), kept, class_key and the columns `keep`.

    Ids may be shared by different texts; class_key names a class without them (a hash of one of its sets), null for a row that is compared with nothing."""
    bounded_batches(docs.sparkSession)
    signed = cut(_signed(docs, Bands(*plan_bands(threshold, recall)), keep), "signed")
    known = signed.where("key is not null and doc_id is not null")
    classes = cut(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")), "classes")
    in_band = classes.select("key", F.explode("bands").alias("band"))
    crowded = cut(in_band.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least"), "bands")
    # a class is joined to the least of its bands' least classes, and that one to the others: no more edges than classes, and few
    leasts = cut(in_band.join(crowded, "band").groupBy("key").agg(F.collect_set("least").alias("of")).select("key", F.array_min("of").alias("low"), "of"), "leasts")
    near = components(leasts.select(F.col("key").alias("a"), F.col("low").alias("b")).union(leasts.select("low", F.explode("of")).distinct()))
    grouped = cut(near.withColumnRenamed("id", "key").join(classes, "key"), "groups")
    sets = _with_sets(docs, grouped.select(F.col("rep").alias("doc_id")).distinct(), most_broadcast)
    rows = sets.join(_dealt(grouped, crowded, most_broadcast), "key").select("key", "copies", "bands", "grams", "kind", "group", "band", "low", "high", "side")
    links = cut(rows.groupBy("kind", "group", "low", "high").applyInPandas(_verify(threshold), "key long, n long, root long"), "links")
    linked = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    by_class = classes.select("key", "rep", "copies").join(
        links.groupBy("key").agg(F.sum("n").alias("n")), "key", "left"
    ).join(linked.withColumnRenamed("id", "key"), "key", "left")
    by_class = cut(by_class.select("key", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component")), "classes")
    least = by_class.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = cut(by_class.join(least, "component").select("key", "rep", "n_links", "class_id", F.col("component").alias("class_key")), "classes")
    passed = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    compared = known.join(named, "key").select("doc_id", "class_id", F.col("rep").alias("copy_of"), "n_links", "class_key", *passed)
    alone = signed.where("key is null or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("class_key"), *passed
    )
    out = compared.unionByName(alone)
    return out.select("doc_id", "class_id", "copy_of", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "class_key", *keep)
