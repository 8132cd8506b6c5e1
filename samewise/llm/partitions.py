"""Adaptive time partitions: a table as Parquet files of at most L rows, leaves of a calendar tree, rewritten by external merges.

Years, months, days and hours with more than L rows are split; neighbours within L share a leaf while its rows stay within L. As L is a
fixed share of the table, a layout has a bounded number of nodes, whatever the table's size: the driver holds that, and nothing else.

Writing a layout takes two jobs. Map tasks sort their rows by leaf and order and spill them as Parquet runs, a file for each bucket of
neighbouring leaves; a count by file and leaf says where each leaf's slice of a run lies. Then each output file is made by one task: for
a part of a long leaf it bisects the runs' keys for the places (merge path) between which the part's rows lie, reading only the row
groups it meets, and merges the slices, a row group of each at a time, by a heap. Files are named by what they hold and put in place by
a rename, so a task may run twice. A rewrite leaves a file alone whose leaf, part and rows recur; leaves that got no row aren't even spilled."""

from __future__ import annotations

import calendar
import hashlib
import heapq
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from samewise.llm.common import cut, discard, shared_dir, shuffle_partitions

HOUR = 3_600_000_000  # microseconds
EPOCH = datetime(1970, 1, 1)
FORMATS = ("{:04d}", "{:02d}", "{:02d}", "{:02d}")
LEAST = np.iinfo(np.int64).min  # a null in a sort key: nulls come first
RUNS = 1_024  # runs of a spill at most, so files that a merge reads at once
GROUP = 2 << 20  # bytes of a run's row group
OUT = 65_536  # rows of an output file's row group


def micros(ts: Column) -> Column:
    """Microseconds from 1970 on of a timestamp, by its own clock whatever the session's zone."""
    ts = ts.cast("timestamp_ntz")
    minutes = (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


# the layout


def _node(path: tuple[int, ...]) -> int:
    """The first hour, counted from 1970, of a year, month, day or hour."""
    y, m, d, h = (*path, *(0, 1, 1, 0)[len(path) :])
    return int((datetime(y, m, d, h) - EPOCH) // timedelta(hours=1))


def _children(path: tuple[int, ...]) -> range:
    if len(path) == 1:
        return range(1, 13)
    return range(1, calendar.monthrange(*path)[1] + 1) if len(path) == 2 else range(24)


def layout(hours: DataFrame, n: str, most: int) -> list[dict]:
    """Leaves by time: name, members (paths of their nodes), rows. hours: hour (from 1970, null for no moment), n: rows of it.

    A level below the years is asked for under nodes above `most` alone, of which there are fewer than the table's rows / `most`."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("hour") / 24).cast("int"))
    dated = hours.where(F.col(n) > 0).select(
        "hour", F.col(n).alias("n"), F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), F.pmod("hour", F.lit(24)).alias("h")
    )
    keys, found, parents = ("y", "m", "d", "h"), {}, None
    for depth in range(4):
        rows = dated.where("hour is not null")
        if parents is not None:
            if not parents:
                break
            under = hours.sparkSession.createDataFrame(parents, ", ".join(f"{k} int" for k in keys[:depth]))
            rows = rows.join(F.broadcast(under), list(keys[:depth]), "left_semi")
        level = {tuple(r)[:-1]: r["n"] for r in rows.groupBy(*keys[: depth + 1]).agg(F.sum("n").alias("n")).collect()}
        level = {tuple(map(int, p)): c for p, c in level.items()}
        found |= level
        parents = [p for p, c in level.items() if c > most]
    leaves: list[dict] = []

    def walk(parent: tuple[int, ...], siblings: range) -> None:
        run = None
        for x in siblings:
            path = (*parent, x)
            count = found.get(path, 0)
            if count > most:
                run = None
                if len(path) < 4:
                    walk(path, _children(path))
                else:
                    leaves.append({"members": [path], "rows": count})
            elif run is not None and run["rows"] + count <= most:
                run["members"].append(path)
                run["rows"] += count
            else:
                run = {"members": [path], "rows": count}
                leaves.append(run)

    years = [p[0] for p in found if len(p) == 1]
    if years:
        walk((), range(min(years), max(years) + 1))
    leaves = [x for x in leaves if x["rows"]]
    for x in leaves:
        first, last = x["members"][0], x["members"][-1]
        *above, own = (f.format(v) for f, v in zip(FORMATS, first))
        x["name"] = "/".join([*above, f"{own}-{FORMATS[len(last) - 1].format(last[-1])}"])
    nulls = hours.where("hour is null").agg(F.sum(n)).first()[0]
    return leaves + ([{"members": [], "rows": nulls, "name": "null"}] if nulls else [])


def _placed(rows: DataFrame, leaves: list[dict], buckets: int) -> DataFrame:
    """rows (with hour) and their leaf and bucket: a lookup for each level of the tree. Buckets are neighbouring leaves of about equal rows."""
    total, before, nodes = sum(x["rows"] for x in leaves), 0, {k: [] for k in range(4)}
    for i, x in enumerate(leaves):
        bucket = before * buckets // max(total, 1)
        before += x["rows"]
        for path in x["members"]:
            nodes[len(path) - 1].append((_node(path), i, bucket))
        if not x["members"]:
            null = F.struct(F.lit(i).alias("leaf"), F.lit(bucket).alias("bucket"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("hour") / 24).cast("int"))
    since = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 24
    starts = (since(F.trunc(day, "year")), since(F.trunc(day, "month")), since(day), F.col("hour"))
    hits = []
    for depth, own in nodes.items():
        if own:
            known = rows.sparkSession.createDataFrame(own, f"at{depth} long, leaf{depth} int, bucket{depth} int")
            rows = rows.join(F.broadcast(known), starts[depth] == F.col(f"at{depth}"), "left")
            hits.append(F.when(F.col(f"leaf{depth}").isNotNull(), F.struct(F.col(f"leaf{depth}").alias("leaf"), F.col(f"bucket{depth}").alias("bucket"))))
    if leaves and not leaves[-1]["members"]:
        hits.append(null)
    return rows.withColumn("place", F.coalesce(*hits))


# files that tasks read and write by themselves


def _filesystem(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


class _Run:
    """A Parquet file of a spill: sort keys and rows by place. It keeps one row group of either."""

    def __init__(self, files, path: str, keys: list[str]):
        self.file = pq.ParquetFile(files.open_input_file(path))
        self.keys, self.held = keys, {}
        sizes = [self.file.metadata.row_group(i).num_rows for i in range(self.file.metadata.num_row_groups)]
        self.ends = np.cumsum(sizes).tolist()

    def group(self, at: int, whole: bool):
        """The row group that holds row `at`: its first row, its keys (a column each), its rows or None."""
        i = bisect_right(self.ends, at)
        held = self.held.get(whole) or (self.held.get(True) if not whole else None)
        if not held or held[0] != i:
            rows = self.file.read_row_group(i, columns=None if whole else self.keys)
            held = (i, np.column_stack([_ints(rows.column(k)) for k in self.keys]) if self.keys else None, rows if whole else None)
            self.held[whole] = held
        return (self.ends[i - 1] if i else 0), held[1], held[2]

    def key(self, at: int) -> tuple:
        first, keys, _ = self.group(at, False)
        return tuple(keys[at - first].tolist())


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us")) if column.type.unit != "us" else column
    return column.cast(pa.int64()).fill_null(int(LEAST)).to_numpy(zero_copy_only=False)


class _Runs:
    """Open runs of a task, `most` at once."""

    def __init__(self, folder: str, keys: list[str], most: int = RUNS):
        self.files, self.base = _filesystem(folder)
        self.keys, self.most, self.open = keys, most, OrderedDict()

    def __getitem__(self, name: str) -> _Run:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].file.close()
            self.open[name] = _Run(self.files, f"{self.base}/{name}", self.keys)
        self.open.move_to_end(name)
        return self.open[name]


def _below(run: _Run, lo: int, hi: int, key: tuple, equal: bool) -> int:
    """The first place from lo to hi whose key is over `key`, or not under it if `equal` is false."""
    while lo < hi:
        mid = (lo + hi) // 2
        other = run.key(mid)
        if other < key or (equal and other == key):
            lo = mid + 1
        else:
            hi = mid
    return lo


def split_points(runs: list[_Run], slices: list[tuple[int, int]], rank: int) -> list[int]:
    """The place in each run before which its share of the `rank` first rows of all slices lies; equal keys come by run, then by place.

    A bisection: the middle key of the widest open interval is ranked in every run, which halves that interval and narrows the others."""
    lo, hi = [a for a, _ in slices], [b for _, b in slices]
    while True:
        j = max(range(len(runs)), key=lambda i: hi[i] - lo[i])
        if hi[j] == lo[j]:
            return lo
        mid = (lo[j] + hi[j]) // 2
        key = runs[j].key(mid)
        at = [mid if i == j else _below(runs[i], lo[i], hi[i], key, i < j) for i in range(len(runs))]
        if sum(at) - sum(a for a, _ in slices) >= rank:  # what lies before this row is enough
            hi = at
        else:
            lo = [x + (i == j) for i, x in enumerate(at)]


def merged(runs: list[_Run], slices: list[tuple[int, int]]) -> Iterator[pa.Table]:
    """The rows of all slices in order, a row group of each run in memory.

    The heap holds the last key of each run's group in hand. Up to the least of them every run's rows are known, and leave together."""
    hand: dict[int, list] = {}  # run: place, end of the group in hand, first row of the group, keys, rows
    heap: list[tuple] = []

    def take(i: int, at: int) -> None:
        if at < slices[i][1]:
            first, keys, rows = runs[i].group(at, True)
            end = min(slices[i][1], first + len(keys))
            hand[i] = [at, end, first, keys, rows]
            heapq.heappush(heap, (tuple(keys[end - 1 - first].tolist()), i))

    for i, (a, _) in enumerate(slices):
        take(i, a)
    while heap:
        last, j = heapq.heappop(heap)
        parts, keys = [], []
        for i in sorted(hand):
            at, end, first, own, rows = hand[i]
            to = end
            if i != j:
                lo, hi = at, end
                while lo < hi:
                    mid = (lo + hi) // 2
                    other = tuple(own[mid - first].tolist())
                    lo, hi = (mid + 1, hi) if other < last or (other == last and i < j) else (lo, mid)
                to = lo
            if to > at:
                parts.append(rows.slice(at - first, to - at))
                keys.append(own[at - first : to - first])
                hand[i][0] = to
        key = np.concatenate(keys)
        together = pa.concat_tables(parts)
        yield together.take(np.lexsort(key.T[::-1])) if len(parts) > 1 else together
        end = hand.pop(j)[1]
        take(j, end)


def _written(
    jobs: Iterator[pa.RecordBatch], spill: str, folder: str, keys: list[str], names: list[str], own: list[str], schema: pa.Schema, id_at: int,
    most: int
) -> Iterator[pa.RecordBatch]:
    """A row for each output file; what is written lies in the folder under its name."""
    runs = _Runs(spill, keys)
    files, base = _filesystem(folder)
    out = []
    for batch in jobs:
        for job in batch.to_pylist():
            slices = sorted((s["file"], s["start"], s["start"] + s["n"]) for s in job["slices"])
            held = [runs[f] for f, _, _ in slices]
            at = [(a, b) for _, a, b in slices]
            total = sum(b - a for a, b in at)
            if total > most:
                first = split_points(held, at, (job["part"] - 1) * most)
                last = split_points(held, at, min(total, job["part"] * most))
                at = list(zip(first, last))
            some = [i for i, (a, b) in enumerate(at) if a < b]
            name, n, fresh, ids, rows = f"{base}/.{uuid.uuid4().hex}", 0, 0, hashlib.sha256(), hashlib.sha256()
            with files.open_output_stream(name) as stream, pq.ParquetWriter(stream, schema) as writer:
                wait: list[pa.Table] = []
                for t in merged([held[i] for i in some], [at[i] for i in some]):
                    ids.update(("," * (n > 0) + ",".join("" if x is None else str(x) for x in t.column(own[id_at]).to_pylist())).encode())
                    rows.update(t.column("digest").combine_chunks().to_numpy(zero_copy_only=False).tobytes())
                    n += len(t)
                    fresh += int(np.count_nonzero(t.column("fresh").combine_chunks().to_numpy(zero_copy_only=False)))
                    wait.append(t.select(own).rename_columns(names).cast(schema))
                    if sum(map(len, wait)) >= OUT:
                        writer.write_table(pa.concat_tables(wait).combine_chunks())
                        wait = []
                if wait:
                    writer.write_table(pa.concat_tables(wait).combine_chunks())
            stays = job["was_rows"] == n and job["was_digest"] == rows.hexdigest()
            to = job["was_path"] if stays else f"{base}/{job['name'].replace('/', '_')}.part-{job['part']:05d}.{rows.hexdigest()[:24]}.parquet"
            if stays:
                files.delete_file(name)
            else:
                try:
                    files.move(name, to)
                except OSError:  # another attempt was first, with the same rows
                    if files.get_file_info(to).type.name != "File":
                        raise
                    files.delete_file(name)
                to = to if folder.startswith("/") else f"{folder}/{to.rpartition('/')[2]}"
            out.append({
                "leaf": job["name"], "part": job["part"], "columns": ",".join(names), "n_rows": n, "n_new": fresh, "ids_sha256": ids.hexdigest(),
                "rows_sha256": rows.hexdigest(), "path": to, "rewritten": not stays
            })
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=FILES_ARROW)
            out = []


FILES = "leaf string, part int, columns string, n_rows long, n_new long, ids_sha256 string, rows_sha256 string, path string, rewritten boolean"
FILES_ARROW = pa.schema([
    ("leaf", pa.string()), ("part", pa.int32()), ("columns", pa.string()), ("n_rows", pa.int64()), ("n_new", pa.int64()), ("ids_sha256", pa.string()),
    ("rows_sha256", pa.string()), ("path", pa.string()), ("rewritten", pa.bool_())
])


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; without a scheme where that is the machine's own or a mounted file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    uri = files.makeQualified(at).toString()
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def _uri(folder: str) -> str:
    return f"file://{folder}" if folder.startswith("/") else folder


def _keep_only(spark: SparkSession, folder: str, paths: set[str]) -> None:
    """Removes whatever else lies in the folder: files that were rewritten, and what stopped tasks left."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_uri(folder))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {p.rpartition("/")[2] for p in paths}
    for status in files.listStatus(at):
        if status.getPath().getName() not in names:
            files.delete(status.getPath(), True)


def write(rows: DataFrame, moment: Column, order: tuple[str, ...], fresh: Column, hours: DataFrame, n: str, most: int, folder: str, before: DataFrame | None = None) -> DataFrame:
    """Writes rows into the folder; a row for each file: leaf, part, columns, n_rows, n_new, ids_sha256, rows_sha256, path, rewritten.

    moment: microseconds, null for rows without one. order: the columns after it, numbers or timestamps, nulls first; the last one is
    the id that is digested. What is equal in all of these is ordered by a hash of the whole row. fresh: rows that are counted as new.
    hours: rows by hour of the moment (column n). most: rows of a file. before: what write() returned for this folder's files, if any;
    of these, the ones whose leaf, part and rows recur stay, and the others go."""
    spark = rows.sparkSession
    leaves = layout(hours, n, most)
    known = {} if before is None else {r["leaf"]: r["n_rows"] for r in before.groupBy("leaf").agg(F.sum("n_rows").alias("n_rows")).collect()}
    if before is not None:  # leaves that are as they were: the same rows at the start, none of them new
        hour = F.floor(moment / HOUR)
        got = _placed(rows.where(fresh).select(hour.alias("hour")), leaves, 1).select("place.leaf").groupBy("leaf").count() if leaves else None
        touched = {r["leaf"] for r in got.collect()} if got is not None else set()
        still = {x["name"] for i, x in enumerate(leaves) if i not in touched and known.get(x["name"]) == x["rows"]}
    else:
        still = set()
    own = [f"c{i}" for i in range(len(rows.columns))]
    schema = to_arrow_schema(rows.schema)
    keys = ["moment", *(own[rows.columns.index(c)] for c in order), "digest"]
    kept = [F.col(f"`{c}`").alias(o) for c, o in zip(rows.columns, own)]
    keyed = rows.select(*kept, moment.cast("long").alias("moment"), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).alias("digest"), fresh.alias("fresh"))
    found = [] if before is None else [before.where(F.col("leaf").isin(sorted(still))).withColumns({"n_new": F.lit(0).cast("long"), "rewritten": F.lit(False)})]
    if len(still) < len(leaves):
        names = spark.createDataFrame([(i, x["name"], x["rows"]) for i, x in enumerate(leaves) if x["name"] not in still], "leaf int, name string, rows long")
        placed = _placed(
            keyed.withColumn("hour", F.floor(F.col("moment") / HOUR)), leaves, max(8, shuffle_partitions(spark))
        ).select(*own, *(k for k in keys if k not in own), "fresh", "place.leaf", "place.bucket")
        if still:
            placed = placed.join(F.broadcast(names.select("leaf")), "leaf", "left_semi")
        spill = new_folder(spark, "samewise-runs")
        # no shuffle: each task sorts what it read, and writes the buckets one after another
        placed.coalesce(RUNS).sortWithinPartitions("bucket", "leaf", *keys).write.mode("overwrite").partitionBy("bucket").option(
            "parquet.block.size", GROUP
        ).option("maxRecordsPerFile", 0).parquet(_uri(spill))
        file = F.concat(F.lit("bucket="), F.col("bucket"), F.lit("/"), F.col("_metadata.file_name"))
        counts = spark.read.parquet(_uri(spill)).select(file.alias("file"), "leaf").groupBy("file", "leaf").agg(F.count("*").alias("n"))
        start = F.sum("n").over(Window.partitionBy("file").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))
        slices = counts.withColumn("start", F.coalesce(start, F.lit(0))).groupBy("leaf").agg(F.collect_list(F.struct("file", "start", "n")).alias("slices"))  # RUNS at most
        jobs = slices.join(F.broadcast(names), "leaf").withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("rows") / most).cast("int"))))
        was = (before if before is not None else spark.createDataFrame([], FILES)).select(
            F.col("leaf").alias("name"), "part", F.col("n_rows").alias("was_rows"), F.col("rows_sha256").alias("was_digest"),
            F.col("path").alias("was_path")
        )
        jobs = jobs.join(F.broadcast(was), ["name", "part"], "left").repartitionByRange(shuffle_partitions(spark), "leaf", "part")
        run = partial(_written, spill=spill, folder=folder, keys=keys, names=rows.columns, own=own, schema=schema, id_at=rows.columns.index(order[-1]), most=most)
        found.append(cut(jobs.mapInArrow(run, FILES), "files"))
    if not found:
        done = spark.createDataFrame([], FILES)
    else:
        done = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    done = cut(done, "manifest")
    _keep_only(spark, folder, {r["path"] for r in done.select("path").collect()})
    if len(still) < len(leaves):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_uri(spill))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return done


# the clicks


def click_moment(ts: Column, click_id: Column) -> Column:
    """Microseconds: ts, by the remainder k of the id's checksum moved back (k < 16) or to the Monday before (k > 111). A null id moves nothing."""
    k = F.coalesce(F.crc32(click_id.cast("string").cast("binary")) % 128, F.lit(64))
    day, at = 24 * HOUR, micros(ts)
    monday = F.floor(at / day) - F.pmod(F.floor(at / day) + 3, F.lit(7))
    return F.when(k < 16, at - (k + 6) * (k + 6) * (k + 6) * day).when(k > 111, monday * day).otherwise(at)


def rewritten(clicks: DataFrame, cutoff: str = "2024-03-01 00:00:00", share: int = 650) -> DataFrame:
    """A row for each final file of clicks: first the rows that arrived before the cutoff are written, then all rows.

    A new folder under spark.checkpoint.dir holds the files and stays. A file has 1 + rows // `share` rows at most. Null ts: leaf null;
    null arrived_at: not before the cutoff, first in order; null ids: the empty text in the digest. Repeated rows are rows of their own;
    extra columns are kept, whatever their names; an empty table gives no files and no rows."""
    spark = clicks.sparkSession
    most = 1 + clicks.count() // share
    moment = click_moment(F.col("ts"), F.col("click_id"))
    fresh = ~F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    # hours are bounded by the time the moments span, and never leave the tasks whole
    hours = cut(
        clicks.select(F.floor(moment / HOUR).alias("hour"), fresh.alias("fresh")).groupBy("hour").agg(F.count("*").alias("n"), F.count_if(~F.col("fresh")).alias("n_start")),
        "hours"
    )
    folder = new_folder(spark, "clicks")
    order = ("arrived_at", "click_id")
    first = write(clicks.where(~fresh), moment, order, F.lit(False), hours, "n_start", most, folder)
    return write(clicks, moment, order, fresh, hours, "n", most, folder, first)
