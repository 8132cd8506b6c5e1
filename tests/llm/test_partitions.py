"""Adaptive time partitions against a layout and an order worked out row by row."""

from __future__ import annotations

import calendar
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from samewise.llm import partitions

CUT = datetime(2024, 3, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, leaf string"


def moment(ts, click_id):
    if ts is None:
        return None
    k = zlib.crc32(str(click_id).encode()) % 128 if click_id is not None else 64
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = ts - timedelta(days=ts.weekday())
        return datetime(day.year, day.month, day.day)
    return ts


def leaves_of(moments: list, most: int) -> dict:
    """Leaf by the node (year, ... hour) of every moment."""
    counts = Counter(p for m in moments if m is not None for p in [(m.year, m.month, m.day, m.hour)[:d] for d in range(1, 5)])
    out = {}

    def name(run):
        pad = lambda v: f"{v:04d}" if v > 999 else f"{v:02d}"
        return "/".join([*map(pad, run[0][:-1]), f"{pad(run[0][-1])}-{pad(run[-1][-1])}"])

    def walk(siblings):
        runs, size = [], None
        for p in siblings:
            n = counts[p]
            if n > most:
                size = None
                if len(p) == 4:
                    runs.append([p])
                else:
                    y = p
                    below = range(1, 13) if len(y) == 1 else range(1, calendar.monthrange(*y)[1] + 1) if len(y) == 2 else range(24)
                    walk([(*p, x) for x in below])
            elif size is not None and size + n <= most:
                runs[-1].append(p)
                size += n
            else:
                runs.append([p])
                size = n
        for r in runs:
            out.update({p: name(r) for p in r})

    years = sorted({m.year for m in moments if m is not None})
    if years:
        walk([(y,) for y in range(years[0], years[-1] + 1)])
    return out


def files_of(rows: list[tuple], most: int) -> dict:
    """The rows of each (leaf, part), in order."""
    of, leaf_rows = leaves_of([moment(r[1], r[0]) for r in rows], most), defaultdict(list)
    for r in rows:
        m = moment(r[1], r[0])
        leaf = "null" if m is None else next(of[p] for d in range(1, 5) if (p := (m.year, m.month, m.day, m.hour)[:d]) in of)
        leaf_rows[leaf].append((m, r))
    low = datetime(1, 1, 1)
    out = {}
    for leaf, own in leaf_rows.items():
        own = [r for m, r in sorted(own, key=lambda x: (x[0] or low, x[1][2] or low, -1 if x[1][0] is None else x[1][0]))]
        for part in range(-(-len(own) // most)):
            out[leaf, part + 1] = own[part * most : (part + 1) * most]
    return out


def check(spark, rows: list[tuple], schema: str, share: int):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = spark.createDataFrame(rows, schema).repartition(5) if rows else spark.createDataFrame([], schema)
    got = partitions.rewritten(df, share=share).collect()
    most = 1 + len(rows) // share
    want, start = files_of(rows, most), files_of([r for r in rows if r[2] is not None and r[2] < CUT], most)
    assert {(g.leaf, g.part) for g in got} == set(want) and len(got) == len(want)
    some = lambda of: Counter(map(repr, of))
    for g in got:
        own = want[g.leaf, g.part]
        ids = ",".join("" if r[0] is None else str(r[0]) for r in own)
        held = [tuple(x.values()) for x in pq.read_table(g.path).to_pylist()]
        assert some(held) == some(own) and [r[:3] for r in held] == [r[:3] for r in own]
        assert g.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert (g.n_rows, g.n_new) == (len(own), sum(r[2] is None or r[2] >= CUT for r in own))
        assert g.columns == ",".join(df.columns)
        assert g.rewritten == (some(start.get((g.leaf, g.part), ["-"])) != some(own))
    made = [f for f in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before if f.startswith("clicks-")]
    assert len(made) == 1
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), made[0])
    assert {f for f in os.listdir(folder) if not f.endswith(".crc")} == {os.path.basename(g.path) for g in got} and all(os.path.dirname(g.path) == folder for g in got)
    return got


def clicks(rng: random.Random, n: int) -> list[tuple]:
    rows = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(microseconds=int(rng.random() ** 2 * 150 * 86400e6))
        if rng.random() < 0.3:
            ts = datetime(2024, 2, 28, 7, rng.randint(0, 59))  # a hot hour
        late = timedelta(days=rng.choice([0, 0, 0, 1, 40]), seconds=rng.randint(0, 5))
        arrived = None if rng.random() < 0.02 else ts + late
        rows.append((None if rng.random() < 0.02 else rng.randint(0, n), None if rng.random() < 0.05 else ts, arrived, i % 7, rng.choice(["view", None]), rng.choice([None, 1.5, float(i)]), "own"))
    return rows + rng.sample(rows, n // 10)


@pytest.mark.parametrize("share", [3, 20, 120])
def test_files_of_two_layouts(spark, share):
    rows = clicks(random.Random(share), 900)
    got = check(spark, rows, SCHEMA, share)
    assert share < 20 or (any(g.part > 2 for g in got) and any(not g.rewritten for g in got))


def test_small_row_groups_and_few_open_runs(spark, monkeypatch):
    monkeypatch.setattr(partitions, "GROUP", 100)
    monkeypatch.setattr(partitions, "OUT", 50)
    monkeypatch.setattr(partitions, "RUNS", 2)
    check(spark, clicks(random.Random(9), 1500), SCHEMA, 7)


def test_one_moment_only_no_moment_no_rows(spark):
    at = datetime(2024, 2, 29, 23, 59, 59, 999999)
    check(spark, [(5, at, at + timedelta(days=i % 3), 1, "x", 2.0, None) for i in range(50)], SCHEMA, 4)
    check(spark, [(i, None, at, 1, "x", 2.0, None) for i in range(5)], SCHEMA, 4)
    check(spark, [], SCHEMA, 4)


def test_query_over_a_whole_table(spark):
    from samewise.llm.queries import op12_partitions

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/clicks.parquet").collect()]
    got = op12_partitions(spark, "/root/testdata/sf0.001").collect()
    want = files_of(rows, 1 + len(rows) // 650)
    assert {(g.leaf, g.part): g.ids_sha256 for g in got} == {k: hashlib.sha256(",".join(str(r[0]) for r in own).encode()).hexdigest() for k, own in want.items()}


def test_split_points_equal_a_full_merge():
    rng = random.Random(2)

    class Held(partitions._Run):
        def __init__(self, keys):
            self.keys_ = sorted(keys)

        def key(self, at):
            return self.keys_[at]

    for _ in range(200):
        runs = [Held([(rng.randint(0, 6), rng.randint(0, 2)) for _ in range(rng.randint(0, 12))]) for _ in range(rng.randint(1, 6))]
        slices = [tuple(sorted((rng.randint(0, len(r.keys_)), rng.randint(0, len(r.keys_))))) for r in runs]
        every = sorted((r.keys_[p], i, p) for i, (r, (a, b)) in enumerate(zip(runs, slices)) for p in range(a, b))
        rank = rng.randint(0, len(every))
        first = Counter(i for _, i, _ in every[:rank])
        assert partitions.split_points(runs, slices, rank) == [a + first[i] for i, (a, _) in enumerate(slices)]
