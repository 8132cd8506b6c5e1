"""Batches that are added once, streams that are replayed, and the state they leave."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from samewise.operators import resolution
from samewise.sources import commits
from samewise.streaming import ingest

SCHEMA = "change_id long, client_id long, seq long, op string, at timestamp_ntz"


def test_a_batch_is_added_once(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert commits.committed(spark, folder, "id long").count() == 0
    assert resolution.append(spark.range(5), folder, "run 1/a") and not resolution.append(spark.range(9), folder, "run 1/a")
    assert resolution.append(spark.range(7, 9), folder, "run 2")
    got = commits.committed(spark, folder, "id long").collect()
    assert sorted((r.id, r.batch) for r in got) == [*((i, "run 1/a") for i in range(5)), (7, "run 2"), (8, "run 2")]


def test_a_run_that_was_stopped_leaves_nothing_and_its_retry_adds_all(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "table")
    own = commits._commit

    def stopped(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "_commit", stopped)
    with pytest.raises(KeyboardInterrupt):
        commits.append_once(spark.range(5), folder, "k")
    assert commits.committed(spark, folder, "id long").count() == 0
    monkeypatch.setattr(commits, "_commit", own)
    assert commits.append_once(spark.range(5), folder, "k") and commits.committed(spark, folder, "id long").count() == 5


def test_of_two_runs_at_a_time_one_counts(spark, tmp_path):
    folder = str(tmp_path / "table")
    for i in (1, 2):
        spark.range(5).write.parquet(f"{folder}/_staging/{i}")
    assert [commits._commit(spark, f"{folder}/_staging/{i}", f"{folder}/batch=k") for i in (1, 2)] == [True, False]
    assert commits.committed(spark, folder, "id long").count() == 5


def test_a_replayed_stream_changes_nothing_and_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 40) if rng.random() < 0.7 else 1, rng.randint(0, 9), rng.choice("IUUD"), datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(400)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    source, folder = str(tmp_path / "in"), str(tmp_path / "table")
    df.repartition(4).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.sync(stream(), folder, str(tmp_path / "c1"), "changes").awaitTermination()
    state = lambda: sorted(map(tuple, commits.latest(commits.committed(spark, folder, SCHEMA).drop("batch"), ["client_id"], ["seq", "change_id"], "op = 'D'").collect()))
    last = {}
    for i, c, s, op, at in rows:
        last[c] = max(last.get(c, (-1, -1, "", at)), (s, i, op, at))
    want = sorted((c, i, s, op, at) for c, (s, i, op, at) in last.items() if op != "D")
    first = state()
    assert first == want and len({r.batch for r in commits.committed(spark, folder, SCHEMA).select("batch").distinct().collect()}) == 4
    ingest.sync(stream(), folder, str(tmp_path / "c2"), "changes").awaitTermination()  # its checkpoint was lost: every batch comes again
    assert state() == want and commits.committed(spark, folder, SCHEMA).count() == len(rows)
    df.limit(0).write.mode("append").parquet(source)
    spark.createDataFrame([(999, 1, 99, "U", datetime(2025, 1, 1))], SCHEMA).write.mode("append").parquet(source)
    ingest.sync(stream(), folder, str(tmp_path / "c1"), "changes").awaitTermination()
    assert (1, 999, 99, "U", datetime(2025, 1, 1)) in state()
    mark = ingest.marks(commits.committed(spark, folder, SCHEMA), "op", "at", "change_id").where("connector = 'U'").first()
    assert mark.high_water == datetime(2025, 1, 1) and mark.n == len({r[0] for r in rows if r[3] == "U"}) + 1


def test_repeats_within_the_watermark_go(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1, 0, 5)), (2, datetime(2024, 1, 1, 1)), (2, datetime(2024, 1, 1, 1))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "id int, at timestamp").write.parquet(source)
    stream = ingest.once(ingest.arriving(spark, source, "id int, at timestamp"), "at", ["id"], "1 day")
    ingest.append(stream, out, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
