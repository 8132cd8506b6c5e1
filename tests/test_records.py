import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from samewise.sources import records


def test_json_both_shapes(spark, tmp_path):
    rows = [{"id": "QB-1", "display_name": "Cenlar, LLC.", "type": "Customer", "email": "A@x.com"}, {"Id": "2", "DisplayName": "Chen, Ann", "type": "Employee", "PrimaryEmailAddr": {"Address": "c@x.com"}, "entity_category": ""}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    read = records.read_json(spark, str(tmp_path / "a.json"), "accounting")
    got = {r.source_id: (r.normalized_name, r.entity_category, r.email, r.category) for r in records.entities(read, "accounting").collect()}
    assert got == {"QB-1": ("cenlar", "organization", "A@x.com", "accounting"), "2": ("ann chen", "person", "c@x.com", "accounting")}
    assert records.matching(read, "accounting", email_contains="a@X").count() == 1
    assert records.of_kind(read, "accounting", "Client").count() == 1
    with pytest.raises(ValueError):
        records.kind_of("psa", "planet")


def test_psa_file(spark, tmp_path):
    rows = [{"id": "RD-1", "display_name": "Cenlar FSB", "type": "client", "slug": "cenlar", "projects": [{"code": "CEN-1", "name": "n", "status": "active", "budget_hours": 10, "logged_hours": 1.5, "hourly_rate": 2.0, "department": "d"}]}, {"id": "RD-2", "display_name": "Chen, Ann", "type": "team-member", "department": "Ops", "email": "c@x.com"}]
    (tmp_path / "b.json").write_text(json.dumps(rows))
    read = records.read_json(spark, str(tmp_path / "b.json"), "psa")
    assert [r.source_id for r in records.project_records(records.of_kind(read, "psa", "client")).collect()] == ["RD-1::CEN-1"]
    assert [r.id for r in records.of_kind(read, "psa", "Resource").collect()] == ["RD-2"]
    got = {r.source_id: (r.normalized_name, r.entity_category, r.category, r.email_is_person) for r in records.entities(read, "psa").collect()}
    assert got == {"RD-1": ("cenlar fsb", "organization", "psa", False), "RD-2": ("ann chen", "person", "psa", True)}
    assert records.matching(read, "psa", department="Ops").count() == 1 and records.matching(read, "psa", email_contains="X.com").count() == 1
    (tmp_path / "c.json").write_text('{"id": 1}')
    with pytest.raises(Exception):
        records.read_json(spark, str(tmp_path / "c.json"), "psa").collect()


def test_operational(spark):
    texts = ['{"Id": "7", "Name": "Sales", "ParentRef": {"value": "3"}, "Active": true, "n": 2}', '{"id": 8, "name": "Ops", "ParentRef": "x"}', "[1]", "{bad", None]
    got = {r.source_id: r for r in records.operational(spark.createDataFrame([(t,) for t in texts], "record string"), "Class").collect()}
    assert set(got) == {"7", "8"} and (got["7"].name, got["7"].parent_source_id, got["8"].parent_source_id, got["8"].name) == ("Sales", "3", None, "Ops")
    assert json.loads(got["7"].attributes) == {"ParentRef": {"value": "3"}, "Active": True, "n": 2}
    with pytest.raises(ValueError):
        records.project_records(spark.createDataFrame([], f"id string, projects {records.PROJECTS}"), "task")


def test_ranges_reach_the_files(spark, tmp_path):
    days = spark.sql("select id, date_add(date'2020-01-01', cast(id as int)) as day, cast(date_add(date'2020-01-01', cast(id as int)) as timestamp) + interval 5 hours as at, 1.0d as amount, '' as currency, 1L as customer, 2L as vendor from range(100)")
    days.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for column in ("day", "at"):
        own = rows.withColumnRenamed(column, "txn_date")
        out = records.transactions(own, own.limit(0), own.limit(0), "2020-01-05", "2020-01-07")
        assert sorted(r.txn_date for r in out.collect()) == ["2020-01-05", "2020-01-06", "2020-01-07"]
        assert f"GreaterThanOrEqual({column}," in out._jdf.queryExecution().executedPlan().toString()


def test_throttle_and_backoff(spark):
    rng = random.Random(2)
    calls = [(rng.choice(["a", "b", None]), rng.randint(0, 30_000)) for _ in range(400)]
    df = spark.createDataFrame(calls, "connector string, t long").select("connector", F.timestamp_seconds("t").alias("at"))
    got = Counter((r.connector, int(r.at.timestamp()), r.recent, r.over_limit) for r in records.throttled(df, 5, 60).collect())
    want = Counter((c, t, n := sum(c == d and t - 60 < u <= t for d, u in calls), n > 5) for c, t in calls)
    assert {(c, n, o): v for (c, _, n, o), v in got.items()}.keys() <= {(c, n, o) for c, _, n, o in want} and sum(got.values()) == 400
    assert sorted(x[2] for x in got.elements()) == sorted(x[2] for x in want.elements())
    assert [r.wait for r in records.backoffs(spark.createDataFrame([(1,), (2,), (4,)], "attempt int")).collect()] == [0.5, 1.0, 4.0]


def test_tokens_expire(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-02T00:00:00+00:00",), ("2024-01-03T00:00:00Z",), ("never",), (None,)], "until string")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert [r[0] for r in rows.select(records.expired(F.col("until"), now)).collect()] == [True, True, False, False, False]


def test_projects(spark):
    rows = spark.createDataFrame([("p", [("CEN-1", "n", "active", 1, 1.0, 1.0, "d"), None]), ("q", None)], f"id string, projects {records.PROJECTS}")
    assert [r.source_id for r in records.projects(rows).collect()] == ["p::CEN-1"]
    assert records.projects(rows, code_prefix="cen").count() == 0


def test_writes(spark):
    rows = spark.createDataFrame([("quickbooks", "accounting", "create"), ("x", None, "drop")], "target_source string, target_category string, operation string")
    checked = records.proposal_issues(rows, "quickbooks", "accounting")
    assert sorted(len(r.issues) for r in checked.collect()) == [0, 3]
    written = records.shadow_writes(checked)
    assert written.count() == 1 and not written.collect()[0].executed and records.rollbacks(written).collect()[0].rolled_back


def test_export(spark, tmp_path):
    rows = records.entities(spark.createDataFrame([("1", "Foo Inc", "Customer", None)], "id string, display_name string, type string, email string"), "accounting")
    records.export_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(records.EXPORT)


def test_stream(spark, tmp_path):
    from samewise.streaming import ingest

    spark.createDataFrame([("1", "organization", "The Foo")], "id string, entity_category string, display_name string").write.parquet(str(tmp_path / "in"))
    stream = ingest.normalized(ingest.arriving(spark, str(tmp_path / "in"), "id string, entity_category string, display_name string"))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.normalized_name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["foo"]
