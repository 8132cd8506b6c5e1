"""Rows of pairs come by lists, what depends on a pair's state comes without a join, and the rows are the SQL's."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from samewise.operators import kinds, matching

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["graph_signals", "trigram_block", "token_block"])
def test_rows_equal_the_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    found = db.execute(entry.oracle_sql()[name])
    columns = [c[0].lower() for c in found.description]
    got = entry.queries()[name](spark, SF)
    want = sorted(found.fetchall())
    assert want and sorted(map(tuple, got.select(*columns).collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    if name == "graph_signals":
        # two joins make the pairs; no third one is made for each of them
        assert plan.count("Join Inner") == 2 and "Repartition" in plan
    else:
        assert "Generate explode" in plan


@pytest.mark.parametrize("most_bytes", [kinds.BYTES, 0])
def test_a_kind_of_many_keys_has_several_lists(spark, monkeypatch, most_bytes):
    small = kinds.small
    monkeypatch.setattr(kinds, "LISTED", 7)
    monkeypatch.setattr(kinds, "small", lambda df, size=most_bytes: small(df, most_bytes))
    entities = spark.createDataFrame([(f"E{i:03}", ("atlas group", "cora")[i % 4 == 0]) for i in range(40)], "entity_id string, normalized_name string")
    canon = spark.createDataFrame([(f"C{i:03}", "t1", ("atlas media", "cora")[i % 2]) for i in range(6)], "canonical_id string, tenant_id string, canonical_name string")
    aliases = spark.createDataFrame([], "canonical_id string, value string, confidence double")
    met = matching.met(entities, canon, aliases)
    rows = kinds.listed(met.left, "left_kind", "entity_id").select(F.size("of").alias("n")).collect()
    assert max(r.n for r in rows) == 7 and sum(r.n for r in rows) == 40
    got = sorted((r.entity_id, r.canonical_id, r.n) for r in met.keys().collect())
    assert got == sorted((f"E{i:03}", f"C{j:03}", 1) for i in range(40) for j in range(6) if (i % 4 == 0) == (j % 2 == 1))
