"""What a task or the driver holds doesn't grow with copies."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from samewise.operators import graph, kinds, orchestrator, registry


def _vectors(ids, rows):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(rows), pa.list_(pa.float64()))], names=["vec_id", "v"])


def test_ties_of_a_scan_are_bounded():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(4, 6)), 5000, 0)  # four vectors, 5,000 copies of each
    ids = rng.permutation(len(x))
    asked = pa.table({"query_id": pa.array(ids[:300]), "q": pa.array(list(x[:300]), pa.list_(pa.float64()))})
    block, batch = graph._Block(asked), _vectors(ids, x)
    tracemalloc.start()
    got = pa.Table.from_batches(graph._nearest(iter([batch.slice(0, 9000), batch.slice(9000)]), block, 3)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all ties of 300 queries are 1,500,000 rows
    same = np.sort(ids[:5000])[:4]  # copies of the queries' vector, the query itself left out
    want = {(int(q), int(v)) for q in ids[:300] for v in same[same != q][:3]}
    assert {(r.query_id, r.vec_id) for r in got.itertuples()} == want and (got.cosine == 1).all()


def test_repeated_ids_of_a_query_take_no_place():
    batch = _vectors([7] * 9 + [1, 2, 3], [[1.0, 0.0]] * 9 + [[1.0, 0.1], [1.0, 0.2], [1.0, 0.3]])
    block = graph._Block(pa.table({"query_id": pa.array([7]), "q": pa.array([[1.0, 0.0]], pa.list_(pa.float64()))}))
    assert pa.Table.from_batches(graph._nearest(iter([batch]), block, 3)).column("vec_id").to_pylist() == [1, 2, 3]


def test_repeated_values_are_not_broadcast_by_their_file(spark):
    wide = graph.written(spark.range(3000).select("id", F.lit("x" * 3000).alias("text")))  # 9 MB in a file of some kB
    few = spark.range(5000)
    plan = lambda df: few.join(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(wide) and "BroadcastHashJoin" in plan(kinds.beside(wide))
    assert "SortMergeJoin" in plan(kinds.beside(wide, 1 << 20))


def test_the_best_candidate_alone_is_told_of(spark, monkeypatch):
    placed = spark.createDataFrame([("E1", "C1", 0.95, "AUTO_APPROVE"), ("E2", None, None, "NO_MATCH")], "entity_id string, top_match string, top_score double, action string")
    scores = spark.createDataFrame([(f"E{e}", f"C{c}", 0.1 * c) for e in (1, 2) for c in range(1, 9)], "entity_id string, canonical_id string, partial double")
    entities = spark.createDataFrame([("E1", "x", "1"), ("E2", "x", "2")], "entity_id string, source string, source_id string")
    anchored = spark.createDataFrame([], "entity_id string, canonical_id string, confidence double, match_key_type string")
    asked = spark.createDataFrame([], "entity_id string, reasoning string")
    told, keep = [], graph.written
    monkeypatch.setattr(orchestrator, "written", lambda df: told.append(keep(df)) or told[-1])
    rows = {r.entity_id: (r.match_type, r.signal_breakdown) for r in orchestrator._results(anchored, placed, asked, scores, entities).collect()}
    assert rows == {"E1": ("scored", '{"partial":0.1}'), "E2": ("new", None)} and [t.count() for t in told] == [1, 1]


def test_shared_neighbours_in_shares(spark):
    edges = spark.createDataFrame([(f"C{i}", f"C{900 + j}", "X") for i in range(40) for j in range(3) if (i + j) % 4], "source_node string, target_node string, relationship string")
    canon = spark.createDataFrame([(f"C{i}", "t1", "person" if i % 2 else "organization") for i in range(903)], "canonical_id string, tenant_id string, entity_category string")
    pairs = spark.createDataFrame([(f"C{i}", f"C{i + 1}") for i in range(39)] + [("C1", "C902"), ("C1", "none")], "left_id string, right_id string")
    near: dict = {}
    for r in edges.collect():
        near.setdefault(r[0], set()).add(r[1])
        near.setdefault(r[1], set()).add(r[0])
    both = {(a, b): near.get(a, set()) & near.get(b, set()) for a, b in ((r[0], r[1]) for r in pairs.collect())}
    out = registry.shared_neighbours(pairs, edges, canon)
    assert {(r[0], r[1]): (r[2], r[3]) for r in out.collect()} == {k: (len(v), sum(int(x[1:]) % 2 for x in v)) for k, v in both.items()}
    # shares by a number of partitions that is asked for
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 4
