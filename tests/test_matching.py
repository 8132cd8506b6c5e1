import pytest
from pyspark.sql import functions as F

from samewise.functions import redaction as R
from samewise.operators import assess, disposition, evidence, graph, matching, registry, reporting, resolution, scoring


@pytest.fixture(scope="module")
def store(spark):
    canon = spark.createDataFrame([("C1", "t1", "atlas media", "client", "organization"), ("C2", "t2", "ana ruiz", "person", "person"), ("C3", "t1", "atlas media", "client", "organization"), ("C4", "t1", "boreal", "client", "organization")], "canonical_id string, tenant_id string, canonical_name string, entity_type string, entity_category string")
    aliases = spark.createDataFrame([("C4", "boreal group", "ruddr", "psa", None), ("C4", "boreal", "ruddr", "psa", 0.5), ("C1", "", "x", "psa", 0.5)], "canonical_id string, value string, source string, category string, confidence double")
    refs = spark.createDataFrame([("C2", "quickbooks", "accounting", "Q2", '{"email": " ANA@x.com ", "employee_id": 7}'), ("C4", "ruddr", "psa", "R4", "{bad"), ("C1", "ruddr", "psa", "R1", '{"email": "ana@x.com"}')], "canonical_id string, source string, category string, external_id string, external_fields string")
    edges = spark.createDataFrame([("C1", "C2", "WORKS_WITH", 0), ("C4", "C2", "WORKS_WITH", 0), ("C3", "C1", "SAME_AS", 2)], "source_node string, target_node string, relationship string, approval_count long")
    return canon, aliases, refs, edges


@pytest.fixture(scope="module")
def entities(spark):
    rows = [("E1", "atlas media", "organization", "ruddr", "psa", "R9", None, None), ("E2", "someone else", "person", "ruddr", "psa", "R8", "ana@X.com", None), ("E3", "boreal group", "organization", "ruddr", "psa", "R4", None, None), ("E4", "nobody", "person", "quickbooks", "accounting", "Q9", None, "7"), ("E5", "", "organization", "x", "", "", None, None)]
    return spark.createDataFrame(rows, "entity_id string, normalized_name string, entity_category string, source string, category string, source_id string, email string, employee_id string").withColumn("display_name", F.col("normalized_name")).withColumn("raw_record", F.lit('{"role": "lead"}'))


def test_cascade(store, entities):
    canon, aliases, refs, _ = store
    got = {r.entity_id: (r.canonical_id, r.confidence, r.match_key_type) for r in matching.deterministic(entities, canon, aliases, refs).collect()}
    assert got == {"E1": (None, None, None), "E2": ("C2", 0.99, "email"), "E3": ("C4", 0.99, "alias"), "E4": ("C2", 1.0, "employee_id"), "E5": (None, None, None)}


def test_tenant(store, entities):
    canon, aliases, refs, edges = store
    assert registry.alias_hits(entities, canon, aliases, "t2").count() == 0
    assert registry.neighbours(edges, canon, "t1").count() == 2


def test_candidates(store, entities):
    canon, aliases, refs, _ = store
    got = {(r.entity_id, r.canonical_id): r.blocking_signals for r in matching.candidates(entities, canon, aliases, refs).collect()}
    assert ("E3", "C4") not in got and "token:atlas" in got["E1", "C1"] and "trigram:^at" in got["E1", "C3"]
    assert not any(e == "E5" for e, _ in got)
    capped = matching.candidates(entities, canon, aliases, refs, most=1).groupBy("entity_id").count()
    assert all(r["count"] == 1 for r in capped.collect())


def test_graph_reads(spark, store):
    canon, aliases, refs, edges = store
    pairs = spark.createDataFrame([("C1", "C4"), ("C3", "C4")], "left_id string, right_id string")
    got = {(r.left_id, r.right_id): (r.shared, r.shared_persons) for r in registry.shared_neighbours(pairs, edges, canon).collect()}
    assert got == {("C1", "C4"): (1, 1), ("C3", "C4"): (0, 0)}
    assert [tuple(r) for r in registry.same_as(edges, canon).collect()] == [("C1", "C3")]
    assert {r.canonical_id: r.system_references is None for r in registry.with_references(canon, refs).collect()}["C3"]
    assert {r.value for r in registry.other_aliases(canon, aliases).collect()} == {"boreal group"}
    assert registry.violations(canon, aliases, refs, edges).count() == 0


def test_scores(spark, store, entities):
    canon, aliases, refs, edges = store
    pairs = spark.createDataFrame([("E1", "C1"), ("E3", "C4"), ("E5", "C1"), ("E1", "missing")], "entity_id string, canonical_id string")
    resolved = spark.createDataFrame([("E1", "C4")], "entity_id string, source_canonical_id string")
    got = {r.entity_id: r for r in scoring.score(pairs, entities, canon, aliases, edges, resolved=resolved).collect()}
    assert set(got) == {"E1", "E3", "E5"} and got["E5"].score == 0 and got["E3"].alias_boost
    cosines = spark.createDataFrame([("E1", "C1", 0.5), ("E5", "C1", 1.0)], "entity_id string, canonical_id string, cosine double")
    near = {r.entity_id: r for r in scoring.score(pairs, entities, canon, aliases, edges, cosines=cosines, cosine_weight=0.1).collect()}
    assert near["E1"].score == pytest.approx(0.85 + 0.05) and near["E1"].cosine == 0.5 and near["E5"].score == 0 and near["E3"].cosine == 0
    assert got["E1"].score == pytest.approx(0.85 + 0.05 + 0.025) and got["E1"].weight_profile_id == "psa_accounting_v1"


def test_short_codes(spark):
    df = spark.createDataFrame([("cen", "cenlar fsb"), ("cf", "cenlar fsb"), ("xx", "cenlar fsb"), ("cenla", "cenlar"), ("", "a"), (None, "a")], "c string, n string")
    assert [r[0] for r in df.select(scoring.abbreviates(F.col("c"), F.col("n"))).collect()] == [True, True, False, False, False, False]


def test_dispositions(spark, store):
    canon, _, _, edges = store
    scores = spark.createDataFrame([("a", "C1", 0.95), ("a", "C3", 0.9), ("b", "C1", 0.95), ("b", "C4", 0.7), ("c", "C1", 0.9), ("d", "C1", 0.5), ("e", "C1", 0.49), ("c", "C1", 0.2)], "entity_id string, canonical_id string, score double")
    everyone = spark.createDataFrame([(x,) for x in "abcdef"], "entity_id string")
    got = {r.entity_id: (r.action, r.top_match, r.cluster_conflict) for r in disposition.dispose(everyone, scores, edges, canon).collect()}
    assert got == {"a": ("AUTO_APPROVE", "C1", False), "b": ("QUEUE_FOR_REVIEW", "C1", True), "c": ("AUTO_APPROVE", "C1", False), "d": ("LLM_FALLBACK", "C1", False), "e": ("NO_MATCH", None, False), "f": ("NO_MATCH", None, False)}


def test_shapes_and_leaks(spark):
    df = spark.createDataFrame([("a.b.c", "CEN-GENAI-SOW3", "Hello Atlas"), ("abc", "x", None)], "c string, p string, t string")
    got = df.select(R.class_shape(F.col("c")), R.project_shape(F.col("p")), R.leak(F.col("t"), F.array(F.lit("at"), F.lit(" ATLAS ")))).collect()
    assert [tuple(r) for r in got] == [("A.B.C", "AAA-AAAAA-AAAN", " ATLAS "), (None, None, None)]


def test_assessment(spark, store, entities):
    canon, aliases, refs, _ = store
    put = spark.createDataFrame([("E1", "LLM_FALLBACK", "C1", 0.55), ("E3", "LLM_FALLBACK", "C4", 0.6), ("E2", "NO_MATCH", None, None)], "entity_id string, action string, top_match string, top_score double")
    ready = assess.prompts(put, entities, canon, aliases, refs)
    texts = {r.entity_id: r for r in ready.collect()}
    assert set(texts) == {"E1", "E3"} and "2/2 tokens match. Stage 3 pairwise score: 0.55." in texts["E1"].redacted_prompt
    assert texts["E1"].redacted_prompt == "Entity A is an organization from the psa category (type: organization). Entity B is an organization from the accounting category (type: client). Normalized-token overlap: 2/2 tokens match. Stage 3 pairwise score: 0.55. Are Entity A and Entity B the same organization?"
    codes = entities.withColumn("raw_record", F.lit('{"class": {"ClassCode": "1.20.300"}, "project_code": "CEN-9", "title": "lead"}'))
    fields = refs.withColumn("external_fields", F.when(F.col("canonical_id") == "C1", '{"class": "9.9", "ProjectId": "AB-C1"}').when(F.col("canonical_id") == "C2", '{"Title": "partner"}'))
    more = spark.createDataFrame([("E1", "LLM_FALLBACK", "C1", 0.645), ("E4", "LLM_FALLBACK", "C2", 0.5)], "entity_id string, action string, top_match string, top_score double")
    full = {r.entity_id: r.redacted_prompt for r in assess.prompts(more, codes, canon, aliases, fields).collect()}
    # the class code is the record's alone, the project code the candidate's alone
    assert full["E1"] == "Entity A is an organization from the psa category (type: organization). Entity B is an organization from the accounting category (type: client). Entity A has a class-code pattern of A.B.C. Entity B has a project-code pattern of AA-AN. Normalized-token overlap: 2/2 tokens match. Stage 3 pairwise score: 0.65. Are Entity A and Entity B the same organization?"
    assert full["E4"] == "Person A is from the accounting category with role=lead. Person B is from the psa category with role=partner. Normalized-token overlap: 0/3 tokens match. Stage 3 pairwise score: 0.50. Are Person A and Person B the same individual?"
    leaky = lambda p: {"match": True, "confidence": 1, "reasoning": "it is Atlas Media or Boreal", "signals": ["x"]}
    got = {r.entity_id: r for r in assess.assess(ready, leaky, calls=1).collect()}
    assert got["E1"].status == "redacted_leak" and got["E1"].action == "QUEUE_FOR_REVIEW" and got["E1"].reasoning == R.PLACEHOLDER
    assert got["E3"].status in ("over_budget", "blocked_leak")
    assert assess.training_rows(assess.assess(ready, calls=5)).count() == sum(r.status == "ready" for r in texts.values())
    assert {r.status for r in assess.assess(ready, lambda p: {"match": 1}).collect()} <= {"invalid_response", "blocked_leak"}


@pytest.mark.parametrize("answer", [None, {}, {"match": "y", "confidence": 0.5, "reasoning": "", "signals": []}, {"match": True, "confidence": True, "reasoning": "", "signals": []}, {"match": True, "confidence": 1.5, "reasoning": "", "signals": []}, {"match": True, "confidence": 0.5, "reasoning": 1, "signals": []}, {"match": True, "confidence": 0.5, "reasoning": "", "signals": [1]}])
def test_invalid_answers(answer):
    assert not assess.valid(answer)


def test_resolution(spark, store, entities):
    _, aliases, _, edges = store
    said = spark.createDataFrame([("E1", "C1", "confirmed"), ("E3", "C4", "confirmed"), ("E4", None, "new"), ("E2", "C1", "rejected")], "entity_id string, canonical_id string, disposition string")
    scores = spark.createDataFrame([("E4", "C2"), ("E4", "C2"), ("E1", "C3")], "entity_id string, canonical_id string")
    out = resolution.resolve(said, entities, aliases, edges, scores)
    assert {r.value for r in out["aliases"].collect()} == {"atlas media"} and out["nodes"].count() == 1 and out["edges"].count() == 2
    assert {(r.entity_id, r.canonical_id): (r.label, r.reason) for r in out["training"].collect()} == {("E1", "C1"): (1, "confirmed"), ("E3", "C4"): (1, "confirmed"), ("E4", "C2"): (0, "new"), ("E2", "C1"): (0, "rejected")}
    assert [(r.source, r.external_id) for r in out["references"].collect()] == [("quickbooks", "Q9")] and [r.entity_type for r in out["nodes"].collect()] == ["person"]
    ids = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("c", None)], "s string, e string").select(resolution.canonical_id(F.col("s"), F.col("e")))
    assert ids.distinct().count() == 4
    assert resolution.merge_edges(resolution.merge_edges(edges, out["edges"]), out["edges"]).count() == 5


def test_append_only(spark, tmp_path):
    said = spark.createDataFrame([("E1", "C1", "confirmed")], "entity_id string, canonical_id string, disposition string")
    for _ in range(2):
        resolution.append(resolution.audit_rows(said, "2024-01-01", "ann", "psa"), str(tmp_path / "audit"))
    rows = spark.read.parquet(str(tmp_path / "audit")).collect()
    assert len(rows) == 2 and {(r.action, r.resource_id, r.diff) for r in rows} == {("confirmed", "E1", '{"canonical_id":"C1","disposition":"confirmed","entity_id":"E1"}')}


def test_evidence(spark):
    pairs = spark.createDataFrame([("E1", "C1"), ("E1", "C2")], "entity_id string, canonical_id string")
    codes, memos = spark.createDataFrame([("E1", "CEN-GP-SOW1")], "entity_id string, code string"), spark.createDataFrame([("C1", "work for cen, sow1"), ("C2", "none")], "canonical_id string, memo string")
    assert {r.canonical_id: r.code_fragments for r in evidence.code_fragments(pairs, codes, memos).collect()} == {"C1": 2, "C2": 0}
    left = spark.createDataFrame([("E1", "p", 90.0), ("E1", "p", 10.0), ("E1", "q", 5.0)], "entity_id string, period string, amount double")
    right = spark.createDataFrame([("C1", "p", 101.0), ("C2", "p", 150.0), ("C1", "q", 50.0)], "canonical_id string, period string, amount double")
    assert {r.canonical_id: r.amount_matches for r in evidence.amount_matches(pairs, left, right).collect()} == {"C1": 1, "C2": 0}
    seen = lambda key, rows: spark.createDataFrame(rows, f"{key} string, seen string").withColumn("seen", F.col("seen").cast("date"))
    assert {r.canonical_id: r.days_apart for r in evidence.days_apart(pairs, seen("entity_id", [("E1", "2024-01-09"), ("E1", "2024-01-05")]), seen("canonical_id", [("C1", "2024-01-25")])).collect()} == {"C1": 20, "C2": None}
    held = spark.createDataFrame([("E1", "C1", 2, 2, 2, 2, 3, 5), ("E1", "C2", 0, 0, 0, 1, None, 0)], "entity_id string, canonical_id string, shared_persons int, code_fragments int, amount_matches int, shared_domains int, days_apart int, shared_nodes int")
    scores = spark.createDataFrame([("E1", "C1", 0.7), ("E1", "C2", 0.8), ("E2", "C1", 0.95), ("E3", "C1", 0.69)], "entity_id string, canonical_id string, score double")
    got = {(r.entity_id, r.canonical_id): r for r in evidence.boosted(scores, held.unionByName(held.limit(1).withColumn("entity_id", F.lit("E2")))).collect()}
    assert got["E1", "C1"].boost == 0.2 and got["E1", "C1"].score == pytest.approx(0.9) and len(got["E1", "C1"]["items"]) == 6
    assert got["E1", "C2"].boost == pytest.approx(0.05) and got["E2", "C1"].boost == 0 and got["E3", "C1"].score == 0.69


def test_cosine(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, None]), (7, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.position) for r in graph.cosine_top(vectors.where("vec_id in (0, 4)").withColumnRenamed("vec_id", "query_id"), vectors, 2).orderBy("query_id", "position").collect()]
    assert got == [(0, 5, 1), (0, 1, 2)]
    near = graph.embedding_signals(graph.cosine_top(vectors.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), vectors, 1)).collect()
    assert [(r.entity_id, r.canonical_id, r.signal) for r in near] == [(0, 5, "embed:1")] and near[0].cosine == pytest.approx(1)


def test_reports(spark):
    money = lambda rows: spark.createDataFrame(rows, "canonical_id string, amount double")
    got = {r.canonical_id: r.status for r in reporting.receivables(money([("a", 100.0), ("a", 1.0), ("b", 50.0), ("c", 10.0)]), money([("a", 100.0), ("d", 5.0), ("c", 20.0)])).collect()}
    assert got == {"a": "MATCHED", "b": "UNBILLED", "c": "OVERBILLED", "d": "OVERBILLED"}


def test_clusters(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.cluster for r in graph.clusters(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert graph.clusters(spark.createDataFrame([], "a long, b long")).count() == 0
