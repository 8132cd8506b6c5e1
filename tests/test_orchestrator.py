"""A stopped run goes on after the last stage that was finished, and gives what an unbroken one gives."""

from __future__ import annotations

import json

import pytest

from samewise.functions.names import normalize, split_rejects
from samewise.operators import assess, orchestrator
from samewise.plans.derive import frame

SF = "/root/testdata/sf0.001"


def test_a_stopped_run_resumes(spark, tmp_path, monkeypatch):
    good = split_rejects(normalize(frame(spark, SF, "incoming")))[0]
    registry = [frame(spark, SF, n) for n in ("canon", "aliases", "refs", "edges")]
    go = lambda run: orchestrator.match(run, good, *registry, "2024-06-01T00:00:00")
    first = orchestrator.Run(spark, str(tmp_path / "run"))

    def stopped(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(orchestrator.scoring, "score", stopped)
        with pytest.raises(KeyboardInterrupt):
            go(first)
    assert first.finished() == ["entities", "anchored", "left", "candidates"] == first.made
    second = orchestrator.Run(spark, str(tmp_path / "run"))
    out = go(second)
    assert "candidates" not in second.made and second.made[0] == "scores" and second.finished() == list(orchestrator.STAGES)
    third = orchestrator.Run(spark, str(tmp_path / "run"))
    again = go(third)
    assert third.made == [] and sorted(map(tuple, again["results"].collect())) == sorted(map(tuple, out["results"].collect()))
    results = out["results"].collect()
    assert len({r.entity_id for r in results}) == len(results) == good.count()
    for r in results:
        assert r.match_type in ("deterministic", "scored", "llm", "new") and (r.match_type != "llm" or r.action == "QUEUE_FOR_REVIEW")
        assert r.match_type == "new" or json.loads(r.signal_breakdown)
        assert (r.match_type == "new") == (r.action == "NO_MATCH") == (r.confidence is None)
    assert {r.entity_id for r in out["audit"].select("resource_id").withColumnRenamed("resource_id", "entity_id").collect()} == {r.entity_id for r in results if r.action in ("MATCHED", "AUTO_APPROVE", "NO_MATCH")}
    assert out["calls"].count() <= assess.CALLS
