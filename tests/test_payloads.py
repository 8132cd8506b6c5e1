"""Payload fields under their keys, at any depth."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from samewise.operators import assess

KEYS = ("role", "title")
CASES = [({"role": "one"}, "one"), ({"role": {"role": {"title": "two"}}}, "two"), ({"role": "  ", "title": "three"}, "three"), ({"role": {"other": {"title": "no"}}, "title": {"role": {"title": {"role": "four"}}}}, "four"), ({"role": 5, "title": ["x"]}, None), ({"other": {"role": "no"}}, None), ([{"role": "no"}], None), ("role", None), ({"role": {"title": ""}, "title": " five"}, " five")]


def test_text_at_any_depth(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(CASES)] + [(90, None), (91, "{bad"), (92, '{"role": ' * 60 + '"deep"' + "}" * 60)]
    df = spark.createDataFrame(rows, "id int, payload string").withColumn("parsed", F.try_parse_json("payload"))
    got = {r.id: r.found for r in df.select("id", assess.first_text(F.col("parsed"), KEYS).alias("found")).collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(CASES)}, 90: None, 91: None, 92: "deep"}
