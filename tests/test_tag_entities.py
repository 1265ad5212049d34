"""Entities of tags found within the row are those of the general form, and nothing is shuffled for them."""

import random

import pytest
from pyspark.sql import functions as F

from lexlake.operators import spans as X


@pytest.mark.parametrize("strict", [True, False])
def test_as_the_general_form(spark, strict):
    draw = random.Random(5)
    rows = []
    for k in range(60):
        text = " ".join("x" * draw.randint(1, 4) for _ in range(draw.choice([0, 1, 5, 150])))
        spans = [(a, a + draw.randint(1, 9), draw.choice(["DRUG", "PERSON", "DEFENDANT"])) for a in (draw.randint(0, max(1, len(text))) for _ in range(draw.randint(0, 12)))]
        rows.append((f"r{k}", text, spans if k % 9 else None))
    records = spark.createDataFrame(rows, "record_id string, text string, spans array<struct<start:int,end:int,label:string>>")
    columns = ["record_id", "label", "first_token", "last_token", "start", "end"]
    show = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    assert show(X.tag_entities(records, strict)) == show(X.bio_to_entities(X.tag_records(records), strict))
    assert show(X.tag_entities(records, strict))


def test_sequence_metrics_shuffle_entities_only(spark, sf_dir):
    from lexlake.plans import registry

    made = registry.load()[0]["eval_sequence"](spark, sf_dir)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "token_idx" not in plan
