"""The text of a paragraph is put right once, not again for the filter above."""

from lexlake.plans import registry


def test_paragraph_text_is_made_once(spark, sf_dir):
    made = registry.load()[0]["source_paragraph_table"](spark, sf_dir)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("([,.;:!?])") == 1
