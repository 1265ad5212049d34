"""Rules search equal texts once, whatever the number of records that they are, and find what they find record by record."""

from pyspark.sql import functions as F

from lexlake.operators import entities as E
from lexlake.operators import segment as S
from lexlake.plans import fixture


def _rows(frame):
    return sorted(map(str, frame.collect()))


def _records(spark, sf_dir):
    made = S.build_records(fixture.layouts(spark, sf_dir).union(fixture.judgments(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 1_000_000))).select("doc_id", "record_idx", "section", "text")
    odd = [(-1, 1, "quyet_dinh", None), (-2, 1, "quyet_dinh", ""), (-3, 1, "quyet_dinh", "Điều 249\x01 và Điều 251\x02"), (-3, 2, "quyet_dinh", "Điều 249\x01 và Điều 251\x02"), (-4, 1, "noi_dung", "Điều 249"), (-5, 1, None, "Điều 249")]
    return made.union(spark.createDataFrame(odd, "doc_id long, record_idx int, section string, text string")).cache()


def test_entities_are_those_of_each_record(spark, sf_dir, monkeypatch):
    records = _records(spark, sf_dir)
    for labels in (None, ("LEGAL_ARTICLE",)):
        want, found = E.rule_entities(records, labels), E.rule_entities_by_text(records, labels)
        assert found.columns == want.columns and found.dtypes == want.dtypes
        assert _rows(found) == _rows(want) != []
    monkeypatch.setattr(E, "_FEW", 3)
    many = E.rule_entities_by_text(records)
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString() and _rows(many) == _rows(E.rule_entities(records))


def test_rules_see_distinct_texts_only(spark, monkeypatch):
    records = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("record_idx"), F.lit("quyet_dinh").alias("section"), F.concat(F.lit("1. Căn cứ Điều "), (F.col("id") % 3 + 249).cast("string"), F.lit(" Bộ luật Hình sự.")).alias("text")).cache()
    seen, rules = [], E.rule_entities
    monkeypatch.setattr(E, "rule_entities", lambda given, labels=None: (seen.append(given.count()), rules(given, labels))[1])
    assert E.rule_entities_by_text(records).where("text like 'Điều%'").count() == 3000
    assert seen == [3]
