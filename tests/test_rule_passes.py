"""Rules read a text once each, and tasks of derived rows stay small."""

from pyspark.sql import functions as F

from lexlake.functions import lexicon as L
from lexlake.operators import entities as E
from lexlake.plans import fixture

RECORDS = "doc_id long, section string, record_idx int, text string"


def test_each_rule_reads_a_text_once(spark):
    records = spark.createDataFrame([(1, "quyet_dinh", 1, "Điều 5")], RECORDS)
    plan = E.rule_entities(records)._jdf.queryExecution().analyzed().toString()
    for _, _, expression, _, _ in L.RULES:
        assert plan.count(L.FLAGS + expression + ",") == 1, expression


def test_rules_give_the_places_of_many_matches_and_of_odd_signs(spark):
    many = " ".join(f"Điều {k}" for k in range(200, 300))
    texts = [many, "a\x01 Điều 5 \x02b Điều\x016 Điều 7", "😀 bị cáo Lò Văn H phạm tội", "bị cáo Lò Văn H; bị cáo Mùa A T về", ""]
    records = spark.createDataFrame([(k, "quyet_dinh", 1, t) for k, t in enumerate(texts)], RECORDS)
    found = sorted((r["doc_id"], r["start"], r["end"], r["label"], r["text"]) for r in E.rule_entities(records).collect())
    want = [(0, 9 * k, 9 * k + 8, "LEGAL_ARTICLE", f"Điều {200 + k}") for k in range(100) if 200 + k != 298]
    want += [(1, 3, 9, "LEGAL_ARTICLE", "Điều 5"), (1, 20, 26, "LEGAL_ARTICLE", "Điều 7")]
    want += [(2, 9, 17, "PERSON", "Lò Văn H"), (3, 7, 15, "PERSON", "Lò Văn H"), (3, 24, 31, "PERSON", "Mùa A T")]
    assert found == sorted(want)


def test_tasks_stay_small(spark, tmp_path):
    day = F.lit("2024-01-01").cast("date").alias("o_orderdate")
    spark.range(0, 300_000, 1, 1).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), day).write.parquet(f"{tmp_path}/orders.parquet")
    assert max(fixture.orders(spark, str(tmp_path)).rdd.glom().map(len).collect()) <= 12_000
