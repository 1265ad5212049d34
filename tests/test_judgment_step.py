"""The step that all judgment queries share: its tasks, its shuffles, and what its faster expressions must keep."""

from pyspark.sql import functions as F

from lexlake.functions import text as T
from lexlake.operators import entities as E
from lexlake.plans import fixture


def test_more_orders_make_more_tasks(spark, tmp_path):
    day = F.lit("2024-01-01").cast("date").alias("o_orderdate")
    rows = 20 * fixture.TASK_ROWS
    spark.range(0, rows, 1, 1).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), day).write.parquet(f"{tmp_path}/orders.parquet")
    made = fixture.orders(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 20 and made.count() == rows


def test_entities_come_together_once(spark):
    rows = spark.createDataFrame([(1, "quyet_dinh", 1, "DRUG", "a", 0, 1, 1.0, True, "r")] * 2, "doc_id long, section string, record_idx int, label string, text string, start int, end int, score double, rule_based boolean, rule_name string")
    ordered = E.order_entities(E.dedupe_entities(rows))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert ordered.count() == 1 and plan.count("Exchange hashpartitioning") == 1


def test_positions_and_pieces_count_code_points(spark):
    rows = [("😀 Điều 5 a", 2), ("ab Điều 5", 3), ("Điều 5", 0), ("x", None), ("a\x01 Điều 7", 3)]
    found = spark.createDataFrame(rows, "text string, at int").select("at", T.position(F.col("text"), r"Điều \d").alias("p"), F.get(E.extract_spans(F.col("text"), r"Điều \d"), F.lit(0))["start"].alias("s"))
    assert all(r["at"] == r["p"] == r["s"] for r in found.collect())


def test_normalize_of_odd_texts(spark):
    texts = ["bịcáo  x\ty", "a b​c – “d”", "matúy tàngtrữ", " a b ", "", None, " a", "\t"]
    want = ["bị cáo x y", 'a bc - "d"', "ma túy tàng trữ", " a b ", "", None, " a", " "]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.normalize(F.col("t")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in found] == want


def test_entities_of_decisions_alone_have_the_same_order(spark, sf_dir):
    from lexlake.plans import judgment_queries as Q

    shown = ["doc_id", "label", "text", "start", "end", "ord"]
    assert Q._decided(spark, sf_dir).select(*shown).exceptAll(Q._ordered(spark, sf_dir).select(*shown)).count() == 0


def test_views_read_records_once_and_send_nothing_through_the_driver(spark, sf_dir):
    from lexlake.plans import registry

    queries, _ = registry.load()
    plan = lambda name: queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for name in ("judgment_report", "judgment_highlighted", "judgment_result_json"):
        made = plan(name)
        assert "Broadcast" not in made and "Generate posexplode(concat" not in made, name
    assert plan("judgment_display_rows").count("orders.parquet") == 1
