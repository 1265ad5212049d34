"""The judgment table, derived from orders by portable SQL: the same text in Spark and in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGMENTS = """
SELECT o_orderkey AS doc_id,
  'BA-' || CAST(o_orderkey % 200 AS STRING) AS source,
  'NỘI DUNG VỤ ÁN:' || chr(10) ||
  'Khoảng ' || CAST(7 + o_orderkey % 12 AS STRING) || ' giờ ngày ' || lpad(CAST(day(o_orderdate) AS STRING),2,'0') || '/' || lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '/' || CAST(year(o_orderdate) AS STRING) ||
  ', tại số ' || CAST(1 + o_custkey % 90 AS STRING) || ' đường Lê Lợi, phường ' || CAST(1 + o_custkey % 9 AS STRING) || ', ' ||
  CASE o_orderkey % 4 WHEN 0 THEN 'Mùa A T' WHEN 1 THEN 'Bùi Phúc T' WHEN 2 THEN 'Trần Thanh L' ELSE 'Lò Văn H' END ||
  ' bị bắt quả tang tàng trữ ' ||
  CASE o_custkey % 5 WHEN 0 THEN 'Methamphetamine' WHEN 1 THEN 'Heroine' WHEN 2 THEN 'Ketamine' WHEN 3 THEN 'MDMA' ELSE 'cần sa' END ||
  ', khối lượng ' || CAST(1 + o_orderkey % 40 AS STRING) || ',' || lpad(CAST(o_custkey % 100 AS STRING),2,'0') || ' gam.' || chr(10) || chr(10) ||
  'Kết quả xét nghiệm nước tiểu dương tính với Morphine.' || chr(10) || chr(10) ||
  'NHẬN ĐỊNH CỦA TÒA ÁN:' || chr(10) ||
  '[1] Viện kiểm sát đề nghị xử phạt bị cáo về tội đã truy tố theo cáo trạng số ' || CAST(o_orderkey % 97 AS STRING) || '.' || chr(10) || chr(10) ||
  '[2] Có đủ căn cứ kết luận bị cáo đã có hành vi tàng trữ trái phép chất ma túy như nội dung vụ án đã nêu, hành vi đó xâm phạm chế độ quản lý của Nhà nước về chất ma túy và gây mất trật tự trị an tại địa phương nơi xảy ra vụ án.' || chr(10) || chr(10) ||
  'QUYẾT ĐỊNH:' || chr(10) ||
  '1. Căn cứ điểm c khoản ' || CAST(1 + o_orderkey % 4 AS STRING) || ' Điều ' || CAST(249 + o_orderkey % 3 AS STRING) || '; Điều 38 Bộ luật Hình sự.' || chr(10) ||
  '2. Tuyên bố bị cáo ' || CASE o_orderkey % 4 WHEN 0 THEN 'Mùa A T' WHEN 1 THEN 'Bùi Phúc T' WHEN 2 THEN 'Trần Thanh L' ELSE 'Lò Văn H' END ||
  ' phạm tội Tàng trữ trái phép chất ma túy. Xử phạt 0' || CAST(1 + o_orderkey % 9 AS STRING) || ' năm 0' || CAST(1 + o_orderkey % 8 AS STRING) || ' tháng tù.' || chr(10) ||
  '3. Về án phí: bị cáo phải chịu 200.000 đồng án phí.' AS text
FROM orders
"""


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, gone when the session ends: below spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/lexlake-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{path.toString()}/data"


def stored(made: DataFrame) -> DataFrame:
    """made, written to a shared folder and read again: what several parts of a query read is computed once."""
    path = shared_folder(made.sparkSession)
    made.write.option("compression", "zstd").parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


_NAMES = "CASE o_orderkey % 3 WHEN 0 THEN 'Giàng A P' WHEN 1 THEN 'Vàng Thị M' ELSE 'Hoàng Văn K' END"
_CONTENT = "'NỘI DUNG VỤ ÁN:' || chr(10) || 'Ngày 0' || CAST(1 + o_orderkey % 9 AS STRING) || '/5/2021, ' || {name} || ' bị bắt quả tang khi đang cất giấu heroin trong người.'"
_REASONING = "'NHẬN ĐỊNH CỦA TÒA ÁN:' || chr(10) || '[1] Hành vi của ' || {name} || ' mua bán trái phép chất ma túy đã đủ cơ sở kết luận, phù hợp với lời khai của người làm chứng, biên bản bắt người phạm tội quả tang, kết luận giám định và các tài liệu, chứng cứ khác đã được thẩm tra công khai tại phiên tòa xét xử hôm nay.'"
_RULING = "'QUYẾT ĐỊNH:' || chr(10) || '1. Căn cứ khoản ' || CAST(1 + o_orderkey % 4 AS STRING) || ' Điều 251 Bộ luật Hình sự.' || chr(10)"

#: Judgments of eight kinds, by o_orderkey % 8: whole; without a decision; without headings; with a decision that names nothing; with two
#: defendants; with a fine and no prison; empty; with a decision alone, whose place is vague. Portable as JUDGMENTS is.
LAYOUTS = f"""
SELECT o_orderkey AS doc_id, 'BL-' || CAST(o_orderkey AS STRING) AS source,
  CASE o_orderkey % 8
  WHEN 0 THEN {_CONTENT} || chr(10) || {_REASONING} || chr(10) || {_RULING} || '2. Tuyên bố bị cáo ' || {{name}} || ' phạm tội Mua bán trái phép chất ma túy. Xử phạt 07 năm tù.'
  WHEN 1 THEN {_CONTENT} || chr(10) || {_REASONING}
  WHEN 2 THEN 'Bản ghi số ' || CAST(o_orderkey AS STRING) || ' chưa có mục nào.'
  WHEN 3 THEN {_CONTENT} || chr(10) || {_REASONING} || chr(10) || 'QUYẾT ĐỊNH:' || chr(10) || '1. Tuyên án công khai.'
  WHEN 4 THEN {_REASONING} || chr(10) || {_RULING} || '2. Tuyên bố bị cáo ' || {{name}} || ' phạm tội Mua bán trái phép chất ma túy. Xử phạt 08 năm tù. Tuyên bố bị cáo Sùng A D phạm tội Tàng trữ trái phép chất ma túy. Xử phạt 02 năm 06 tháng tù.'
  WHEN 5 THEN {_CONTENT} || chr(10) || {_REASONING} || chr(10) || {_RULING} || '2. Phạt tiền bị cáo ' || {{name}} || ' 5.000.000 đồng sung ngân sách nhà nước.'
  WHEN 6 THEN ''
  ELSE 'QUYẾT ĐỊNH:' || chr(10) || '1. Tuyên bố bị cáo ' || {{name}} || ' phạm tội Vận chuyển trái phép chất ma túy tại đây. Xử phạt 03 năm tù.' END AS text
FROM orders
""".replace("{name}", _NAMES)


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text: one invented judgment for each order, of eight kinds."""
    return spark.sql(LAYOUTS.replace("FROM orders", "FROM {orders}"), orders=orders(spark, sf_dir))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text: one invented judgment for each order, over 200 sources."""
    return spark.sql(JUDGMENTS.replace("FROM orders", "FROM {orders}"), orders=orders(spark, sf_dir))


#: Orders of a task: what is derived from one takes up to a millisecond or two.
TASK_ROWS = 10_000


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the derived tables are made of. A small file is one partition of few bytes; what is derived from it is dear, so
    rows are dealt out before, to more tasks the more there are."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return table.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS)))  # the count is read from the file's footer


_NAME = "CASE o_orderkey % 4 WHEN 0 THEN 'Mùa A T' WHEN 1 THEN 'Bùi Phúc T' WHEN 2 THEN 'Trần Thanh L' ELSE 'Lò Văn H' END"
_DRUG = "CASE o_custkey % 5 WHEN 0 THEN 'Methamphetamine' WHEN 1 THEN 'Heroine' WHEN 2 THEN 'Ketamine' WHEN 3 THEN 'MDMA' ELSE 'cần sa' END"
_WEIGHT = "CAST(1 + o_orderkey % 40 AS STRING) || ',' || lpad(CAST(o_custkey % 100 AS STRING),2,'0') || ' gam'"
_TIME = "'Khoảng ' || CAST(7 + o_orderkey % 12 AS STRING) || ' giờ ngày ' || lpad(CAST(day(o_orderdate) AS STRING),2,'0') || '/' || lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '/' || CAST(year(o_orderdate) AS STRING)"
_PLACE = "'số ' || CAST(1 + o_custkey % 90 AS STRING) || ' đường Lê Lợi, phường ' || CAST(1 + o_custkey % 9 AS STRING)"

#: One sentence for each order with the words of its entities; portable as JUDGMENTS is.
ANNOTATED = f"""
SELECT rid, 'R' || CAST(rid AS STRING) AS record_id, 'BA-' || CAST(rid % 200 AS STRING) AS source, person, drug, weight, crime_time, crime_loc,
  crime_time || ', tại ' || crime_loc || ', ' || person || ' bị bắt quả tang tàng trữ ' || drug || ', khối lượng ' || weight || '.' AS text
FROM (SELECT o_orderkey AS rid, {_NAME} AS person, {_DRUG} AS drug, {_WEIGHT} AS weight, {_TIME} AS crime_time, {_PLACE} AS crime_loc FROM orders) o
"""

#: Gold spans of ANNOTATED: rid, record_id, label, word, start_at, end_at.
GOLD = "\nUNION ALL\n".join(
    f"SELECT rid, record_id, '{label}' AS label, {column} AS word, CAST(instr(text, {column}) - 1 AS INT) AS start_at, CAST(instr(text, {column}) - 1 + length({column}) AS INT) AS end_at FROM annotated"
    for label, column in (("CRIME_TIME", "crime_time"), ("CRIME_LOC", "crime_loc"), ("PERSON", "person"), ("DRUG", "drug"), ("DRUG_WEIGHT", "weight"))
)

#: Two simulated taggers: one misses spans; one gets some ends and some labels wrong, and adds a span.
PREDICTED = {
    "model_a": "SELECT * FROM gold WHERE rid % 7 <> 0",
    "model_b": """
SELECT rid, record_id, CASE WHEN rid % 13 = 0 AND label = 'DRUG' THEN 'CRIME_LOC' ELSE label END AS label, word, start_at,
  CAST(CASE WHEN rid % 11 = 0 THEN end_at + 1 ELSE end_at END AS INT) AS end_at FROM gold
UNION ALL SELECT rid, record_id, 'CHARGE' AS label, 'tại' AS word, CAST(instr(text, 'tại') - 1 AS INT) AS start_at, CAST(instr(text, 'tại') + 2 AS INT) AS end_at FROM annotated WHERE rid % 17 = 0
""",
}


def with_tables(body: str, *names: str) -> str:
    """DuckDB SQL of body with the named derived tables in front of it."""
    made = {"judgments": JUDGMENTS, "layouts": LAYOUTS, "annotated": ANNOTATED, "gold": GOLD, **PREDICTED}
    return "WITH " + ",\n".join(f"{n} AS ({made[n]})" for n in names) + "\n" + body


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, record_id, source, text and the words of the entities."""
    return spark.sql(ANNOTATED.replace("FROM orders", "FROM {orders}"), orders=orders(spark, sf_dir))


_GOLD_COLUMNS = [("CRIME_TIME", "crime_time"), ("CRIME_LOC", "crime_loc"), ("PERSON", "person"), ("DRUG", "drug"), ("DRUG_WEIGHT", "weight")]


def _made_once(table: DataFrame) -> DataFrame:
    """table with its columns as generated ones; in place of their names the optimizer would put the expressions that they are made of, again and again."""
    return table.select(F.inline(F.array(F.struct(*table.columns))))


def _gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of GOLD, all five spans of a sentence from one reading of it."""
    place = lambda c: (F.call_function("instr", "text", c) - 1).cast("int")
    span = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).alias("word"), place(c).alias("start_at"), (place(c) + F.length(c)).cast("int").alias("end_at"))
    return _made_once(annotated(spark, sf_dir)).select("rid", "record_id", F.inline(F.array(*[span(label, c) for label, c in _GOLD_COLUMNS])))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, record_id, label, word, start, end."""
    return _spans(_gold_rows(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    table = _gold_rows(spark, sf_dir)
    sql = PREDICTED[model].replace("FROM gold", "FROM {gold}").replace("FROM annotated", "FROM {annotated}")
    named = {"gold": table} | ({"annotated": annotated(spark, sf_dir)} if "{annotated}" in sql else {})
    return _spans(spark.sql(sql, **named))


def _spans(table: DataFrame) -> DataFrame:
    return table.withColumnsRenamed({"start_at": "start", "end_at": "end"})


def records_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, source, text, spans of the annotated sentences."""
    place = lambda c: F.call_function("instr", "text", c) - 1
    span = lambda label, c: F.struct(place(c).alias("start"), (place(c) + F.length(c)).alias("end"), F.lit(label).alias("label"))
    return _made_once(annotated(spark, sf_dir)).select("rid", "record_id", "source", "text", F.explode(F.array(F.array(*[span(label, c) for label, c in _GOLD_COLUMNS]))).alias("spans"))
