"""Headings are sought only in paragraphs that begin with a heading's letter, and found as before."""

from pyspark.sql import functions as F

from lexlake.operators import segment as S

TEXTS = [
    ("NỘI DUNG VỤ ÁN", "noi_dung", None, None), ("  nội dung  vụ án: POSITIVE ", "noi_dung", "noi_dung", ""), ("Quyết định: Xử phạt", None, "quyet_dinh", "Xử phạt"), ("nhận định của tòa án Bị cáo khai", None, "nhan_dinh", "Bị cáo khai"),
    ("ngữ cảnh không gán nhãn negative", "negative", None, None), ("NỘI DUNG VỤ ÁN Theo các tài liệu có", None, None, None), ("Về nội dung vụ án", None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_headings_and_prefixes(spark):
    given = spark.createDataFrame([(k, t[0]) for k, t in enumerate(TEXTS)], "k int, text string")
    found = given.select("k", "text", S.detect_heading(F.col("text")).alias("line"), S.split_heading_prefix(F.col("text")).alias("prefix")).orderBy("k").collect()
    for row, (text, line, _, _) in zip(found, TEXTS, strict=True):
        assert (row["line"] and row["line"]["section"]) == line, text
    for row in (found[2], found[3]):
        assert (row["prefix"]["section"], row["prefix"]["rest"]) == TEXTS[row["k"]][2:]
    for row in found[5:]:
        assert row["prefix"]["section"] is None and row["prefix"]["rest"] == row["text"]


def test_other_first_letters_are_passed_over(spark):
    for made in (S.detect_heading(F.col("text")), S.split_heading_prefix(F.col("text"))):
        plan = spark.createDataFrame([("a",)], "text string").select(made.alias("made"))._jdf.queryExecution().analyzed().toString()
        assert " IN (N,n,Q,q)" in plan.replace(", ", ",").replace(" IN(", " IN (")
