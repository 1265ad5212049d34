"""Files that are read as a whole have a bounded size."""

from pyspark.sql import functions as F

from lexlake.sources import readers as R
from lexlake.sources import sinks as K


def test_files_read_as_a_whole_are_bounded(spark, tmp_path):
    lines = spark.range(0, 1000, 1, 1).select(F.lit("x" * 9).alias("line"))
    K.write_lines(lines, "line", f"{tmp_path}/out", rows_per_file=100)
    sizes = [r["n"] for r in R.read_documents(spark, f"{tmp_path}/out").select(F.length("text").alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 1000
