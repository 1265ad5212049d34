"""The trees and thresholds of personal data come from all candidates."""

import pytest
from pyspark.sql import functions as F

from lexlake.llm import pii


def test_all_candidates_count(spark, monkeypatch):
    n, seen = 60_000, []

    def stop(grouped):
        seen.append(grouped.agg(F.sum("weight")).first()[0])
        raise InterruptedError

    monkeypatch.setattr(pii.common, "checkpoint", stop)
    found = spark.range(n).select(F.col("id").alias("row_id"), F.lit("card").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"), (F.col("id") % 2).cast("int").alias("label"), *[F.lit(1).alias(c) for c in pii.FEATURES])
    with pytest.raises(InterruptedError):
        pii.fit(found)
    assert seen == [n]
