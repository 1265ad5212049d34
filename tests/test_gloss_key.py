"""The words of the dictionary are sought in a key that is made once."""

from pyspark.sql import functions as F

from lexlake.functions import gloss


def test_the_key_is_made_once(spark):
    rows = spark.createDataFrame([("CHARGE", 'Tội "Tàng  trữ" ma túy'), ("PERSON", "Lò Văn H"), ("DRUG", None), ("LEGAL_ARTICLE", "")], "label string, text string")
    made = rows.select(gloss.describe(F.col("label"), F.col("text")).alias("d"))
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 2
    found = [r["d"] for r in made.collect()]
    assert found[0] == next(x for label, keys, x in gloss.GLOSS if "tàng trữ" in keys) and found[1:] == ["", gloss.DEFAULTS["DRUG"], gloss.DEFAULTS["LEGAL_ARTICLE"]]
