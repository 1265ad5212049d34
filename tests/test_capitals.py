"""A letter whose capital is two letters, in the query and in its SQL."""

import duckdb

from lexlake.plans import registry

QUERIES, SQL = registry.load()


def test_capitals_of_two_letters(spark, tmp_path):
    texts = ["ßelich energe. ßsch x! ŉa", "a. ẞb", "ﬁn. ab"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["text_capitalize"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(duck.sql(SQL["text_capitalize"]).fetchall())
