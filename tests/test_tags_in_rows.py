"""Tags and phrase counts that are found without a join: as the general forms find them, and nothing large is sent through the driver."""

import random

from pyspark.sql import functions as F

from lexlake.operators import spans as X
from lexlake.plans import registry


def records(spark):
    draw = random.Random(3)
    texts = ["", " ", "a", " a  b\tc ", "tại số 5 đường", "😀 x y z ", None] + [" ".join(draw.choice(["ab", "c", "dé", "😀f"]) for _ in range(draw.choice([5, 63, 64, 65, 200]))) for _ in range(40)]
    rows = []
    for k, text in enumerate(texts):
        at = lambda: draw.randint(-2, len(text or "") + 2)  # noqa: B023, E731
        spans = [(at(), at(), draw.choice(["DRUG", "PERSON", "DEFENDANT", "none"])) for _ in range(draw.choice([0, 1, 3, 30]))]
        rows.append((f"R{k}", f"s{k % 3}", text, spans if k % 5 else spans * 2))
    rows.append(("null", "s", "a b", None))
    return spark.createDataFrame(rows, f"record_id string, source string, text string, spans {X.SPANS}")


def test_tags_within_the_row_are_those_of_the_sweep(spark):
    given = records(spark)
    found = X.tag_records(given)
    want = X.spans_to_bio(X.tokenize(given), X.explode_spans(given))
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert found.where("tag != 'O'").count() > 100
    assert X.tag_records(given, "source").columns[-1] == "source"


def test_tokens_are_the_runs_of_letters_and_signs(spark):
    for r in records(spark).select("text").distinct().collect():
        got = X.tokenize(spark.createDataFrame([("r", r["text"])], "record_id string, text string")).orderBy("token_idx").collect()
        assert [t["token"] for t in got] == (r["text"] or "").split()
        assert all(r["text"][t["start"] : t["end"]] == t["token"] for t in got)


def test_counts_are_those_of_all_places(spark):
    pages = spark.createDataFrame([(1, "a b c d e f a b"), (2, "A, b! x a b c d e f"), (3, ""), (4, None)], "page_id long, text string")
    phrases = spark.createDataFrame([(1, "a"), (2, "A!"), (3, "a b"), (4, "a b c d e"), (5, "b c d e f a"), (6, "zz"), (7, "--"), (8, "a b c d"), (9, None)], "phrase_id long, text string")
    want = X.phrase_stats(phrases, X.phrase_locate(pages, phrases)).orderBy("phrase_id").collect()
    assert X.phrase_counts(pages, phrases).orderBy("phrase_id").collect() == want
    assert [r["occurrences"] for r in want] == [4, 4, 4, 2, 1, 0, 0, 2, 0]
    assert [r["occurrences"] for r in X.phrase_counts(pages, phrases.where("phrase_id = 7")).collect()] == [0]


def test_neither_tokens_nor_runs_of_pages_are_sent_through_the_driver(spark, sf_dir):
    queries, _ = registry.load()
    plan = lambda name: queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan("span_bio_tags")
    for name in ("span_phrase_stats", "span_unmatched", "span_phrase_locate"):
        assert "BuildLeft" not in plan(name)


def test_places_of_single_words_are_not_shuffled(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("a b a c a").alias("text"))
    phrases = spark.createDataFrame([(k, "a") for k in range(50)], "phrase_id long, text string")
    counted = X.phrase_counts(pages, phrases)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Window") == 0
    assert {r["occurrences"] for r in counted.collect()} == {6000}
