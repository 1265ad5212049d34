"""Taggers are fitted to distinct tokens with their numbers, and tag as if fitted to single ones."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StringIndexer
from pyspark.sql import functions as F

from lexlake.operators import corpus, evaluate, tagger
from lexlake.operators import spans as X
from lexlake.plans import fixture


def _tagged(spark, sf_dir, copies=1):
    records = fixture.records_with_spans(spark, sf_dir).where("rid < 200")
    records = records.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("record_id", F.concat_ws("-", "record_id", "copy"))
    return X.tag_records(records, "source", around=True)


def test_neighbours_come_from_the_row(spark, sf_dir):
    tagged = _tagged(spark, sf_dir)
    features = lambda d: sorted(map(tuple, tagger.token_features(d).select("record_id", "token_idx", "tag", *tagger.FEATURES).collect()))
    assert features(tagged) == features(tagged.drop("last_token", "next_token"))
    plan = lambda d: tagger.token_features(d)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(tagged) and "Window" in plan(tagged.drop("last_token", "next_token"))


def test_counts_do_not_grow_with_copies(spark, sf_dir):
    once, often = (tagger.counted_features(_tagged(spark, sf_dir, k)) for k in (1, 20))
    assert once.count() == often.count() < _tagged(spark, sf_dir).count()
    assert often.agg(F.sum("n")).first()[0] == _tagged(spark, sf_dir, 20).count()


def test_model_is_that_of_single_tokens(spark, sf_dir):
    tagged = _tagged(spark, sf_dir, 5).cache()
    found = tagger.train_token_classifier(tagged, reg=0.01, hashed=256, rounds=5)
    counts = tagged.where("tag != 'O'").groupBy(F.expr("substring(tag, 3)").alias("label")).agg(F.count("*").alias("n"))
    rows = tagger.token_features(tagged).join(corpus.class_weights(counts), "tag", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = FeatureHasher(inputCols=tagger.FEATURES, outputCol="features", numFeatures=256).transform(rows)
    index = StringIndexer(inputCol="tag", outputCol="target", handleInvalid="keep").fit(rows)
    want = LogisticRegression(labelCol="target", weightCol="weight", regParam=0.01, maxIter=5).fit(index.transform(rows))
    assert found.stages[0].labels == index.labels
    assert abs(found.stages[2].coefficientMatrix.toArray() - want.coefficientMatrix.toArray()).max() < 0.03 * abs(want.coefficientMatrix.toArray()).max()  # the plain fit differs by 0.6 % when its rows are dealt otherwise
    other = tagger.train_token_classifier(tagged, reg=10.0, hashed=256, rounds=3)
    tags = lambda m: tagger.tag_tokens(m, tagged.drop("tag")).select("record_id", "token_idx", "tag")
    differ = tags(found).join(tags(other).withColumnRenamed("tag", "other"), ["record_id", "token_idx"]).where("tag != other").count()
    counted = tagger.counted_features(tagged)
    assert tagger.differing_tags(found, other, counted).first()["differ"] == differ > 0
    assert tagger.differing_tags(found, found, counted).first()["differ"] == 0


def test_rates_read_both_sides_once(spark):
    spans = spark.createDataFrame([("r", 0, 2, "DRUG"), ("r", 3, 5, "PERSON"), ("r", 6, 7, "unknown")], "record_id string, start int, end int, label string")
    rated = evaluate.prf_exact(spans, spans.where("start < 3"))
    assert rated._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    assert {r["label"]: (r["support"], r["predicted"], r["tp"]) for r in rated.collect() if r["support"]} == {"DRUG": (1, 1, 1), "PERSON": (1, 0, 0), "overall": (2, 1, 1)}
