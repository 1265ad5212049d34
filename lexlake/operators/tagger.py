"""Taggers: a linear token classifier on window features, choice by development F1, and any model as a pandas UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from . import corpus
from .evaluate import prf_sequence

PREDICTION = ArrayType(StructType([StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType()), StructField("score", DoubleType())]))
FEATURES = ["word", "before", "after", "shape", "head"]


#: The largest share of all weight that one row of the fit has; equal tokens beyond it stay in several rows.
_SHARE = 1e-5


def _with_neighbours(tokens: DataFrame) -> DataFrame:
    if {"last_token", "next_token"} <= set(tokens.columns):
        return tokens
    run = Window.partitionBy("record_id").orderBy("token_idx")
    return tokens.withColumns({"last_token": F.lag("token").over(run), "next_token": F.lead("token").over(run)})


def token_features(tokens: DataFrame) -> DataFrame:
    """tokens with features of the word and its neighbours. Where tokens have last_token and next_token (tag_records(around=True)) nothing is shuffled."""
    low = F.lower("token")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{N}", "9")
    return _with_neighbours(tokens).withColumns({
        "word": low, "before": F.coalesce(F.lower("last_token"), F.lit("<")), "after": F.coalesce(F.lower("next_token"), F.lit(">")),
        "shape": F.regexp_replace(shape, r"(.)\1+", "$1"), "head": F.left(low, F.lit(3)),
    }).drop("last_token", "next_token")


def counted_features(tagged: DataFrame, *by: str) -> DataFrame:
    """The features and tags of tagged tokens with the number n of tokens; features are made once for a token between the same neighbours. Apart for each value of `by`."""
    seen = _with_neighbours(tagged).groupBy(*by, "tag", "token", "last_token", "next_token").agg(F.count("*").alias("n"))
    return token_features(seen).select(*by, "tag", *FEATURES, "n")


def train_token_classifier(tagged: DataFrame, weights: DataFrame | None = None, reg: float = 0.01, hashed: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """A linear model from tagged tokens (record_id, token_idx, token, tag), or from their counted_features(); weights: (tag, weight), by default from its own counts.

    Tokens of equal features and tags are rows that weigh as much as all of them, so a round costs what distinct ones do.
    Heavy rows are dealt into equal parts, since the variances by which features are scaled depend on the weight of single rows.
    """
    counted = tagged if {*FEATURES, "n"} <= set(tagged.columns) else counted_features(tagged)
    counted = counted.groupBy("tag", *FEATURES).agg(F.sum("n").alias("n")).persist()
    try:
        tags = counted.groupBy("tag").agg(F.sum("n").alias("n"))
        if weights is None:
            weights = corpus.class_weights(tags.where("tag != 'O'").groupBy(F.substring("tag", F.lit(3), F.length("tag")).alias("label")).agg(F.sum("n").alias("n")))
        known = tags.join(F.broadcast(weights), "tag", "left").select("tag", "n", F.coalesce("weight", F.lit(1.0)).alias("weight")).collect()  # a row for each tag
        total = sum(r["n"] * r["weight"] for r in known)
        labels = [r["tag"] for r in sorted(known, key=lambda r: (-r["n"], r["tag"]))]
        weights = counted.sparkSession.createDataFrame([(r["tag"], r["weight"]) for r in known], "tag string, weight double")
        rows = counted.join(F.broadcast(weights), "tag")
        parts = F.least("n", F.ceil(F.col("n") * F.col("weight") / (total * _SHARE)))
        rows = rows.withColumn("parts", parts).select("tag", *FEATURES, (F.col("weight") * F.col("n") / F.col("parts")).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "parts")))
        index = StringIndexerModel.from_labels(labels, inputCol="tag", outputCol="target", handleInvalid="keep")
        stages = [index, FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=hashed), LogisticRegression(labelCol="target", weightCol="weight", regParam=reg, maxIter=rounds), IndexToString(inputCol="prediction", outputCol="tag_pred", labels=labels)]
        return Pipeline(stages=stages).fit(rows)
    finally:
        counted.unpersist()


def _scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    # the target of unknown rows is never read; the indexer keeps them. Only the best tag is asked for, no columns of rates
    linear = model.stages[-2]
    return model.transform(rows.withColumn("tag", F.lit("O")), {linear.rawPredictionCol: "", linear.probabilityCol: ""})


def differing_tags(model: PipelineModel, other: PipelineModel, counted: DataFrame) -> DataFrame:
    """differ: the number of tokens that the models tag differently, given their counted_features()."""
    tags = _scored(model, counted).select(*FEATURES, "n", F.col("tag_pred").alias("first_pred"))
    pair = _scored(other, tags).select("n", F.coalesce("first_pred", F.lit("O")).alias("a"), F.coalesce("tag_pred", F.lit("O")).alias("b"))
    return pair.agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("n"))), F.lit(0).cast("long")).alias("differ"))


def tag_tokens(model: PipelineModel, tokens: DataFrame) -> DataFrame:
    """tokens (record_id, token_idx, token, start, end) with the model's tag."""
    scored = _scored(model, token_features(tokens))
    return scored.select("record_id", "token_idx", "token", "start", "end", F.coalesce("tag_pred", F.lit("O")).alias("tag"))


def select_best(train: DataFrame, dev: DataFrame, grid: list[dict]) -> tuple[PipelineModel, dict, float]:
    """The model of the highest F1 on dev, its parameters and that F1."""
    best = None
    for params in grid:
        model = train_token_classifier(train, **params)
        rated = prf_sequence(dev, tag_tokens(model, dev.drop("tag"))).where("label = 'overall'").first()
        if best is None or rated["f1"] > best[2]:
            best = (model, params, rated["f1"])
    return best


def in_folds(rows: DataFrame, folds: int = 3, seed: int = 42) -> DataFrame:
    """rows (with source) and the fold of each, from 0: whole sources, by a hash of the name."""
    digits = F.left(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), F.lit(8))
    return rows.withColumn("fold", (F.conv(digits, 16, 10).cast("long") % folds).cast("int"))


def _dealt(tagged: DataFrame, folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    dealt = in_folds(tagged, folds, seed).drop("source").persist()
    return dealt, counted_features(dealt, "fold").persist()


def _tried(dealt: DataFrame, counted: DataFrame, grid: list[dict], patience: int) -> list[dict]:
    tried, left = [], patience
    present = sorted(r["fold"] for r in counted.select("fold").distinct().collect())
    for params in grid:
        rates = []
        for fold in present:
            dev = dealt.where(F.col("fold") == fold)
            model = train_token_classifier(counted.where(F.col("fold") != fold), **params)
            rates.append(prf_sequence(dev, tag_tokens(model, dev.drop("tag"))).where("label = 'overall'").first()["f1"])
        best = max((t["mean"] for t in tried), default=-1.0)
        tried.append({"params": params, "f1": rates, "mean": sum(rates) / max(1, len(rates))})
        left = patience if tried[-1]["mean"] > best else left - 1
        if left == 0:
            break
    return tried


def cross_validate(tagged: DataFrame, grid: list[dict], folds: int = 3, patience: int = 2, seed: int = 42) -> list[dict]:
    """What was tried, in order: params, f1 of each fold (trained on the others) and their mean; tagged has source beside its tokens and tags.

    A candidate that isn't better than the best so far counts against patience; when that is used up the rest of the grid is left out. The list is as
    short as the grid; the data stay in Spark.
    """
    dealt, counted = _dealt(tagged, folds, seed)
    try:
        return _tried(dealt, counted, grid, patience)
    finally:
        counted.unpersist()
        dealt.unpersist()


def save_best(tagged: DataFrame, grid: list[dict], path: str, folds: int = 3, patience: int = 2, seed: int = 42) -> tuple[PipelineModel, dict]:
    """The candidate of the best mean F1 over folds (of equal ones the first), trained on all of tagged and written to path; and what it was, with all that was tried."""
    dealt, counted = _dealt(tagged, folds, seed)
    try:
        tried = _tried(dealt, counted, grid, patience)
        best = max(tried, key=lambda t: t["mean"]) | {"tried": tried}
        model = train_token_classifier(counted, **best["params"])
    finally:
        counted.unpersist()
        dealt.unpersist()
    model.write().overwrite().save(path)
    return model, best


def load_tagger(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def register_tagger(load: Callable[[], Callable[[str], list[dict]]]):
    """A column function from texts to predictions. load() runs once in each Python worker and returns predict(text)."""

    @F.pandas_udf(PREDICTION)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            yield texts.map(lambda t: [{k: p.get(k) for k in ("label", "start", "end", "text", "score")} for p in predict(t or "")])

    return tag


def score_records(records: DataFrame, tag) -> DataFrame:
    """Entities that a tagger finds in records, of labels that the record's section may hold."""
    asked = records.where((F.trim("text") != "") & (F.size("ner_targets") > 0))
    each = asked.withColumn("p", F.explode(tag("text"))).where(F.array_contains("ner_targets", F.col("p.label")))
    return each.select("doc_id", "section", "record_idx", "p.label", "p.text", "p.start", "p.end", "p.score", F.lit(False).alias("rule_based"), F.lit(None).cast("string").alias("rule_name"), F.left("text", F.lit(500)).alias("context"))
