"""Corpus statistics, splits without leakage, de-duplication and naming over annotated records.

Records are rows (record_id, source, text, spans, ...) and span tables as in spans.py.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

SPLITS = ["train", "dev", "test"]


def label_counts(spans: DataFrame, *by: str) -> DataFrame:
    return spans.groupBy(*by, "label").agg(F.count("*").alias("n"))


def label_ratios(spans: DataFrame) -> DataFrame:
    """label, n and percent of all. Shares are taken over the few rows of counts."""
    counts = label_counts(spans)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def corpus_summary(records: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: records, entities, labels, mean entities a record, most and least frequent label (ties: first by name)."""
    counts = label_counts(spans)
    ends = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("entities"), F.count("*").alias("labels"),
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("most_frequent"), F.min_by("label", F.struct("n", "label")).alias("least_frequent"))
    return records.agg(F.count("*").alias("records")).crossJoin(ends).select("records", "entities", "labels", (F.col("entities") / F.col("records")).alias("mean_entities"), "most_frequent", "least_frequent")


def split_stats(records: DataFrame, spans: DataFrame) -> DataFrame:
    """row_order, name, train, dev, test, all: entities of each label, then entities, rows and sources in total.

    One pass: records and spans are put together and counted by record, which needs no join, then by split and in total by grouping sets.
    """
    names = [*L.STATISTICS_ORDER, "#Entities in total", "#Rows/snippets in total", "#Source judgments in total"]
    none = F.lit(None).cast("string")
    both = records.select("record_id", "split", "source", none.alias("label"), F.lit(1).alias("row")).union(spans.select("record_id", none, none, "label", F.lit(0)))
    counts = [F.count_if(F.col("label") == label).alias(f"n{k}") for k, label in enumerate(L.STATISTICS_ORDER)]
    by_record = both.groupBy("record_id").agg(F.max("split").alias("split"), F.max("source").alias("source"), *counts, F.count("label").alias("n8"), F.sum("row").alias("n9")).where("n9 > 0")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(10)]
    sets = by_record.groupingSets([["split"], []], "split").agg(F.grouping_id().alias("total"), *sums, F.count_distinct("source").alias("n10"))  # a row for each split, and one
    column = lambda held: [F.max(F.when(held, F.col(f"n{k}"))).alias("x") for k in range(11)]
    wanted = {s: (F.col("total") == 0) & (F.col("split") == s) for s in SPLITS} | {"all": F.col("total") == 1}
    wide = sets.agg(*[F.array(*column(held)).alias(name) for name, held in wanted.items()])
    value = lambda name: F.coalesce(F.get(F.col(name), F.col("row_order")), F.lit(0).cast("long")).alias(name)
    rows = wide.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("row_order", "name"))
    return rows.select("row_order", "name", *map(value, wanted))


def split_samples(records: DataFrame, spans: DataFrame) -> DataFrame:
    """split, records, percent of records, entities and mean entities a record."""
    counts = spans.groupBy("record_id").agg(F.count("*").alias("n"))
    grouped = records.join(counts, "record_id", "left").groupBy("split").agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("entities"))
    total = grouped.agg(F.sum("records").alias("total"))
    return grouped.crossJoin(F.broadcast(total)).select("split", "records", (F.col("records") * 100.0 / F.col("total")).alias("percent"), "entities", (F.col("entities") / F.col("records")).alias("mean_entities"))


def doc_stats(records: DataFrame, spans: DataFrame) -> DataFrame:
    """split, records, documents, entities and labels (a map) of each split and of all."""
    both = records.withColumn("split", F.explode(F.array("split", F.lit("all"))))
    base = both.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("source").alias("documents"))
    counts = spans.join(both.select("record_id", "split"), "record_id").groupBy("split", "label").agg(F.count("*").alias("n"))
    maps = counts.groupBy("split").agg(F.sum("n").alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    return base.join(maps, "split", "left").withColumn("entities", F.coalesce("entities", F.lit(0).cast("long")))


def file_stats(records: DataFrame) -> DataFrame:
    """source_file, records and entities."""
    return records.groupBy("source_file").agg(F.count("*").alias("records"), F.sum(F.size("spans")).alias("entities"))


def tag_distribution(tagged: DataFrame, tags: list[str]) -> DataFrame:
    """tag and n for every tag, those without tokens too."""
    spine = tagged.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    return F.broadcast(spine).join(tagged.groupBy("tag").agg(F.count("*").alias("n")), "tag", "left").select("tag", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_weights(counts: DataFrame, least: float = 1.0, most: float = 3.0, absent: float = 2.5, outside: float = 0.25) -> DataFrame:
    """tag and weight from counts (label, n): the root of the largest count over a label's, within bounds; O has its own."""
    top = counts.agg(F.max("n").alias("top"))
    raw = F.when(F.col("n") <= 0, absent).otherwise(F.sqrt(F.col("top") / F.col("n")))
    weighed = counts.crossJoin(F.broadcast(top)).select("label", F.least(F.greatest(raw, F.lit(least)), F.lit(most)).alias("weight"))
    tags = weighed.select(F.explode(F.array(F.concat(F.lit("B-"), "label"), F.concat(F.lit("I-"), "label"))).alias("tag"), "weight")
    return tags.union(counts.sparkSession.createDataFrame([("O", outside)], "tag string, weight double"))


def prior_counts(spark) -> DataFrame:
    return spark.createDataFrame(list(L.PRIOR_COUNTS.items()), "label string, n long")


def polarity_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "section").agg(F.count_if(F.col("polarity") == "positive").alias("positive"), F.count_if(F.col("polarity") == "negative").alias("negative"))


def source_of(*keys: Column, row: Column) -> Column:
    """The first key that isn't empty, else a name made of the row's number."""
    return F.coalesce(*[F.nullif(k, F.lit("")) for k in keys], F.concat(F.lit("__row_"), row.cast("string")))


def _ranked(records: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Distinct sources with a place in an order that only seed and name decide, and their number, one row.

    The order needs all sources in one sequence; a source is a judgment, so this is the count of documents, not of rows,
    and only names travel. Places come from a range-sorted count by prefix of the hash.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("source")))
    names = records.select("source").distinct().select("source", key.alias("key")).withColumn("prefix", F.left("key", F.lit(3)))
    sizes = names.groupBy("prefix").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("prefix", before.alias("before"))  # at most 4,096 rows
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("key", "source")) - 1
    return names.withColumn("place", place).join(F.broadcast(offsets), "prefix").select("source", (F.col("before") + F.col("place")).alias("place")), sizes.agg(F.sum("n").alias("total"))


def split_by_source(records: DataFrame, train: float = 0.85, dev: float = 0.10, seed: int = 42, rounded: bool = False) -> DataFrame:
    """records with split: whole sources go to train, dev or test.

    Sizes are truncated, at least 1, with all that train leaves for dev below ten sources and a source taken from train where
    test would be empty; or rounded half to even, the rest being test.
    """
    ranked, total = _ranked(records, seed)
    n = F.col("total")
    if rounded:
        n_train, n_dev = F.rint(n * train), F.rint(n * dev)
        split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_dev, "dev").otherwise("test")
    else:
        n_train = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
        n_dev = F.when(n >= 10, F.greatest(F.lit(1), F.floor(n * F.lit(dev)))).otherwise(F.greatest(F.lit(1), n - n_train))
        rescue = (n_train + n_dev >= n) & (n_train > 1) & (F.col("place") == 0)
        split = F.when(rescue, "test").when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_dev, "dev").otherwise("test")
    chosen = ranked.crossJoin(F.broadcast(total)).select("source", split.alias("split"))
    return records.drop("split").join(chosen, "source")


def resolve_split(records: DataFrame, **how) -> DataFrame:
    """The split that records bring (column split), under its usual name, where every row has one; else a new one."""
    missing = records.where(F.col("split").isNull() | (F.col("split") == "")).limit(1).count()
    if missing:
        return split_by_source(records, rounded=True, **how).withColumn("split", T.split_name(F.col("split")))
    return records.withColumn("split", T.split_name(F.col("split")))


def leaks(records: DataFrame) -> DataFrame:
    """Sources that stand in more than one split; empty when a split is sound."""
    return records.groupBy("source").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def dedupe_first(rows: DataFrame, *by: str, order: str = "idx") -> DataFrame:
    """The first of rows with the same collapsed text within `by`; empty texts go."""
    keyed = rows.withColumn("text", T.collapse(F.col("text"))).where("text != ''")
    first = Window.partitionBy(*by, "text").orderBy(order)
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def anti_units(units: DataFrame, positive: DataFrame) -> DataFrame:
    """Units (doc_id, text) whose collapsed text isn't among the positive ones of their document."""
    key = lambda d: d.withColumn("_key", T.collapse(F.col("text")))
    return key(units).join(key(positive).select("doc_id", "_key"), ["doc_id", "_key"], "left_anti").drop("_key")


def skip_existing(docs: DataFrame, done: DataFrame) -> DataFrame:
    """docs whose source isn't among those done."""
    return docs.join(done.select("source").distinct(), "source", "left_anti")


_RANGES = 256


def places(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with place, from 0 in the order of a number within each key. A key of any share of the rows is numbered in ranges of `order`.

    The bounds of ranges are approximate quantiles, which decide about balance only: rows before a range are counted, places in it ranked.
    Rows of one key and order must be few; ties among them are in any order.
    """
    bounds = rows.agg(F.percentile_approx(order, [k / _RANGES for k in range(1, _RANGES)], 10_000).alias("q")).first()["q"] or []
    at = F.col(order)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b <= at)) if bounds else F.lit(0)
    ranged = rows.withColumn("_range", part)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1
    return ranged.withColumn("_inside", inside).join(counts, [key, "_range"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def version_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (stem, n) with the next free name: the stem itself, then stem_1, stem_2, ...; existing: (name)."""
    parsed = existing.select(F.regexp_replace("name", r"_\d+$", "").alias("stem"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("name", r"_(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)).alias("version"))
    top = parsed.groupBy("stem").agg(F.max("version").alias("top"))
    numbered = places(wanted, "stem", "n").join(top, "stem", "left").withColumn("version", F.coalesce(F.col("top"), F.lit(-1)) + F.col("place") + 1)
    return numbered.withColumn("name", F.when(F.col("version") == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", "version"))).drop("place", "top", "version")


HISTORY = "id string, at timestamp, kind string, filename string, model string, elapsed_ms long, count long, result string"


def history_entries(results: DataFrame) -> DataFrame:
    """Log rows (HISTORY, kind `saved`) of analyses (id, saved_at, filename, model_display_name, model_name, elapsed_ms, entities, highlighted; any of
    them but id and saved_at may be missing): names by default, the number of all entities, and as JSON what a display needs again.

    entities is a map from labels to lists.
    """
    given = lambda name, kind="string": F.col(name) if name in results.columns else F.lit(None).cast(kind)
    named = lambda *names, default: F.coalesce(*[F.nullif(given(n).cast("string"), F.lit("")) for n in names], F.lit(default))
    sizes = F.transform(F.map_values("entities"), lambda items: F.coalesce(F.size(items), F.lit(0))) if "entities" in results.columns else F.array().cast("array<int>")
    count = F.aggregate(F.coalesce(sizes, F.array().cast("array<int>")), F.lit(0).cast("long"), lambda total, n: total + F.greatest(n, F.lit(0)))
    kept = [n for n in ("filename", "model_name", "model_display_name", "elapsed_ms", "entities", "highlighted") if n in results.columns]
    return results.select(
        F.col("id").cast("string").alias("id"), F.col("saved_at").cast("timestamp").alias("at"), F.lit("saved").alias("kind"), named("filename", default="Không rõ tên").alias("filename"),
        named("model_display_name", "model_name", default="PhoBERT").alias("model"), given("elapsed_ms").cast("long").alias("elapsed_ms"), count.alias("count"), F.to_json(F.struct(*kept)).alias("result"))


def history_deletes(marks: DataFrame) -> DataFrame:
    """Log rows (kind `deleted`) that take the entries of an id away (id, at); a null id clears all that was saved before."""
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in HISTORY.split(", ")[3:]}
    return marks.select(F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), F.lit("deleted").alias("kind"), *[v.alias(k) for k, v in empty.items()])


def live_history(log: DataFrame) -> DataFrame:
    """What a log of saves and deletes leaves: the latest version of each id that no later mark took away; a delete counts before a save of the same time.

    The log is only ever appended to and merged here, on reading, by one partial aggregate; the newest clearing is one value.
    """
    row = F.struct("at", (F.col("kind") == "saved").alias("saved"), *[c.split()[0] for c in HISTORY.split(", ")[3:]])
    latest = log.where("id IS NOT NULL").groupBy("id").agg(F.max(row).alias("last"))
    cleared = log.where("id IS NULL AND kind = 'deleted'").agg(F.max("at").alias("cleared"))
    live = latest.crossJoin(F.broadcast(cleared)).where("last.saved AND (cleared IS NULL OR last.at >= cleared)")
    return live.select("id", F.col("last.at").alias("saved_at"), *[f"last.{c.split()[0]}" for c in HISTORY.split(", ")[3:]])


def top_history(history: DataFrame, k: int = 30) -> DataFrame:
    """The newest k analyses; ties by id."""
    return history.orderBy(F.desc("saved_at"), F.desc("id")).limit(k)


def stats_markdown(stats: DataFrame) -> DataFrame:
    """row_order and line: the table of split_stats() in Markdown, thousands separated."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "name", *[F.format_number(c, 0) for c in [*SPLITS, "all"]]), F.lit(" |"))
    return stats.select("row_order", line.alias("line"))


def split_report(stats: DataFrame, train: float = 0.85, dev: float = 0.10, seed: int = 42, paths: dict[str, str] | None = None) -> DataFrame:
    """One row: the JSON report of doc_stats(), with all three ratios and where the splits were written (paths by split)."""
    files = F.from_json(F.lit(json.dumps(paths or {})), "map<string,string>")
    item = F.struct("split", F.struct("records", "documents", "entities", "labels").alias("stats"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct(item["split"], F.to_json(item["stats"])))))
    head = F.struct(F.lit(seed).alias("seed"), F.lit(train).alias("train_ratio"), F.lit(dev).alias("dev_ratio"), F.lit(round(1 - train - dev, 10)).alias("test_ratio"), files.alias("files"))
    return stats.agg(F.to_json(F.struct(head["seed"].alias("seed"), head["train_ratio"].alias("train_ratio"), head["dev_ratio"].alias("dev_ratio"), head["test_ratio"].alias("test_ratio"), head["files"].alias("files"), whole.alias("stats"))).alias("report"))
