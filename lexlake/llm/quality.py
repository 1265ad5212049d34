"""Quality rules from cross-document line frequency, with built-in functions only.

Base rules look at one text: words, symbols, repeated lines, words in repeated 8-word windows.
The method then looks across documents: every line is normalised (lower case, digits to 0, white space
collapsed) and hashed; for each host (source) it counts the distinct documents that hold the line. Lines above
the host's limit are boilerplate and count as removed; a document is rejected when too few words are left.
Copies must not make a page its own boilerplate, so documents are told apart by a content signature, the hash of
their whole text, case and white space aside: copies count once, and different documents that share a passage count each.

A line of a third of all documents costs no task more than another: lines are counted through partial sums, first
by (host, line, signature), and the verdict join has the lines on a side that adaptive execution splits.

Defined results: a null text has no words and fails; a null source counts as the empty one; repeated rows are judged
each; a very long text is judged as a whole, within its row; a line that reaches a limit exactly is no boilerplate, and a document that
keeps exactly the least share of its words stays; an empty table gives an empty result; other columns, whatever their names, are
ignored by the verdict and kept by keep_good().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate for a host in more distinct documents than LINE_DOCS and than LINE_SHARE of the host's.
LINE_DOCS = 10
LINE_SHARE = 0.05
#: A document is depleted when fewer words than MIN_WORDS or than LEFT_SHARE of its words are left.
LEFT_SHARE = 0.2


def _window_hashes(hashes: Column) -> Column:
    window = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW_WORDS), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW_WORDS)]))
    return F.when(F.size(hashes) >= WINDOW_WORDS, window).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(grams: Column) -> Column:
    """Words under the windows that occur twice or more: the length of the union of their ranges."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: (p["g"] == F.get(pairs, i - 1)["g"]) | (p["g"] == F.get(pairs, i + 1)["g"]))
        places = F.array_sort(F.transform(twice, lambda p: p["i"]))
        steps = common.let(places, lambda a: F.transform(a, lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(a, i + 1) - p, F.lit(WINDOW_WORDS)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(common.let(pairs, covered))


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]+", "0")


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, signature, name (of the row) and lines (hash, words) of each row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), common.named_rows(docs).alias("name"))
    words = text.select("*", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    grams = words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).select("*", _window_hashes(F.col("hashes")).alias("grams"))
    return grams.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("grams")).alias("n_repeat_words"),
        F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), SPACE, " "))).alias("signature"),
        "name",
        F.transform("lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """For each row of docs its counts, base_failed, kept, and removed_words under boilerplate lines."""
    rows = common.checkpoint(common.with_row_id(text_features(docs)))
    lines = rows.select("row_id", "host", "signature", F.explode("lines").alias("x")).select("row_id", "host", "signature", "x.line", "x.words")
    distinct = lines.select("host", "line", "signature").distinct()
    hosts = rows.select("host", "signature").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    spread = distinct.groupBy("host", "line").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") > LINE_DOCS)
    common_lines = spread.join(hosts, "host").where(F.col("line_docs") > LINE_SHARE * F.col("host_docs")).select("host", "line")
    removed = lines.join(common_lines, ["host", "line"]).groupBy("row_id").agg(F.sum("words").alias("removed_words"))
    judged = rows.drop("lines", "signature").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < MIN_WORDS) | (left < LEFT_SHARE * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass. Rows that are equal in every column have the same verdict and stay or go together."""
    return common.keep_rows(docs, judge(docs).where("kept").select("name"))


def op3_quality_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


QUERIES = {"op3_quality_line_frequency": op3_quality_line_frequency}
#: The content signature is a 64-bit hash that SQL engines don't share; tests/llm compares with brute force.
SQL: dict[str, str] = {}
