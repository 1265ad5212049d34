"""Readers. JSON lines are read as text and parsed to VARIANT, so that a bad line is a row and not a failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.spans import explode_spans

SPANS = "array<struct<start:int,end:int,label:string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source and text of every text file below path; source is the file's stem without a copy number."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(T.source_key(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "")).alias("source"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """source_file, line_no and line of files of JSON lines, of any size; line numbers count from 1, blank lines too.

    The files are scanned twice within one query, by the same plan: both scans cut them into the same blocks, in the same order.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    # a block is read by one task, in order: its ids have no gaps, and the lines of the blocks before it make up the rest
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("path", "block", (F.col("first") - before - 1).alias("shift"))
    return lines.join(shift, ["path", "block"]).select("source_file", (F.col("id") - F.col("shift")).cast("int").alias("line_no"), "line")


def concat_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold something, as they are."""
    return lines.where(T.strip(F.col("line")) != "")


def _field(record: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", kind)


def spans_of(record: Column) -> Column:
    """The spans of a record, as triples or as objects: of the first of labels, label and entities that it has; null when that field is no list."""
    fields = _object(record, "$")
    first = F.get(F.filter(F.array(*map(F.lit, ("labels", "label", "entities"))), lambda n: F.map_contains_key(fields, n)), F.lit(0))
    labels = T.let(F.element_at(fields, first), lambda v: F.when(~F.is_variant_null(v), v))
    listed = F.try_variant_get(labels, "$", "array<variant>")

    def span(v: Column) -> Column:
        start = F.coalesce(F.try_variant_get(v, "$[0]", "int"), F.try_variant_get(v, "$.start", "int"))
        end = F.coalesce(F.try_variant_get(v, "$[1]", "int"), F.try_variant_get(v, "$.end", "int"))
        label = F.coalesce(F.try_variant_get(v, "$[2]", "string"), F.try_variant_get(v, "$.label", "string"), F.try_variant_get(v, "$.entity", "string"))
        return F.struct(start.alias("start"), end.alias("end"), label.alias("label"))

    return F.when(labels.isNull(), F.array().cast(SPANS)).otherwise(F.filter(F.transform(listed, span), lambda s: s["label"].isNotNull()).cast(SPANS))


def _object(record: Column, path: str) -> Column:
    """The fields of an object of a record; none where there is no object."""
    return F.coalesce(F.try_variant_get(record, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def set_fields(fields: Column, **values: Column) -> Column:
    """fields (a map of variants) with some of them set, whatever they were before."""
    others = F.map_filter(fields, lambda k, _: ~k.isin(list(values)))
    return F.map_concat(others, F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("variant"))]))


def with_defaults(record: Column, source_file: Column) -> Column:
    """The whole record as it came, but for what must be there: labels (a list) and meta with source and source_file.

    labels is what the record calls labels, or else label; null counts as an empty list. A meta that is no object is replaced. Fields of meta
    that are there stay, be they null; all others, of meta and of the record, pass through.
    """
    fields, meta = _object(record, "$"), _object(record, "$.meta")
    named = F.map_contains_key(fields, F.lit("labels"))
    labels = F.element_at(fields, F.when(named, F.lit("labels")).otherwise(F.lit("label")))
    kept = F.map_filter(fields, lambda k, _: (k != "label") | named)
    defaults = F.create_map(F.lit("source"), F.regexp_replace(source_file, r"\.jsonl$", "").cast("variant"), F.lit("source_file"), source_file.cast("variant"))
    whole_meta = F.map_concat(meta, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(meta, k)))
    listed = F.when(labels.isNull() | F.is_variant_null(labels), F.parse_json(F.lit("[]"))).otherwise(labels)
    return F.to_variant_object(set_fields(kept, labels=listed, meta=F.to_variant_object(whole_meta)))


def parse_annotated(lines: DataFrame) -> DataFrame:
    """lines with what they say: error (null: a record), record_id, source, text, spans, split, and the whole record with its defaults (a VARIANT).

    error is `json` for a line that doesn't parse, `text` for a record without a text, `labels` for labels that are no list.
    The source defaults to the file's name without its ending.
    """
    record, spans = F.col("record"), F.col("spans")
    # as generated columns, the parsed line and its spans are made once and not again in each filter above
    parsed = concat_lines(lines).withColumn("record", F.explode(F.array(F.try_parse_json("line")))).withColumn("spans", F.explode(F.array(spans_of(record))))
    text = _field(record, "text", "string")
    error = F.when(record.isNull(), "json").when(text.isNull(), "text").when(spans.isNull(), "labels")
    source = F.coalesce(F.nullif(_field(record, "meta.source", "string"), F.lit("")), F.nullif(_field(record, "source", "string"), F.lit("")), F.regexp_replace("source_file", r"\.jsonl$", ""))
    return parsed.select(
        "source_file", "line_no", "line", error.alias("error"), F.coalesce(_field(record, "id", "string"), F.concat_ws(":", "source_file", "line_no")).alias("record_id"),
        source.alias("source"), text.alias("text"), "spans", _field(record, "meta.split", "string").alias("split"), with_defaults(record, F.col("source_file")).alias("record"),
    )


def records_and_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, with their lines as they were, and (source_file, line_no, error, line) of the others."""
    parsed = parse_annotated(lines)
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("source_file", "line_no", "error", "line")


def strict_records(lines: DataFrame) -> DataFrame:
    """Records of lines that must all be good: the first bad one fails the job, with its file and line.

    The check is a filter, so no plan that reads the rows can leave it out, whichever columns it asks for.
    """
    parsed = parse_annotated(lines)
    where = F.concat(F.lit("bad record ("), F.col("error"), F.lit(") in "), F.col("source_file"), F.lit(":"), F.col("line_no").cast("string"))
    return parsed.where(F.when(F.col("error").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True))).drop("error")


def load_corpus(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The good records of all .jsonl files of a folder except those named."""
    lines = read_lines(spark, folder, "*.jsonl")
    return records_and_rejects(lines.where(~F.col("source_file").isin(list(exclude))) if exclude else lines)[0]


def merge_annotated(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As load_corpus(), with its report: good records; (source_file, records, rejects, entities); (label, n) of usable spans."""
    lines = read_lines(spark, folder, "*.jsonl")
    parsed = parse_annotated(lines.where(~F.col("source_file").isin(list(exclude))) if exclude else lines)
    good = parsed.where("error is null").drop("error")
    by_file = parsed.groupBy("source_file").agg(
        F.count_if(F.col("error").isNull()).alias("records"), F.count_if(F.col("error").isNotNull()).alias("rejects"), F.sum(F.when(F.col("error").isNull(), F.size("spans")).otherwise(0)).alias("entities"))
    return good, by_file, explode_spans(good).groupBy("label").agg(F.count("*").alias("n"))


def paragraph_table(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, source, para_idx, style, text) in one shape, whatever they come with; empty ones are dropped."""
    # as a generated column the text is made once; the filter above would make it again
    made = paragraphs.withColumn("text", F.explode(F.array(T.normalize(F.col("text"), "annotated")))).where("text != ''")
    return made.select("doc_id", T.source_key(F.col("source")).alias("source"), F.col("para_idx").cast("int").alias("para_idx"), F.coalesce("style", F.lit("")).alias("style"), "text")


def load_metrics(frames: dict[str, DataFrame], labels: list[str]) -> DataFrame:
    """model, label, precision, recall, f1, support of several models' metric tables; a label that one lacks counts 0.

    The label column may be called label or `Entity type`, and names of columns may differ in case.
    """

    def one(model: str, frame: DataFrame) -> DataFrame:
        names = {c.lower(): c for c in frame.columns}
        label = F.col(f"`{names.get('label') or names['entity type']}`")
        values = [F.coalesce(F.col(f"`{names[c]}`").cast("double"), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "support")]
        named = frame.select(F.when(F.lower(label) == "overall", "overall").otherwise(label).alias("label"), *values)
        spine = frame.sparkSession.createDataFrame([(x,) for x in [*labels, "overall"]], "label string")
        return F.broadcast(spine).join(named, "label", "left").select(F.lit(model).alias("model"), "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "support")])

    return reduce(DataFrame.unionByName, [one(m, f) for m, f in frames.items()])


def load_split(train: DataFrame, dev: DataFrame, test: DataFrame) -> DataFrame:
    """Given split tables as one, with split."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("split", F.lit(n)) for n, d in (("train", train), ("dev", dev), ("test", test))])
