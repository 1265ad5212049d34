"""Writers. Each leaves a folder of part files; names of columns and nesting are the readers'."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spans import export_bio
from .readers import _object, set_fields


def record_lines(records: DataFrame) -> DataFrame:
    """source and value: a JSON line for each prediction record."""
    meta = F.struct("source", "section", "ner_targets", F.col("record_idx").alias("para_idx"))
    return records.select("source", F.to_json(F.struct(F.col("record_id").alias("id"), "text", F.array().cast("array<string>").alias("labels"), meta.alias("meta"))).alias("value"))


def write_records(records: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 1_000_000) -> None:
    """A folder for each source, with few files. Rows of a source are brought together, but those of a large one stay with several tasks: Spark cuts
    partitions above its advisory size, and puts small ones together."""
    record_lines(records).hint("rebalance", "source").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("source").text(path)


def annotated_lines(records: DataFrame) -> DataFrame:
    """split and value: a JSON line for each annotated record, spans as triples.

    Records that were read (with a column record) keep all fields that they came with; id, text, labels and the meta fields source and split are set.
    """
    triple = F.transform("spans", lambda s: F.concat(F.lit("["), F.concat_ws(",", s["start"], s["end"]), F.lit(',"'), s["label"], F.lit('"]')))
    labels = F.concat(F.lit("["), F.array_join(triple, ","), F.lit("]"))
    if "record" in records.columns:
        meta = F.map_filter(set_fields(_object(F.col("record"), "$.meta"), source=F.col("source"), split=F.col("split")), lambda k, v: v.isNotNull())
        whole = set_fields(_object(F.col("record"), "$"), id=F.col("record_id"), text=F.col("text"), labels=F.parse_json(labels), meta=F.to_variant_object(meta))
        return records.select("split", F.to_json(F.to_variant_object(whole)).alias("value"))
    head = F.to_json(F.struct(F.col("record_id").alias("id"), "text", F.struct("source", "split").alias("meta")))
    return records.select("split", F.concat(F.left(head, F.length(head) - 1), F.lit(',"labels":'), labels, F.lit("}")).alias("value"))


def merged_lines(records: DataFrame) -> DataFrame:
    """source_file and value: the JSON line of each record that was read, with the defaults of the readers and all that it came with."""
    return records.select("source_file", F.to_json("record").alias("value"))


def write_split(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    annotated_lines(records).write.mode(mode).partitionBy("split").text(path)


BOM = "\ufeff"


def stats_lines(stats: DataFrame) -> DataFrame:
    """row_order and value: the table of statistics as lines of CSV, a header with a byte order mark first."""
    columns = [c for c in stats.columns if c != "row_order"]
    header = stats.sparkSession.createDataFrame([(-1, BOM + ",".join(columns))], "row_order int, value string")
    text = lambda c: F.col(c).cast("string")
    field = lambda c: F.when(text(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    return header.union(stats.select("row_order", F.concat_ws(",", *map(field, columns)).alias("value")))


def write_stats_csv(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file of some ten lines, which spreadsheets open as UTF-8."""
    stats_lines(stats).repartition(1).sortWithinPartitions("row_order").select("value").write.mode(mode).text(path)


def write_lines(lines: DataFrame, column: str, path: str, mode: str = "errorifexists", rows_per_file: int = 0) -> None:
    """Reports, Markdown tables and JSON documents: one column of text. rows_per_file: a bound for files that are read as a whole; 0 is none."""
    lines.select(F.col(column).alias("value")).write.mode(mode).option("maxRecordsPerFile", rows_per_file).text(path)


def write_bio(tagged: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Blocks of `token<TAB>tag` lines, an empty line behind each."""
    export_bio(tagged).select(F.concat("block", F.lit("\n")).alias("value")).write.mode(mode).text(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists", form: str = "csv") -> None:
    """form: csv (with a header) or json (a line for each row)."""
    writer = metrics.write.mode(mode)
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def write_jsonl(lines: DataFrame, column: str, folder: str, stem: str) -> list[str]:
    """Lines as files stem-00000.jsonl, ... of a folder that may hold others; their names."""
    spark, made = lines.sparkSession, []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    apart = f"{folder}/_new-{uuid.uuid4().hex}"
    write_lines(lines, column, apart)
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in sorted(store.listStatus(path(apart)), key=lambda x: x.getPath().getName()):
        if status.getPath().getName().startswith("part-"):
            made.append(f"{stem}-{len(made):05d}.jsonl")
            store.rename(status.getPath(), path(f"{folder}/{made[-1]}"))
    store.delete(path(apart), True)
    return made
