"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session names none, one is set: a folder of this machine in local mode, else one below the warehouse.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
        context.setCheckpointDir(named or (tempfile.mkdtemp(prefix="spark-checkpoint-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoint"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the session ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, by one job. The files go when the session ends.

    Shuffle files behind df are of no more use; Spark's cleaner removes them once the driver has collected its garbage, which may take long to come by itself.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_end(spark, path)
    made = spark.read.parquet(path)
    context = spark.sparkContext
    with contextlib.suppress(Py4JJavaError):  # listeners that are slow only keep the files for longer
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # the last event of the write holds its plan until events of the read have come
    context._jvm.System.gc()
    return made


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def text_hash(text: Column) -> Column:
    """64-bit hash of a whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row, whatever their types; rows that differ anywhere differ here."""
    hashable = lambda t: not any(x in t.simpleString() for x in ("map<", "variant", "interval"))
    return F.xxhash64(*[column(f.name) if hashable(f.dataType) else F.to_json(F.struct(column(f.name))) for f in df.schema])


def named_rows(df: DataFrame) -> Column:
    """What tells rows of documents apart in two readings of df: doc_id, the text's hash and the hash of all columns."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), row_hash(df).alias("row_hash"))


def keep_rows(df: DataFrame, names: DataFrame, once: bool = False) -> DataFrame:
    """The rows of df that names (column name, as of named_rows) has; once: of rows equal in every column, one.

    Null doc_ids compare as equal. The key column gets a name that df doesn't use.
    """
    key = free_name(df, "_key")
    flat = lambda name: F.concat_ws(":", F.coalesce(name["doc_id"].cast("string"), F.lit("null")), name["text_hash"], name["row_hash"])
    wanted = names.select(flat(F.col("name")).alias(key)).distinct()
    keyed = df.withColumn(key, flat(named_rows(df)))
    # rows that are equal in every column are reduced to one before they travel, so that many of them load no task
    return (keyed.dropDuplicates([key]) if once else keyed).join(wanted.hint("merge"), key, "left_semi").select(*columns_of(df))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row, so that repeated doc_ids stay apart. Use only below a checkpoint()."""
    return df.withColumn(name, F.monotonically_increasing_id())
