"""Queries over annotated corpora: lines and records, statistics, splits, reports, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import segment as S
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import annotate as A
from . import fixture
from .fixture import shared_folder
from .registry import query


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.records_with_spans(spark, sf_dir)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of annotated sentences in two files, every tenth one spoilt in one of five ways."""
    rows = _records(spark, sf_dir).withColumn("split", F.lit(None).cast("string"))
    good = K.annotated_lines(rows.select("rid", "record_id", "source", "text", "spans", "split"))
    # annotated_lines keeps the order of columns, not the row; the number comes back from the id
    rid = F.regexp_extract("value", r'"id":"R(\d+)"', 1).cast("long")
    way = F.when(F.col("rid") % 10 != 0, F.col("value")).otherwise(
        F.element_at(F.array(F.lit(""), F.lit("{not json"), F.lit('{"labels": []}'), F.concat(F.lit('{"text": "t", "meta": {"source": "S"}, "labels": null}')), F.lit('{"text": "t", "entities": [{"start": 0, "end": 1, "entity": "DRUG"}]}')), (F.col("rid") / 10 % 5 + 1).cast("int")))
    numbered = good.withColumn("rid", rid)
    return numbered.select(F.concat(F.lit("part"), (F.col("rid") % 2).cast("string"), F.lit(".jsonl")).alias("source_file"), F.col("rid").cast("int").alias("line_no"), way.alias("line"))


_GOLD_LINES = fixture.with_tables("", "annotated").rstrip()


@query(_GOLD_LINES + """
SELECT 'part' || rid % 2 || '.jsonl' AS source_file, rid AS line_no, CASE WHEN rid % 10 = 0 THEN CASE rid // 10 % 5 WHEN 3 THEN 'S' ELSE 'part' || rid % 2 END ELSE source END AS source,
  CASE WHEN rid % 10 = 0 THEN 't' ELSE text END AS text, CASE WHEN rid % 10 = 0 THEN CASE rid // 10 % 5 WHEN 3 THEN 0 ELSE 1 END ELSE 5 END AS n_spans
FROM annotated WHERE rid % 10 <> 0 OR rid // 10 % 5 IN (3, 4)""")  # fmt: skip
def source_lenient_records(spark, sf_dir):
    good, _ = R.records_and_rejects(_lines(spark, sf_dir))
    return good.select("source_file", "line_no", "source", "text", F.size("spans").alias("n_spans"))


@query(_GOLD_LINES + """
SELECT 'part' || rid % 2 || '.jsonl' AS source_file, rid AS line_no, CASE rid // 10 % 5 WHEN 1 THEN 'json' ELSE 'text' END AS error FROM annotated WHERE rid % 10 = 0 AND rid // 10 % 5 IN (1, 2)""")  # fmt: skip
def source_rejects(spark, sf_dir):
    return R.records_and_rejects(_lines(spark, sf_dir))[1].drop("line")


@query(_GOLD_LINES + "SELECT 'part' || rid % 2 || '.jsonl' AS source_file, count(*) AS n FROM annotated WHERE NOT (rid % 10 = 0 AND rid // 10 % 5 = 0) GROUP BY ALL")
def source_concat_lines(spark, sf_dir):
    return R.concat_lines(_lines(spark, sf_dir)).groupBy("source_file").agg(F.count("*").alias("n"))


@query(fixture.with_tables("SELECT record_id, label, start_at, end_at FROM gold WHERE rid % 10 <> 0", "annotated", "gold"))
def source_explode_spans(spark, sf_dir):
    from ..operators import spans as X

    good, _ = R.records_and_rejects(_lines(spark, sf_dir))
    return X.explode_spans(good.where(F.col("record_id").startswith("R"))).select("record_id", "label", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(_GOLD_LINES + "SELECT 'part' || rid % 2 || '.jsonl' AS source_file, count(*) AS records, sum(CASE WHEN rid % 10 = 0 THEN CASE rid // 10 % 5 WHEN 3 THEN 0 ELSE 1 END ELSE 5 END)::BIGINT AS entities FROM annotated WHERE rid % 10 <> 0 OR rid // 10 % 5 IN (3, 4) GROUP BY ALL")
def source_file_stats(spark, sf_dir):
    return C.file_stats(R.records_and_rejects(_lines(spark, sf_dir))[0])


@query(_GOLD_LINES + "SELECT 'part1.jsonl' AS source_file, count(*) AS n FROM annotated WHERE rid % 2 = 1")
def source_folder_roundtrip(spark, sf_dir):
    """Lines written as files of two names, and the folder loaded again without those of one."""
    folder, lines = shared_folder(spark), _lines(spark, sf_dir)
    names = [K.write_jsonl(lines.where(F.col("source_file") == f"{n}.jsonl"), "line", folder, n) for n in ("part0", "part1")]
    good = R.load_corpus(spark, folder, exclude=tuple(names[0]))
    return good.groupBy(F.regexp_replace("source_file", r"-\d+", "").alias("source_file")).agg(F.count("*").alias("n"))


@query(fixture.with_tables("""
SELECT 'records' AS kind, 'part0.jsonl' AS name, count(*) AS n FROM annotated WHERE rid % 2 = 0 AND (rid % 10 <> 0 OR rid // 10 % 5 IN (3, 4))
UNION ALL SELECT 'rejects', 'part0.jsonl', count(*) FROM annotated WHERE rid % 10 = 0 AND rid // 10 % 5 IN (1, 2)
UNION ALL SELECT 'label', label, count(*) + CASE WHEN label = 'DRUG' THEN (SELECT count(*) FROM annotated WHERE rid % 10 = 0 AND rid // 10 % 5 = 4) ELSE 0 END FROM gold WHERE rid % 2 = 0 AND rid % 10 <> 0 GROUP BY label""", "annotated", "gold"))  # fmt: skip
def source_merge_annotated(spark, sf_dir):
    """The report of a folder that is merged without the files of one name: good and bad lines by file, spans by label."""
    folder, lines = shared_folder(spark), _lines(spark, sf_dir)
    names = [K.write_jsonl(lines.where(F.col("source_file") == f"{n}.jsonl"), "line", folder, n) for n in ("part0", "part1")]
    _, by_file, by_label = R.merge_annotated(spark, folder, exclude=tuple(names[1]))
    files = by_file.groupBy(F.regexp_replace("source_file", r"-\d+", "").alias("name")).agg(F.sum("records").alias("records"), F.sum("rejects").alias("rejects"))
    return files.unpivot("name", ["records", "rejects"], "kind", "n").select("kind", "name", "n").union(by_label.select(F.lit("label"), "label", "n"))


def _rich_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with fields that no reader asks for: whole meta objects, others without a source, null ones, labels under their other name or missing."""
    rows = _records(spark, sf_dir)
    triples = F.to_json(F.transform("spans", lambda s: F.array(s["start"].cast("string"), s["end"].cast("string"), s["label"])))
    labels = F.regexp_replace(triples, r'"(\d+)"', "$1")
    number = lambda c: c.cast("string")
    way = [
        F.concat(F.lit('"labels": '), labels, F.lit(', "meta": {"para_idx": '), number(F.col("rid") % 50), F.lit(', "source": "'), F.col("source"), F.lit('", "source_file": "orig.jsonl", "section": "noi_dung", "ner_targets": ["DRUG", "PERSON"]}')),
        F.concat(F.lit('"meta": {"section": "quyet_dinh"}, "label": '), labels), F.lit('"meta": null'), F.lit('"labels": null, "label": "x", "meta": {"source": null, "flag": true}'),
    ]
    head = F.concat(F.lit('{"note": {"rev": '), number(F.col("rid") % 7), F.lit(', "by": [1.5, null]}, "id": "'), F.col("record_id"), F.lit('", "text": "'), F.col("text"), F.lit('", '))
    line = F.concat(head, F.element_at(F.array(*way), (F.col("rid") % 4 + 1).cast("int")), F.lit("}"))
    return rows.select(F.concat(F.lit("part"), number(F.col("rid") % 2), F.lit(".jsonl")).alias("source_file"), F.col("rid").cast("int").alias("line_no"), line.alias("line"))


def _rich_sql(body: str) -> str:
    return fixture.with_tables("", "annotated", "gold").rstrip() + """,
l AS (SELECT rid, '[' || string_agg('[' || start_at || ',' || end_at || ',"' || label || '"]', ',' ORDER BY start_at) || ']' AS labels FROM gold GROUP BY rid),
r AS (SELECT a.*, l.labels, 'part' || a.rid % 2 AS stem, '"note":{"by":[1.5,null],"rev":' || a.rid % 7 || '},' AS note FROM annotated a JOIN l USING (rid))
""" + body  # fmt: skip


@query(_rich_sql("""SELECT '{"id":"' || record_id || '",' || CASE rid % 4
  WHEN 0 THEN '"labels":' || labels || ',"meta":{"ner_targets":["DRUG","PERSON"],"para_idx":' || rid % 50 || ',"section":"noi_dung","source":"' || source || '","source_file":"orig.jsonl"},'
  WHEN 1 THEN '"labels":' || labels || ',"meta":{"section":"quyet_dinh","source":"' || stem || '","source_file":"' || stem || '.jsonl"},'
  WHEN 2 THEN '"labels":[],"meta":{"source":"' || stem || '","source_file":"' || stem || '.jsonl"},'
  ELSE '"label":"x","labels":[],"meta":{"flag":true,"source":null,"source_file":"' || stem || '.jsonl"},' END || note || '"text":"' || text || '"}' AS line FROM r"""))
def source_lossless_merge(spark, sf_dir):
    """Annotated records read and merged into one folder with all that they came with."""
    folder = shared_folder(spark)
    good, _ = R.records_and_rejects(_rich_lines(spark, sf_dir))
    K.write_jsonl(K.merged_lines(good), "value", folder, "merged")
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(_rich_sql("""SELECT CASE rid % 3 WHEN 0 THEN 'dev' ELSE 'train' END AS split, '{"id":"' || record_id || '",' || CASE rid % 4
  WHEN 0 THEN '"labels":' || labels || ',"meta":{"ner_targets":["DRUG","PERSON"],"para_idx":' || rid % 50 || ',"section":"noi_dung","source":"' || source || '","source_file":"orig.jsonl",'
  WHEN 1 THEN '"labels":' || labels || ',"meta":{"section":"quyet_dinh","source":"' || stem || '","source_file":"' || stem || '.jsonl",'
  WHEN 2 THEN '"labels":[],"meta":{"source":"' || stem || '","source_file":"' || stem || '.jsonl",'
  ELSE '"label":"x","labels":[],"meta":{"flag":true,"source":"' || stem || '","source_file":"' || stem || '.jsonl",' END || '"split":"' || CASE rid % 3 WHEN 0 THEN 'dev' ELSE 'train' END || '"},' || note || '"text":"' || text || '"}' AS line FROM r"""))
def source_lossless_split(spark, sf_dir):
    """Annotated records read, given a split and written by split: meta and unknown fields are still there."""
    folder = shared_folder(spark)
    good, _ = R.records_and_rejects(_rich_lines(spark, sf_dir))
    rid = F.regexp_extract("record_id", r"R(\d+)", 1).cast("long")
    K.write_split(good.withColumn("split", F.when(rid % 3 == 0, "dev").otherwise("train")), folder)
    return spark.read.text(folder).select("split", F.col("value").alias("line"))


@query(fixture.with_tables("SELECT CASE WHEN doc_id % 2 = 0 THEN 'BA-0' ELSE source END AS source, 5 * count(*) AS n FROM judgments GROUP BY ALL", "judgments"))
def sink_records_roundtrip(spark, sf_dir):
    """Prediction records written by source, of which one has half of all, counted from the files."""
    path = shared_folder(spark)
    docs = fixture.judgments(spark, sf_dir).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "BA-0").otherwise(F.col("source")))
    K.write_records(S.build_records(docs), path)
    return spark.read.text(path).where(F.try_parse_json("value").isNotNull()).groupBy("source").agg(F.count("*").alias("n"))


@query(fixture.with_tables("SELECT label, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM gold WHERE rid % 3 <> 0 OR label <> 'DRUG' GROUP BY label", "annotated", "gold"))
def corpus_label_ratios(spark, sf_dir):
    return C.label_ratios(_uneven(spark, sf_dir))


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans without the drug of every third record, so that labels differ in number."""
    return fixture.gold(spark, sf_dir).where("rid % 3 != 0 or label != 'DRUG'")


@query(fixture.with_tables("""
, u AS (SELECT * FROM gold WHERE rid % 3 <> 0 OR label <> 'DRUG'), c AS (SELECT label, count(*) AS n FROM u GROUP BY label)
SELECT (SELECT count(*) FROM annotated) AS records, (SELECT count(*) FROM u) AS entities, (SELECT count(*) FROM c) AS labels, (SELECT count(*) FROM u) / (SELECT count(*) FROM annotated) AS mean_entities,
  (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS most_frequent, (SELECT label FROM c ORDER BY n, label LIMIT 1) AS least_frequent""", "annotated", "gold").replace("\n, u AS", ", u AS"))  # fmt: skip
def corpus_summary(spark, sf_dir):
    return C.corpus_summary(_records(spark, sf_dir), _uneven(spark, sf_dir))


_SPLIT = """
, src AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM annotated)),
split AS (SELECT source, CASE WHEN place < greatest(1, floor(n * 0.85)) THEN 'train' WHEN place < greatest(1, floor(n * 0.85)) + greatest(1, floor(n * 0.1)) THEN 'dev' ELSE 'test' END AS split FROM src),
rec AS (SELECT a.rid, a.record_id, a.source, s.split FROM annotated a JOIN split s USING (source)),
u AS (SELECT g.*, r.split, r.source FROM gold g JOIN rec r USING (rid) WHERE g.rid % 3 <> 0 OR label <> 'DRUG')
"""


def _split_sql(body: str) -> str:
    return fixture.with_tables("", "annotated", "gold").rstrip() + _SPLIT.rstrip() + "\n" + body


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_by_source(_records(spark, sf_dir))


@query(_split_sql("SELECT record_id, split FROM rec"))
def corpus_split(spark, sf_dir):
    return _split(spark, sf_dir).select("record_id", "split")


@query(fixture.with_tables("""
, src AS (SELECT source, row_number() OVER (ORDER BY md5('7|' || source), source) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM annotated))
SELECT source, CASE WHEN place < round_even(n * 0.8, 0) THEN 'Train' WHEN place < round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'Validation' ELSE 'Testing' END AS split FROM src""", "annotated").replace("\n, src", ", src").replace("'Train'", "'Training'"))  # fmt: skip
def corpus_resolve_split(spark, sf_dir):
    """Records of which some have no split get a new one; sizes are rounded half to even."""
    some = _records(spark, sf_dir).withColumn("split", F.when(F.col("rid") % 2 == 0, "dev"))
    return C.resolve_split(some, train=0.8, dev=0.1, seed=7).select("source", "split").distinct()


@query(_split_sql("SELECT source, count(DISTINCT CASE WHEN rid % 9 = 0 THEN 'test' ELSE split END) AS splits FROM rec GROUP BY source HAVING count(DISTINCT CASE WHEN rid % 9 = 0 THEN 'test' ELSE split END) > 1"))
def corpus_leaks(spark, sf_dir):
    """A sound split into which every ninth record was put by itself, into test."""
    return C.leaks(_split(spark, sf_dir).withColumn("split", F.when(F.col("rid") % 9 == 0, "test").otherwise(F.col("split"))))


@query(_split_sql("SELECT count(*) AS n FROM rec WHERE false"))
def corpus_no_leaks(spark, sf_dir):
    """A sound split has none."""
    return C.leaks(_split(spark, sf_dir)).agg(F.count("*").alias("n"))


_STATS = """
, lab AS (SELECT * FROM (VALUES (0, 'PERSON'), (1, 'DRUG'), (2, 'DRUG_WEIGHT'), (3, 'CRIME_TIME'), (4, 'CRIME_LOC'), (5, 'CHARGE'), (6, 'SENTENCE'), (7, 'LEGAL_ARTICLE')) AS t(row_order, name))
SELECT l.row_order, l.name, count(u.label) FILTER (split = 'train') AS train, count(u.label) FILTER (split = 'dev') AS dev, count(u.label) FILTER (split = 'test') AS test, count(u.label) AS "all" FROM lab l LEFT JOIN u ON u.label = l.name GROUP BY ALL
UNION ALL SELECT 8, '#Entities in total', count(*) FILTER (split = 'train'), count(*) FILTER (split = 'dev'), count(*) FILTER (split = 'test'), count(*) FROM u
UNION ALL SELECT 9, '#Rows/snippets in total', count(*) FILTER (split = 'train'), count(*) FILTER (split = 'dev'), count(*) FILTER (split = 'test'), count(*) FROM rec
UNION ALL SELECT 10, '#Source judgments in total', count(DISTINCT source) FILTER (split = 'train'), count(DISTINCT source) FILTER (split = 'dev'), count(DISTINCT source) FILTER (split = 'test'), count(DISTINCT source) FROM rec"""


@query(_split_sql(_STATS))
def corpus_split_stats(spark, sf_dir):
    return C.split_stats(_split(spark, sf_dir), _uneven(spark, sf_dir))


@query(_split_sql("""
SELECT split, records, records * 100.0 / sum(records) OVER () AS percent, entities, entities / records AS mean_entities
FROM (SELECT split, count(*) AS records FROM rec GROUP BY split) JOIN (SELECT split, count(*) AS entities FROM u GROUP BY split) USING (split)"""))  # fmt: skip
def corpus_split_samples(spark, sf_dir):
    return C.split_samples(_split(spark, sf_dir), _uneven(spark, sf_dir))


_DOC_STATS = """
, everyone AS (SELECT split, record_id, source FROM rec UNION ALL SELECT 'all', record_id, source FROM rec), ub AS (SELECT split, label FROM u UNION ALL SELECT 'all', label FROM u),
stats AS (SELECT b.split, count(*) AS records, count(DISTINCT source) AS documents, (SELECT count(*) FROM ub WHERE ub.split = b.split) AS entities,
  (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM ub WHERE ub.split = b.split GROUP BY label)) AS labels FROM everyone b GROUP BY b.split)
"""


def _pairs(labels: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query(_split_sql(_DOC_STATS + "SELECT split, records, documents, entities, labels FROM stats"))
def corpus_doc_stats(spark, sf_dir):
    return C.doc_stats(_split(spark, sf_dir), _uneven(spark, sf_dir)).withColumn("labels", _pairs(F.col("labels")))


@query(_split_sql(_DOC_STATS + "SELECT 42 AS seed, 0.85 AS train_ratio, 0.1 AS dev_ratio, 0.05 AS test_ratio, 'out/split=dev' AS dev_file, split, records, documents, entities, labels FROM stats"))
def corpus_split_report(spark, sf_dir):
    """The JSON report with all its fields, read again."""
    report = C.split_report(C.doc_stats(_split(spark, sf_dir), _uneven(spark, sf_dir)), paths={s: f"out/split={s}" for s in C.SPLITS})
    read = report.select(F.from_json("report", "seed int, train_ratio double, dev_ratio double, test_ratio double, files map<string,string>, stats map<string,string>").alias("r"))
    each = read.select("r.seed", "r.train_ratio", "r.dev_ratio", "r.test_ratio", F.col("r.files")["dev"].alias("dev_file"), F.explode("r.stats").alias("split", "json"))
    stats = each.withColumn("s", F.from_json("json", "records long, documents long, entities long, labels map<string,long>"))
    return stats.select("seed", "train_ratio", "dev_ratio", "test_ratio", "dev_file", "split", "s.records", "s.documents", "s.entities", _pairs(F.col("s.labels")).alias("labels"))


def _stats_sql(body: str) -> str:
    return _split_sql(_STATS.replace("SELECT l.row_order, l.name", "stats AS (SELECT l.row_order, l.name").replace("AS t(row_order, name))\n", "AS t(row_order, name)),\n") + ")\n" + body)


@query(_stats_sql("""SELECT row_order, '| ' || name || ' | ' || format('{:,}', train) || ' | ' || format('{:,}', dev) || ' | ' || format('{:,}', test) || ' | ' || format('{:,}', "all") || ' |' AS line FROM stats"""))
def corpus_stats_markdown(spark, sf_dir):
    return C.stats_markdown(C.split_stats(_split(spark, sf_dir), _uneven(spark, sf_dir)))


@query(_stats_sql("""SELECT 'name,train,dev,test,all' AS line UNION ALL SELECT name || ',' || train || ',' || dev || ',' || test || ',' || "all" FROM stats"""))
def sink_stats_csv(spark, sf_dir):
    """The lines of the statistics file, written and read again; readers take the byte order mark off."""
    path = shared_folder(spark)
    K.write_stats_csv(C.split_stats(_split(spark, sf_dir), _uneven(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(fixture.with_tables("SELECT form, label, count(*) AS support, 0.5 AS f1 FROM gold, (VALUES ('csv'), ('json')) AS f(form) GROUP BY form, label", "annotated", "gold"))
def sink_metrics_roundtrip(spark, sf_dir):
    """A table of metrics in both forms, read again."""
    folder = shared_folder(spark)
    metrics = fixture.gold(spark, sf_dir).groupBy("label").agg(F.count("*").alias("support")).withColumn("f1", F.lit(0.5))
    for form in ("csv", "json"):
        K.write_metrics(metrics, f"{folder}/{form}", form=form)
    csv = spark.read.option("header", True).csv(f"{folder}/csv").select(F.lit("csv").alias("form"), "label", F.col("support").cast("long").alias("support"), F.col("f1").cast("double").alias("f1"))
    return csv.union(spark.read.json(f"{folder}/json").select(F.lit("json"), "label", "support", "f1"))


@query(fixture.with_tables("SELECT doc_id, source, (n - 1)::INT AS para_idx, 'Normal' AS style, line AS text FROM judgments, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n) WHERE line <> ''", "judgments"))
def source_paragraph_table(spark, sf_dir):
    """Lines of judgments as paragraphs of annotated documents."""
    lines = fixture.judgments(spark, sf_dir).select("doc_id", F.concat("source", F.lit(" (2)")).alias("source"), F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))
    return R.paragraph_table(lines.withColumn("style", F.lit("Normal")))


@query(fixture.with_tables("SELECT doc_id, n::INT - 1 AS idx, line AS text FROM judgments, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n) WHERE line <> '' AND n <> 2", "judgments"))
def corpus_anti_units(spark, sf_dir):
    """Lines of judgments that aren't among their positive units."""
    docs = fixture.judgments(spark, sf_dir)
    units = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text")).where("text != ''")
    return C.anti_units(units, S.positive_content(docs)).select("doc_id", "idx", "text")


@query(fixture.with_tables("""
, c AS (SELECT label, count(*) AS n FROM gold WHERE rid % 3 <> 0 OR label <> 'DRUG' GROUP BY label), w AS (SELECT label, least(greatest(sqrt(max(n) OVER () / n), 1.0), 3.0) AS weight FROM c)
SELECT 'B-' || label AS tag, weight FROM w UNION ALL SELECT 'I-' || label, weight FROM w UNION ALL SELECT 'O', 0.25""", "annotated", "gold").replace("\n, c AS", ", c AS"))  # fmt: skip
def corpus_class_weights(spark, sf_dir):
    return C.class_weights(C.label_counts(_uneven(spark, sf_dir)))


@query(fixture.with_tables("SELECT source, section, sum((polarity = 'positive')::INT)::BIGINT AS positive, sum((polarity = 'negative')::INT)::BIGINT AS negative FROM judgments, (VALUES ('noi_dung', 'positive'), ('nhan_dinh', 'positive'), ('negative', 'negative'), ('negative', 'negative'), ('quyet_dinh', 'positive'), ('quyet_dinh', 'positive')) AS t(section, polarity) GROUP BY ALL", "judgments"))
def corpus_polarity_counts(spark, sf_dir):
    return C.polarity_counts(S.build_training_records(fixture.judgments(spark, sf_dir)))


@query("""
WITH w AS (SELECT source AS stem, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT stem, doc_id, CASE WHEN stem IN ('src1', 'src2') THEN stem || '_' || (n + 4) WHEN stem = 'src3' THEN stem || '_' || n WHEN n = 1 THEN stem ELSE stem || '_' || (n - 1) END AS name FROM w""")  # fmt: skip
def corpus_version_names(spark, sf_dir):
    """New names for documents of sources of which some have files already."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("stem"), "doc_id", F.col("doc_id").alias("n"))
    existing = spark.createDataFrame([("src1",), ("src1_4",), ("src2_4",), ("src2_1",), ("src3",)], "name string")
    return C.version_names(docs, existing).select("stem", "doc_id", "name")


@query("SELECT doc_id, coalesce(nullif(source, ''), nullif(lang, ''), '__row_' || doc_id) AS key FROM documents")
def corpus_source_of(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", C.source_of(F.col("source"), F.col("lang"), row=F.col("doc_id")).alias("key"))


@query("SELECT event_id AS id, ts AS saved_at, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def corpus_top_history(spark, sf_dir):
    """A top-k report: the newest 30."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return C.top_history(events.select(F.col("event_id").alias("id"), F.col("ts").alias("saved_at"), "user_id"))


_SAVED = "SELECT 'u' || user_id || '-' || event_id % 7 AS id, * FROM events"


@query(f"""
WITH log AS ({_SAVED}), last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_type <> 'error' DESC, event_id DESC) AS n FROM log)
SELECT id, ts AS saved_at, CASE WHEN event_type = 'signup' THEN 'Không rõ tên' ELSE 'file-' || event_id END AS filename, CASE event_type WHEN 'view' THEN 'crf' WHEN 'click' THEN 'PhoBERT' ELSE 'PhoBERT+CRF' END AS model,
  CASE WHEN event_type <> 'click' THEN event_id % 1000 END AS elapsed_ms, event_id % 4 + event_id % 3 AS count, (event_id % 4)::INT AS n_drugs
FROM last WHERE n = 1 AND event_type <> 'error' AND ts >= TIMESTAMP '2024-01-05 00:00:00'""")  # fmt: skip
def corpus_live_history(spark, sf_dir):
    """Analyses saved again and again under their ids, errors as deletes, all before the fifth of January cleared: what is left, with entity counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("id", F.concat(F.lit("u"), "user_id", F.lit("-"), F.col("event_id") % 7))
    items = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(k)), lambda i: i < F.col("event_id") % k), lambda i: F.concat(F.lit("word"), i))
    kind = F.col("event_type")
    saved = events.where("event_type != 'error'").select(
        "id", F.col("ts").alias("saved_at"), F.when(kind != "signup", F.concat(F.lit("file-"), "event_id")).otherwise("").alias("filename"), F.when(kind.isin("signup", "purchase"), "PhoBERT+CRF").alias("model_display_name"),
        F.when(kind == "view", "crf").alias("model_name"), F.when(kind != "click", F.col("event_id") % 1000).alias("elapsed_ms"), F.create_map(F.lit("DRUG"), items(4), F.lit("PERSON"), items(3)).alias("entities"))
    marks = events.where("event_type = 'error'").select("id", F.col("ts").alias("at"))
    clear = spark.range(1).select(F.lit(None).cast("string").alias("id"), F.lit("2024-01-05 00:00:00").cast("timestamp").alias("at"))
    live = C.live_history(C.history_entries(saved).unionByName(C.history_deletes(marks)).unionByName(C.history_deletes(clear)))
    drugs = F.size(F.from_json("result", "entities map<string,array<string>>")["entities"]["DRUG"])
    return live.select("id", "saved_at", "filename", "model", "elapsed_ms", "count", drugs.alias("n_drugs"))


@query(f"""
WITH saved AS ({_SAVED}), half AS (SELECT id, ts >= TIMESTAMP '2024-01-16 00:00:00' AS late, min(ts) AS first, max(ts) AS last FROM saved GROUP BY ALL),
mark AS (SELECT late, max(last) - INTERVAL 10 MINUTE AS at_ FROM half GROUP BY late), a AS (SELECT half.*, last + INTERVAL 1 HOUR < at_ AS gone FROM half JOIN mark USING (late) WHERE NOT late),
b AS (SELECT coalesce(h.id, a.id) AS id, h.first, coalesce(h.last, a.last) AS last, (a.id IS NOT NULL AND NOT a.gone) AS known FROM (SELECT * FROM half WHERE late) h FULL JOIN a ON a.id = h.id WHERE h.id IS NOT NULL OR NOT a.gone)
SELECT id, first AS saved_at, 'added' AS move FROM a UNION ALL SELECT id, last, 'expired' FROM a WHERE gone
UNION ALL SELECT id, first, 'added' FROM b WHERE NOT known UNION ALL SELECT id, last, 'expired' FROM b WHERE last + INTERVAL 1 HOUR < (SELECT at_ FROM mark WHERE late)""")  # fmt: skip
def stream_expiry(spark, sf_dir):
    """Results that come in two runs of a stream, the second one from the first one's checkpoint and with results that are too late: what was added and what expired."""
    folder = shared_folder(spark)
    saved = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), "user_id", F.lit("-"), F.col("event_id") % 7).alias("id"), F.col("ts").alias("saved_at"))
    too_late = saved.where("saved_at < '2024-01-02 00:00:00'").select(F.concat(F.lit("late-"), "id").alias("id"), "saved_at")
    for part in (saved.where("saved_at < '2024-01-16 00:00:00'"), saved.where("saved_at >= '2024-01-16 00:00:00'").union(too_late)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("id string, saved_at timestamp").parquet(f"{folder}/in")
        A.expire_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def stream_expire_results(spark, sf_dir):
    return A.expire_results(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "user_id")


@query(fixture.with_tables("SELECT j.doc_id, j.source FROM judgments j WHERE CAST(substr(j.source, 4) AS INT) % 3 <> 0", "judgments"))
def corpus_skip_existing(spark, sf_dir):
    docs = fixture.judgments(spark, sf_dir)
    done = docs.where(F.substring("source", 4, 9).cast("int") % 3 == 0)
    return C.skip_existing(docs, done).select("doc_id", "source")


@query(fixture.with_tables("SELECT label, count(*) AS n FROM judgments, (VALUES ('LEGAL_ARTICLE'), ('LEGAL_ARTICLE'), ('LEGAL_ARTICLE'), ('LEGAL_ARTICLE'), ('PERSON'), ('CHARGE'), ('SENTENCE'), ('SENTENCE')) AS t(label) GROUP BY label", "judgments"))
def stream_annotate(spark, sf_dir):
    """Judgments as a stream of files, annotated batch by batch; counts of all entities from what the batches wrote."""
    folder = shared_folder(spark)
    fixture.judgments(spark, sf_dir).write.parquet(f"{folder}/in")
    # a batch has a file for each core; there are two batches at least
    A.stream_annotate(A.read_judgments(spark, f"{folder}/in", files_per_batch=spark.sparkContext.defaultParallelism), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("label").agg(F.count("*").alias("n"))


@query(fixture.with_tables("SELECT source FROM judgments GROUP BY source", "judgments"))
def stream_ingest_new(spark, sf_dir):
    """Of a stream of judgments, the first of each source."""
    folder = shared_folder(spark)
    fixture.judgments(spark, sf_dir).withColumn("arrived", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(A.JUDGMENT + ", arrived timestamp").parquet(f"{folder}/in")
    A.ingest_new(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("source")


@query(_GOLD_LINES + "SELECT record_id, source, len(string_split(text, ' '))::INT AS n_words FROM annotated WHERE rid % 10 <> 0")
def corpus_strict_records(spark, sf_dir):
    """Strict reading of lines that are all good; a bad one would stop the query."""
    lines = _lines(spark, sf_dir).where("line_no % 10 != 0")
    return R.strict_records(lines).select("record_id", "source", T.count_words(F.col("text")).alias("n_words"))


@query(fixture.with_tables("SELECT 'part' AS stem, count(*) AS n, sum(length(text) + 1)::BIGINT AS chars FROM judgments", "judgments"))
def source_read_documents(spark, sf_dir):
    """All judgments written as text files, and the files read as documents. A file is one row, so more judgments make more files and not longer ones."""
    folder = shared_folder(spark)
    K.write_lines(fixture.judgments(spark, sf_dir), "text", folder, rows_per_file=5_000)
    read = R.read_documents(spark, folder).select(F.left("source", F.lit(4)).alias("stem"), F.regexp_count("text", F.lit("QUYẾT ĐỊNH:")).alias("n"), F.length("text").alias("chars"))
    return read.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query(_split_sql("SELECT split, count(*) AS n FROM rec GROUP BY split"))
def source_load_split(spark, sf_dir):
    """Splits written apart and read as one."""
    folder = shared_folder(spark)
    K.write_split(_split(spark, sf_dir), folder)
    parts = [spark.read.text(f"{folder}/split={s}").withColumn("record_id", F.get_json_object("value", "$.id")) for s in C.SPLITS]
    return R.load_split(*parts).groupBy("split").agg(F.count("*").alias("n"))


@query(fixture.with_tables("""
SELECT m.model, l.label, CASE WHEN l.label = 'DRUG' AND m.model = 'b' THEN 0.0 WHEN l.label IN ('PERSON', 'DRUG', 'DRUG_WEIGHT', 'CRIME_TIME', 'CRIME_LOC') THEN (SELECT count(*) FROM gold g WHERE g.label = l.label AND rid % 7 <> 0)::DOUBLE ELSE 0.0 END AS support
FROM (SELECT unnest(['a', 'b']) AS model) m, (SELECT unnest(['PERSON', 'DRUG', 'DRUG_WEIGHT', 'CRIME_TIME', 'CRIME_LOC', 'CHARGE', 'LEGAL_ARTICLE', 'SENTENCE']) AS label) l""", "annotated", "gold"))  # fmt: skip
def source_load_metrics(spark, sf_dir):
    """Metric tables of two models under different column names, one without a label."""
    from ..functions import lexicon as L

    counts = fixture.gold(spark, sf_dir).where("rid % 7 != 0").groupBy("label").agg(F.count("*").alias("support"))
    full = counts.select("label", F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("f1"), "support")
    other = full.where("label != 'DRUG'").withColumnsRenamed({"label": "Entity type", "precision": "Precision", "recall": "Recall", "f1": "F1", "support": "Support"})
    return R.load_metrics({"a": full, "b": other}, L.LABELS).where("label != 'overall'").select("model", "label", "support")
