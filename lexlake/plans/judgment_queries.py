"""Queries over the judgment table: sections, records, entities, relations, views of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gloss
from ..functions import predicates as P
from ..operators import entities as E
from ..operators import segment as S
from ..operators import tagger
from . import cases, fixture, pipeline
from .registry import query

# SQL below restates what the template of the judgments holds; it shares no rule with the operators.
_RECORDS = """
records AS (
  SELECT doc_id, source, 1 AS record_idx, 'noi_dung' AS section, split_part(text, chr(10), 2) AS text FROM judgments
  UNION ALL SELECT doc_id, source, 2, 'noi_dung', split_part(text, chr(10), 4) FROM judgments
  UNION ALL SELECT doc_id, source, 3, 'nhan_dinh', split_part(text, chr(10), 9) FROM judgments
  UNION ALL SELECT doc_id, source, 4, 'quyet_dinh', split_part(text, chr(10), 12) FROM judgments
  UNION ALL SELECT doc_id, source, 5, 'quyet_dinh', split_part(text, chr(10), 13) FROM judgments)
"""
_ENTITIES = """
slots AS (
  SELECT doc_id, text AS r4, (SELECT 1) AS one, doc_id % 4 AS person_no, 1 + doc_id % 4 AS clause, 249 + doc_id % 3 AS article, 1 + doc_id % 9 AS years, 1 + doc_id % 8 AS months FROM judgments),
named AS (
  SELECT *, CASE person_no WHEN 0 THEN 'Mùa A T' WHEN 1 THEN 'Bùi Phúc T' WHEN 2 THEN 'Trần Thanh L' ELSE 'Lò Văn H' END AS person FROM slots),
entities AS (
  SELECT doc_id, 4 AS record_idx, 'LEGAL_ARTICLE' AS label, 'điểm c khoản ' || clause || ' Điều ' || article AS text, 10 AS start_at, 0 AS ord FROM named
  UNION ALL SELECT doc_id, 4, 'LEGAL_ARTICLE', 'khoản ' || clause || ' Điều ' || article, 17, 1 FROM named
  UNION ALL SELECT doc_id, 4, 'LEGAL_ARTICLE', 'Điều ' || article, 25, 2 FROM named
  UNION ALL SELECT doc_id, 4, 'LEGAL_ARTICLE', 'Điều 38', 35, 3 FROM named
  UNION ALL SELECT doc_id, 5, 'PERSON', person, 19, 4 FROM named
  UNION ALL SELECT doc_id, 5, 'CHARGE', 'Tàng trữ trái phép chất ma túy', 29 + length(person), 5 FROM named
  UNION ALL SELECT doc_id, 5, 'SENTENCE', '0' || years || ' năm 0' || months || ' tháng tù', 69 + length(person), 6 FROM named
  UNION ALL SELECT doc_id, 5, 'SENTENCE', '0' || months || ' tháng tù', 76 + length(person), 7 FROM named)
"""


def _sql(body: str, *parts: str) -> str:
    return fixture.with_tables("", "judgments").rstrip() + "".join(f", {p.strip()}" for p in parts) + "\n" + body


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_records(fixture.judgments(spark, sf_dir))


def _stored_decisions(records: DataFrame) -> DataFrame:
    """Records of decisions, the only ones with entities, computed once."""
    return fixture.stored(records.where("section = 'quyet_dinh'").select("doc_id", "record_idx", "section", "text"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.ordered_entities(_stored_decisions(_records(spark, sf_dir)), by_text=True)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _ordered(), for what shows no record_idx: rules find entities in decisions only, and within these records have the same order if others aren't made."""
    return pipeline.ordered_entities(_stored_decisions(S.build_records(fixture.judgments(spark, sf_dir), sections=("quyet_dinh",))), by_text=True)


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of decisions and their entities, each computed once."""
    records = _stored_decisions(_records(spark, sf_dir))
    return records, fixture.stored(pipeline.ordered_entities(records, by_text=True).drop("context"))


@query(_sql("""
SELECT doc_id, 0 AS content_pos, strpos(text, 'NHẬN ĐỊNH CỦA TÒA ÁN') - 1 AS reasoning_pos, strpos(text, 'QUYẾT ĐỊNH:') - 2 AS decision_pos FROM judgments"""))  # fmt: skip
def judgment_sections(spark, sf_dir):
    return S.locate_sections(fixture.judgments(spark, sf_dir)).select("doc_id", "content_pos", "reasoning_pos", "decision_pos")


@query(_sql("""
SELECT doc_id, length(regexp_extract(text, '^(.*)NHẬN ĐỊNH CỦA', 1, 's')) AS content_chars, strpos(text, 'QUYẾT ĐỊNH:') - 1 - strpos(text, 'NHẬN ĐỊNH CỦA') AS reasoning_chars, length(text) - strpos(text, 'QUYẾT ĐỊNH:') + 2 AS decision_chars FROM judgments"""))  # fmt: skip
def judgment_slices(spark, sf_dir):
    cut = S.slice_sections(S.locate_sections(fixture.judgments(spark, sf_dir)))
    return cut.select("doc_id", *[F.length(f"{n}_text").alias(f"{n}_chars") for n in ("content", "reasoning", "decision")])


@query(_sql("SELECT doc_id, source || '::' || lpad(record_idx::VARCHAR, 4, '0') AS record_id, source, record_idx, section, text, CASE WHEN section = 'quyet_dinh' THEN 'PERSON' ELSE 'DRUG' END AS first_target FROM records", _RECORDS))
def judgment_records(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", "record_id", "source", "record_idx", "section", "text", F.get("ner_targets", F.lit(0)).alias("first_target"))


@query(_sql("SELECT doc_id, CASE WHEN record_idx > 2 THEN record_idx - 1 ELSE record_idx END AS record_idx, section FROM records WHERE record_idx <> 2", _RECORDS))
def judgment_records_filtered(spark, sf_dir):
    """The filtered mode drops the laboratory result, which hints at no act."""
    return S.build_records(fixture.judgments(spark, sf_dir), "filtered").select("doc_id", "record_idx", "section")


@query(_sql("""
SELECT doc_id, 'quyet_dinh' AS section, record_idx, label, text, start_at, (start_at + length(text))::BIGINT AS end_at, ord FROM entities""", _ENTITIES))  # fmt: skip
def judgment_entities(spark, sf_dir):
    return _ordered(spark, sf_dir).select("doc_id", "section", "record_idx", "label", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "ord")


@query(_sql("SELECT text AS article, count(*) AS n FROM entities WHERE label = 'LEGAL_ARTICLE' AND text LIKE 'Điều%' GROUP BY text", _ENTITIES))
def judgment_article_counts(spark, sf_dir):
    """Counts need no record numbers, one section and one label: nothing else is segmented or searched."""
    found = E.rule_entities(S.build_records(fixture.judgments(spark, sf_dir), sections=("quyet_dinh",)), labels=("LEGAL_ARTICLE",))
    return found.where(F.col("text").startswith("Điều")).groupBy(F.col("text").alias("article")).agg(F.count("*").alias("n"))


@query(_sql("SELECT doc_id, label, text FROM entities WHERE ord IN (0, 3, 4, 5, 6)", _ENTITIES))
def judgment_longest_entities(spark, sf_dir):
    return E.longest_only(_decided(spark, sf_dir)).select("doc_id", "label", "text")


@query(_sql("""
SELECT a.doc_id, 'PERSON_HAS_SENTENCE' AS rel_type, a.text AS from_text, b.text AS to_text, a.ord AS from_ord, b.ord AS to_ord FROM entities a JOIN entities b USING (doc_id) WHERE a.ord = 4 AND b.ord = 6
UNION ALL SELECT a.doc_id, 'PERSON_HAS_CHARGE', a.text, b.text, a.ord, b.ord FROM entities a JOIN entities b USING (doc_id) WHERE a.ord = 4 AND b.ord = 5""", _ENTITIES))  # fmt: skip
def judgment_relations(spark, sf_dir):
    return E.relations(_decided(spark, sf_dir))


@query(fixture.with_tables("""
SELECT rid AS doc_id, 'DRUG_HAS_WEIGHT' AS rel_type, drug AS from_text, weight AS to_text, 3 AS from_ord, 4 AS to_ord FROM annotated""", "annotated"))  # fmt: skip
def judgment_weight_relations(spark, sf_dir):
    """Relations among gold entities of a content section."""
    gold = fixture.gold(spark, sf_dir).select(
        F.col("rid").alias("doc_id"), F.lit("noi_dung").alias("section"), F.lit(1).alias("record_idx"), "label", F.col("word").alias("text"), "start", "end",
        F.lit(1.0).alias("score"), F.lit(False).alias("rule_based"), F.lit(None).cast("string").alias("rule_name"))
    return E.relations(E.order_entities(gold))


@query(fixture.with_tables("""
SELECT rid, label, CASE WHEN label = 'DRUG' AND word = 'cần sa' THEN 'Cần sa' ELSE word END AS text FROM gold WHERE label <> 'CRIME_LOC' OR word LIKE '%đường%'""", "gold").replace("gold AS", f"annotated AS ({fixture.ANNOTATED}), gold AS"))  # fmt: skip
def judgment_clean_entities(spark, sf_dir):
    """Gold entities through the cleaning of every label."""
    words = fixture.gold(spark, sf_dir).join(fixture.annotated(spark, sf_dir).select("rid", F.col("text").alias("context")), "rid")
    return E.clean_entities(words.select("rid", "label", F.concat(F.lit(' "'), "word", F.lit('," ')).alias("text"), "context", F.lit(0.0).alias("score"))).select("rid", "label", "text")


@query(_sql("SELECT doc_id, 1::BIGINT AS person, 0::BIGINT AS drug, 0::BIGINT AS crime_time, 1::BIGINT AS charge, 4::BIGINT AS legal_article, 2::BIGINT AS sentence, 8::BIGINT AS n_entities FROM judgments"))
def judgment_entity_counts(spark, sf_dir):
    return E.entity_counts(_decided(spark, sf_dir)).select("doc_id", "person", "drug", "crime_time", "charge", "legal_article", "sentence", "n_entities")


@query(_sql("""
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY record_idx) FILTER (section = 'noi_dung') AS noi_dung, string_agg(text, chr(10) || chr(10) ORDER BY record_idx) FILTER (section = 'nhan_dinh') AS nhan_dinh,
  string_agg(text, chr(10) || chr(10) ORDER BY record_idx) FILTER (section = 'quyet_dinh') AS quyet_dinh FROM records GROUP BY doc_id""", _RECORDS))  # fmt: skip
def judgment_section_texts(spark, sf_dir):
    return E.sections_text(_records(spark, sf_dir))


@query(_sql("""
, t AS (SELECT doc_id, section, string_agg(text, chr(10) || chr(10) ORDER BY record_idx) AS body, min(record_idx) AS k FROM records GROUP BY doc_id, section)
SELECT doc_id, md5(string_agg(CASE section WHEN 'noi_dung' THEN 'NỘI DUNG VỤ ÁN' WHEN 'nhan_dinh' THEN 'NHẬN ĐỊNH CỦA TÒA ÁN' ELSE 'QUYẾT ĐỊNH' END || chr(10) || body, chr(10) || chr(10) ORDER BY k)) AS text_md5 FROM t GROUP BY doc_id""", _RECORDS))  # fmt: skip
def judgment_filtered_text(spark, sf_dir):
    return E.filtered_text(E.sections_text(_records(spark, sf_dir))).select("doc_id", F.md5("text").alias("text_md5"))


@query(_sql("SELECT doc_id, label, string_agg(text, '|' ORDER BY ord) AS items, count(*) AS n FROM entities GROUP BY doc_id, label", _ENTITIES))
def judgment_entities_by_label(spark, sf_dir):
    maps = E.entities_by_label(_decided(spark, sf_dir)).select("doc_id", F.explode("entities").alias("label", "items")).where(F.size("items") > 0)
    return maps.select("doc_id", "label", F.array_join("items.text", "|").alias("items"), F.size("items").cast("long").alias("n"))


@query(_sql("SELECT doc_id, record_idx, string_agg(start_at || '-' || (start_at + length(entities.text)), ',' ORDER BY start_at, length(entities.text)) AS spans FROM entities GROUP BY doc_id, record_idx", _ENTITIES))
def judgment_highlighted(spark, sf_dir):
    marked = E.highlighted(*_marked(spark, sf_dir))
    return marked.select("doc_id", "record_idx", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


@query(_sql("""
SELECT e.doc_id, e.record_idx, e.text AS word, (start_at + CASE WHEN e.record_idx = 5 THEN 2 + length(r.text) ELSE 0 END)::BIGINT AS start_at FROM entities e JOIN records r ON r.doc_id = e.doc_id AND r.record_idx = 4""", _ENTITIES, _RECORDS))  # fmt: skip
def judgment_flat_offsets(spark, sf_dir):
    marked = E.highlighted(*_marked(spark, sf_dir))
    return E.flatten_offsets(marked).select("doc_id", "record_idx", "word", F.col("start").alias("start_at"))


_TITLES = "CASE label WHEN 'PERSON' THEN 'Tên bị cáo' WHEN 'CHARGE' THEN 'Tội danh' WHEN 'LEGAL_ARTICLE' THEN 'Điều luật' WHEN 'SENTENCE' THEN 'Hình phạt' WHEN 'DRUG' THEN 'Loại ma túy' WHEN 'DRUG_WEIGHT' THEN 'Khối lượng ma túy' WHEN 'CRIME_TIME' THEN 'Thời gian phạm tội' ELSE 'Địa điểm phạm tội' END"
_SUMMARY = f"""
spine AS (SELECT label, n - 1 AS place FROM unnest(['PERSON', 'CHARGE', 'LEGAL_ARTICLE', 'SENTENCE', 'DRUG', 'DRUG_WEIGHT', 'CRIME_TIME', 'CRIME_LOC']) WITH ORDINALITY AS u(label, n)),
summary AS (
  SELECT j.doc_id, s.place, s.label, {_TITLES.replace('label', 's.label')} || ': ' || coalesce((SELECT string_agg(text, '; ' ORDER BY ord) FROM entities e WHERE e.doc_id = j.doc_id AND e.label = s.label), 'Không tìm thấy') AS line
  FROM judgments j CROSS JOIN spine s)
"""


@query(_sql("SELECT doc_id, place, label, line FROM summary", _ENTITIES, _SUMMARY))
def judgment_summary(spark, sf_dir):
    return E.summary_lines(_decided(spark, sf_dir))


@query(_sql("""
, passages AS (SELECT r.doc_id, r.record_idx, chr(10) || '[QUYẾT ĐỊNH]' || chr(10) || 'Thực thể: ' || string_agg('[' || e.label || ': ' || e.text || ']', '; ' ORDER BY e.start_at, length(e.text)) || chr(10) || any_value(r.text) AS p
  FROM records r JOIN entities e ON e.doc_id = r.doc_id AND e.record_idx = r.record_idx GROUP BY r.doc_id, r.record_idx)
SELECT j.doc_id, md5('KẾT QUẢ NHẬN DIỆN THỰC THỂ BẢN ÁN HÌNH SỰ MA TÚY' || chr(10) || repeat('=', 70) || chr(10) || 'Tên file: ' || j.source || chr(10) || 'Model: rules' || chr(10) || 'Thời gian xử lý: ' || j.doc_id % 100 || ' ms' || chr(10) || chr(10) || 'I. TÓM TẮT THỰC THỂ' || chr(10) || repeat('-', 70) || chr(10)
  || (SELECT string_agg(line, chr(10) ORDER BY place) FROM summary s WHERE s.doc_id = j.doc_id) || chr(10) || chr(10) || 'II. VĂN BẢN ĐƯỢC GÁN NHÃN' || chr(10) || repeat('-', 70) || chr(10)
  || (SELECT string_agg(p, chr(10) ORDER BY record_idx) FROM passages q WHERE q.doc_id = j.doc_id)) AS report_md5 FROM judgments j""", _ENTITIES, _RECORDS, _SUMMARY))  # fmt: skip
def judgment_report(spark, sf_dir):
    docs = fixture.judgments(spark, sf_dir).withColumns({"model": F.lit("rules"), "elapsed_ms": F.col("doc_id") % 100})
    return E.report_text(*_marked(spark, sf_dir), docs).select("doc_id", F.md5("report").alias("report_md5"))


@query(_sql("""
SELECT j.doc_id, md5('<!doctype html><html lang="vi"><head><meta charset="utf-8"/><title>' || j.source || '</title></head><body><table>'
  || (SELECT string_agg('<tr><td>' || label || '</td><td>' || line || '</td></tr>', '' ORDER BY place) FROM summary s WHERE s.doc_id = j.doc_id) || '</table><div>'
  || (SELECT string_agg(text, '<br/><br/>' ORDER BY record_idx) FROM records r WHERE r.doc_id = j.doc_id AND record_idx >= 4) || '</div></body></html>') AS html_md5 FROM judgments j""", _ENTITIES, _RECORDS, _SUMMARY))  # fmt: skip
def judgment_report_html(spark, sf_dir):
    docs = fixture.judgments(spark, sf_dir)
    records, ordered = _marked(spark, sf_dir)
    return E.report_html(ordered, records, docs).select("doc_id", F.md5("html").alias("html_md5"))


@query(_sql("SELECT doc_id, 8::BIGINT AS n_entities, 2::BIGINT AS n_relations, length((SELECT text FROM records r WHERE r.doc_id = j.doc_id AND record_idx = 3)) AS reasoning_chars FROM judgments j", _RECORDS))
def judgment_result_json(spark, sf_dir):
    """Nested results written as JSON and read again."""
    made = pipeline.analyse(fixture.judgments(spark, sf_dir), keep=fixture.stored)
    read = E.result_json(made.results).select("doc_id", F.from_json("json", "nhan_dinh string, n_entities long, relations array<struct<rel_type:string>>").alias("r"))
    return read.select("doc_id", "r.n_entities", F.size("r.relations").cast("long").alias("n_relations"), F.length("r.nhan_dinh").cast("long").alias("reasoning_chars"))


@query(_sql("""
SELECT label, true AS rule_based, count(*) AS n FROM entities GROUP BY label
UNION ALL SELECT 'DRUG', false, count(*) FROM judgments WHERE regexp_matches(split_part(text, chr(10), 2), 'Methamphetamine|Heroine|Ketamine|MDMA')""", _ENTITIES))  # fmt: skip
def judgment_model_and_rules(spark, sf_dir):
    """The whole pipeline with a tagger beside the rules; the tagger's charges belong to no section that it is asked about."""

    def load():
        import re

        found = re.compile("Methamphetamine|Heroine|Ketamine|MDMA")
        return lambda text: [{"label": kind, "start": m.start(), "end": m.end(), "text": m[0], "score": 0.9} for m in found.finditer(text) for kind in ("DRUG", "CHARGE")]

    made = pipeline.analyse(fixture.judgments(spark, sf_dir), tagger.register_tagger(load))
    return made.entities.groupBy("label", "rule_based").agg(F.count("*").alias("n"))


@query(_sql("SELECT doc_id, label, text AS word, lower(text) AS word_key, ord FROM entities", _ENTITIES))
def judgment_best_score(spark, sf_dir):
    return E.best_score(_decided(spark, sf_dir)).select("doc_id", "label", "word", "word_key", "ord")


@query(_sql("SELECT doc_id, label, text, length(text) AS length, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ord) AS rank FROM entities", _ENTITIES))
def judgment_longest_first(spark, sf_dir):
    return E.longest_first(_decided(spark, sf_dir))


@query(_sql("SELECT doc_id, string_agg(text, '|' ORDER BY ord) AS words FROM entities WHERE ord < 3 GROUP BY doc_id", _ENTITIES))
def judgment_first_words(spark, sf_dir):
    return E.first_words(_decided(spark, sf_dir), "LEGAL_ARTICLE", 3).select("doc_id", F.array_join("words", "|").alias("words"))


@query(_sql("SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM entities", _ENTITIES))
def judgment_display_rows(spark, sf_dir):
    """A display without doubles: every entity is given twice."""
    twice = _decided(spark, sf_dir).withColumn("given", F.explode(F.array(F.lit(1), F.lit(2))))
    return E.distinct_rows(twice).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(_sql("""
SELECT section, record_idx, count(*) AS n, count(*) AS words_ok, sum((record_idx IN (1, 2))::INT)::BIGINT AS drug, sum((record_idx = 1)::INT)::BIGINT AS weight, sum((record_idx IN (1, 3, 5))::INT)::BIGINT AS action,
  sum((record_idx = 1)::INT)::BIGINT AS time, sum((record_idx IN (1, 3))::INT)::BIGINT AS place, sum((record_idx = 2)::INT)::BIGINT AS noise, sum((record_idx = 1)::INT)::BIGINT AS strict,
  sum((record_idx = 1)::INT)::BIGINT AS content, sum((record_idx IN (1, 3))::INT)::BIGINT AS fact, 0::BIGINT AS title FROM records GROUP BY section, record_idx""", _RECORDS))  # fmt: skip
def judgment_predicates(spark, sf_dir):
    text, made = F.col("text"), F.col("signals")
    tests = {
        "words_ok": F.size(F.split(text, " ")) >= 4, "drug": made["drug"], "weight": made["weight"], "action": made["action"], "time": made["time"], "place": made["place"], "noise": P.is_noise(text, made),
        "strict": P.is_strict_crime(text, made), "content": P.is_relevant_content(text, made), "fact": P.is_reasoning_fact(text, made), "title": P.is_section_title(text),
    }
    # judgments repeat their formulas: each text is tested once, whatever the number of records that it is
    each = P.with_signals(_records(spark, sf_dir).groupBy("section", "record_idx", "text").agg(F.count("*").alias("n")))
    zero = F.lit(0).cast("long")
    return each.groupBy("section", "record_idx").agg(F.sum("n").alias("n"), *[F.sum(F.when(c, F.col("n")).otherwise(zero)).alias(k) for k, c in tests.items()])


_UNITS = [(name, text, holds) for name, (yes, no) in cases.UNITS.items() for texts, holds in ((yes, True), (no, False)) for text in texts]
_UNITS_SQL = ", ".join(f"({k}, '{name}', {str(holds).lower()})" for k, (name, _, holds) in enumerate(_UNITS))


@query(f"SELECT name, holds, count(*) AS n FROM orders JOIN (VALUES {_UNITS_SQL}) AS u(k, name, holds) ON u.k = o_orderkey % {len(_UNITS)} GROUP BY name, holds")
def judgment_unit_rules(spark, sf_dir):
    """Every predicate on units where it is known to hold or to fail, dealt out over all orders."""
    texts = F.element_at(F.array(*[F.lit(t) for _, t, _ in _UNITS]), F.col("k") + 1)
    names = F.element_at(F.array(*[F.lit(n) for n, _, _ in _UNITS]), F.col("k") + 1)
    units = fixture.orders(spark, sf_dir).select((F.col("o_orderkey") % len(_UNITS)).cast("int").alias("k")).select(names.alias("name"), texts.alias("text"))
    holds = F.lit(None).cast("boolean")
    for name in cases.UNITS:
        test = (lambda t: P.relevant_content_para(t, "filtered")) if name == "relevant_content_para" else getattr(P, name)
        holds = F.when(F.col("name") == name, test(F.col("text"))).otherwise(holds)
    return units.groupBy("name", holds.alias("holds")).agg(F.count("*").alias("n"))


_CASES_SQL = ", ".join(f"({k}, {cases.sql_text('PERSON' if label == 'DEFENDANT' else label)}, {cases.sql_text(clean)})" for k, (label, _, _, clean) in enumerate(cases.ENTITIES))


@query(f"SELECT o_orderkey AS doc_id, label, clean AS text FROM orders JOIN (VALUES {_CASES_SQL}) AS c(k, label, clean) ON c.k = o_orderkey % {len(cases.ENTITIES)} WHERE clean IS NOT NULL")
def judgment_entity_rules(spark, sf_dir):
    """Cleaning of entities that pass and fail their labels' rules, dealt out over all orders."""
    each = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("label", "text", "context"), case[:3], strict=True)]) for case in cases.ENTITIES])
    dealt = fixture.orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.element_at(each, (F.col("o_orderkey") % len(cases.ENTITIES) + 1).cast("int")).alias("c"))
    return E.clean_entities(dealt.select("doc_id", "c.*", F.lit(1.0).alias("score"))).select("doc_id", "label", "text")


_GLOSS = ", ".join(f"('{label}', {n}, '{key}', '{text.replace(chr(39), chr(39) * 2)}')" for n, (label, keys, text) in enumerate(gloss.GLOSS) for key in keys)
_GLOSS_DEFAULT = "CASE e.label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gloss.DEFAULTS.items()) + " ELSE '' END"


@query(_sql(f"""
, gloss AS (SELECT * FROM (VALUES {_GLOSS}) AS g(label, priority, key, description))
SELECT e.doc_id, e.ord, e.label, coalesce((SELECT arg_min(g.description, g.priority) FROM gloss g WHERE g.label = e.label AND contains(lower(e.text), g.key)), {_GLOSS_DEFAULT}) AS description FROM entities e""", _ENTITIES))  # fmt: skip
def judgment_gloss(spark, sf_dir):
    return _decided(spark, sf_dir).select("doc_id", "ord", "label", gloss.describe(F.col("label"), F.col("text")).alias("description"))


@query(_sql("""
SELECT doc_id, 'noi_dung' AS section, 'positive' AS polarity, 0 AS idx, split_part(text, chr(10), 2) AS text FROM judgments
UNION ALL SELECT doc_id, 'nhan_dinh', 'positive', 0, split_part(text, chr(10), 9) FROM judgments
UNION ALL SELECT doc_id, 'negative', 'negative', 0, split_part(text, chr(10), 4) FROM judgments
UNION ALL SELECT doc_id, 'negative', 'negative', 1, split_part(text, chr(10), 7) FROM judgments
UNION ALL SELECT doc_id, 'quyet_dinh', 'positive', 0, split_part(text, chr(10), 12) FROM judgments
UNION ALL SELECT doc_id, 'quyet_dinh', 'positive', 1, split_part(text, chr(10), 13) FROM judgments"""))  # fmt: skip
def judgment_training_records(spark, sf_dir):
    return S.build_training_records(fixture.judgments(spark, sf_dir)).select("doc_id", "section", "polarity", "idx", "text")


@query(_sql("""
SELECT doc_id, 'noi_dung' AS section, 'positive' AS polarity, 1 AS para_idx, 1 AS record_idx, split_part(text, chr(10), 2) AS text FROM judgments
UNION ALL SELECT doc_id, 'noi_dung', 'positive', 3, 2, split_part(text, chr(10), 4) FROM judgments
UNION ALL SELECT doc_id, 'nhan_dinh', 'positive', 6, 3, split_part(text, chr(10), 7) FROM judgments
UNION ALL SELECT doc_id, 'nhan_dinh', 'positive', 8, 4, split_part(text, chr(10), 9) FROM judgments
UNION ALL SELECT doc_id, 'quyet_dinh', 'positive', 11, 5, split_part(text, chr(10), 12) FROM judgments
UNION ALL SELECT doc_id, 'quyet_dinh', 'positive', 12, 6, split_part(text, chr(10), 13) FROM judgments
UNION ALL SELECT doc_id, 'quyet_dinh', 'positive', 13, 7, split_part(text, chr(10), 14) FROM judgments"""))  # fmt: skip
def judgment_paragraph_records(spark, sf_dir):
    """Lines of judgments as the paragraphs of annotated documents."""
    paras = fixture.judgments(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("para_idx", "text")).withColumn("style", F.lit("Normal"))
    return S.paragraph_records(paras).drop("source")
