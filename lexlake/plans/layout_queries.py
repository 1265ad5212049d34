"""Queries over judgments of several kinds, some of which hold no entity, no decision or nothing at all: every document has its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import entities as E
from . import fixture, pipeline
from .judgment_queries import _SUMMARY
from .registry import query

# SQL below restates what the kinds of fixture.LAYOUTS hold; it shares no rule with the operators.
_RECORDS = """
records AS (
  SELECT doc_id, idx AS record_idx, section, split_part(text, chr(10), line) AS text FROM layouts JOIN (VALUES
    (0, 1, 'noi_dung', 2), (0, 2, 'nhan_dinh', 4), (0, 3, 'quyet_dinh', 6), (0, 4, 'quyet_dinh', 7), (1, 1, 'noi_dung', 2), (1, 2, 'nhan_dinh', 4), (3, 1, 'noi_dung', 2), (3, 2, 'nhan_dinh', 4), (3, 3, 'quyet_dinh', 6),
    (4, 1, 'nhan_dinh', 2), (4, 2, 'quyet_dinh', 4), (4, 3, 'quyet_dinh', 5), (5, 1, 'noi_dung', 2), (5, 2, 'nhan_dinh', 4), (5, 3, 'quyet_dinh', 6), (5, 4, 'quyet_dinh', 7), (7, 1, 'quyet_dinh', 2)) AS r(way, idx, section, line)
  ON doc_id % 8 = way)
"""
_ENTITIES = """
named AS (SELECT doc_id, doc_id % 8 AS way, 1 + doc_id % 4 AS clause, CASE doc_id % 3 WHEN 0 THEN 'Giàng A P' WHEN 1 THEN 'Vàng Thị M' ELSE 'Hoàng Văn K' END AS person FROM layouts),
entities AS (
  SELECT doc_id, idx AS record_idx, label, replace(replace(said, '@', person), '#', clause::VARCHAR) AS text, place + behind * length(person) AS start_at, ord FROM named JOIN (VALUES
    (0, 3, 'LEGAL_ARTICLE', 'khoản # Điều 251', 10, 0, 0), (0, 3, 'LEGAL_ARTICLE', 'Điều 251', 18, 0, 1), (0, 4, 'PERSON', '@', 19, 0, 2), (0, 4, 'CHARGE', 'Mua bán trái phép chất ma túy', 29, 1, 3), (0, 4, 'SENTENCE', '07 năm tù', 68, 1, 4),
    (4, 2, 'LEGAL_ARTICLE', 'khoản # Điều 251', 10, 0, 0), (4, 2, 'LEGAL_ARTICLE', 'Điều 251', 18, 0, 1), (4, 3, 'PERSON', '@', 19, 0, 2), (4, 3, 'CHARGE', 'Mua bán trái phép chất ma túy', 29, 1, 3), (4, 3, 'SENTENCE', '08 năm tù', 68, 1, 4),
    (4, 3, 'PERSON', 'Sùng A D', 95, 1, 5), (4, 3, 'CHARGE', 'Tàng trữ trái phép chất ma túy', 113, 1, 6), (4, 3, 'SENTENCE', '02 năm 06 tháng tù', 153, 1, 7), (4, 3, 'SENTENCE', '06 tháng tù', 160, 1, 8),
    (5, 3, 'LEGAL_ARTICLE', 'khoản # Điều 251', 10, 0, 0), (5, 3, 'LEGAL_ARTICLE', 'Điều 251', 18, 0, 1), (5, 4, 'SENTENCE', 'Phạt tiền bị cáo @ 5.000.000 đồng', 3, 0, 2), (5, 4, 'PERSON', '@', 20, 0, 3),
    (7, 1, 'PERSON', '@', 19, 0, 0), (7, 1, 'CHARGE', 'Vận chuyển trái phép chất ma túy', 29, 1, 1), (7, 1, 'SENTENCE', '03 năm tù', 79, 1, 2)) AS e(way, idx, label, said, place, behind, ord)
  USING (way))
"""
_LINES = _SUMMARY.replace("FROM judgments j", "FROM layouts j")
_LABELS = "unnest([" + ", ".join(f"'{label}'" for label in L.LABELS) + "])"


def _sql(body: str, *parts: str) -> str:
    return fixture.with_tables("", "layouts").rstrip() + "".join(f", {p.strip()}" for p in parts) + "\n" + body


def _made(spark, sf_dir, **how) -> tuple:
    docs = fixture.layouts(spark, sf_dir)
    return docs, pipeline.analyse(docs, **how)


@query(_sql("""
SELECT doc_id, 'quyet_dinh' AS section, record_idx, label, text, start_at, (start_at + length(text))::INT AS end_at, ord FROM entities""", _ENTITIES))  # fmt: skip
def layout_entities(spark, sf_dir):
    return _made(spark, sf_dir)[1].entities.select("doc_id", "section", "record_idx", "label", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "ord")


@query(_sql("""
SELECT a.doc_id, kind AS rel_type, a.text AS from_text, b.text AS to_text, a.ord AS from_ord, b.ord AS to_ord FROM named
JOIN (VALUES (0, 2, 4, 'PERSON_HAS_SENTENCE'), (0, 2, 3, 'PERSON_HAS_CHARGE'), (4, 2, 4, 'PERSON_HAS_SENTENCE'), (4, 2, 3, 'PERSON_HAS_CHARGE'), (4, 5, 7, 'PERSON_HAS_SENTENCE'), (4, 5, 6, 'PERSON_HAS_CHARGE'),
  (7, 0, 2, 'PERSON_HAS_SENTENCE'), (7, 0, 1, 'PERSON_HAS_CHARGE')) AS r(way, a, b, kind) USING (way)
JOIN entities a ON a.doc_id = named.doc_id AND a.ord = r.a JOIN entities b ON b.doc_id = named.doc_id AND b.ord = r.b""", _ENTITIES))  # fmt: skip
def layout_relations(spark, sf_dir):
    """Each of two defendants goes with the sentence and the charge that follow; a fine before its person goes with none."""
    return _made(spark, sf_dir)[1].relations


@query(_sql("SELECT j.doc_id, " + ", ".join(f"count(*) FILTER (label = '{label}') AS {label.lower()}" for label in L.LABELS) + ", count(label) AS n_entities FROM layouts j LEFT JOIN entities USING (doc_id) GROUP BY j.doc_id", _ENTITIES))
def layout_entity_counts(spark, sf_dir):
    docs, made = _made(spark, sf_dir)
    return E.entity_counts(made.entities, docs)


@query(_sql(f"""
SELECT j.doc_id, l.label, coalesce(string_agg(e.text, '|' ORDER BY ord), '') AS items, count(e.text) AS n FROM layouts j CROSS JOIN (SELECT {_LABELS} AS label) l
LEFT JOIN entities e ON e.doc_id = j.doc_id AND e.label = l.label GROUP BY ALL""", _ENTITIES))  # fmt: skip
def layout_entities_by_label(spark, sf_dir):
    """All eight labels of every document, empty ones too."""
    docs, made = _made(spark, sf_dir)
    maps = E.entities_by_label(made.entities, docs).select("doc_id", F.explode("entities").alias("label", "items"))
    return maps.select("doc_id", "label", F.array_join("items.text", "|").alias("items"), F.size("items").cast("long").alias("n"))


@query(_sql("""
SELECT j.doc_id, coalesce(string_agg(r.text, chr(10) || chr(10) ORDER BY record_idx) FILTER (section = 'noi_dung'), '') AS noi_dung, coalesce(string_agg(r.text, chr(10) || chr(10) ORDER BY record_idx) FILTER (section = 'nhan_dinh'), '') AS nhan_dinh,
  coalesce(string_agg(r.text, chr(10) || chr(10) ORDER BY record_idx) FILTER (section = 'quyet_dinh'), '') AS quyet_dinh FROM layouts j LEFT JOIN records r USING (doc_id) GROUP BY j.doc_id""", _RECORDS))  # fmt: skip
def layout_section_texts(spark, sf_dir):
    docs, made = _made(spark, sf_dir)
    return E.sections_text(made.records, docs)


@query(_sql("SELECT doc_id, place, label, line FROM summary", _ENTITIES, _LINES))
def layout_summary(spark, sf_dir):
    """Lines for all labels of every document; those without an entity say so."""
    docs, made = _made(spark, sf_dir)
    return E.summary_lines(made.entities, docs)


@query(_sql("""
, passages AS (SELECT r.doc_id, r.record_idx, chr(10) || '[QUYẾT ĐỊNH]' || chr(10) || 'Thực thể: ' || string_agg('[' || e.label || ': ' || e.text || ']', '; ' ORDER BY e.start_at, length(e.text)) || chr(10) || any_value(r.text) AS p
  FROM records r JOIN entities e ON e.doc_id = r.doc_id AND e.record_idx = r.record_idx GROUP BY r.doc_id, r.record_idx)
SELECT j.doc_id, md5('KẾT QUẢ NHẬN DIỆN THỰC THỂ BẢN ÁN HÌNH SỰ MA TÚY' || chr(10) || repeat('=', 70) || chr(10) || 'Tên file: ' || j.source || chr(10) || 'Model: ' || chr(10) || 'Thời gian xử lý:  ms' || chr(10) || chr(10)
  || 'I. TÓM TẮT THỰC THỂ' || chr(10) || repeat('-', 70) || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY place) FROM summary s WHERE s.doc_id = j.doc_id) || chr(10) || chr(10) || 'II. VĂN BẢN ĐƯỢC GÁN NHÃN' || chr(10) || repeat('-', 70)
  || coalesce(chr(10) || (SELECT string_agg(p, chr(10) ORDER BY record_idx) FROM passages q WHERE q.doc_id = j.doc_id), '')) AS report_md5 FROM layouts j""", _ENTITIES, _RECORDS, _LINES))  # fmt: skip
def layout_report(spark, sf_dir):
    """A report for every document."""
    docs, made = _made(spark, sf_dir, keep=fixture.stored)
    return E.report_text(made.records, made.entities, docs).select("doc_id", F.md5("report").alias("report_md5"))


@query(_sql("""
SELECT j.doc_id, md5('<!doctype html><html lang="vi"><head><meta charset="utf-8"/><title>' || j.source || '</title></head><body><table>'
  || (SELECT string_agg('<tr><td>' || label || '</td><td>' || line || '</td></tr>', '' ORDER BY place) FROM summary s WHERE s.doc_id = j.doc_id) || '</table><div>'
  || coalesce((SELECT string_agg(text, '<br/><br/>' ORDER BY record_idx) FROM records r WHERE r.doc_id = j.doc_id AND EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = r.doc_id AND e.record_idx = r.record_idx)), '')
  || '</div></body></html>') AS html_md5 FROM layouts j""", _ENTITIES, _RECORDS, _LINES))  # fmt: skip
def layout_report_html(spark, sf_dir):
    docs, made = _made(spark, sf_dir, keep=fixture.stored)
    return E.report_html(made.entities, made.records, docs).select("doc_id", F.md5("html").alias("html_md5"))


@query(_sql("""
SELECT j.doc_id, 8 AS labels, (SELECT count(*) FROM entities e WHERE e.doc_id = j.doc_id) AS n_entities, CASE doc_id % 8 WHEN 0 THEN 2 WHEN 4 THEN 4 WHEN 7 THEN 2 ELSE 0 END AS n_relations,
  (SELECT count(*) FROM records r WHERE r.doc_id = j.doc_id AND section = 'quyet_dinh') > 0 AS has_decision FROM layouts j""", _ENTITIES, _RECORDS))  # fmt: skip
def layout_result_json(spark, sf_dir):
    """Results of every document as JSON, read again."""
    _, made = _made(spark, sf_dir, keep=fixture.stored)
    kept = "quyet_dinh string, n_entities long, entities map<string, array<struct<text:string>>>, relations array<struct<rel_type:string>>"
    read = E.result_json(made.results).select("doc_id", F.from_json("json", kept).alias("r"))
    return read.select("doc_id", F.size("r.entities").alias("labels"), "r.n_entities", F.size("r.relations").alias("n_relations"), (F.col("r.quyet_dinh") != "").alias("has_decision"))
