"""Queries over the texts of documents: normalisation, tokens, units, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import corpus as C
from ..operators import segment as S
from ..operators import spans as X
from .registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query("SELECT doc_id, md5(upper(strip_accents(replace(replace(replace(text, 'đ', 'd'), 'Đ', 'D'), 'ß', 'ẞ')))) AS folded FROM documents")
def text_fold_upper(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.fold_upper(F.col("text"))).alias("folded"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words FROM documents")
def text_collapse(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("collapsed"), T.count_words(F.col("text")).cast("long").alias("n_words"))


@query(r"""
SELECT doc_id, md5(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g')) AS predict,
  md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS annotated
FROM documents""")
def text_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("predict"), F.md5(T.normalize(F.col("text"), "annotated")).alias("annotated"))


@query(r"""
WITH lines AS (SELECT doc_id, regexp_replace(x, '[ \t]+', ' ', 'g') AS line, n FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, n))
SELECT doc_id, md5(trim(regexp_replace(string_agg(rtrim(line), chr(10) ORDER BY n), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS cleaned
FROM lines WHERE NOT regexp_full_match(trim(line), '\d{1,3}|[-_\s]{3,}') GROUP BY doc_id""")
def text_clean_raw(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_raw(F.col("text"))).alias("cleaned"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s,.\-/]', '', 'g'), '\s+', ' ', 'g'))) AS word, md5(trim(regexp_replace(lower(replace(text, chr(34), '')), '\s+', ' ', 'g'))) AS key FROM documents")
def text_word_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_word(F.col("text"))).alias("word"), F.md5(T.compare_key(F.col("text"), quotes=True)).alias("key"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS html, md5(substr(text, 1, 500)) AS context FROM documents""")
def text_html_escape(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.html_escape(F.col("text"))).alias("html"), F.md5(T.context_prefix(F.col("text"))).alias("context"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem FROM pages)
SELECT page_id, coalesce(nullif(substr(lower(trim(regexp_replace(regexp_replace(coalesce(nullif(stem, ''), 'file'), '[^0-9A-Za-z._ -]+', '_', 'g'), '[\s_]+', '_', 'g'), '._-')), 1, 90), ''), 'file') AS slug,
  coalesce(nullif(substr(regexp_replace(url, '[^\p{L}\p{N}_-]+', '_', 'g'), 1, 80), ''), 'ket_qua_ner') AS file_slug, trim(regexp_replace(url || ' (3)', '\s*\(\d+\)\s*$', '')) AS source_key
FROM p""")
def text_slugs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.slug(F.col("url")).alias("slug"), T.file_slug(F.col("url")).alias("file_slug"), T.source_key(F.concat("url", F.lit(" (3)"))).alias("source_key"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Training' WHEN 1 THEN 'Validation' WHEN 2 THEN 'Validation' WHEN 3 THEN 'Testing' WHEN 4 THEN 'Other' ELSE 'Training' END AS split,
  CASE WHEN doc_id % 2 = 0 THEN 'PERSON' ELSE 'DRUG' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'Tên bị cáo' ELSE 'Loại ma túy' END AS title,
  CASE doc_id % 3 WHEN 0 THEN 'NỘI DUNG VỤ ÁN' WHEN 1 THEN 'QUYẾT ĐỊNH' ELSE 'x' END AS section, CASE doc_id % 3 WHEN 0 THEN 'Nội dung vụ án' WHEN 1 THEN 'Quyết định' ELSE 'Không rõ' END AS name
FROM documents""")
def text_display_names(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % len(v) + 1).cast("int"))
    label, section = T.label_alias(pick("DEFENDANT", "DRUG")), pick("noi_dung", "quyet_dinh", "x")
    return _docs(spark, sf_dir).select(
        "doc_id", T.split_name(pick(" Train", "VALID", "dev", "Testing", "other", "training ")).alias("split"), label.alias("label"), T.label_title(label).alias("title"),
        T.section_title(section).alias("section"), T.section_name(section).alias("name"))


@query(rf"SELECT doc_id, len({_WORDS}) AS n_tokens, list_sum(list_transform({_WORDS}, lambda w: length(w)))::BIGINT AS token_chars, length(regexp_replace(text, '\s+$', '')) AS last_end, (len({_WORDS}) - 1) // 254 + 1 AS n_windows FROM documents WHERE len({_WORDS}) > 0")
def text_tokens(spark, sf_dir):
    tokens = X.token_windows(X.tokenize(_docs(spark, sf_dir).select(F.col("doc_id").alias("record_id"), "text")))
    found = tokens.groupBy(F.col("record_id").alias("doc_id")).agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("token_chars"), F.max("end").cast("long").alias("last_end"), F.count_distinct("window").alias("n_windows"))
    return found


@query(r"""
WITH x AS (SELECT doc_id, n - 1 AS idx, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n))
SELECT doc_id, min(idx)::INT AS idx, text FROM x WHERE text <> '' GROUP BY doc_id, text""")
def text_dedupe_first(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return C.dedupe_first(lines, "doc_id")


#: In place of look-around, the borders of sentences are marked; as a capital is never a stop, no border hides another.
@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
cut AS (SELECT doc_id, o, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x
  FROM d, unnest(string_split(regexp_replace(text, '([.!?;:])\s+([{L.SENTENCE_CAPITALS_ANNOTATED}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) WITH ORDINALITY AS u(x, o) WHERE len(w) > 240),
s AS MATERIALIZED (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, len(list_filter(regexp_split_to_array(x, '\s+'), lambda v: v <> '')) AS n FROM cut WHERE x <> ''),
packed AS (
  SELECT doc_id, i, 0 AS chunk, n AS held FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, chunk + (held + n > 240)::INT, CASE WHEN held + n > 240 THEN n ELSE held + n END FROM packed p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
SELECT doc_id, 0 AS chunk, len(w)::INT AS n_words, md5(text) AS text_md5 FROM d WHERE len(w) <= 240
UNION ALL SELECT doc_id, (k // 240)::INT, len(w[k + 1:k + 240])::INT, md5(array_to_string(w[k + 1:k + 240], ' '))
  FROM d, unnest(range(0, len(w), 240)) AS u(k) WHERE len(w) > 240 AND doc_id NOT IN (SELECT doc_id FROM s WHERE i = 2)
UNION ALL SELECT doc_id, chunk, sum(n)::INT, md5(string_agg(x, ' ' ORDER BY i)) FROM packed JOIN s USING (doc_id, i)
  WHERE doc_id IN (SELECT doc_id FROM s WHERE i = 2) GROUP BY doc_id, chunk""")  # fmt: skip
def text_sentence_chunks(spark, sf_dir):
    """Chunks of at most 240 words."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.pack_sentences(F.col("text"))).alias("chunk", "text")).select("doc_id", "chunk", T.count_words(F.col("text")).alias("n_words"), F.md5("text").alias("text_md5"))


#: Letters whose capital is more than one letter (ß: SS); DuckDB's upper knows one for one only.
_CAPITALS = "MAP {" + ", ".join(f"'{c}': '{c.upper()}'" for c in map(chr, range(0xDF, 0xFB18)) if len(c.upper()) > 1) + "}"


#: The words that are always capitalised aren't in these texts; golden rows in tests hold them.
@query(r"""
SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '([.!?] )', '\1' || chr(1), 'g'), chr(1)),
  lambda p: coalesce(@capitals[p[1:1]], upper(p[1:1])) || p[2:]), '')) AS text_md5 FROM documents""".replace("@capitals", _CAPITALS))
def text_capitalize(spark, sf_dir):
    """Sentence capitals."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.capitalize_sentences(F.lower("text"))).alias("text_md5"))


@query(r"""
WITH paras AS (SELECT doc_id, b, trim(regexp_replace(string_agg(trim(line), ' ' ORDER BY n), '\s+', ' ', 'g')) AS para
  FROM (SELECT doc_id, b, block FROM documents, unnest(regexp_split_to_array(text, '\n\s*\n')) WITH ORDINALITY AS u(block, b)) x, unnest(string_split(block, chr(10))) WITH ORDINALITY AS v(line, n)
  WHERE trim(line) <> '' AND NOT regexp_full_match(trim(line), '\d{1,3}') GROUP BY doc_id, b)
SELECT doc_id, count(*) AS n_paras, sum(length(para))::BIGINT AS n_chars FROM paras WHERE para <> '' GROUP BY doc_id""")
def text_paragraphs(spark, sf_dir):
    paras = _docs(spark, sf_dir).select("doc_id", F.explode(S.split_paragraphs(F.col("text"), split_long=False)).alias("para"))
    return paras.groupBy("doc_id").agg(F.count("*").alias("n_paras"), F.sum(F.length("para")).alias("n_chars"))
