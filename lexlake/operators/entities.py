"""Rule entities of the decision section, cleaning, de-duplication, order, relations, and the views of a document.

Entities are rows: doc_id, section, record_idx, label, text, start, end, score, rule_based, rule_name, context. Work by
document is one shuffle on doc_id; everything before it is narrow.

Views of a document take docs, the documents that must have one: those without records or entities get empty texts, empty lists, counts of 0
and lines that say so. Their ids travel in the shuffle that groups the view, as rows without anything else, so no join is added.
Without docs a view has the documents that have something to show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import predicates as P
from ..functions import text as T

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Around a match, and between it and its group.
_MARK, _PART = "\x01", "\x02"


def _has_marks(text: Column) -> Column:
    return text.contains(_MARK) | text.contains(_PART)


def _mark(text: Column, expression: str, group: int = 0) -> Column:
    """text with a mark at both ends of each match, and the match's group behind it; the expression runs once. Other marks become another sign without meaning."""
    plain = F.when(_has_marks(text), F.translate(text, _MARK + _PART, "\x03\x03")).otherwise(text)
    return F.regexp_replace(plain, expression, f"{_MARK}$0{_PART}${group}{_MARK}")


def _marked_spans(pieces: Column) -> Column:
    """array<struct<start, end, text>> of what _mark() found, given its text cut at the marks; positions are sums of the lengths of matches and of the pieces between."""
    # what stands before a match, the match with its group, and so on; what stands behind the last one
    first = lambda k: F.length(F.get(pieces, k)) + F.length(F.substring_index(F.get(pieces, k + 1), _PART, 1))
    inner = lambda k: F.substring_index(F.get(pieces, k + 1), _PART, -1)
    span = lambda text, end: F.struct((end - F.length(text)).alias("start"), end.alias("end"), text.alias("text"))
    places = F.sequence(F.lit(0), F.size(pieces) - 3, F.lit(2))
    several = F.zip_with(places, T.running_sums(F.transform(places, first)), lambda k, end: T.let(inner(k), lambda text: span(text, end)))
    return F.when(F.size(pieces) == 3, F.array(span(inner(F.lit(0)), first(F.lit(0))))).when(F.size(pieces) > 3, several)


def _as_written(span: Column, text: Column) -> Column:
    """A span with its text as it stands; where the text has marks of its own, they were another sign in the search."""
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.substring(text, span["start"] + 1, span["end"] - span["start"]).alias("text"))


def extract_spans(text: Column, expression: str, group: int = 0) -> Column:
    """array<struct<start, end, text>> of all matches, left to right; with a group, of that group, which must end its match. Matches must not be empty."""
    found = T.let(F.split(_mark(text, expression, group), _MARK, -1), _marked_spans)
    return F.coalesce(F.when(_has_marks(text), F.transform(found, lambda s: _as_written(s, text))).otherwise(found), F.array().cast(SPAN))


def rule_entities(records: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Cleaned entities that the rules find in the decision section of records (doc_id, record_idx, section, text).

    Rules nest, and every match stays: an article with its clause also counts alone. labels: those wanted; rules of others don't run.
    A rule with a trigger looks at texts only that hold the word in lower case.
    """
    text, rules = F.col("text"), [r for r in L.RULES if labels is None or r[0] in labels]

    def marked(label: str, rule: str, expression: str, group: int, trigger: str | None) -> Column:
        found = _mark(text, L.FLAGS + expression, group)
        return F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule_name"), (found if trigger is None else F.when(F.col("_low").contains(trigger), found)).alias("_marked"))

    # step by step as rows, which Spark compiles, and not inside arrays, which it interprets; what follows the search is written once and not for each rule
    place = ["doc_id", "section", "record_idx"]
    decision = records.where(F.col("section") == "quyet_dinh").select(*place, "text", F.lower("text").alias("_low"), F.when(_has_marks(text), text).alias("_odd"))
    hits = decision.select(*place, T.context_prefix(text).alias("context"), "_odd", F.inline(F.array(*[marked(*r) for r in rules]))).where(F.col("_marked").contains(_MARK))
    each = hits.withColumn("_pieces", F.split("_marked", _MARK, -1)).select(*place, "context", "_odd", "label", "rule_name", F.inline(_marked_spans(F.col("_pieces"))))
    written = F.when(F.col("_odd").isNotNull(), F.substring("_odd", F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("text"))
    # a person's span ends where the name does
    named = each.withColumn("_text", F.explode(F.array(F.when(F.col("label") == "PERSON", T.cut_person(T.strip(written))).otherwise(written))))
    end = F.when(F.col("label") == "PERSON", F.col("start") + F.length("_text")).otherwise(F.col("end"))
    rows = named.select(*place, "label", F.col("_text").alias("text"), "start", end.alias("end"), F.lit(1.0).alias("score"), F.lit(True).alias("rule_based"), "rule_name", "context")
    return clean_entities(rows, tuple({r[0]: None for r in rules}))


#: Distinct texts, at most, whose entities are sent to all tasks; with more, each record is searched.
_FEW = 5_000


def rule_entities_by_text(records: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of rule_entities(), with each distinct text searched once where judgments repeat their formulas: where distinct texts are few, they are
    searched apart and their entities go to all tasks. An estimate of their number decides, at once; records are read several times, so they should be stored.
    """
    decision = records.where(F.col("section") == "quyet_dinh").select("doc_id", "section", "record_idx", "text")
    if decision.agg(F.approx_count_distinct("text")).first()[0] > _FEW:
        return rule_entities(records, labels)
    texts = decision.select("section", "text").distinct().select(F.col("text").alias("doc_id"), "section", F.lit(0).alias("record_idx"), "text")
    columns = ["label", "text", "start", "end", "score", "rule_based", "rule_name"]
    found = rule_entities(texts, labels).groupBy(F.col("doc_id").alias("_key")).agg(F.collect_list(F.struct(*columns)).alias("_found"))
    met = decision.withColumnRenamed("text", "_text").join(F.broadcast(found), F.col("_text") == F.col("_key"))
    return met.select("doc_id", "section", "record_idx", T.context_prefix(F.col("_text")).alias("context"), F.inline("_found")).select("doc_id", "section", "record_idx", *columns, "context")


def clean_entities(entities: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """entities with their texts normalised by label; those that fail their label's rules are dropped. Positions stay as found.

    labels: those that may come, if that is known; entities of others are dropped.
    """
    label, context, raw = F.col("_label"), F.col("context"), F.col("_raw")
    checks = {
        "DRUG": (T.norm_drug, lambda t: ~P.bad_drug(t) & ~P.bad_drug_context(context)),
        "DRUG_WEIGHT": (T.norm_weight, lambda t: P.valid_weight(t) & ~P.bad_weight_context(context)),
        "CRIME_TIME": (lambda t: t, lambda t: P.valid_time(t) & ~P.bad_time_context(context)),
        "CRIME_LOC": (lambda t: t, lambda t: P.clear_location(t) & ~P.bad_location_context(context)),
        "PERSON": (T.norm_person, P.valid_person),
        "CHARGE": (T.norm_charge, lambda t: F.lower(t).contains(L.CHARGE_OBJECT)),
        "LEGAL_ARTICLE": (T.norm_article, lambda t: ~P.bad_article(t)),
        "SENTENCE": (T.norm_sentence, P.valid_sentence),
    }
    known = {n: c for n, c in checks.items() if labels is None or n in labels}

    def by_label(of) -> Column:
        out = F.lit(None)
        for name, rule in known.items():
            out = F.when(label == name, of(rule)).otherwise(out)
        return out

    named = entities.withColumn("_label", T.label_alias(F.col("label"))).withColumn("_raw", T.trim_entity(F.col("text"))).where(raw != "")
    # as a generated column the normalised text is made once, whatever filters come above
    cleaned = named.withColumn("_clean", F.explode(F.array(by_label(lambda rule: rule[0](raw))))).where(by_label(lambda rule: rule[1](F.col("_clean"))))
    columns = {"label": F.col("_label"), "text": F.col("_clean"), "score": F.coalesce(F.nullif(F.col("score").cast("double"), F.lit(0.0)), F.lit(1.0))}
    return cleaned.withColumns(columns).drop("_label", "_raw", "_clean")


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """One of entities that agree in place, label and text; a model's before a rule's.

    They come together by document, so that what works by document afterwards needs no other shuffle.
    """
    key = ["doc_id", "section", "record_idx", "label", "text", "start", "end"]
    first = Window.partitionBy(*key).orderBy("rule_based", "rule_name", "score")
    return entities.repartition("doc_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def section_rank(section: Column) -> Column:
    out = F.lit(L.OTHER_SECTION_RANK)
    for name, rank in L.SECTION_RANK.items():
        out = F.when(section == name, rank).otherwise(out)
    return out


def order_entities(entities: DataFrame, zero_last: bool = False) -> DataFrame:
    """entities with ord, from 0 in each document: by section, record, start, model before rule, then end, label and text.

    zero_last puts record 0 and start 0 behind all others, as some consumers expect.
    """
    place = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(999_999)) if zero_last else F.coalesce(F.col(c), F.lit(999_999))
    order = Window.partitionBy("doc_id").orderBy(section_rank(F.col("section")), place("record_idx"), place("start"), "rule_based", "end", "label", "text")
    return entities.withColumn("ord", F.row_number().over(order) - 1)


def longest_only(entities: DataFrame) -> DataFrame:
    """entities without those that lie inside a longer one of their label and record."""
    frame = Window.partitionBy("doc_id", "section", "record_idx", "label").orderBy("start", F.desc("end"), "text").rowsBetween(Window.unboundedPreceding, -1)
    return entities.withColumn("_end", F.max("end").over(frame)).where(F.col("_end").isNull() | (F.col("end") > F.col("_end"))).drop("_end")


def relations(ordered: DataFrame) -> DataFrame:
    """doc_id, rel_type, from_text, to_text, from_ord, to_ord of ordered entities.

    A person of the decision goes with the first sentence and the first charge within reach behind; a drug with the nearest weight
    of its section, the earlier of two as near. Sections are contiguous in the order, so frames within a section are exact.
    """
    run = Window.partitionBy("doc_id", "section").orderBy("ord")
    partner = F.struct("text", "ord")
    ahead = lambda label, n: F.first(F.when(F.col("label") == label, partner), ignorenulls=True).over(run.rowsBetween(1, n))
    behind = F.last(F.when(F.col("label") == "DRUG_WEIGHT", partner), ignorenulls=True).over(run.rowsBetween(-L.WEIGHT_REACH, -1))
    after = ahead("DRUG_WEIGHT", L.WEIGHT_REACH)
    near = F.when(after.isNull() | ((F.col("ord") - behind["ord"]) <= (after["ord"] - F.col("ord"))), behind).otherwise(after)
    to = [F.when((F.col("label") == "PERSON") & (F.col("section") == "quyet_dinh"), F.struct(F.lit(kind).alias("rel_type"), ahead(label, n).alias("to"))) for kind, label, n in L.PERSON_RELATIONS]
    to.append(F.when(F.col("label") == "DRUG", F.struct(F.lit(L.WEIGHT_RELATION).alias("rel_type"), near.alias("to"))))
    each = ordered.withColumn("_to", F.array(*to)).select("doc_id", F.col("text").alias("from_text"), F.col("ord").alias("from_ord"), F.explode("_to").alias("r")).where("r.to is not null")
    return each.select("doc_id", "r.rel_type", "from_text", F.col("r.to.text").alias("to_text"), "from_ord", F.col("r.to.ord").alias("to_ord"))


def _with_docs(rows: DataFrame, docs: DataFrame | None) -> DataFrame:
    """rows, and a row of nulls for each of docs."""
    return rows if docs is None else rows.unionByName(docs.select("doc_id"), allowMissingColumns=True)


def sections_text(records: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id with the text of each section: its records in order, an empty line between; '' for a missing section."""
    ordered = lambda name: F.array_sort(F.collect_list(F.when((F.col("section") == name) & (T.strip(F.col("text")) != ""), F.struct("record_idx", T.strip(F.col("text")).alias("text")))))
    return _with_docs(records.select("doc_id", "section", "record_idx", "text"), docs).groupBy("doc_id").agg(*[F.array_join(F.transform(ordered(name), lambda x: x["text"]), "\n\n").alias(name) for name in L.SECTION_RANK])


def filtered_text(sections: DataFrame) -> DataFrame:
    """doc_id and text: the sections under their titles, empty ones left out."""
    parts = [F.when(T.strip(F.col(n)) != "", F.concat(F.lit(L.SECTION_TITLES[n] + "\n"), T.strip(F.col(n)))) for n in L.SECTION_RANK]
    return sections.select("doc_id", F.concat_ws("\n\n", *parts).alias("text"))


def _by_label() -> Column:
    item = F.struct("ord", "text", "score", "section", "start", "end", "record_idx", "rule_based", "rule_name")
    lists = [F.struct(F.lit(label).alias("label"), F.array_sort(F.collect_list(F.when(F.col("label") == label, item))).alias("items")) for label in L.LABELS]
    return F.map_from_entries(F.array(*lists))


def _counts() -> list[Column]:
    return [*[F.count_if(F.col("label") == label).alias(label.lower()) for label in L.LABELS], F.count("label").alias("n_entities")]


def entities_by_label(ordered: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id and a map from each of the labels to its entities in order; labels without any have an empty list."""
    return _with_docs(ordered, docs).groupBy("doc_id").agg(_by_label().alias("entities"))


def entity_counts(ordered: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, a count for each label, and n_entities."""
    return _with_docs(ordered, docs).groupBy("doc_id").agg(*_counts())


def highlighted(records: DataFrame, ordered: DataFrame) -> DataFrame:
    """doc_id, record_idx, section, text and spans (by start, then end) of every record that has any."""
    span = F.struct("start", "end", F.col("label").alias("entity"), F.col("text").alias("word"), "score", "ord", "rule_based")
    spans = ordered.groupBy("doc_id", "record_idx").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # the views' joins are all among rows for each document: none is to go through the driver, whatever Spark takes it to weigh
    return records.select("doc_id", "record_idx", "section", "text").join(spans.hint("merge"), ["doc_id", "record_idx"])


def summary_lines(ordered: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, label and line of every document and label: distinct words whatever their case, in order, or a notice that there are none."""
    word = T.strip(F.col("text"))
    first = Window.partitionBy("doc_id", "label", F.lower(word)).orderBy("ord")
    distinct = ordered.withColumn("word", word).withColumn("_n", F.row_number().over(first)).where("_n = 1 and word != ''")
    parts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("ord", "word")))), lambda x: x["word"]), "; ").alias(label) for label in L.REPORT_ORDER]
    wide = _with_docs(distinct, docs).groupBy("doc_id").agg(*parts)
    line = lambda label: F.concat(F.lit(L.LABEL_TITLES[label] + ": "), F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit(L.NOT_FOUND)))
    return wide.select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(label).alias("label"), line(label).alias("line")) for label in L.REPORT_ORDER])).alias("place", "x")).select("doc_id", "place", "x.label", "x.line")


def report_text(records: DataFrame, ordered: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id and report of each of sources: summary lines, then each highlighted record under its section with its tagged entities.

    sources may bring model and elapsed_ms, which stand in the report's head.
    """
    summary = summary_lines(ordered, sources).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("summary"))
    tags = F.array_join(F.transform("spans", lambda s: F.concat(F.lit("["), s["entity"], F.lit(": "), s["word"], F.lit("]"))), "; ")
    passage = F.concat(F.lit("\n["), T.section_title(F.col("section")), F.lit("]\nThực thể: "), tags, F.lit("\n"), T.strip(F.col("text")))
    passages = highlighted(records, ordered).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_idx", passage.alias("p")))), lambda x: x["p"]), "\n").alias("passages"))
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in sources.columns else F.lit("")
    head = sources.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), given("model").alias("model"), given("elapsed_ms").alias("elapsed_ms"))
    whole = F.concat_ws(
        "\n", F.lit("KẾT QUẢ NHẬN DIỆN THỰC THỂ BẢN ÁN HÌNH SỰ MA TÚY"), F.lit("=" * 70), F.concat(F.lit("Tên file: "), F.col("source")), F.concat(F.lit("Model: "), F.col("model")),
        F.concat(F.lit("Thời gian xử lý: "), F.col("elapsed_ms"), F.lit(" ms")), F.lit(""), F.lit("I. TÓM TẮT THỰC THỂ"), F.lit("-" * 70), F.col("summary"), F.lit(""), F.lit("II. VĂN BẢN ĐƯỢC GÁN NHÃN"), F.lit("-" * 70), F.col("passages"),
    )
    return head.join(summary.hint("merge"), "doc_id").join(passages.hint("merge"), "doc_id", "left").select("doc_id", whole.alias("report"))


def report_html(ordered: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id and html of each of sources: a table of the summary and the recognised text, escaped."""
    row = F.concat(F.lit("<tr><td>"), T.html_escape(F.col("label")), F.lit("</td><td>"), T.html_escape(F.col("line")), F.lit("</td></tr>"))
    summary = summary_lines(ordered, sources).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", row.alias("row")))), lambda x: x["row"]), "").alias("summary"))
    text = flatten_text(highlighted(records, ordered)).select("doc_id", F.replace(T.html_escape(F.col("text")), F.lit("\n"), F.lit("<br/>")).alias("body"))
    page = F.concat(F.lit("<!doctype html><html lang=\"vi\"><head><meta charset=\"utf-8\"/><title>"), T.html_escape(F.coalesce("source", F.lit(""))), F.lit("</title></head><body><table>"), F.col("summary"), F.lit("</table><div>"), F.coalesce("body", F.lit("")), F.lit("</div></body></html>"))
    return sources.select("doc_id", "source").join(summary.hint("merge"), "doc_id").join(text.hint("merge"), "doc_id", "left").select("doc_id", page.alias("html"))


def flatten_offsets(marked: DataFrame) -> DataFrame:
    """Spans of highlighted records, shifted to the document's joined text: doc_id, record_idx, start, end, entity, word."""
    before = Window.partitionBy("doc_id").orderBy("record_idx").rowsBetween(Window.unboundedPreceding, -1)
    shifted = marked.withColumn("_shift", F.coalesce(F.sum(F.length(T.strip(F.col("text"))) + 2).over(before), F.lit(0)).cast("int"))
    each = shifted.select("doc_id", "record_idx", "_shift", F.explode("spans").alias("s"))
    return each.select("doc_id", "record_idx", (F.col("s.start") + F.col("_shift")).alias("start"), (F.col("s.end") + F.col("_shift")).alias("end"), "s.entity", "s.word")


def flatten_text(marked: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("record_idx", T.strip(F.col("text")).alias("text"))))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def distinct_rows(ordered: DataFrame) -> DataFrame:
    """Entities for display: the first of those with the same word and place."""
    key = T.compare_key(T.clean_word(F.col("text")), quotes=True)
    first = Window.partitionBy("doc_id", "label", key, "section", "record_idx", "start", "end").orderBy("ord")
    named = ordered.withColumn("word", T.clean_word(F.col("text"))).where("word != ''")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def best_score(entities: DataFrame) -> DataFrame:
    """For each document, label and cleaned word whatever its case, the entity of the highest score, at the place of the first."""
    key = F.lower(T.clean_word(F.col("text")))
    best = F.max_by(F.struct(T.clean_word(F.col("text")).alias("word"), "score", "section"), F.struct("score", -F.col("ord"))).alias("best")
    return entities.withColumn("word_key", key).where("word_key != ''").groupBy("doc_id", "label", "word_key").agg(best, F.min("ord").alias("ord")).select("doc_id", "label", "word_key", "best.word", "best.score", "ord")


def longest_first(entities: DataFrame) -> DataFrame:
    """Distinct (label, text) of each document whatever the case, two characters at least, with length and rank from 1: the longest first, then as in the text."""
    folded = Window.partitionBy("doc_id", "label", F.lower("text")).orderBy("ord")
    one = entities.where(F.length("text") >= 2).withColumn("_n", F.row_number().over(folded)).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "ord")).cast("long")
    return one.select("doc_id", "label", "text", F.length("text").alias("length"), rank.alias("rank"))


def first_words(ordered: DataFrame, label: str, k: int) -> DataFrame:
    """doc_id and the first k entities of a label."""
    items = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), 1, k)
    return ordered.where(F.col("label") == label).groupBy("doc_id").agg(items.alias("words"))


def result_documents(records: DataFrame, ordered: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One nested row for each document: sections, entities by label, relations and counts."""
    links = relations(ordered).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from_ord", "rel_type", "from_text", "to_text", "to_ord"))).alias("relations"))
    spine = records.select("doc_id").distinct() if docs is None else docs
    # lists and counts come from one reading of the entities
    views = _with_docs(ordered, spine).groupBy("doc_id").agg(_by_label().alias("entities"), *_counts())
    whole = sections_text(records, docs).join(views.hint("merge"), "doc_id").join(links.hint("merge"), "doc_id", "left")
    none = F.array().cast(links.schema["relations"].dataType)
    return whole.withColumn("relations", F.coalesce("relations", none))


def result_json(results: DataFrame, dropped: tuple[str, ...] = ("model_dir", "model_root")) -> DataFrame:
    """doc_id and json of result documents, without internal columns."""
    return results.select("doc_id", F.to_json(F.struct(*[c for c in results.columns if c not in dropped])).alias("json"))
