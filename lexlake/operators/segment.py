"""From judgments to numbered records: sections, paragraphs, units, clauses.

Everything here is narrow, one document at a time, until records are exploded; numbering is by positions of
posexplode, so that nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import predicates as P
from ..functions.text import beyond_basic, clean_raw, collapse, count_words, fold_upper, let, more_words, normalize, normalize_paragraph, pieces, position, source_key, strip, strip_tail_noise, words

BLOCKS = r"(?U)\n\s*\n"


def locate_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with content_pos, reasoning_pos, decision_pos (null: no such heading); text should be clean."""
    # the folded text is an expensive column that several searches share: it is bound once
    folded = docs.withColumn("_folded", fold_upper(F.col(text))).withColumn("_wide", beyond_basic(F.col("_folded")))
    heads = lambda phrases, first=None: L.any_of(phrases, lines=True, flags="(?U)", first=first)  # noqa: E731  folded text has capitals only
    reasoning = position(F.col("_folded"), heads(L.REASONING_HEADS, L.REASONING_FIRST), F.col("_wide"))
    found = folded.withColumn("content_pos", position(F.col("_folded"), heads(L.CONTENT_HEADS, L.CONTENT_FIRST), F.col("_wide"))).withColumn("reasoning_pos", reasoning)
    start = F.coalesce(F.col("reasoning_pos") + L.DECISION_OFFSET, F.lit(0))
    rest = F.substring("_folded", start + 1, F.length("_folded"))
    return found.withColumn("decision_pos", start + position(rest, heads(L.DECISION_HEADS), F.col("_wide"))).drop("_folded", "_wide")


def _between(text: Column, start: Column, end: Column | None = None) -> Column:
    return F.substring(text, start + 1, (F.length(text) if end is None else end) - start)


def slice_sections(located: DataFrame, text: str = "text") -> DataFrame:
    """located with content_text, reasoning_text, decision_text: each section up to the next, '' where it is missing."""
    body, content, reasoning, decision = F.col(text), F.col("content_pos"), F.col("reasoning_pos"), F.col("decision_pos")
    close = F.coalesce(F.nullif(decision, F.lit(0)), F.length(body))
    return located.withColumns({
        "content_text": F.coalesce(F.when(reasoning > content, _between(body, content, reasoning)).otherwise(_between(body, content, close)), F.lit("")),
        "reasoning_text": F.coalesce(_between(body, reasoning, close), F.lit("")),
        "decision_text": F.coalesce(_between(body, decision), F.lit("")),
    })


def _resplit(text: Column, long: int, connectors: list[str]) -> Column:
    """text as an array, cut before connectors where it has more than `long` words."""
    cuts = rf"(?U)\s+(?=(?:{'|'.join(connectors)})\b)"
    return F.when(more_words(text, long), F.filter(F.transform(F.split(text, cuts), strip), lambda x: x != "")).otherwise(F.array(text))


def split_paragraphs(text: Column, split_long: bool = True) -> Column:
    """The paragraphs of a text; very long ones are cut before words of time and place."""
    paras = F.filter(F.transform(F.split(text, BLOCKS), normalize_paragraph), lambda x: x != "")
    return F.flatten(F.transform(paras, lambda x: _resplit(x, L.LONG_UNIT_PREDICT, L.CONNECTORS_PREDICT))) if split_long else paras


def split_sentences(text: Column, annotated: bool = False) -> Column:
    """Cut after . ! ? ; : before a capital or a bracket (annotated: or a digit, and no bracket)."""
    head = L.SENTENCE_CAPITALS_ANNOTATED + "0-9" if annotated else L.SENTENCE_CAPITALS + r"\["
    return F.filter(F.transform(F.split(text, rf"(?U)(?<=[.!?;:])\s+(?=[{head}])"), strip), lambda x: x != "")


def to_units(text: Column) -> Column:
    """Sentences of a section: numbered blocks, without titles and tail noise; very long ones are cut at connectors."""
    blocks = F.split(F.regexp_replace(text, r"(?U)(?<!\A)\s*(\[\d+\]\s*)", "\n\n$1"), BLOCKS)
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^\d{1,3}$"))
    joined = F.transform(blocks, lambda b: strip_tail_noise(collapse(F.array_join(lines(b), " "))))
    chunks = F.filter(joined, lambda x: (x != "") & ~P.is_section_title(x))
    sentences = F.transform(F.flatten(F.transform(chunks, lambda x: split_sentences(x))), strip_tail_noise)
    return F.flatten(F.transform(sentences, lambda x: _resplit(x, L.LONG_UNIT_TRAIN, L.CONNECTORS_TRAIN)))


def pack_sentences(text: Column, most: int = L.PACK_WORDS) -> Column:
    """Sentences packed in order into chunks of at most `most` words; a text without sentence breaks is cut by words."""
    state = "struct<done:array<string>,open:string,n:int>"
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n")).cast(state)

    def add(acc: Column, sentence: Column) -> Column:
        n = count_words(sentence)
        over = (acc["n"] > 0) & (acc["n"] + n > most)
        return F.struct(
            F.when(over, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(over | (acc["n"] == 0), sentence).otherwise(F.concat_ws(" ", acc["open"], sentence)).alias("open"),
            F.when(over, n).otherwise(acc["n"] + n).alias("n"),
        ).cast(state)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(most)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(most)), " "))

    packed = F.aggregate(split_sentences(text, annotated=True), empty, add, lambda acc: F.array_append(acc["done"], acc["open"]))
    cut = F.when(F.size(split_sentences(text, annotated=True)) <= 1, let(words(text), windows)).otherwise(packed)
    return F.when(count_words(text) <= most, F.array(text)).otherwise(cut)


def _until_stop(text: Column, stops: list[str], first: str | None = None) -> Column:
    """text up to the first stop, found on its folded form; text and form are computed once."""
    stop = L.any_of(stops, lines=True, flags="(?U)", first=first)
    return let(text, lambda t: strip(F.left(t, let(fold_upper(t), lambda f: F.coalesce(position(f, stop), F.length(f))))))


def decision_clauses(text: Column) -> Column:
    """The preamble and clauses 1 and 2 of a decision, as an array; other clauses and what follows a stop heading go."""
    lines = F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^\d{1,3}$")), "\n")
    body = strip(F.regexp_replace(lines, rf"{L.FLAGS}^\s*QUYẾT\s+ĐỊNH\s*:?\s*", ""))
    kept = strip(F.regexp_replace(F.regexp_replace(_until_stop(body, L.DECISION_STOPS), r"[ \t]+", " "), r"\n+", " "))
    parts = F.filter(F.transform(pieces(kept, r"(?U)(?=\b\d{1,2}\s*[.)]\s+)"), strip), lambda x: x != "")
    return F.filter(parts, lambda x: ~x.rlike(r"(?U)^\d{1,2}\s*[.)]") | x.rlike(r"(?U)^[12]\s*[.)]"))


def decision_clauses_train(text: Column) -> Column:
    """All clauses of a decision up to a stop heading, cut before `n. Capital`."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^\d{1,3}$"))
    body = _until_stop(collapse(F.array_join(lines, " ")), L.DECISION_STOPS_TRAIN, L.STOPS_TRAIN_FIRST)
    kept = strip(F.regexp_replace(body, rf"{L.FLAGS}^QUYẾT\s+ĐỊNH\s*:\s*", ""))
    return F.filter(F.transform(pieces(kept, r"(?U)(?=\b\d{1,2}\.\s+[A-ZĐÁÀẢÃẠ])"), strip), lambda x: x != "")


def detect_heading(text: Column) -> Column:
    """struct(section, polarity) of a line that is a heading of an annotated document, else null."""
    return _heading_of(normalize(text, "annotated"))


def _may_open(body: Column) -> Column:
    """Whether a text begins with the letter of a heading; at others no heading is sought."""
    letters = sorted({head[0] for _, _, head, _ in L.ANNOTATED_HEADS})
    return F.left(body, F.lit(1)).isin([x for letter in letters for x in (letter.upper(), letter.lower())])


def _heading_of(body: Column) -> Column:
    out = F.lit(None).cast("struct<section:string,polarity:string>")
    for section, polarity, head, tail in reversed(L.ANNOTATED_HEADS):
        line = L.any_of([rf"^{head}~(?:[-–—:]~)?(?:{tail})?~$"])
        out = F.when(body.rlike(line), F.struct(F.lit(section).alias("section"), F.lit(polarity).alias("polarity"))).otherwise(out)
    return F.when(_may_open(body), out)


def split_heading_prefix(text: Column) -> Column:
    """struct(section, polarity, rest) of a paragraph that begins with a heading; without one section is null and rest the text."""
    return _clean_rest(_prefix_of(normalize(text, "annotated")))


def _clean_rest(prefix: Column) -> Column:
    # once for all headings, since a Python function's input is made for each row, whatever condition stands around it
    rest = F.when(prefix["section"].isNotNull(), normalize(prefix["rest"], "annotated")).otherwise(prefix["rest"])
    return F.struct(prefix["section"].alias("section"), prefix["polarity"].alias("polarity"), rest.alias("rest"))


def _prefix_of(body: Column) -> Column:
    out = F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("polarity"), body.alias("rest"))
    for section, polarity, head, tail in (L.ANNOTATED_HEADS[2], L.ANNOTATED_HEADS[1], L.ANNOTATED_HEADS[0], L.ANNOTATED_HEADS[3]):
        prefix = rf"^{head}~[:\-–—]? (.+)$" if section == "quyet_dinh" else rf"^{head}~(?:[-–—:]~)?(?:{tail})? (.+)$"
        expression = "(?s)" + L.any_of([prefix])
        rest = F.regexp_extract(body, expression, 1)
        out = F.when(body.rlike(expression), F.struct(F.lit(section).alias("section"), F.lit(polarity).alias("polarity"), rest.alias("rest"))).otherwise(out)
    plain = F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("polarity"), body.alias("rest"))
    return F.when(_may_open(body) & ~body.rlike(L.any_of([L.SUMMARY_OPENING])), out).otherwise(plain)


def build_records(docs: DataFrame, mode: str = "raw", sections: tuple[str, ...] | None = None) -> DataFrame:
    """Prediction records of docs (doc_id, source, text): doc_id, record_id, source, record_idx, section, text, ner_targets.

    record_idx counts a document's records from 1; ner_targets are the labels that its section may hold. sections: those wanted; others
    are not segmented, and record_idx counts the records of those alone.
    """
    cleaned = docs.select("doc_id", source_key(F.col("source")).alias("source"), clean_raw(F.col("text")).alias("text"))
    cut = slice_sections(locate_sections(cleaned)).select("doc_id", "source", "content_text", "reasoning_text", "decision_text")
    tag = lambda paras, section: F.transform(paras, lambda x: F.struct(F.lit(section).alias("section"), x.alias("text")))
    content = F.filter(split_paragraphs(F.col("content_text")), lambda x: P.relevant_content_para(x, mode))
    reasoning = F.filter(split_paragraphs(F.col("reasoning_text")), P.relevant_reasoning_para)
    decision = F.filter(F.transform(decision_clauses(F.col("decision_text")), normalize_paragraph), lambda x: x != "")
    made = {"noi_dung": content, "nhan_dinh": reasoning, "quyet_dinh": decision}
    parts = F.concat(*[tag(paras, name) for name, paras in made.items() if sections is None or name in sections])
    rows = cut.select("doc_id", "source", F.posexplode(parts).alias("at", "part")).select("doc_id", "source", (F.col("at") + 1).alias("record_idx"), "part.section", "part.text")
    return rows.select("doc_id", F.format_string("%s::%04d", "source", "record_idx").alias("record_id"), "source", "record_idx", "section", "text", ner_targets(F.col("section")).alias("ner_targets"))


def ner_targets(section: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, labels in L.SECTION_LABELS.items():
        if labels:
            out = F.when(section == name, F.array(*map(F.lit, labels))).otherwise(out)
    return out


def _first_of(units: Column) -> Column:
    """Units collapsed, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(units, collapse), lambda x: x != ""))


def build_training_records(docs: DataFrame) -> DataFrame:
    """doc_id, source, section, polarity, idx, text: positive units by section, and the units without entities as negative.

    Sections are noi_dung, nhan_dinh, negative and quyet_dinh; idx counts within a section from 0.
    """
    cleaned = docs.select("doc_id", source_key(F.col("source")).alias("source"), clean_raw(F.col("text"), "train").alias("text"))
    cut = slice_sections(locate_sections(cleaned)).select("doc_id", "source", "decision_text", to_units(F.col("content_text")).alias("_content"), to_units(F.col("reasoning_text")).alias("_reasoning"))
    cut = cut.withColumn("_facts", _first_of(F.filter("_reasoning", lambda x: P.is_reasoning_fact(x))))
    content = _first_of(F.filter("_content", lambda x: P.is_relevant_content(x)))
    negative = F.concat(
        _first_of(F.filter("_content", lambda x: ~P.is_relevant_content(x) & P.is_useful_negative(x))),
        _first_of(F.filter("_reasoning", lambda x: ~F.array_contains(F.col("_facts"), collapse(x)) & P.is_useful_negative(x))),
    )
    tag = lambda units, section, polarity: F.transform(units, lambda x, i: F.struct(F.lit(section).alias("section"), F.lit(polarity).alias("polarity"), i.alias("idx"), x.alias("text")))
    parts = F.concat(
        tag(content, "noi_dung", "positive"), tag(F.col("_facts"), "nhan_dinh", "positive"), tag(negative, "negative", "negative"),
        tag(decision_clauses_train(F.col("decision_text")), "quyet_dinh", "positive"),
    )
    return cut.select("doc_id", "source", F.inline(parts))


def positive_content(docs: DataFrame) -> DataFrame:
    return build_training_records(docs).where((F.col("section") == "noi_dung") & (F.col("polarity") == "positive"))


def paragraph_records(paragraphs: DataFrame) -> DataFrame:
    """Records of annotated documents (doc_id, source, para_idx, style, text): headings set the section of what follows.

    Columns: doc_id, source, section, polarity, para_idx, record_idx, text. Headings and boilerplate give no record;
    long paragraphs give several, numbered by record_idx within the document.
    """
    line, prefix = F.col("_line"), F.col("_prefix")
    # generated columns, so that a paragraph is normalised once and its heading sought once, whatever reads them
    once = lambda made: F.explode(F.array(made))
    bodies = paragraphs.withColumn("_body", once(normalize(F.col("text"), "annotated")))
    headed = bodies.withColumn("_h", once(F.struct(_heading_of(F.col("_body")).alias("line"), _prefix_of(F.col("_body")).alias("prefix")))).drop("_body")
    headed = headed.withColumns({"_line": F.col("_h.line"), "_prefix": _clean_rest(F.col("_h.prefix"))}).drop("_h")
    own = F.coalesce(line, F.when(prefix["section"].isNotNull(), F.struct(prefix["section"].alias("section"), prefix["polarity"].alias("polarity"))))
    before = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = headed.withColumn("_head", F.last(own, ignorenulls=True).over(before)).where(line.isNull())
    kept = carried.withColumn("_rest", prefix["rest"]).where(~P.should_skip_text(F.col("_rest")))
    each = kept.select(
        "doc_id", "source", F.coalesce("_head.section", F.lit("unknown")).alias("section"), F.coalesce("_head.polarity", F.lit("positive")).alias("polarity"),
        "para_idx", F.posexplode(pack_sentences(F.col("_rest"))).alias("_part", "text"),
    )
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", "_part"))
    return each.withColumn("record_idx", numbered).select("doc_id", "source", "section", "polarity", "para_idx", "record_idx", "text")
