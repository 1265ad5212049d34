"""Boolean columns that select units, paragraphs and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .text import count_words, fold_upper, let, strip, trim_entity, words


def has_drug_name(text: Column) -> Column:
    return text.rlike(L.any_of(L.DRUG_NAMES, words=True))


def has_real_weight(text: Column) -> Column:
    """A number with a unit that doesn't open a range; in a text that names a drug any will do."""
    weight = L.FLAGS + L.pattern(L.WEIGHT)
    ranged = L.FLAGS + L.pattern(L.RANGE_AFTER)
    behind = F.slice(F.split(text, weight, -1), 2, 1 << 30)
    # what follows a weight runs into the next one, so matches are put back before looking at RANGE_CHARS characters
    matches = F.regexp_extract_all(text, F.lit(weight), F.lit(0))
    alone = F.exists(F.zip_with(behind, F.concat(F.slice(matches, 2, 1 << 30), F.array(F.lit(""))), lambda b, m: F.concat(b, m)), lambda b: ~F.left(b, F.lit(L.RANGE_CHARS)).rlike(ranged))
    return F.when(text.rlike(weight), has_drug_name(text) | alone).otherwise(F.lit(False))


def has_crime_action(text: Column) -> Column:
    return text.rlike(L.any_of(L.CRIME_ACTIONS, words=True))


def has_time_signal(text: Column) -> Column:
    return text.rlike(L.any_of(L.TIME_WORDS, words=True)) | text.rlike(L.any_of(L.TIME_FORMS))


def has_loc_signal(text: Column) -> Column:
    return text.rlike(L.any_of(L.PLACE_WORDS, words=True))


def has_drug_or_weight(text: Column) -> Column:
    return has_drug_name(text) | has_real_weight(text)


#: Signals that several predicates are made of, by name.
SIGNALS = {
    "drug": has_drug_name, "weight": has_real_weight, "action": has_crime_action, "time": has_time_signal, "place": has_loc_signal, "n_words": count_words, "folded": fold_upper,
}


def with_signals(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with a column signals, whose fields predicates take in place of making them: each is made once a row, however many predicates use it."""
    made = F.struct(*[f(F.col(text)).alias(name) for name, f in SIGNALS.items()])
    return rows.withColumn("signals", F.explode(F.array(made)))


def _signal(text: Column, name: str, signals: Column | None) -> Column:
    return SIGNALS[name](text) if signals is None else signals[name]


def is_noise(text: Column, signals: Column | None = None) -> Column:
    """Procedure: a numbered heading at the start, or a marker anywhere."""
    opening = L.FLAGS + r"^\s*\[\d+\]\s*(?:" + "|".join(map(L.pattern, L.NOISE_OPENINGS)) + ")"
    return fold_upper(F.left(text, F.lit(L.NOISE_OPENING_CHARS))).rlike(opening) | _signal(text, "folded", signals).rlike(L.any_of(L.NOISE_INSIDE))


def _what(text: Column, signals: Column | None) -> Column:
    return _signal(text, "drug", signals) | _signal(text, "weight", signals)


def is_strict_crime(text: Column, signals: Column | None = None) -> Column:
    return _signal(text, "action", signals) & _signal(text, "time", signals) & _signal(text, "place", signals) & _what(text, signals)


def keep_drug_mention(text: Column, signals: Column | None = None) -> Column:
    """A drug that isn't only tested for, listed or handed back."""
    return _signal(text, "drug", signals) & ~_signal(text, "folded", signals).rlike(L.any_of(L.MENTION_STOPS, flags="(?U)"))


def is_relevant_content(text: Column, signals: Column | None = None) -> Column:
    told = is_strict_crime(text, signals) | keep_drug_mention(text, signals)
    return (_signal(text, "n_words", signals) >= L.MIN_WORDS) & ~is_noise(text, signals) & told


def is_section_title(text: Column) -> Column:
    return text.rlike(L.any_of([f"^~(?:{'|'.join(L.TITLE_LINES)})~:?~$"]))


def is_useful_negative(text: Column) -> Column:
    """A unit that talks of people and procedure and not of the act."""
    return (
        (count_words(text) >= L.MIN_WORDS) & ~is_section_title(text) & ~text.rlike(L.any_of(L.NEGATIVE_DROP, words=True))
        & text.rlike(L.any_of(L.NEGATIVE_KEEP, words=True)) & ~is_strict_crime(text)
    )


def is_reasoning_fact(text: Column, signals: Column | None = None) -> Column:
    """A unit of the reasoning that states the act. A conclusion overrides what would drop it; headings never pass."""
    concludes = text.rlike(L.any_of(L.CONCLUSIONS))
    stops = L.FLAGS + r"^\s*\[?\d{0,2}\]?\s*(?:" + "|".join(map(L.pattern, L.REASONING_STOPS)) + r")\b"
    dropped = text.rlike(L.any_of(L.PROSECUTION, words=True)) | text.rlike(L.any_of(L.REASONING_DROP, words=True)) | _signal(text, "folded", signals).rlike(L.any_of(L.REASONING_STOPS_FOLDED, flags="(?U)"))
    when_, where, what = _signal(text, "time", signals), _signal(text, "place", signals), _what(text, signals)
    told = is_strict_crime(text, signals) | (text.rlike(L.any_of(L.FACT_CUES, words=True)) & (what | when_ | where)) | (_signal(text, "action", signals) & (what | (when_ & where)))
    return (_signal(text, "n_words", signals) >= L.MIN_WORDS) & ~is_section_title(text) & ~text.rlike(stops) & (concludes | (~dropped & told))


def _hints(text: Column) -> Column:
    what = text.rlike(L.any_of(L.DRUG_HINTS, words=True)) | text.rlike(L.any_of([L.WEIGHT]))
    act = text.rlike(L.any_of(L.ACTION_HINTS, words=True))
    when_ = text.rlike(L.any_of(L.TIME_HINTS, words=True)) | text.rlike(L.any_of(L.TIME_HINT_FORMS))
    return what | (act & (when_ | text.rlike(L.any_of(L.PLACE_HINTS, words=True))))


def relevant_content_para(text: Column, mode: str = "raw") -> Column:
    """mode raw: every paragraph; filtered: those with a hint of the act."""
    return F.lit(True) if mode == "raw" else _hints(text)


def relevant_reasoning_para(text: Column) -> Column:
    return F.when(text.rlike(L.any_of(L.REASONING_KEEP_HINTS, words=True)), True).when(text.rlike(L.any_of(L.REASONING_DROP_HINTS, words=True)), False).otherwise(_hints(text))


def should_skip_text(text: Column) -> Column:
    """Nothing, a page number, or an opening formula; for text of annotated documents, already normalised."""
    return (text == "") | text.rlike(r"^\d{1,3}$") | text.rlike(L.any_of(L.BOILERPLATE))


def contains_any(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def valid_weight(text: Column) -> Column:
    return text.rlike(L.any_of([L.ENTITY_WEIGHT]))


def bad_weight_context(context: Column) -> Column:
    return contains_any(F.lower(context), L.NOT_WEIGHT_CONTEXT)


def bad_drug(text: Column) -> Column:
    return strip(text).isin(L.NOT_DRUGS)


def bad_drug_context(context: Column) -> Column:
    return contains_any(F.lower(context), L.NOT_DRUG_CONTEXT)


def bad_article(text: Column) -> Column:
    return text.rlike(L.any_of(L.NOT_ARTICLES))


def valid_person(text: Column) -> Column:
    return let(words(text), lambda w: F.size(w).between(2, 6) & ~F.get(w, F.lit(0)).isin(L.NOT_FIRST_NAMES))


def valid_time(text: Column) -> Column:
    return trim_entity(text).rlike(L.any_of(L.ENTITY_TIMES))


def bad_time_context(context: Column) -> Column:
    low = F.lower(context)
    return contains_any(low, L.NOT_TIME_CONTEXT) & ~contains_any(low, L.ACT_CONTEXT)


def clear_location(text: Column) -> Column:
    """A place that can be found: not vague, not a bare administrative unit, with a specific word or two units."""
    name = trim_entity(text)
    low = F.lower(name)
    specific = low.rlike(L.FLAGS + r"\b(?:" + "|".join(map(L.pattern, L.CLEAR_PLACES)) + ")")
    units = F.regexp_count(low, F.lit(L.any_of(L.ADMIN_WORDS, words=True))) >= 2
    return (F.length(name) >= 5) & ~low.isin(L.VAGUE_PLACES) & ~name.rlike(L.any_of([L.BARE_PLACE])) & (specific | (units & (count_words(name) >= 4)))


def bad_location_context(context: Column) -> Column:
    low = F.lower(context)
    return contains_any(low, L.NOT_PLACE_CONTEXT) & ~contains_any(low, L.ACT_CONTEXT)


def valid_sentence(text: Column) -> Column:
    low = F.lower(text)
    return ~low.contains("án phí") & ~low.contains("vật chứng") & (low.contains("tù") | low.rlike(L.any_of([L.FINE])))


def valid_span(start: Column, end: Column, label: Column, length: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & (end <= length) & label.isin(L.LABELS), F.lit(False))


