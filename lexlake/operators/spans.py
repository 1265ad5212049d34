"""Tokens, BIO tags, overlaps, alignment, re-anchoring and phrase search over span tables.

Annotated records are rows (record_id, text, spans array<struct<start, end, label>>); tokens are rows (record_id,
token_idx, token, start, end). Tokens and spans of a record meet in a sweep over their borders, in one sorted pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.predicates import valid_span

SPANS = "array<struct<start:int,end:int,label:string>>"


def _tokens(text: Column) -> Column:
    """array<struct<token, start, end>>: the non-space runs of a text with their positions, which are summed within the row."""
    # most texts are words with single blanks between: no expression is needed to cut them
    plain = (text != "") & ~text.rlike(r"(?U)[^\S ]|  |^ | $")
    words = F.when(plain, F.split(text, " ", -1)).otherwise(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))

    def rows(found: Column) -> Column:
        # a split at an expression compiles it for each row
        spaced = F.zip_with(found, F.slice(F.split(text, r"(?U)\S+", -1), F.lit(1), F.size(found)), lambda token, gap: F.length(gap) + F.length(token))
        ends = T.running_sums(F.when(plain, F.transform(found, lambda token, k: F.length(token) + F.least(k, F.lit(1)))).otherwise(spaced))
        return F.zip_with(found, ends, lambda token, end: F.struct(token.alias("token"), (end - F.length(token)).alias("start"), end.alias("end")))

    return T.let(words, rows)


def tokenize(records: DataFrame, text: str = "text") -> DataFrame:
    """The non-space runs of each record's text with their positions; nothing is shuffled."""
    each = records.select("record_id", F.posexplode(_tokens(F.col(text))).alias("token_idx", "x"))
    return each.select("record_id", "token_idx", "x.token", "x.start", "x.end")


#: Tokens that look for their spans together, among those that touch any of them.
_RUN = 64


def _tagged_tokens() -> Column:
    """array<struct<token, start, end, tag>> of the columns text and spans. Runs of tokens look at the spans that touch them only, so that a long record isn't all pairs."""
    layer = lambda s, k: F.struct(s["start"].cast("int").alias("start"), (s["start"] - s["end"]).cast("int").alias("shorter"), k.alias("span_idx"), s["end"].cast("int").alias("end"), T.label_alias(s["label"]).alias("label"))
    usable = F.filter(F.transform("spans", layer), lambda s: valid_span(s["start"], s["end"], s["label"], F.length("text")))
    spans = F.coalesce(F.array_sort(usable), F.array().cast("array<struct<start:int,shorter:int,span_idx:int,end:int,label:string>>"))

    def tagged(found: Column, laid: Column) -> Column:
        def run(k: Column) -> Column:
            part, before = F.slice(found, k * _RUN + 1, F.lit(_RUN)), F.get(found, k * _RUN - 1)["end"]
            return T.let(part, lambda tokens: T.let(F.filter(laid, lambda s: overlap(s["start"], s["end"], F.get(tokens, F.lit(0))["start"], F.element_at(tokens, -1)["end"])), lambda near: F.transform(tokens, lambda t, i: one(t, F.coalesce(F.get(tokens, i - 1)["end"], before, F.lit(-1)), near))))

        def one(token: Column, before: Column, near: Column) -> Column:
            # the last one laid stays; a token is a span's first where the one before it ends at the span's start or ahead of it
            tag = T.let(F.get(F.reverse(F.filter(near, lambda s: overlap(s["start"], s["end"], token["start"], token["end"]))), F.lit(0)), lambda s: F.concat(F.when(before <= s["start"], "B-").otherwise("I-"), s["label"]))
            return F.struct(token["token"].alias("token"), token["start"].alias("start"), token["end"].alias("end"), F.coalesce(tag, F.lit("O")).alias("tag"))

        runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _RUN).cast("int"))
        return F.when(F.size(found) > 0, F.flatten(F.transform(runs, run)))

    return T.let(_tokens(F.col("text")), lambda found: T.let(spans, lambda laid: tagged(found, laid)))


def tag_records(records: DataFrame, *kept: str, around: bool = False) -> DataFrame:
    """spans_to_bio(tokenize(records), explode_spans(records)) where text and spans stand in one row: found within it, so nothing is shuffled or joined.

    Columns: record_id, token_idx, token, start, end, tag, and those of `kept`; around: also last_token and next_token, null at the ends of a text.
    """
    if not around:
        each = records.select("record_id", *kept, F.posexplode(_tagged_tokens()).alias("token_idx", "x"))
        return each.select("record_id", "token_idx", "x.token", "x.start", "x.end", "x.tag", *kept)
    beside = lambda t, i: F.struct(t.alias("t"), F.get("_tagged", i - 1)["token"].alias("last_token"), F.get("_tagged", i + 1)["token"].alias("next_token"))
    # a generated column, so that tags are made once
    each = records.select("record_id", *kept, F.explode(F.array(_tagged_tokens())).alias("_tagged"))
    each = each.select("record_id", *kept, F.posexplode(F.transform("_tagged", beside)).alias("token_idx", "x"))
    return each.select("record_id", "token_idx", "x.t.token", "x.t.start", "x.t.end", "x.t.tag", *kept, "x.last_token", "x.next_token")


def tag_entities(records: DataFrame, strict: bool = True) -> DataFrame:
    """bio_to_entities(tag_records(records), strict), found within the row: record_id, label, first_token, last_token, start, end."""

    def entities(x: Column) -> Column:
        rest = lambda token: F.substring(token["tag"], F.lit(2), F.length(token["tag"]))  # noqa: E731  nothing for O, which no other has
        kind = lambda token: F.left(token["tag"], F.lit(1))
        opens = lambda t, i: (kind(t) == "B") | ((kind(t) == "I") & ~F.coalesce(rest(F.get(x, i - 1)) == rest(t), F.lit(False)))
        # an entity runs from a token that opens one to the next that opens one or is outside
        borders = F.filter(F.transform(x, lambda t, i: F.struct(i.alias("at"), opens(t, i).alias("opens"), kind(t).alias("kind"))), lambda m: m["opens"] | (m["kind"] == "O"))

        def run(found: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                last = F.coalesce(F.get(found, k + 1)["at"], F.size(x)) - 1
                label = F.substring(F.get(x, m["at"])["tag"], F.lit(3), F.length(F.get(x, m["at"])["tag"]))
                whole = F.struct(label.alias("label"), m["at"].alias("first_token"), last.alias("last_token"), F.get(x, m["at"])["start"].alias("start"), F.get(x, last)["end"].alias("end"))
                return F.when(m["kind"] == "B" if strict else m["opens"], whole)

            return F.filter(F.transform(found, one), lambda e: e.isNotNull())

        return T.let(borders, run)

    # a generated column, so that tags are made once
    tagged = records.select("record_id", F.explode(F.array(_tagged_tokens())).alias("_tagged"))
    return tagged.select("record_id", F.inline(entities(F.col("_tagged"))))


def token_windows(tokens: DataFrame, size: int = L.WINDOW_WORDS) -> DataFrame:
    """tokens with the number of their window and their place in it; no entity crosses a window."""
    return tokens.withColumn("window", F.floor(F.col("token_idx") / size).cast("int")).withColumn("place", F.col("token_idx") % size)


def explode_spans(records: DataFrame) -> DataFrame:
    """One row for each usable span of records (record_id, text, spans): labels by their aliases, bounds inside the text."""
    each = records.select("record_id", F.length("text").alias("length"), F.posexplode("spans").alias("span_idx", "s"))
    label = T.label_alias(F.col("s.label"))
    return each.where(valid_span(F.col("s.start"), F.col("s.end"), label, F.col("length"))).select("record_id", "span_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), label.alias("label"))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def _met(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with before and after of both borders: the last token that begins at or before the start, the one behind it, the last token that begins
    before the end, and the one before that. Each token is a struct (token_idx, start, end).

    A sweep over the record's borders: tokens and both ends of spans stand in one order, and each end looks at its neighbours among the tokens. The work is
    that of sorting tokens + spans; no pairs are made, however long a record is. Tokens must not overlap.
    """
    token = F.struct("token_idx", "start", "end")
    none = F.lit(None).cast("struct<token_idx:int,start:int,end:int>")
    span = F.struct("span_idx", "start", "end", "label")
    points = tokens.select("record_id", F.col("start").alias("at"), F.lit(1).alias("kind"), token.cast("struct<token_idx:int,start:int,end:int>").alias("token"), F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType).alias("span"))
    borders = F.array(F.struct(F.col("start").alias("at"), F.lit(2).alias("kind")), F.struct(F.col("end").alias("at"), F.lit(0).alias("kind")))  # at one position: ends of spans, then tokens, then starts of spans
    points = points.union(spans.select("record_id", F.inline(borders), none, span))
    over = "OVER (PARTITION BY record_id ORDER BY at, kind)"
    seen = points.select(
        "record_id", "kind", "span", F.expr(f"lag(token) IGNORE NULLS {over}").alias("last"), F.expr(f"lag(token, 2) IGNORE NULLS {over}").alias("second"), F.expr(f"lead(token) IGNORE NULLS {over}").alias("next")
    )
    of = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    ends = seen.where(F.col("span").isNotNull()).groupBy("record_id", "span").agg(of("last", 2).alias("from"), of("next", 2).alias("behind"), of("last", 0).alias("to"), of("second", 0).alias("ahead"))
    return ends.select("record_id", "span.*", "from", "behind", "to", "ahead")


def spans_to_bio(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens with tag. A token that overlaps a span is B at the span's first token and I at others.

    Spans are laid in order of start, the longer first, then as listed; later ones overwrite.
    """
    first = F.when(F.col("from.end") > F.col("start"), F.col("from.token_idx")).otherwise(F.col("behind.token_idx"))
    met = _met(tokens, spans).select("record_id", "span_idx", "start", "end", "label", first.alias("first"), F.col("to.token_idx").alias("last")).where("first <= last")
    layer = F.struct("start", (F.col("start") - F.col("end")).alias("shorter"), "span_idx").alias("layer")
    each = met.select("record_id", "label", "first", layer, F.explode(F.sequence("first", "last")).alias("token_idx"))
    tags = each.groupBy("record_id", "token_idx").agg(F.max_by(F.concat(F.when(F.col("token_idx") == F.col("first"), "B-").otherwise("I-"), F.col("label")), "layer").alias("tag"))
    # tags are as many as tokens inside spans, which Spark takes to be few: without the hint they all go to the driver
    return tokens.join(tags.hint("merge"), ["record_id", "token_idx"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def bio_to_entities(tagged: DataFrame, strict: bool = True) -> DataFrame:
    """Entities of tagged tokens: record_id, label, first_token, last_token, start, end.

    B opens an entity; I continues one of its label. strict: any other I is dropped; else it opens one.
    """
    kind, label = F.left("tag", F.lit(1)), F.substring("tag", F.lit(3), F.length("tag"))
    run = Window.partitionBy("record_id").orderBy("token_idx")
    marked = tagged.withColumn("kind", kind).withColumn("label", label)
    before = F.lag("label").over(run)
    opens = (F.col("kind") == "B") | ((F.col("kind") == "I") & ~F.coalesce((before == F.col("label")) & (F.lag("kind").over(run) != "O"), F.lit(False)))
    islands = marked.withColumn("island", F.sum(opens.cast("int")).over(run)).where("kind != 'O'")
    grouped = islands.groupBy("record_id", "island", "label").agg(
        F.min_by("kind", "token_idx").alias("head"), F.min("token_idx").alias("first_token"), F.max("token_idx").alias("last_token"), F.min("start").alias("start"), F.max("end").alias("end"))
    return (grouped.where("head = 'B'") if strict else grouped).drop("island", "head")


def drop_overlaps(spans: Column, longest: bool = False) -> Column:
    """An array of spans without those that overlap an earlier kept one; by start, then end (longest: longer first)."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"] if longest else s["end"]).alias("key"), s.alias("s")))
    element = "struct<start:int,end:int,label:string>"
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{element}>").alias("kept"))
    state = f"struct<last:int,kept:array<{element}>>"

    def step(acc: Column, x: Column) -> Column:
        s = x["s"]
        fits = s["start"] >= acc["last"]
        return F.when(fits, F.struct(s["end"].alias("last"), F.array_append(acc["kept"], s).alias("kept")).cast(state)).otherwise(acc)

    return F.aggregate(F.array_sort(keyed), zero.cast(state), step, lambda acc: acc["kept"])


def align_to_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with aligned_start and aligned_end at token borders, and misaligned.

    A span that is off shrinks to the tokens inside it, or, where there are none, grows to those it touches. Spans that touch no token go.
    """
    start, end = F.col("start"), F.col("end")
    touched = _met(tokens, spans).withColumn("out_start", F.when(F.col("from.end") > start, F.col("from.start")).otherwise(F.col("behind.start"))).withColumn("out_end", F.col("to.end")).where("out_start < out_end")
    in_start = F.when(F.col("from.start") == start, start).otherwise(F.col("behind.start"))
    in_end = F.when(F.col("to.end") <= end, F.col("to.end")).otherwise(F.col("ahead.end"))
    found = touched.withColumn("in_start", in_start).withColumn("in_end", in_end)
    inside = F.coalesce(F.col("in_start") < F.col("in_end"), F.lit(False))
    aligned = found.withColumn("aligned_start", F.when(inside, F.col("in_start")).otherwise(F.col("out_start"))).withColumn("aligned_end", F.when(inside, F.col("in_end")).otherwise(F.col("out_end")))
    off = (F.col("aligned_start") != start) | (F.col("aligned_end") != end)
    return aligned.select("record_id", "span_idx", "label", "start", "end", "aligned_start", "aligned_end", off.alias("misaligned"))


_ANCHORED = "struct<start:int,end:int,label:string,word:string>"
#: A run of white space in a text may be so much longer than the blank in a word.
_WIDEST = 21


def _find(text: Column, lowered: Column, word: Column, cursor: Column) -> Column:
    """struct(start, end) of the word's place: from the cursor on or else anywhere; as it stands, or else whatever its case, or else with other white space."""
    at = lambda hay, needle, start: F.nullif(F.call_function("locate", needle, hay, start + 1), F.lit(0)) - 1
    place = lambda start, length: F.when(start.isNotNull(), F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end")))
    literal = F.regexp_replace(word, r"([\\\[\](){}.*+?^$|\-])", r"\\$1")
    loose = F.concat(F.lit("(?iuU)"), F.regexp_replace(literal, r"(?U)\s+", rf"\\s{{1,{_WIDEST}}}"))

    def spaced(start: Column) -> Column:
        rest = F.substring(text, start + 1, F.length(text))
        return F.when(F.regexp_instr(rest, loose) > 0, place(start + F.regexp_instr(rest, loose) - 1, F.length(F.regexp_substr(rest, loose))))

    exact, folded = F.coalesce(at(text, word, cursor), at(text, word, F.lit(0))), F.coalesce(at(lowered, F.lower(word), cursor), at(lowered, F.lower(word), F.lit(0)))
    return F.coalesce(place(exact, F.length(word)), place(folded, F.length(word)), spaced(cursor), spaced(F.lit(0)))


def reanchor_spans(text: Column, spans: Column) -> Column:
    """An array of spans (start, end, label, word) moved to where their words stand, in order of start, without those that overlap an earlier one.

    One pass in the order given: places that hold the word stay, others are sought from the end of the furthest span before, so repeated words
    find their next place; what is nowhere is dropped. An end is that of the passage found, with its white space. Of spans with one start the longest stays.
    """

    def step(lowered: Column):
        def add(acc: Column, s: Column) -> Column:
            word = T.strip(F.coalesce(s["word"], F.lit("")))
            inside = F.coalesce((s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)), F.lit(False))
            own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
            stays = inside & ((word == "") | (T.compare_key(own) == T.compare_key(word)))
            place = F.when(stays, F.struct(s["start"].alias("start"), s["end"].alias("end"))).when(word != "", _find(text, lowered, word, acc["cursor"]))
            kept = lambda p: F.struct(
                F.greatest(acc["cursor"], p["end"]).alias("cursor"),
                F.array_append(acc["kept"], F.struct(p["start"].alias("start"), p["end"].alias("end"), s["label"].alias("label"), F.coalesce(F.nullif(word, F.lit("")), F.substring(text, p["start"] + 1, p["end"] - p["start"])).alias("word"))).alias("kept"),
            ).cast(state)
            return T.let(place, lambda p: F.when(p.isNull(), acc).otherwise(kept(p)))

        return add

    state = f"struct<cursor:int,kept:array<{_ANCHORED}>>"
    none = F.struct(F.lit(0).alias("cursor"), F.array().cast(f"array<{_ANCHORED}>").alias("kept")).cast(state)
    moved = T.let(F.lower(text), lambda lowered: F.aggregate(F.coalesce(spans, F.array().cast(f"array<{_ANCHORED}>")), none, step(lowered), lambda acc: acc["kept"]))
    keyed = F.array_sort(F.transform(moved, lambda s, k: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), k.alias("k"), s.alias("s"))))
    first = F.aggregate(keyed, none, lambda acc, x: F.when(x["start"] >= acc["cursor"], F.struct(x["s"]["end"].alias("cursor"), F.array_append(acc["kept"], x["s"]).alias("kept")).cast(state)).otherwise(acc), lambda acc: acc["kept"])
    return first


_GRAM = 4
#: Runs of phrases, at most, that are sent to all tasks; more are shuffled.
_FEW = 50_000


def _word_keys(text: Column) -> Column:
    return F.filter(F.transform(T.words(text), T.token_key), lambda w: w != "")


def _votes(pages: DataFrame, phrases: DataFrame) -> tuple[DataFrame | None, bool, bool]:
    """page_id, phrase_id, needed, first_word: a vote of each run of a page that a phrase has too; None if no phrase has a word. Whether some phrase needs
    several votes, and whether the runs are few.

    What Spark takes a page's runs to weigh is what their file does, so the side that is sent to all tasks isn't left to it.
    """
    gram = lambda words, at, k: F.xxhash64(F.array_join(F.slice(words, at + 1, F.lit(k) if isinstance(k, int) else k), " "))
    sought = phrases.select("phrase_id", _word_keys(F.col("text")).alias("run")).where(F.size("run") > 0).withColumn("k", F.least(F.size("run"), F.lit(_GRAM)))
    last = F.size("run") - F.col("k")
    offsets = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(_GRAM)), last))
    cut = sought.withColumn("offsets", offsets)
    known = {r["k"]: r for r in cut.groupBy("k").agg(F.count("*").alias("phrases"), F.sum(F.size("offsets")).alias("runs")).collect()}  # at most four rows
    if not known:
        return None, False, True
    runs = cut.select("phrase_id", "k", F.size("offsets").alias("needed"), F.explode(F.transform("offsets", lambda o: F.struct(o.alias("offset"), gram(F.col("run"), o, F.col("k")).alias("gram")))).alias("x"))
    runs = runs.select("phrase_id", "k", "needed", "x.offset", "x.gram")

    def grams(k: int) -> Column:
        places = F.sequence(F.lit(0), F.size("words") - k)
        return F.when(F.size("words") >= k, F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("at"), gram(F.col("words"), i, k).alias("gram"))))

    paged = pages.select("page_id", _word_keys(F.col("text")).alias("words"))
    each = paged.select("page_id", F.inline(F.flatten(F.filter(F.array(*map(grams, sorted(known))), lambda a: a.isNotNull()))))
    few = sum(r["runs"] for r in known.values()) <= _FEW
    met = each.join(F.broadcast(runs) if few else runs.hint("merge"), ["k", "gram"])
    return met.select("page_id", "phrase_id", "needed", (F.col("at") - F.col("offset")).alias("first_word")), any(r["runs"] > r["phrases"] for r in known.values()), few


def _agreed(votes: DataFrame) -> DataFrame:
    """page_id, phrase_id and first_word of the places for which all runs of a phrase voted."""
    found = votes.groupBy("page_id", "phrase_id", "first_word").agg(F.count("*").alias("votes"), F.max("needed").alias("needed"))
    return found.where("votes = needed").select("page_id", "phrase_id", "first_word")


def phrase_locate(pages: DataFrame, phrases: DataFrame, hits: int | None = None, longest: int | None = None) -> DataFrame:
    """Where phrases (phrase_id, text) stand in pages (page_id, text) as runs of words, case and punctuation aside.

    page_id, phrase_id, first_word, hit: the places of a phrase on a page, numbered from 1. A phrase is the hashes of its runs of four words, one behind the
    other and the last one at its end (a shorter phrase is one run); a page has the hash of the run at each of its words. Each run of a page that a
    phrase has too votes for where the phrase would begin, and a phrase stands where all its runs voted. Only rows move: the page's runs meet the phrases' by
    hash (few phrases are sent to all tasks), and votes are counted by partial sums, so that neither a page full of hits nor a
    phrase on every page is gathered anywhere. The limits are off unless given: a report of results takes hits=20 places of a
    phrase on a page, and phrases of longest=220 characters at most.
    """
    votes, _, _ = _votes(pages, phrases.where(F.length("text") <= longest) if longest is not None else phrases)
    if votes is None:
        return pages.select("page_id", F.lit(None).cast(phrases.schema["phrase_id"].dataType).alias("phrase_id"), F.lit(0).alias("first_word"), F.lit(0).alias("hit")).limit(0)
    numbered = _agreed(votes).withColumn("hit", F.row_number().over(Window.partitionBy("page_id", "phrase_id").orderBy("first_word")))
    return (numbered.where(F.col("hit") <= hits) if hits is not None else numbered).select("page_id", "phrase_id", "first_word", "hit")


def phrase_counts(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases with the number of their places on all pages (0: unmatched), as phrase_stats() of phrase_locate(), without listing the places.

    Phrases of the same words are sought once. Where one run is a whole phrase, its places are counted where they are found; only places of
    longer phrases are put together.
    """
    named = phrases.withColumn("_key", F.array_join(_word_keys(F.col("text")), " "))
    votes, several, few = _votes(pages, named.where("_key != ''").select(F.col("_key").alias("phrase_id"), F.col("_key").alias("text")).distinct())
    zero = F.lit(0).cast("long")
    if votes is None:
        return named.drop("_key").withColumn("occurrences", zero)
    count = lambda places: places.groupBy("phrase_id").agg(F.count("*").alias("occurrences"))
    counts = count(votes.where("needed = 1"))
    if several:
        counts = counts.union(count(_agreed(votes.where("needed > 1"))))
    counts = counts.withColumnRenamed("phrase_id", "_key")
    return named.join(F.broadcast(counts) if few else counts.hint("merge"), "_key", "left").drop("_key").withColumn("occurrences", F.coalesce("occurrences", zero))


def phrase_stats(phrases: DataFrame, found: DataFrame) -> DataFrame:
    """phrases with the number of their places (0: unmatched)."""
    counts = found.groupBy("phrase_id").agg(F.count("*").alias("occurrences"))
    return phrases.join(counts, "phrase_id", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0).cast("long")))


def unmatched(stats: DataFrame, most: int = 80) -> DataFrame:
    """The longest `most` phrases without a place, ties by phrase_id: a report's cap."""
    return stats.where("occurrences = 0").orderBy(F.desc(F.length("text")), "phrase_id").limit(most)


def decode_predictions(scores: DataFrame, tags: list[str]) -> DataFrame:
    """scores (record_id, token_idx, scores array, mask) as tagged tokens: the best tag of each token that counts."""
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return scores.where("mask and size(scores) > 0").select("record_id", "token_idx", F.element_at(F.array(*map(F.lit, tags)), best).alias("tag"))


def export_bio(tagged: DataFrame) -> DataFrame:
    """record_id and block: a line `token<TAB>tag` for each token."""
    line = F.struct("token_idx", F.concat_ws("\t", "token", "tag").alias("line"))
    return tagged.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("block"))


def bio_tags() -> list[str]:
    return ["O", *[f"{k}-{label}" for label in L.LABELS for k in "BI"]]
