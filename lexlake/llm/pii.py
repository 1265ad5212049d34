"""Personal data by candidate gradient boosting, with built-in functions and Spark ML only.

High-recall generators propose spans, which may overlap: the four base kinds and looser ones (number groups, long mixed
tokens, spelled-out addresses). Each candidate gets features of its kind, its format (lengths, digits, groups) and its
context (neighbouring characters). Boosted trees are fitted on all candidates but those held back, as distinct rows of features with their numbers.

Labels come from signals that no feature shows the trees: the check digit of cards, the range of the parts of IP addresses, the number of
digits of phones, the ending of spelled-out addresses, and, for numbers and tokens, a cue word right before the match. A cue makes
a positive; a number or token without one is unlabelled, not negative. So for these two kinds the trees, which see the format of a match and what
touches it but neither words nor signs before it, learn how often a format is announced. On the quarter of the candidates that they were not fitted
on, the share of announced ones among the best-scoring candidates (as many as hold half of the announced ones) says how often true ones are
announced at all. Where that share is LEAST_TOLD or more, a candidate counts as right with its own share over that one, and unannounced ones of
the format are found too; where it is less, plain numbers and words look like personal data, and none of the kind is added. For the other kinds the
share is 1. The threshold of a kind is the least score from which on at least PRECISION of the kept-out candidates are right.

Base spans that pass their rules always stay. Of other candidates above their threshold, those inside a base span go; of the rest
the best stay: by score, then length, then start, then kind, each that overlaps none chosen before it.

Positions are code points, from the lengths of the matches and of the pieces between them, summed by windows over one
text's candidates. Texts are scanned once and leave only candidates behind. Patterns are possessive and anchored at
run borders, so that a long run costs time in proportion to its length, and never a deep stack.

Defined results: a null text is empty and has no spans; repeated rows are judged each; with candidates of one class only, or none
kept back of a kind, no span of it is added to the base; a very long text is scanned as a whole, within its row; an empty table gives
an empty result; other columns, whatever their names, are ignored by find() and kept by redact().
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
#: Patterns equal in effect to the base ones, written so that they can't run long; and the loose generators.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,29}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "address": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]++)++",
}
#: What a text must hold for a generator to run on it at all.
_TRIGGERS = {"email": "@", "phone": "+", "address": "at"}
KINDS = tuple(PATTERNS)
#: Words that announce personal data (fixed values).
CUES = "token|key|secret|password|passwd|pwd|auth|bearer|ssn|iban|account|card|phone|tel|call|mail|passport"
CONTEXT = 24
HELD_BACK = 4
PRECISION = 0.97
#: Kinds of which only announced ones are labelled, and the share of announced ones that a format must have.
UNLABELLED = ("number", "secret")
LEAST_TOLD = 0.5
TREES, DEPTH = 12, 3
FEATURES = ["length", "letters", "upper", "spaces", "dashes", "dots", "brackets", "groups", "mixed", "plus", "at_sign", "before_word", "after_word", "after_dot", "distinct", "hex", *[f"is_{k}" for k in KINDS]]


def _generate(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, before, match, after>>: the matches of one generator, left to right."""
    pattern = F.lit(PATTERNS[kind])

    def row(pieces: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"),
                m.alias("match"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after"),
            ),
        )

    able = text.contains(_TRIGGERS[kind]) if kind in _TRIGGERS else text.rlike("[0-9]")
    return F.when(able & text.rlike(PATTERNS[kind]), common.let(F.split(text, PATTERNS[kind], -1), row))


def candidate_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the candidates (found) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    made = [F.coalesce(_generate(F.col("text"), kind), F.array().cast("array<struct<kind:string,i:int,gap:int,before:string,match:string,after:string>>")) for kind in KINDS]
    return slim.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(*made).alias("found"))


def _count(column: str, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern))


def candidates(rows: DataFrame) -> DataFrame:
    """A row for each candidate of rows (row_id, found): row_id, kind, start, end, base, label and the features."""
    each = rows.select("row_id", F.inline("found")).repartition("row_id")
    before = Window.partitionBy("row_id", "kind").orderBy("i")
    length = F.length("match")
    placed = each.withColumn("start", F.sum("gap").over(before.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(length).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    digits, kind, near = F.regexp_replace("match", "[^0-9]", ""), F.col("kind"), F.lower("before")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    featured = placed.select(
        "row_id", "kind", "start", (F.col("start") + length).alias("end"), length.alias("length"), _count("match", "[A-Za-z]").alias("letters"),
        _count("match", "[A-Z]").alias("upper"), _count("match", " ").alias("spaces"), _count("match", "-").alias("dashes"), _count("match", r"\.").alias("dots"), _count("match", r"[()\[\]]").alias("brackets"),
        _count("match", "[0-9]++").alias("groups"), _count("match", "[0-9][A-Za-z]|[A-Za-z][0-9]").alias("mixed"), F.col("match").startswith("+").cast("int").alias("plus"), F.col("match").contains("@").cast("int").alias("at_sign"),
        F.col("before").rlike(r"[\p{L}\p{N}]$").cast("int").alias("before_word"), F.col("after").rlike(r"^[\p{L}\p{N}]").cast("int").alias("after_word"),
        F.col("after").rlike("^[.][A-Za-z0-9]").cast("int").alias("after_dot"), F.size(F.array_distinct(F.split(F.left("match", F.lit(64)), ""))).alias("distinct"), F.col("match").rlike("^(?:[0-9a-f]++|[0-9A-F]++)$").cast("int").alias("hex"),
        *[(kind == k).cast("int").alias(f"is_{k}") for k in KINDS],
        F.when(kind == "email", F.lit(True)).when(kind == "ip", F.col("match").rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.length(digits).between(12, 19) & F.call_function("luhn_check", F.left(digits, F.lit(20)))).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(False)).alias("base"),
        near.rlike(f"(?:{CUES})[^a-z0-9]*$").alias("cue"), F.col("match").rlike(r"(?:\.|dot[)\]] ?)[A-Za-z]{2,6}$").alias("ending"),
    )
    label = F.when(kind.isin("number", "secret"), F.col("cue")).when(kind == "address", F.col("ending")).otherwise(F.col("base"))
    return featured.withColumn("label", label.cast("int")).drop("cue", "ending")


def fit(found: DataFrame):
    """(model, thresholds by kind), or None where there is one class only.

    All candidates count: they are grouped to distinct rows of features with their numbers as weights, so that a training pass reads a smaller table.
    """
    counted = found.agg(F.count("*").alias("n"), F.sum("label").alias("right")).first()
    if not counted["right"] or counted["right"] == counted["n"]:
        return None
    part = F.pmod(F.xxhash64("start", "row_id", "kind"), F.lit(HELD_BACK)) == 0
    grouped = common.checkpoint(found.groupBy("kind", *FEATURES, "label", part.alias("back")).agg(F.count("*").cast("double").alias("weight")))
    classes = {r["label"] for r in grouped.where("not back").select("label").distinct().collect()}
    if len(classes) < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False)
    model = trees.fit(assembler.transform(grouped.where("not back").withColumn("label", F.col("label").cast("double"))))
    scored = score(grouped.where("back"), model).groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("bin")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("right"))
    bins: dict[str, list] = {kind: [] for kind in KINDS}
    for r in sorted(scored.collect(), key=lambda r: -r["bin"]):  # at most 101 bins of a kind
        bins[r["kind"]].append((r["bin"] / 100, r["n"], r["right"]))
    least = {kind: _threshold(own, kind in UNLABELLED) for kind, own in bins.items()}
    return model, {kind: x for kind, x in least.items() if x is not None}


def _threshold(bins: list[tuple[float, float, float]], unlabelled: bool) -> float | None:
    """The least score of bins (score, candidates, labelled ones), best first, from which on enough of them are right."""
    known, n, right = sum(b[2] for b in bins), 0.0, 0.0
    told = 1.0
    if unlabelled:
        for _, size, labelled in bins:
            n, right = n + size, right + labelled
            if right >= known / 2:
                break
        told = right / n if n and known else 0.0
        if told < LEAST_TOLD:
            return None
    n, right, out = 0.0, 0.0, None
    for value, size, labelled in bins:
        n, right = n + size, right + labelled
        if right >= PRECISION * told * n:
            out = value
    return out


def score(found: DataFrame, model) -> DataFrame:
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    return model.transform(assembled).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _islands(spans: DataFrame) -> DataFrame:
    """spans with a number for each run of overlapping spans of a row."""
    order = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    begins = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("_begins", begins.cast("int")).withColumn("island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def select_spans(rows: DataFrame) -> DataFrame:
    """row_id, kind, start, end, base of all spans that stay; rows come from candidate_rows() with a row_id."""
    found = common.checkpoint(candidates(rows))
    slim = ["row_id", "kind", "start", "end", "base"]
    fitted = fit(found)
    if fitted is None:
        return found.where("base").select(slim)
    model, thresholds = fitted
    bound = F.lit(2.0)
    for kind, least in thresholds.items():
        bound = F.when(F.col("kind") == kind, least).otherwise(bound)
    open_ = score(found, model).where(F.col("base") | (F.col("score") >= bound)).select(*slim, "score")
    covers = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(covers) >= F.col("end"), F.lit(False))
    fresh = open_.withColumn("_told", told).where(F.col("base") | ~F.col("_told")).drop("_told")
    # the added spans of an island lie in one text and overlap one another
    span = F.struct((-F.col("score")).alias("worse"), (F.col("start") - F.col("end")).alias("shorter"), "start", "kind", "end")
    grouped = _islands(fresh.where("not base")).groupBy("row_id", "island").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    added = grouped.select("row_id", F.explode(_best(F.col("spans"))).alias("s")).select("row_id", "s.kind", "s.start", "s.end", F.lit(False).alias("base"))
    return fresh.where("base").select(slim).union(added.select(slim))


def _best(spans: Column) -> Column:
    """Of an array of spans, best first, each that overlaps none chosen before it."""
    none = F.filter(spans, lambda s: F.lit(False))
    free = lambda chosen, s: ~F.exists(chosen, lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"]))
    return F.when(F.size(spans) == 1, spans).otherwise(F.aggregate(spans, none, lambda chosen, s: F.when(free(chosen, s), F.array_append(chosen, s)).otherwise(chosen)))


def _listed(only: Column) -> Column:
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = F.array_sort(F.collect_list(F.when(only, F.struct("start", order.alias("order"), "end", "kind"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of each row."""
    rows = common.checkpoint(common.with_row_id(candidate_rows(docs)))
    spans = select_spans(rows.where(F.size("found") > 0).select("row_id", "found"))
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE]
    listed = spans.groupBy("row_id").agg(*counts, _listed(F.col("base")).alias("base_spans"), _listed(F.lit(True)).alias("spans"))
    joined = rows.select("row_id", "doc_id").join(listed, "row_id", "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars, where there is one, counted anew.

    Equal texts have equal spans; the columns used meanwhile have names that docs doesn't use.
    """
    rows = common.checkpoint(common.with_row_id(candidate_rows(docs)).where(F.size("found") > 0).dropDuplicates(["text_hash"]))
    spans = _islands(select_spans(rows.select("row_id", "found")))
    merged = spans.groupBy("row_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    key, cuts = common.free_name(docs, "_key"), common.free_name(docs, "_cuts")
    listed = merged.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(cuts))
    named = rows.select("row_id", F.col("text_hash").alias(key)).join(listed, "row_id").select(key, cuts)
    joined = docs.withColumn(key, common.text_hash(F.col("text"))).join(named, key, "left")

    def cut(at: Column) -> Column:
        kept = F.transform(at, lambda c, i: F.concat(_slice(F.col("text"), F.coalesce(F.get(at, i - 1)["end"], F.lit(0)), c["start"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
        return F.concat(F.array_join(kept, ""), _slice(F.col("text"), F.element_at(at, -1)["end"], F.length("text")))

    done = joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(common.let(F.col(cuts), cut)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*common.columns_of(docs))


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"))


QUERIES = {"op9_pii_boosting": op9_pii_boosting}
#: Boosted trees have no SQL counterpart; tests/llm compares the base with brute force.
SQL: dict[str, str] = {}
