"""Predicates share their signals, and expressions that were put together otherwise find what they found."""

import re

from pyspark.sql import functions as F

from lexlake.functions import lexicon as L
from lexlake.functions import predicates as P
from lexlake.functions import text as T
from lexlake.plans import cases, registry

SHARED = ("is_noise", "is_strict_crime", "keep_drug_mention", "is_relevant_content", "is_reasoning_fact")


def test_each_signal_is_made_once(spark, sf_dir):
    plan = registry.load()[0]["judgment_predicates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # weight looks for a drug's name by itself, too
    assert plan.count(L.any_of(L.DRUG_NAMES, words=True) + ")") == 2
    assert plan.count(L.any_of(L.CRIME_ACTIONS, words=True) + ")") == 1


def test_shared_signals_give_what_predicates_give(spark):
    units = spark.createDataFrame([(t,) for yes, no in cases.UNITS.values() for t in yes + no] + [(None,)], "text string")
    pairs = [(getattr(P, name)(F.col("text")), getattr(P, name)(F.col("text"), F.col("signals"))) for name in SHARED]
    assert P.with_signals(units).where(~F.forall(F.array(*[a.eqNullSafe(b) for a, b in pairs]), lambda x: x)).count() == 0


def test_letters_in_front_are_shared_and_the_earlier_phrase_wins():
    assert L.any_of(["ab", "a c", "ad?"], flags="") == r"(?:a(?:b|\s+c|d?))"
    assert L.any_of(["x?y", "xz", r"\bw"], flags="") == r"(?:x?y|xz|\bw)"
    for phrases in (["tổ", "tổ chức", "t"], ["tổ chức", "tổ"], ["a", "a", "b|c"]):
        plain = re.compile("|".join(map(L.pattern, phrases)))
        grouped = re.compile(L.any_of(phrases, flags=""))
        for text in ("tổ chức tổ", "xtổ", "a b c", ""):
            assert grouped.findall(text) == plain.findall(text), (phrases, text)


def test_pieces_are_those_of_split(spark):
    texts = ["1. a 2) b 12. c", "a\x01b 3. c", "", None, "x"]
    expression = r"(?U)(?=\b\d{1,2}\s*[.)]\s+)"
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = lambda c: F.filter(c, lambda x: x != "")
    found = rows.select(whole(T.pieces(F.col("t"), expression)).alias("a"), whole(F.split("t", expression)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found) and found[0]["a"] == ["1. a ", "2) b ", "12. c"]
