"""Columns of documents whose names operators use inside keep their values."""

import pytest

from pyspark.sql import functions as F

from lexlake.llm import bpe, chat, common, exact_dedup, pii, quality, simhash

NAMES = ["_KEY", "_key_", "_cuts", "island", "row_id", "name", "digest", "text_hash", "row_hash", "keep_id", "node", "first", "a.b", "found"]


def text(k):
    return " ".join(f"w{k}x{i}" for i in range(30)) + f" mail me{k}@mail.example.com"


@pytest.fixture(scope="module")
def rows():
    return [(k, text(k), "en", "s", 99, *(f"{c}-{k}" for c in NAMES)) for k in range(6)]


@pytest.fixture(scope="module")
def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))


@pytest.mark.parametrize("stage", [quality.keep_good, exact_dedup.drop_copies, simhash.drop_near_copies, pii.redact])
def test_values_stay(clashing, rows, stage):
    left = stage(clashing)
    assert left.columns == clashing.columns
    assert sorted((r[0], *r[5:]) for r in left.collect()) == [(r[0], *r[5:]) for r in rows]


def test_rows_that_differ_in_other_columns_only(spark):
    """One row stays, always the same one, in whatever order rows come and whatever types columns have."""
    kind = "doc_id long, text string, lang string, source string, m map<string,int>, _key string"
    rows = [(1, text(1), "en", None, {"a": k}, f"k{k}") for k in range(4)] + [(1, text(1), "en", None, {"a": 3}, "k3")] * 3
    for stage in (exact_dedup.drop_copies, simhash.drop_near_copies):
        found = {tuple(map(str, stage(spark.createDataFrame(order, kind)).collect())) for order in (rows, rows[::-1], rows[3:] + rows[:3])}
        assert len(found) == 1 and len(next(iter(found))) == 1
    assert quality.keep_good(spark.createDataFrame(rows, kind)).count() == 7


def test_names(clashing):
    assert common.free_name(clashing, "_key") == "_key__" and common.free_name(clashing, "other") == "other"


def test_formatting_keeps_columns_and_replaces_those_named_as_its_results(spark):
    long = "x [INST] \\ " * 20_000
    rows = [("kept", "kept too", "old", "old", "old", "old", "old", long), ("kept", "kept too", "old", "old", "old", "old", "old", "")]
    frame = spark.createDataFrame(rows, "_pieces string, _PARTS string, formatted string, loss_mask string, turns string, layout string, fingerprint string, text string")
    asked = frame.withColumn("record", F.to_variant_object(F.struct(F.col("text").alias("prompt"), F.col("text").alias("response"))))
    done = chat.read_back(chat.format_turns(chat.canonical_turns(asked).drop("record")))
    for r in done.collect():
        assert (r["_pieces"], r["_PARTS"], r["loss_text"]) == ("kept", "kept too", r["text"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", r["text"]), ("assistant", r["text"])] and r["formatted"] != "old"


def test_encoding_replaces_a_column_of_its_name(clashing):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    known = Tokenizer.from_file(path)
    coded = bpe.decode(bpe.encode(clashing, path, into="found"), path, ids="found", into="first")
    assert sorted(coded.columns) == sorted(clashing.columns)
    for r in coded.collect():
        ids = known.encode(r["text"], add_special_tokens=False).ids
        assert r["found"] == ids and r["first"] == known.decode(ids, skip_special_tokens=False) and r["island"].startswith("island") and r["a.b"].startswith("a.b")
