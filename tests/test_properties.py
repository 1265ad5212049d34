"""Properties of splits, spans and metrics, and totals of a published corpus."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexlake.functions import lexicon as L
from lexlake.operators import corpus as C
from lexlake.operators import evaluate as V
from lexlake.operators import spans as X
from lexlake.operators import tagger
from lexlake.plans import fixture
from lexlake.sources import readers as R
from lexlake.sources import sinks as K


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    return fixture.records_with_spans(spark, sf_dir).cache()


@pytest.mark.parametrize("rounded", [True, False])
def test_no_source_in_two_splits(spark, records, rounded):
    split = C.split_by_source(records, rounded=rounded)
    assert split.count() == records.count() and C.leaks(split).count() == 0
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count_distinct("source").alias("n")).collect()}
    assert sizes == {"train": 170, "dev": 20, "test": 10}
    assert {tuple(r) for r in split.select("record_id", "split").collect()} == {tuple(r) for r in C.split_by_source(records.repartition(9), rounded=rounded).select("record_id", "split").collect()}


@pytest.mark.parametrize(("n", "want"), [(3, {"train": 1, "dev": 1, "test": 1}), (9, {"train": 6, "dev": 2, "test": 1}), (1, {"train": 1}), (12, {"train": 10, "dev": 1, "test": 1})])
def test_small_splits(spark, n, want):
    rows = spark.createDataFrame([(f"s{k}",) for k in range(n)], "source string")
    assert {r["split"]: r["n"] for r in C.split_by_source(rows).groupBy("split").agg(F.count("*").alias("n")).collect()} == want


def test_tokens_lie_where_they_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("record_id"), "text")
    texts = {r["record_id"]: r["text"] for r in docs.collect()}
    tokens = X.tokenize(docs).collect()
    assert all(texts[r["record_id"]][r["start"] : r["end"]] == r["token"] for r in tokens)
    assert len(tokens) == sum(len(t.split()) for t in texts.values())


def test_bio_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        words = ["w" * rng.randint(1, 6) for _ in range(30)]
        text, ends = " ".join(words), []
        for w in words:
            ends.append((sum(e - s + 1 for s, e in ends), sum(e - s + 1 for s, e in ends) + len(w)))
        cuts = sorted(rng.sample(range(30), 6))
        rows.append((str(k), text, [(ends[a][0], ends[b - 1][1], rng.choice(L.LABELS)) for a, b in zip(cuts[::2], cuts[1::2])]))
    frame = spark.createDataFrame(rows, f"record_id string, text string, spans {X.SPANS}")
    tagged = X.spans_to_bio(X.tokenize(frame), X.explode_spans(frame))
    found = {(r["record_id"], r["start"], r["end"], r["label"]) for r in X.bio_to_entities(tagged).collect()}
    assert found == {(k, s, e, label) for k, _, spans in rows for s, e, label in spans}


def test_stray_inside_tags(spark):
    rows = [("a", k, "x", k, k + 1, t) for k, t in enumerate(["I-DRUG", "B-DRUG", "I-DRUG", "I-PERSON", "O", "I-PERSON", "B-PERSON", "B-PERSON"])]
    tagged = spark.createDataFrame(rows, "record_id string, token_idx int, token string, start int, end int, tag string")
    spans = lambda strict: sorted((r["first_token"], r["last_token"], r["label"]) for r in X.bio_to_entities(tagged, strict).collect())
    assert spans(True) == [(1, 2, "DRUG"), (6, 6, "PERSON"), (7, 7, "PERSON")]
    assert spans(False) == [(0, 0, "DRUG"), (1, 2, "DRUG"), (3, 3, "PERSON"), (5, 5, "PERSON"), (6, 6, "PERSON"), (7, 7, "PERSON")]


@pytest.mark.parametrize("longest", [True, False])
def test_kept_spans_are_apart(spark, longest):
    rng = random.Random(2)
    rows = [([(s, s + rng.randint(1, 9), "DRUG") for s in rng.choices(range(50), k=20)],) for _ in range(40)]
    for (given,), r in zip(rows, spark.createDataFrame(rows, f"spans {X.SPANS}").select("spans", X.drop_overlaps(F.col("spans"), longest).alias("kept")).collect()):
        kept = [tuple(s) for s in r["kept"]]
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:])) and set(kept) <= set(given)
        assert all(any(max(g[0], k[0]) < min(g[1], k[1]) for k in kept) for g in given)


def test_counts_add_up(spark, sf_dir):
    rated = V.prf_exact(fixture.gold(spark, sf_dir), fixture.predicted(spark, sf_dir, "model_b")).collect()
    assert all(r["tp"] + r["fn"] == r["support"] and r["tp"] + r["fp"] == r["predicted"] for r in rated)
    perfect = V.prf_exact(fixture.gold(spark, sf_dir), fixture.gold(spark, sf_dir)).where("label = 'overall'").first()
    assert perfect["f1"] == 1.0


def test_dedupe_twice_is_once(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a  b", "a b", " ", "c", "a b "])], "doc_id int, idx int, text string")
    once = C.dedupe_first(rows, "doc_id")
    assert [(r["idx"], r["text"]) for r in once.orderBy("idx").collect()] == [(0, "a b"), (3, "c")]
    assert {tuple(r) for r in C.dedupe_first(once, "doc_id").collect()} == {tuple(r) for r in once.collect()}


def test_totals_of_the_published_corpus(spark):
    """The published totals of records, judgments and entities by split, added up by doc_stats()."""
    splits = {"train": (2303, 85, 2793), "dev": (264, 10, 366), "test": (106, 5, 109)}
    made = [(f"{s}{k}", f"{s}-{k % docs}", s, n // rec + (k < n % rec)) for s, (rec, docs, n) in splits.items() for k in range(rec)]
    frame = spark.createDataFrame(made, "record_id string, source string, split string, n int")
    spans = frame.select("record_id", F.explode(F.array_repeat(F.lit("DRUG"), F.col("n"))).alias("label"))
    found = {r["split"]: (r["records"], r["documents"], r["entities"]) for r in C.doc_stats(frame, spans).collect()}
    assert found == splits | {"all": (2673, 100, 3268)}


def test_prior_weights(spark):
    weights = {r["tag"]: round(r["weight"], 4) for r in C.class_weights(C.prior_counts(spark)).collect()}
    assert weights["B-DRUG"] == 1.0 and weights["I-CHARGE"] == round((519 / 116) ** 0.5, 4) and weights["O"] == 0.25 and len(weights) == 17
    absent = {r["tag"]: r["weight"] for r in C.class_weights(spark.createDataFrame([("DRUG", 9), ("PERSON", 0), ("CHARGE", 1), ("SENTENCE", 4)], "label string, n long")).collect()}
    assert (absent["B-PERSON"], absent["B-CHARGE"], absent["B-SENTENCE"]) == (2.5, 3.0, 1.5)


LINES = [
    '{"id": 1, "text": "abc", "labels": [[0, 1, "DRUG"]], "meta": {"source": "s"}}', "", "{broken", '{"labels": []}', '{"text": "x", "labels": null}', '{"text": "x", "labels": 5}',
    '{"text": "abcd", "label": [[0, 2, "DEFENDANT"], [1, 99, "DRUG"], [2, 1, "DRUG"], [0, 1, "NOPE"]]}', '{"text": "abcd", "entities": [{"start": 1, "end": 3, "entity": "DRUG"}]}',
]


def test_readers_on_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(LINES))
    (tmp_path / "in/skip.jsonl").write_text(LINES[0])
    lines = R.read_lines(spark, f"{tmp_path}/in", "*.jsonl")
    good, bad = R.records_and_rejects(lines)
    assert good.count() == 5 and R.load_corpus(spark, f"{tmp_path}/in", exclude=("skip.jsonl",)).count() == 4
    assert sorted((r["line_no"], r["error"]) for r in bad.collect()) == [(3, "json"), (4, "text"), (6, "labels")]
    spans = {(r["start"], r["end"], r["label"]) for r in X.explode_spans(good).collect()}
    assert spans == {(0, 1, "DRUG"), (0, 2, "PERSON"), (1, 3, "DRUG")}
    strict = R.strict_records(lines)
    for read in (strict.collect, strict.count, strict.select("record_id").collect, strict.groupBy("source").count().collect, strict.select(F.lit(1)).collect, strict.agg(F.max("line_no")).collect):
        with pytest.raises(Exception, match="bad record .json. in a.jsonl:3"):
            read()
    assert R.strict_records(lines.where("line_no not in (3, 4, 6)")).count() == 5
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/BA 5 (2).txt").write_text("một\nhai")
    assert [tuple(r) for r in R.read_documents(spark, f"{tmp_path}/docs").collect()] == [("BA 5", "một\nhai")]


def test_records_keep_what_they_came_with(spark):
    whole = {"id": "a::1", "text": "Lò Văn H", "labels": [[0, 8, "PERSON"]], "stray": {"x": [1, 2.5, None]}, "meta": {"source": "s", "source_file": "orig.jsonl", "section": "noi_dung", "ner_targets": ["DRUG"], "para_idx": 3, "split": "dev"}}
    others = [{"text": "t", "labels": None, "label": [[0, 1, "DRUG"]], "meta": None}, {"text": "t", "label": [[0, 1, "DRUG"]], "meta": [1]}, {"text": "t", "meta": {"source": None}}]
    lines = spark.createDataFrame([("f.jsonl", k, json.dumps(x, ensure_ascii=False)) for k, x in enumerate([whole, *others])], "source_file string, line_no int, line string")
    good, bad = R.records_and_rejects(lines)
    assert bad.count() == 0 and [r["line"] for r in good.orderBy("line_no").collect()] == [r["line"] for r in lines.collect()]
    merged = [json.loads(r["value"]) for r in K.merged_lines(good.orderBy("line_no")).collect()]
    named = {"source": "f", "source_file": "f.jsonl"}
    assert merged == [whole, {"text": "t", "label": [[0, 1, "DRUG"]], "labels": [], "meta": named}, {"text": "t", "labels": [[0, 1, "DRUG"]], "meta": named}, {"text": "t", "labels": [], "meta": {"source": None, "source_file": "f.jsonl"}}]
    written = {(x := json.loads(r["value"]))["id"]: x for r in K.annotated_lines(good.withColumn("split", F.lit("test"))).collect()}
    assert written["a::1"] == whole | {"meta": whole["meta"] | {"split": "test"}}
    assert written["f.jsonl:2"] == {"id": "f.jsonl:2", "text": "t", "labels": [[0, 1, "DRUG"]], "meta": named | {"split": "test"}}


def test_line_numbers_of_files_that_are_split(spark, tmp_path):
    made = {f"{name}.jsonl": [f"{name} line {k}" if k % 7 else "" for k in range(n)] for name, n in (("a", 900), ("b", 5), ("c", 1300))}
    for name, lines in made.items():
        (tmp_path / name).write_text("\r\n".join(lines) + "\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        read = R.read_lines(spark, str(tmp_path), "*.jsonl")
        assert read.select("line").rdd.getNumPartitions() > 1
        found = sorted(tuple(r) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == sorted((name, k + 1, line) for name, lines in made.items() for k, line in enumerate(lines))


def test_sinks(spark, records, tmp_path):
    split = C.split_by_source(records.limit(50))
    K.write_split(split, f"{tmp_path}/split")
    read = R.records_and_rejects(spark.read.text(f"{tmp_path}/split").select(F.lit("f").alias("source_file"), F.lit(1).alias("line_no"), F.col("value").alias("line")))[0]
    key = lambda d: {(r["record_id"], r["source"], r["text"], r["split"], tuple(map(tuple, r["spans"]))) for r in d.collect()}
    assert key(read) == key(split)
    stats = C.split_stats(split, X.explode_spans(records.limit(50)))
    K.write_stats_csv(stats, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 11
    tagged = X.spans_to_bio(X.tokenize(records.limit(3)), X.explode_spans(records.limit(3)))
    K.write_bio(tagged, f"{tmp_path}/bio")
    assert sum("\t" in r[0] for r in spark.read.text(f"{tmp_path}/bio").collect()) == tagged.count()


def test_metrics_tables(spark):
    a = spark.createDataFrame([("DRUG", 0.5, 0.5, 0.5, 3), ("OVERALL", 0.5, 0.5, 0.6, 3)], "`Entity type` string, Precision double, Recall double, F1 double, Support int")
    b = spark.createDataFrame([("PERSON", 0.9, 0.9, 0.9, 1), ("overall", 0.1, 0.1, 0.1, 1)], "label string, precision double, recall double, f1 double, support int")
    both = R.load_metrics({"a": a, "b": b}, L.LABELS)
    assert both.count() == 18 and [r["model"] for r in V.rank_models(both).collect()] == ["a", "b"]
    best = {r["label"]: r["best"] for r in V.best_model(V.side_by_side(both, ["a", "b"]), ["a", "b"]).collect()}
    assert best["DRUG"] == "a" and best["PERSON"] == "b" and best["CHARGE"] == "a / b"


def test_select_best_tagger(spark, records):
    some = records.limit(120)
    tagged = X.spans_to_bio(X.tokenize(some), X.explode_spans(some)).cache()
    dev = tagged.where(F.col("record_id").endswith("0"))
    train = tagged.where(~F.col("record_id").endswith("0"))
    model, params, f1 = tagger.select_best(train, dev, [{"reg": 10.0, "rounds": 2, "hashed": 256}, {"reg": 0.001, "rounds": 10, "hashed": 1024}])
    assert params["reg"] == 0.001 and f1 > 0.8 and model is not None


def test_phrases(spark):
    pages = spark.createDataFrame([(1, "The Cat, sat on the cat sat."), (2, "x " * 30 + "cat " * 30)], "page_id int, text string")
    phrases = spark.createDataFrame([(1, "the CAT"), (2, "dog"), (3, "cat"), (4, "w " * 200)], "phrase_id int, text string")
    found = X.phrase_locate(pages, phrases, hits=20, longest=220)
    assert {tuple(r) for r in found.where("page_id = 1").collect()} == {(1, 1, 0, 1), (1, 1, 4, 2), (1, 3, 1, 1), (1, 3, 5, 2)}
    assert found.where("page_id = 2 and phrase_id = 3").count() == 20
    assert X.phrase_locate(pages, phrases).where("page_id = 2 and phrase_id = 3").count() == 30
    assert X.phrase_locate(pages.union(spark.createDataFrame([(3, "w " * 250)], pages.schema)), phrases).where("phrase_id = 4").count() == 51
    assert X.phrase_locate(pages, phrases.limit(0)).count() == 0
    words = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    text = " ".join(words + ["x"] + words[:8] + ["y"] + words + words)
    wanted = {1: " ".join(words), 2: " ".join(words[:4]), 3: "c d e", 4: " ".join([*words, *words]), 5: " ".join(words[4:] + ["x"]), 6: "a b c d x", 7: "i a b c d e"}
    hay = spark.createDataFrame([(1, text), (2, "nothing"), (3, ""), (4, None)], "page_id int, text string")
    stood = {(r["phrase_id"], r["first_word"]) for r in X.phrase_locate(hay, spark.createDataFrame(list(wanted.items()), "phrase_id int, text string")).collect()}
    runs = {k: v.split() for k, v in wanted.items()}
    assert stood == {(k, at) for k, run in runs.items() for at in range(len(text.split())) if text.split()[at : at + len(run)] == run}
    stats = X.phrase_stats(phrases, found)
    assert [r["phrase_id"] for r in X.unmatched(stats).collect()] == [4, 2]


def test_statistics_file_begins_with_a_byte_order_mark(spark, tmp_path):
    from lexlake.sources import sinks as K

    K.write_stats_csv(spark.createDataFrame([(1, 'a "b", c', 5), (0, "#x", 7)], "row_order int, name string, n int"), f"{tmp_path}/stats")
    (part,) = (tmp_path / "stats").glob("part-*")
    assert part.read_bytes().decode() == '﻿name,n\n#x,7\n"a ""b"", c",5\n'


@pytest.mark.parametrize(
    ("text", "spans", "want"),
    [
        ("Điều 249 và Điều 249", [(None, None, "Điều 249"), (None, None, "Điều 249")], [(0, 8), (12, 20)]),
        ("Ông Lò   Văn H", [(None, None, "Lò Văn H")], [(4, 14)]),
        ("Lò Văn H", [(None, None, "Lò   Văn  H")], [(0, 8)]),
        ("x (a.b) y", [(5, 99, "(a.b)"), (-1, 3, "Y")], [(2, 7), (8, 9)]),
        ("a b a", [(4, 5, "a"), (None, None, "a"), (None, None, "b")], [(0, 1), (2, 3), (4, 5)]),  # nothing behind the cursor: anywhere
        ("abcdef", [(0, 3, "abc"), (0, 5, "abcde"), (4, 6, "ef")], [(0, 5)]),  # the longest of one start, then what overlaps nothing
        ("abc", [(0, 2, ""), (None, None, ""), (1, 2, None)], [(0, 2)]),
        ("abc", [(0, 1, "zz"), (0, 1, "A")], [(0, 1)]),
        ("", [(0, 1, "a")], []),
        ("abc", None, []),
    ],
)
def test_reanchor(spark, text, spans, want):
    kind = "text string, spans array<struct<start:int,end:int,label:string,word:string>>"
    frame = spark.createDataFrame([(text, spans and [(a, b, "DRUG", w) for a, b, w in spans])], kind)
    (row,) = frame.select(X.reanchor_spans(F.col("text"), F.col("spans")).alias("s")).collect()
    assert [(s["start"], s["end"]) for s in row["s"]] == want and all(s["word"] for s in row["s"])


def brute_tags(tokens, spans):
    """Tag of each token by trying all spans, laid in order of start, the longer first, then as listed."""
    tags = ["O"] * len(tokens)
    for a, b, label in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        hit = [k for k, (x, y) in enumerate(tokens) if max(a, x) < min(b, y)]
        for n, k in enumerate(hit):
            tags[k] = ("I-" if n else "B-") + label
    return tags


def brute_aligned(tokens, span):
    a, b = span[:2]
    touched = [t for t in tokens if max(a, t[0]) < min(b, t[1])]
    inside = [t for t in touched if t[0] >= a and t[1] <= b] or touched
    return (inside[0][0], inside[-1][1]) if inside else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(60):
        text = "".join(draw.choice("ab  ") for _ in range(draw.randrange(40)))
        spans = [(a, a + draw.randrange(1, 12), draw.choice(L.LABELS)) for a in (draw.randrange(max(1, len(text))) for _ in range(draw.randrange(8)))]
        rows.append((f"r{k}", text, [s for s in spans if s[1] <= len(text)]))
    frame = spark.createDataFrame(rows, "record_id string, text string, spans array<struct<start:int,end:int,label:string>>").repartition(3)
    tokens, spans = X.tokenize(frame), X.explode_spans(frame)
    tagged, aligned = {}, {}
    for r in X.spans_to_bio(tokens, spans).orderBy("token_idx").collect():
        tagged.setdefault(r["record_id"], []).append(r["tag"])
    for r in X.align_to_tokens(tokens, spans).collect():
        aligned[(r["record_id"], r["span_idx"])] = (r["aligned_start"], r["aligned_end"])
        assert r["misaligned"] == ((r["aligned_start"], r["aligned_end"]) != (r["start"], r["end"]))
    import re

    for name, text, own in rows:
        places = [m.span() for m in re.finditer(r"\S+", text)]
        assert tagged.get(name, []) == brute_tags(places, own)
        assert {k: v for k in range(len(own)) if (v := brute_aligned(places, own[k]))} == {k: aligned[(name, k)] for k in range(len(own)) if (name, k) in aligned}


def test_sweep_over_one_long_record(spark):
    """100,000 tokens and 10,000 spans in one record: all pairs would be a thousand million."""
    tokens = spark.range(100_000).select(F.lit("r").alias("record_id"), F.col("id").cast("int").alias("token_idx"), F.lit("ab").alias("token"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 2).cast("int").alias("end"))
    spans = spark.range(10_000).select(F.lit("r").alias("record_id"), F.col("id").cast("int").alias("span_idx"), (F.col("id") * 30).cast("int").alias("start"), (F.col("id") * 30 + 8).cast("int").alias("end"), F.lit("DRUG").alias("label"))
    counts = {r["tag"]: r["count"] for r in X.spans_to_bio(tokens, spans).groupBy("tag").count().collect()}
    assert counts == {"B-DRUG": 10_000, "I-DRUG": 20_000, "O": 70_000}
    assert X.align_to_tokens(tokens, spans).where("not misaligned").count() == 10_000


def test_statistics_of_odd_splits(spark):
    records = spark.createDataFrame([("a", "s", "train"), ("b", "s", "other"), ("c", "t", None), ("d", None, "dev")], "record_id string, source string, split string")
    spans = spark.createDataFrame([("a", "DRUG"), ("a", "DRUG"), ("b", "PERSON"), ("gone", "DRUG")], "record_id string, label string")
    rows = {r["name"]: (r["train"], r["dev"], r["test"], r["all"]) for r in C.split_stats(records, spans).collect()}
    assert rows["DRUG"] == (2, 0, 0, 2) and rows["PERSON"] == (0, 0, 0, 1) and rows["#Entities in total"] == (2, 0, 0, 3)
    assert rows["#Rows/snippets in total"] == (1, 1, 0, 4) and rows["#Source judgments in total"] == (1, 0, 0, 2) and len(rows) == 11
    assert {tuple(r)[2:] for r in C.split_stats(records.limit(0), spans.limit(0)).collect()} == {(0, 0, 0, 0)}


def test_a_large_source_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.col("id").cast("string").alias("record_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("noi_dung").alias("section"), F.array(F.lit("DRUG")).alias("ner_targets"), F.lit(1).alias("record_idx"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        K.write_records(rows, f"{tmp_path}/out", rows_per_file=4000)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {p.name.split("-")[1] for p in (tmp_path / "out/source=hot").glob("part-*")}
    assert len(files) > 1 and all(sum(1 for _ in p.open()) <= 4000 for p in (tmp_path / "out").rglob("part-*"))
    assert spark.read.text(f"{tmp_path}/out").count() == 20_000


def test_history(spark):
    at = "2024-01-0{} 00:00:00".format
    rows = [("a", at(1), "", None, None, 5, {"DRUG": ["x"], "PERSON": None}), ("a", at(3), "f2", "m2", "n2", None, None), ("b", at(2), "g", None, "n", 7, {}), ("c", at(4), None, "", "", 1, {"DRUG": ["x", "y"]})]
    results = spark.createDataFrame(rows, "id string, saved_at string, filename string, model_display_name string, model_name string, elapsed_ms long, entities map<string,array<string>>")
    log = C.history_entries(results)
    marks = lambda *m: C.history_deletes(spark.createDataFrame(list(m), "id string, at string"))
    show = lambda frame: {(r["id"], r["filename"], r["model"], r["elapsed_ms"], r["count"]) for r in C.live_history(frame).collect()}
    a, b, c = ("a", "f2", "m2", None, 0), ("b", "g", "n", 7, 0), ("c", "Không rõ tên", "PhoBERT", 1, 2)
    assert show(log) == {a, b, c}
    assert show(log.unionByName(marks(("b", at(5)), ("a", at(2))))) == {a, c}  # a was saved again after its delete
    assert show(log.unionByName(marks((None, at(3))))) == {a, c}  # what is saved at the time of a clearing stays
    assert show(log.limit(0)) == set() and [r["id"] for r in C.top_history(C.live_history(log), 2).collect()] == ["c", "a"]


def test_expiry_over_a_restart(spark, tmp_path):
    from lexlake.streaming import annotate as A

    def run(*rows):
        spark.createDataFrame([(i, f"2024-01-01 {t}:00") for i, t in rows], "id string, saved_at string").select("id", F.col("saved_at").cast("timestamp").alias("saved_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = A.expire_stream(spark.readStream.schema("id string, saved_at timestamp").parquet(f"{tmp_path}/in"), ttl_seconds=3600, late="10 minutes")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["id"], r["saved_at"].strftime("%H:%M"), r["move"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("a", "10:00", "added"), ("b", "10:30", "added")]
    assert run(("a", "10:00"), ("b", "10:30"), ("a", "10:20"), (None, "10:00")) == first
    # a restart from the checkpoint: b is renewed, a's latest result is an hour and more behind the watermark of 11:30
    second = sorted([*first, ("a", "10:20", "expired"), ("c", "11:40", "added")])
    assert run(("b", "11:20"), ("c", "11:40")) == second
    # results behind the watermark are ignored, whether of a known id or a new one
    assert run(("z", "10:00"), ("b", "09:00"), ("c", "11:41")) == second
    assert run(("d", "14:00")) == sorted([*second, ("b", "11:20", "expired"), ("c", "11:41", "expired"), ("d", "14:00", "added")])


def test_model_choice(spark, records, tmp_path, monkeypatch):
    some = records.limit(120)
    tagged = X.spans_to_bio(X.tokenize(some), X.explode_spans(some)).join(some.select("record_id", "source"), "record_id")
    dealt = tagger.in_folds(some.select("source"), 3)
    assert dealt.groupBy("source").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and dealt.select("fold").distinct().count() == 3
    rated = iter([0.5, 0.7, 0.6, 0.6, 0.5, 0.7, 0.9])
    monkeypatch.setattr(tagger, "train_token_classifier", lambda *_, **params: params)
    monkeypatch.setattr(tagger, "tag_tokens", lambda model, dev: dev)
    monkeypatch.setattr(tagger, "prf_sequence", lambda *_: spark.createDataFrame([("overall", next(rated))], "label string, f1 double"))
    tried = tagger.cross_validate(tagged, [{"reg": r} for r in (1.0, 2.0, 3.0, 4.0)], folds=2, patience=2)
    assert [t["params"]["reg"] for t in tried] == [1.0, 2.0, 3.0] and tried[0]["mean"] == 0.6  # none is better: patience ends before the fourth
