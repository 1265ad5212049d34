from collections import Counter

import corpus_pipeline
from lexlake.llm import bpe

from .conftest import EDGES, make_docs
from .test_alike import brute_least
from .test_bpe_packing import check_pack
from .test_exact_dedup import LOWER
from .test_pii import base as spans
from .test_quality import brute as judged


def through(spark, docs, tmp_path):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, None).write.parquet(f"{tmp_path}/{k}")
        out.append(docs := spark.read.parquet(f"{tmp_path}/{k}"))
    return out


def test_stages_against_brute_force(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good, one, apart, clean, packed = through(spark, docs, tmp_path)
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {int(r[0]) for r in judged([(i, r["text"], r["source"]) for i, r in rows.items()]) if r[7]}
    assert {r["doc_id"] for r in good.collect()} == kept
    last = {}
    for i in sorted(kept):
        last[rows[i]["text"].translate(LOWER)] = i
    assert {r["doc_id"] for r in one.collect()} == set(last.values())
    ids = sorted(last.values())
    alone = set(brute_least([(i, rows[i]["text"]) for i in ids]))  # 5-word shingles, similarity 0.8
    assert {r["doc_id"] for r in apart.collect()} == alone
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(left) == alone and not any(spans(t) for t in left.values())
    assert sum(t != rows[i]["text"] for i, t in left.items()) >= sum(bool(spans(rows[i]["text"])) for i in left)
    for frame in (good, one, apart, clean):
        assert frame.columns == docs.columns
    from tokenizers import Tokenizer

    check_pack(packed.collect(), left, Tokenizer.from_file(bpe.vocabulary()))


def test_edges_and_empty_tables(spark, no_docs, edge_docs, tmp_path):
    assert [f.count() for f in through(spark, no_docs, tmp_path / "none")] == [0] * 5
    found = through(spark, edge_docs, tmp_path / "edges")
    assert all(f.columns == edge_docs.columns for f in found[:4])


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(Counter(r["sequence_id"] for r in rows).values()) >= 1


def test_edges_are_known():
    assert make_docs and len(EDGES) > 10
