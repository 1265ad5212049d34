import hashlib
import random
from collections import defaultdict

import pytest

from lexlake.llm import exact_dedup as X

from .conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(found, rows):
    want = brute(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        assert (r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += 1
    assert kept == dict.fromkeys(by_hash, 1)


def test_edges(edge_docs, no_docs):
    check(X.label_copies(edge_docs).collect(), [(r[0], r[1]) for r in EDGES])
    assert X.label_copies(no_docs).collect() == []
    assert X.drop_copies(no_docs).collect() == []


def test_documents(docs):
    check(X.label_copies(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_drop_keeps_columns_and_one_row(edge_docs):
    left = X.drop_copies(edge_docs)
    assert left.columns == edge_docs.columns
    rows = left.collect()
    assert len(rows) == len(brute([(r[0], r[1]) for r in EDGES]))
    assert 7 in {r["doc_id"] for r in rows} and 6 not in {r["doc_id"] for r in rows}


def test_cuckoo_insert_delete_resize():
    rng = random.Random(3)
    index, live = X.CuckooIndex(4), {}
    for _ in range(20_000):
        digest = hashlib.sha256(str(rng.randrange(6000)).encode()).digest()
        if rng.random() < 0.6:
            assert index.insert(digest, len(live)) == (digest not in live)
            live[digest] = index.get(digest)
        else:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
    assert len(index) == len(live) and all(index.get(k) == v for k, v in live.items())
    assert index.get(b"\0" * 32) is None


@pytest.mark.parametrize("n", [10_000])
def test_equal_fingerprints_are_verified(n):
    index = X.CuckooIndex(8)
    digests = [i.to_bytes(8, "little") + b"\1\2" + i.to_bytes(22, "big") for i in range(n)]  # one 16-bit fingerprint for all
    for k, d in enumerate(digests):
        index.insert(d, k)
    assert all(index.get(d) == k for k, d in enumerate(digests))


def test_the_slots_alone_decide():
    """Whatever is taken out of a slot is gone from the index."""
    index = X.CuckooIndex()
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(1000)]
    for k, d in enumerate(digests):
        index.insert(d, k)
    for d in digests[:500]:
        index._contents[index.slot(d)] = (b"?" * 32, None)
    assert all(index.get(d) is None for d in digests[:500]) and all(index.get(d) == k for k, d in enumerate(digests[500:], 500))


def test_live_index_against_sql(spark, sf_dir):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = {tuple(r) for r in X.exact_dedup_live_index(spark, sf_dir).select("text_sha256", "keep_id", "n").collect()}
    assert found == set(connection.sql(X.SQL["exact_dedup_live_index"]).fetchall())


def test_update_index(spark, docs):
    rows = X.digest_rows(docs).cache()
    index = X.build_index(rows).cache()
    gone = index.limit(5)
    after = X.update_index(index, gone, gone)
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in index.collect()}
    assert X.update_index(index, gone.limit(0), gone).count() == index.count() - 5
