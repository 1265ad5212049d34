import zlib

import pytest

from lexlake.llm import shards as S

from .conftest import EDGES, make_docs


def check(rows, texts, shards=8):
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]


def brute(rows, shards=8, target=None):
    """Leaves in order, as lists of doc_ids, by sorting every node as a whole."""

    def split(own, k):
        size = sum(r["size"] for r in own)
        if (target and (size <= target or len(own) < 2)) or (not target and k < 2) or not own:
            return [[r["doc_id"] for r in own]] if own else []
        d = max(("d0", "d1", "d2"), key=lambda c: max(r[c] for r in own) - min(r[c] for r in own))
        part, whole = (1, 2) if target else (k // 2, k)
        before, left, right = 0, [], []
        for r in sorted(own, key=lambda r: (r[d], r["text_hash"], r["doc_key"], r["row_id"])):
            (left if before + r["size"] / 2 < size * (part / whole) else right).append(r)
            before += r["size"]
        return split(left, k // 2) + split(right, k - k // 2)

    return split(rows, shards)


@pytest.mark.parametrize(("how", "window_rows"), [({"shards": 8}, 40), ({"shards": 5}, 0), ({"shards": 1}, 0), ({"target_bytes": 20_000}, 40), ({"target_bytes": 1}, 1 << 20)])
def test_tree_against_brute_force(docs, monkeypatch, how, window_rows):
    monkeypatch.setattr(S, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(S, "SLACK", 0)
    monkeypatch.setattr(S, "BINS", 1 << 20)
    leaves = {}
    for r in S.kd_shards(docs, **how).collect():
        leaves.setdefault(r["shard"], set()).add(r["doc_id"])
    want = brute(S.metadata(docs).collect(), how.get("shards", 8), how.get("target_bytes"))
    assert [leaves[k] for k in range(len(leaves))] == [set(x) for x in want]


def test_edges(edge_docs, no_docs):
    check(S.kd_shards(edge_docs).collect(), [r[1] for r in EDGES])
    assert S.kd_shards(no_docs).collect() == []


def test_documents_are_near_equal(docs):
    rows = S.kd_shards(docs).collect()
    sizes = check(rows, [r["text"] for r in docs.collect()])
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_a_group_of_copies_larger_than_a_shard_is_cut(spark):
    texts = ["the same text " * 30] * 900 + [f"text number {k} " * 30 for k in range(900)]
    sizes = check(S.kd_shards(make_docs(spark, list(enumerate(texts)))).collect(), texts)
    assert max(sizes) < 1.02 * min(sizes)


def test_repeated_rows_without_ids(spark):
    sizes = check(S.kd_shards(make_docs(spark, [(None, "abc", None, None)] * 64)).collect(), ["abc"] * 64)
    assert sizes == [32] * 8


def test_other_numbers_of_shards(docs):
    rows = S.kd_shards(docs, shards=5).collect()
    sizes = check(rows, [r["text"] for r in docs.collect()], 5)
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    target = sum(sizes) // 3
    assert max(check(S.kd_shards(docs, target_bytes=target).collect(), [r["text"] for r in docs.collect()], 4)) <= target


def test_target_bytes_with_rows_above_it(spark):
    texts = ["x" * 999, "", "", "y" * 599, *["z" * 99] * 10]
    sizes = check(S.kd_shards(make_docs(spark, list(enumerate(texts))), target_bytes=400).collect(), texts, 20)
    assert sorted(x for x in sizes if x > 400) == [600, 1000], "only single rows stay above the target"


def test_does_not_depend_on_partitions(docs):
    place = lambda d: {r["doc_id"]: r["shard"] for r in S.kd_shards(d).collect()}
    assert place(docs.repartition(7)) == place(docs.coalesce(1))
