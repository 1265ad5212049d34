import random

import numpy as np
import pytest
import xxhash

from lexlake.llm import simhash as H

from .conftest import EDGES, make_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = np.array([xxhash.xxh64(s, seed=42).intdigest() for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if int((hashes >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(hashes))


def brute_groups(prints, bits=2):
    """prints: list of fingerprints; root place of each."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    codes = np.array(prints, np.uint64)
    for a in range(len(codes)):
        for b in np.flatnonzero(np.bitwise_count(codes[a] ^ codes[a + 1 :]) <= bits) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(root))]


def check(found, rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_groups(prints)
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    want = sorted((str(i), f"{p:016x}", str(least.get(r))) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted((str(r["doc_id"]), f"{r['fp'] & (1 << 64) - 1:016x}", str(r["component_id"])) for r in found) == want


def test_edges(edge_docs, no_docs):
    check(H.label_groups(edge_docs).collect(), [(r[0], r[1]) for r in EDGES])
    assert H.label_groups(no_docs).collect() == []
    assert H.drop_near_copies(no_docs).collect() == []


def test_documents(docs):
    check(H.label_groups(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def chain(rng, n):
    """Fingerprints of which many are one or two bits apart, in long chains and dense balls."""
    out = []
    for _ in range(n // 50):
        code = rng.getrandbits(64)
        for _ in range(50):
            out.append(code)
            for _ in range(rng.choice([1, 2, 2, 3])):
                code ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize(("block", "hot_block"), [(1 << 20, 1 << 20), (1024, 16_384), (64, 16_384), (64, 8), (1, 2)])
def test_links_against_brute_force(spark, block, hot_block):
    prints = sorted(set(chain(random.Random(5), 1500)))
    nodes = spark.createDataFrame([(H._signed(p),) for p in prints], "fp long")
    found = H.components(H.links(nodes, block=block, hot_block=hot_block)).collect()
    roots = brute_groups(prints)
    label = {H._signed(p): H._signed(p) for p in prints} | {r["node"]: r["root"] for r in found}
    groups = {}
    for p, r in zip(prints, roots):
        groups.setdefault(r, set()).add(label[H._signed(p)])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_gray_index_finds_all():
    rng = random.Random(9)
    codes = np.array(sorted(set(chain(rng, 2000))), np.uint64)
    index = H.GrayIndex(codes)
    q, at = index.search(codes[:300], 2)
    want = {(k, int(c)) for k in range(300) for c in codes[np.bitwise_count(codes[k] ^ codes) <= 2]}
    assert {(int(a), int(index.codes[b])) for a, b in zip(q, at)} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    assert {(r["node"], r["root"]) for r in H.components(edges).collect()} == {(k, 0) for k in range(201)} | {(1000, 1000), (1001, 1000)}


def test_drop_keeps_the_least(spark):
    docs = make_docs(spark, [(5, "one two three four"), (3, "ONE two three four"), (9, "other words stand here now"), (3, "ONE two three four")])
    left = H.drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 9] and left.columns == docs.columns
