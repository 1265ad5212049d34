import random

import pytest

from lexlake.llm import alike as A
from lexlake.llm import simhash as H

from .conftest import make_docs


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_least(rows):
    """Of each component of rows (doc_id, text) the least doc_id."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize(("pivots", "crowd"), [(2, 64), (0, 1), (1, 3)])
def test_near_copies_against_brute_force(spark, monkeypatch, pivots, crowd):
    monkeypatch.setattr(A, "PIVOTS", pivots)
    monkeypatch.setattr(A, "CROWD", crowd)
    rng = random.Random(3)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        copies = [words, *[changed(rng, words, max(1, len(words) * p // 1000)) for p in (5, 15, 30, 60)]]
        texts += [" ".join(w) for w in copies] + ([" ".join(copies[2]).upper()] if k % 5 == 0 else [])
    chain = [f"c{k}" for k in range(200)]
    for _ in range(30):  # each is near the one before, the ends are not near
        texts.append(" ".join(chain))
        chain = changed(rng, chain, 3)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    left = sorted(r["doc_id"] for r in H.drop_near_copies(make_docs(spark, rows)).collect())
    assert left == brute_least(rows) and len(left) < len(rows) / 2


def test_many_edited_copies_of_one_text(spark, monkeypatch):
    """Copies with one to twelve words changed, out of few words: not all are alike to another."""
    monkeypatch.setattr(A, "CROWD", 8)
    rng = random.Random(7)
    words = [f"w{rng.randrange(300)}" for _ in range(150)]
    texts = []
    for k in range(150):
        own = list(words)
        for at in rng.sample(range(len(own)), 1 + k % 12):
            own[at] = f"w{rng.randrange(40)}"
        texts.append(" ".join(own[: 150 - k % 3]))
    rows = list(enumerate(dict.fromkeys(texts)))
    left = sorted(r["doc_id"] for r in H.drop_near_copies(make_docs(spark, rows)).collect())
    assert left == brute_least(rows) and 1 < len(left) < len(rows)


def test_wordless_texts_are_alike(spark):
    rows = [(4, None), (2, ""), (3, " \n"), (5, "one two"), (1, "two one"), (6, "ONE  two")]
    assert sorted(r["doc_id"] for r in H.drop_near_copies(make_docs(spark, rows)).collect()) == [1, 2, 5]


def test_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = A.label_alike(docs).select("first.doc_id").distinct().collect()
    assert sorted(r["doc_id"] for r in found) == brute_least(rows)


def test_unlike_texts_with_one_or_no_id_stay(spark):
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    rows = [(None, text(k)) for k in range(20)] + [(7, text(30)), (7, text(31)), (7, text(31)), (8, text(32)), (9, text(32) + " end"), (None, text(32) + " end now")]
    left = H.drop_near_copies(make_docs(spark, rows))
    want = [(None, text(k)) for k in range(20)] + [(7, text(30)), (7, text(31)), (8, text(32))]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, want))


def test_exact_mode_needs_no_bands(spark, monkeypatch):
    """Bands that are useless: what is near is found by rare shingles alone."""
    import numpy as np

    rng = random.Random(11)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 60, 150]))]
        texts += [" ".join(changed(rng, words, n)) for n in (0, 1, 1, 2)]
    rows = list(enumerate(dict.fromkeys(texts)))
    bands = A.BANDS
    monkeypatch.setattr(A, "_band_keys", lambda hashes: np.arange(bands, dtype=np.uint64) + hashes[:1].sum() * np.uint64(1000003))
    frame = make_docs(spark, rows)
    least = lambda exact: sorted(r["doc_id"] for r in A.label_alike(frame, exact=exact).select("first.doc_id").distinct().collect())
    assert least(True) == brute_least(rows) and len(least(False)) > len(least(True))
