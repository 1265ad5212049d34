import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm import repeats

from .conftest import EDGES, make_docs


def brute(rows, length=100):
    """(doc_id, bytes, removed, runs, digest of the rest) of rows (doc_id, text), each window looked up among all earlier ones."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        doc_id, data = rows[k][0], (rows[k][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - length + 1):
            window = data[a : a + length]
            gone[a : a + length] |= window in seen
            seen.add(window)
        runs = int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame, length=100):
    rows = repeats.find_repeats(frame, length).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.size("spans"), F.sha2("kept", 256)
    )
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_query_against_brute_force(spark, sf_dir, docs):
    rows = repeats.op11_suffix_merge_dedup(spark, sf_dir)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r) for r in rows.collect()), key=str) == want
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and sum(w[2] for w in want) > 0


def planted(seed, n=60):
    """Texts over few words, with copies, edited copies and passages that many share, some of them periodic."""
    draw = random.Random(seed)
    words = [x for x in "la été ß über 日本 no sí ab abc abcd".split()]
    make = lambda k: " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(k))
    shared = [make(30), make(60), "ab" * 90, "z" * 150]
    texts = []
    for _ in range(n):
        kind = draw.randrange(5)
        if kind == 0 and texts:
            texts.append(draw.choice(texts))
        elif kind == 1 and texts:
            old = draw.choice(texts)
            at = draw.randrange(len(old) + 1)
            texts.append(old[:at] + make(2) + old[at:])
        else:
            texts.append(make(draw.randrange(40)) + draw.choice(shared + ["", ""]) + make(draw.randrange(20)))
    return [(draw.randrange(10 * n) * 7 + k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [None, 16])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_texts(spark, monkeypatch, seed, hot):
    if hot:  # anchors in parts, blocks cut inside an anchor, several shards in each
        monkeypatch.setattr(repeats, "HOT_ROWS", hot)
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "SHARD_PIECES", 3)
    rows = list({i: (i, t) for i, t in planted(seed)}.values())
    frame = make_docs(spark, rows).repartition(3)
    assert found(frame) == brute(rows)
    if hot:
        assert len(repeats.hot_anchors(repeats._docs(frame), 100).anchors)


def test_edges(spark, edge_docs, no_docs):
    assert found(no_docs) == []
    rows = [r[:2] for r in EDGES]
    rows += [(20, "q" * 100), (20, "q" * 100), (21, "q" * 99), (None, "n" * 120), (None, "n" * 120), (22, "r" * 99), (22, "r" * 99)]
    assert found(make_docs(spark, rows)) == brute(rows)


def test_other_lengths(spark):
    rows = [(k, "abcabcabd" * k + "xyz") for k in range(1, 12)]
    for length in (1, 2, 7, 20):
        assert found(make_docs(spark, rows), length) == brute(rows, length)


def test_merged_intervals_are_those_of_all_windows():
    draw = random.Random(5)
    pieces = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 60))) for _ in range(50)]
    for size in (1, 7, 100):
        repeats.SHARD_PIECES, kept = size, repeats.SHARD_PIECES
        interval, piece, offset = repeats.merged_intervals(pieces, 9)
        repeats.SHARD_PIECES = kept
        by: dict = {}
        for p, x in enumerate(pieces):
            for o in range(len(x) - 8):
                by.setdefault(x[o : o + 9], set()).add((p, o))
        groups: dict = {}
        for i, p, o in zip(interval.tolist(), piece.tolist(), offset.tolist(), strict=True):
            groups.setdefault(i, set()).add((p, o))
        assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in by.values() if len(v) > 1)


def test_suffix_order():
    draw = random.Random(6)
    pieces = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 80))) for _ in range(40)] + [b"ab" * 50] * 3
    before, lf, of, offset = repeats.transform(pieces)
    order = list(zip(of.tolist(), offset.tolist(), strict=True))
    assert order == sorted(((p, o) for p, x in enumerate(pieces) for o in range(len(x) + 1)), key=lambda s: (pieces[s[0]][s[1] :], s[0]))
    place = {s: k for k, s in enumerate(order)}
    assert all(place[(p, o - 1)] == lf[k] and pieces[p][o - 1] + 1 == before[k] for k, (p, o) in enumerate(order) if o)
