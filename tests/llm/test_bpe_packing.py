import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexlake.llm import bpe, packing

from .conftest import EDGES, make_docs

PATH = bpe.vocabulary()
ODD = [
    "Hello  World's <|endoftext|> áé ß İ 123 #$% 😀ok", "", "  ", "ΑΣ ς", "a<|startoftext|>b", "don't 'sun we'll x\u0085y\x1cz", "²³½ ª º µ", "é café ｆｕｌｌ", "日本語 テスト",
    "x y" * 100_000, "😀" * 300, "don’t", "Ⅷ ⅷ ǅ", "\x00\x01 a\x7fb", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "é" * 40 + "1234",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_words_like_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefgh '.,1<|>éßİ\n😀ς") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    cache = bpe.word_bytes(PATH)
    ids = [[] for _ in texts]
    for k, values in cache.texts(texts):
        ids[k].extend(np.frombuffer(b"".join(values), "<u4").tolist())
    for text, found in zip(texts, ids):
        want = library.encode(text, add_special_tokens=False).ids
        assert found == want, text[:50]
        assert cache.encoder.decode(found) == library.decode(want, skip_special_tokens=False)


def test_cache_starts_anew_when_full(library):
    cache = bpe.WordCache(PATH, lambda ids: ids.tolist(), limit=20)
    texts = ["one two three four five", "six seven eight nine ten eleven twelve " * 3, "one <|endoftext|> two"] * 3
    found = [[] for _ in texts]
    for k, values in cache.texts(texts):
        found[k].extend(i for v in values for i in v)
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_on_edges(library, edge_docs, no_docs):
    want = []
    for doc_id, text, *_ in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((str(doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encode_decode(edge_docs, PATH).collect()) == sorted(want)
    assert bpe.encode_decode(no_docs, PATH).collect() == []


def test_encode_and_decode_columns(library, edge_docs):
    back = bpe.decode(bpe.encode(edge_docs, PATH), PATH).collect()
    for r in back:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def check_pack(rows, texts, library, tokens=4096):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == list(range(0, len(ids), tokens))
        for r in pieces:
            own = ids[r["start"] : r["start"] + tokens]
            assert r["length"] == len(own) and r["ids_crc32"] == zlib.crc32(own.tobytes())
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= tokens
    return len(filled), sum(filled.values())


def test_pack_documents(library, docs, no_docs):
    rows = packing.pack(docs, PATH).collect()
    n, total = check_pack(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, library)
    assert n <= -(-total // 4096) + 1
    assert packing.pack(no_docs, PATH).collect() == []


def test_pack_edges_in_small_groups(library, spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    monkeypatch.setattr(packing, "REPACK_ROWS", 5)
    edges = [(k, r[1]) for k, r in enumerate(EDGES)]
    check_pack(packing.pack(make_docs(spark, edges), PATH).collect(), dict(edges), library)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1200, 3000)
    limit = packing.Capacity(tokens=1200, documents=3, attention=700_000)
    bins, offsets = packing.best_fit(np.minimum(lengths, 800), limit, score)
    lengths = np.minimum(lengths, 800)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1200 and len(own) <= 3 and (own**2).sum() <= 700_000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum([0, *own[np.argsort(offsets[bins == b])][:-1]]))


def brute_fit(lengths, limit, score, weights):
    """Best-fit in plain numbers: a list of bins in order of opening, each a list of pieces."""
    most = limit.vector().tolist()
    bins, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (float(lengths[i]), 1.0, float(lengths[i]) ** 2)
        best = None
        for b, rest in enumerate(left):
            if all(r >= n for r, n in zip(rest, need)):
                if score == "norm":
                    value = sum(w * ((r - n) / m) ** 2 for w, r, n, m in zip(weights, rest, need, most))
                else:
                    value = -sum(w * (r / m) * (n / m) for w, r, n, m in zip(weights, rest, need, most))
                if best is None or value < best[0]:
                    best = (value, b)
        if best is None:
            bins.append([])
            left.append(list(most))
            best = (0, len(bins) - 1)
        bins[best[1]].append(i)
        left[best[1]] = [r - n for r, n in zip(left[best[1]], need)]
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (1.0, 1e-3, 1e-3), (0.0, 1.0, 2.0)])
@pytest.mark.parametrize("limit", [packing.Capacity(1200, 3, 700_000), packing.Capacity(1200), packing.Capacity(1200, 1000, 300_000), packing.Capacity(1200, 4)])
def test_scores_against_brute_force(score, weights, limit):
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.choice([rng.integers(1, 60, 400), rng.integers(1, 1300, 400)], axis=0).ravel()[:400], limit.longest)
    bins, _ = packing.best_fit(lengths, limit, score, weights)
    found = {}
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        found.setdefault(int(bins[i]), []).append(i)
    assert [found[b] for b in sorted(found)] == brute_fit(lengths.tolist(), limit, score, weights)


def test_tight_capacities_bind(spark, sf_dir):
    limit = packing.TIGHT
    rows = packing.packing_vector_capacities(spark, sf_dir).collect()
    assert all(r["tokens"] <= limit.tokens and r["documents"] <= limit.documents and r["attention"] <= limit.attention for r in rows)
    assert any(r["documents"] == limit.documents for r in rows) and any(r["attention"] > 0.98 * limit.attention for r in rows) and any(r["tokens"] > 0.95 * limit.tokens for r in rows)


def test_sequences_hold_the_ids(docs, library):
    made = packing.sequences(docs.limit(20), PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.limit(20).collect()}
    for row in made:
        at = 0
        for doc_id, piece, length in row["documents"]:
            ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 1]
            assert row["ids"][at : at + length] == ids[piece * 4096 : piece * 4096 + length]
            at += length
