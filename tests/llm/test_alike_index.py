"""The near-duplicate stage searches the Gray-order index over SimHash fingerprints first."""

import random

import numpy as np
import xxhash

from lexlake.llm import alike as A

from .conftest import make_docs


def test_index_finds_alike_texts_without_bands(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(words)]
    for k in range(12):
        texts.append(" ".join([*words[: 100 * k], "changed", *words[100 * k + 1 :]]))
    texts.append("quite another text stands here")
    prints = [A._fingerprint(A.shingles(t)) for t in texts]
    close = sum((prints[0] ^ p).bit_count() <= 2 for p in prints[1:-1])
    assert close > 0
    monkeypatch.setattr(A, "_band_keys", lambda s: np.array([xxhash.xxh64_intdigest(s.tobytes(), k) for k in range(A.BANDS)], np.uint64))  # no two texts share a band
    found = {r["doc_id"]: r["first"]["doc_id"] for r in A.label_alike(make_docs(spark, list(enumerate(texts)))).collect()}
    assert len(found) == len(texts) and sum(first == 0 for first in found.values()) >= 1 + close and found[len(texts) - 1] == len(texts) - 1
