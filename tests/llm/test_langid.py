import math
import random
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexlake.llm import langid as G

from .conftest import EDGES, make_docs


def test_held_out_accuracy(docs):
    found = G.identify(docs, G.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 30 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_edges(spark, docs, edge_docs, no_docs):
    models = G.train(docs)
    rows = {str(r["doc_id"]): r for r in G.identify(edge_docs, models).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in ("1", "2", "3"))
    assert all(r["lang_pred"] in {"en", "de", "es", "fr"} for k, r in rows.items() if k not in ("1", "2", "3"))
    assert G.identify(no_docs, models).collect() == []
    nothing = G.train(no_docs)
    assert {r["lang_pred"] for r in G.identify(edge_docs, nothing).collect()} == {"und"} and len(EDGES) == edge_docs.count()
    one = G.train(make_docs(spark, [(k, "only one language here", "en", "s") for k in range(20)]))
    assert {r["lang_pred"] for r in G.identify(edge_docs.where("doc_id = 6"), one).collect()} == {"en"}


def test_prediction_reads_the_text_only(docs):
    models = G.train(docs)
    plain = {r["doc_id"]: r["lang_pred"] for r in G.identify(docs, models).collect()}
    blind = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("?"))
    assert {r["doc_id"]: r["lang_pred"] for r in G.identify(blind, models).collect()} == plain


def test_held_out_rows_are_not_learned(docs):
    spoilt = docs.withColumn("lang", F.when(G.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert "xx" not in G.train(spoilt).languages


class Plain:
    """Interpolated Kneser-Ney by dictionaries, for one language."""

    def __init__(self, texts, order, alphabet, discounts):
        self.order, self.uniform, self.discounts = order, 1 / (alphabet + 1), discounts
        self.counts = {order: Counter(t[k : k + order] for t in texts for k in range(len(t) - order + 1))}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.totals = {n: Counter() for n in self.counts}
        self.kinds = {n: Counter() for n in self.counts}
        for n, grams in self.counts.items():
            for g, c in grams.items():
                self.totals[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return self.uniform
        total = self.totals[n][gram[:-1]]
        if not total:
            return self.p(gram[1:])
        d = self.discounts[n]
        return (max(self.counts[n][gram] - d, 0) + d * self.kinds[n][gram[:-1]] * self.p(gram[1:])) / total


def test_models_against_dictionaries():
    rng = random.Random(4)
    order = 3
    texts = {name: [" " * (order - 1) + G.letters("".join(rng.choice(chars) for _ in range(60))) for _ in range(20)] for name, chars in (("a", "abcd  "), ("b", "cdefgh "))}
    counts = [Counter(t[i : i + order] for t in own for i in range(len(t) - order + 1)) for own in texts.values()]
    alphabet = len({g[-1] for own in counts for g in own})
    models, plain = G.Models(list(texts), order, []), []
    for own, rows in zip(texts.values(), counts):
        models.of.append(G.kneser_ney(np.array([[ord(c) + 1 for c in g] for g in rows], np.uint64), np.array(list(rows.values()), float), alphabet))
        discounts, level = {}, Counter(rows)
        for n in range(order, 0, -1):
            ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
            discounts[n] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
            level = Counter(g[1:] for g in level)
        plain.append(Plain(own, order, alphabet, discounts))
    shown = [G.letters(t) for t in ["abc dab", "ghz ef", "zzz", "a", "dcba " * 5]]
    want = [[-sum(math.log(m.p(t[max(0, k - order + 1) : k + 1])) for k in range(1, len(t))) / (len(t) - 1) for m in plain] for t in shown]
    assert np.allclose(models.entropies(shown), want)


def test_texts_score_alike_alone_together_and_in_pieces(docs, monkeypatch):
    models = G.train(docs)
    texts = [G.letters(r["text"]) for r in docs.limit(10).collect()] + ["", " a ", " "]
    texts.append(G.letters(" ".join(texts)))
    whole = models.entropies(texts)
    assert np.allclose([models.entropies([t])[0] for t in texts], whole)
    monkeypatch.setattr(G, "_PIECE", 97)
    monkeypatch.setattr(G, "_BATCH_CHARS", 1000)
    assert np.allclose(models.entropies(texts), whole)


@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), min_size=1, max_size=60))
def test_scores_never_fall_with_the_margin(pairs):
    n = np.array([a + b for a, b in pairs])
    margins, right = G.monotone(np.array([a for a, _ in pairs]), n)
    assert (np.diff(margins) > 0).all() and (np.diff(right) >= 0).all() and ((right >= 0) & (right <= 1)).all()
