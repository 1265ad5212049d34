"""Language identification with interpolated Kneser-Ney character models.

For each language seen in training, an order-N character model: counts of N-grams come from Spark, lower orders from distinct
continuations, an absolute discount for each order. A language's model is fitted in one task, from the bounded sample's counts, and
kept as sorted arrays of 64-bit N-gram hashes, one for each order, with the log-probability and the back-off weight beside each
hash: 16 bytes a gram that the language has, whatever the number of languages. (Texts of 2,000 documents have some 80,000 grams of
all orders in an alphabetic script, so that 200 languages take some 260 MB on the driver and in each worker.) A text is scored
by binary search in those arrays, backing off order by order, and the language of the least cross-entropy per character wins.
Many texts are scored together: each distinct N-gram of a batch is looked up once.

Texts are lower-cased; every run of characters that aren't letters or marks becomes one boundary, so that digits, junk and
white space say nothing about the language.

Calibration. A part of the training sample is kept out of the models; on it, cross-entropies and margins are
histogrammed by Spark. A text is rejected (column `rejected`) when its cross-entropy is above that of all but REJECT_SHARE of the
kept-out texts; score is the share of right answers among kept-out texts with a like margin, made monotone.

Training uses a bounded sample of labelled rows: at most SAMPLE_DOCS for each language on average, drawn by a hash of
doc_id, with their whole texts. Prediction covers every row and whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the language first in order; with no
training rows every text is `und`; repeated rows are scored each; a very long text is scored piece by piece, with the characters before
each piece in view; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
SAMPLE_DOCS = 2_000
HELD_BACK = 5  # one of so many sample documents calibrates
REJECT_SHARE = 0.005
_PIECE = 1 << 16
_BATCH_CHARS = 1 << 18
_BINS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """The text as the models see it: words of letters, each with a boundary before and behind."""
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip(" ") + " "


def _codes(text: str) -> np.ndarray:
    """Code points + 1; 0 stands before the beginning of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def hash_rows(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of codes."""
    if grams.shape[1] == 0:
        return np.zeros(len(grams), np.uint64)
    out = grams[:, 0].astype(np.uint64) * _MIX
    for k in range(1, grams.shape[1]):
        out = (out ^ (out >> np.uint64(29)) ^ grams[:, k].astype(np.uint64)) * _MIX
    return out


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


@dataclass
class Model:
    """One language. For each order n from 1: sorted hashes, log-probabilities, and log back-off weights of grams as contexts."""

    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float

    def score(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log-probabilities. grams[n - 1], contexts[n - 1]: hashes of the last n characters, and of those without the last one."""
        order = len(self.hashes)
        out, left = np.zeros(len(grams[0])), np.arange(len(grams[0]))
        for n in range(order, 0, -1):
            at, hit = _find(self.hashes[n - 1], grams[n - 1][left])
            out[left[hit]] += self.logp[n - 1][at[hit]]
            left = left[~hit]
            if n == 1:
                out[left] += self.unseen
            elif len(left):  # the context's weight, if the context was seen, then the next order
                at, hit = _find(self.hashes[n - 2], contexts[n - 1][left])
                out[left[hit]] += self.backoff[n - 2][at[hit]]
        return out


@dataclass
class Models:
    languages: list[str]
    order: int
    of: list[Model]
    worst: float = float("inf")
    margins: np.ndarray | None = None
    right: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy in nats per character: a row for each text, a column for each language. Texts as letters() gives them."""
        total, count = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), _PIECE):
                codes = _codes(text[max(0, at - self.order + 1) : at + _PIECE])
                lack = self.order - 1 - min(at, self.order - 1)
                if at == 0:  # the first character is a given boundary
                    lack -= 1
                padded = np.concatenate([np.zeros(max(lack, 0), np.uint64), codes])
                places = len(padded) - self.order + 1
                if places > 0:
                    held.append((k, padded))
                    count[k] += places
                    size += places
                if size >= _BATCH_CHARS:
                    self._add(held, total)
                    held, size = [], 0
        self._add(held, total)
        return (-total / np.maximum(count, 1)).T

    def _add(self, held: list[tuple[int, np.ndarray]], total: np.ndarray) -> None:
        """Add the log-probabilities of all places of some pieces, by text."""
        if not held:
            return
        order, codes = self.order, np.concatenate([c for _, c in held])
        sizes = np.array([len(c) for _, c in held])
        begins = np.cumsum(sizes) - sizes
        places = sizes - order + 1
        starts = np.arange(places.sum()) + np.repeat(begins - (np.cumsum(places) - places), places)
        out = codes * _MIX
        for k in range(1, order):  # hash of `order` codes from each place on
            out[: len(codes) - k] = (out[: len(codes) - k] ^ (out[: len(codes) - k] >> np.uint64(29)) ^ codes[k:]) * _MIX
        _, first, which = np.unique(out[starts], return_index=True, return_inverse=True)
        windows = codes[starts[first][:, None] + np.arange(order)]
        grams = [hash_rows(windows[:, order - n :]) for n in range(1, order + 1)]
        contexts = [hash_rows(windows[:, order - n : -1]) for n in range(1, order + 1)]
        of_text, piece = np.array([k for k, _ in held]), np.cumsum(places) - places
        for n, model in enumerate(self.of):
            np.add.at(total[n], of_text, np.add.reduceat(model.score(grams, contexts)[which], piece))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected, for each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        able = [k for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for k, entropy in zip(able, self.entropies([letters(texts[k]) for k in able]), strict=True):
            best = int(entropy.argmin())
            out[k] = (self.languages[best], self.confidence(margin(entropy)), bool(entropy[best] > self.worst))
        return out

    def confidence(self, gap: float) -> float:
        if self.margins is None or not len(self.margins):
            return float(1 - np.exp(-gap))
        return float(np.interp(gap, self.margins, self.right))


def margin(entropy: np.ndarray) -> float:
    return float(np.diff(np.partition(entropy, 1)[:2])[0]) if len(entropy) > 1 else 1.0


def kneser_ney(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> Model:
    """The model of one language from counts of distinct N-grams; grams: (rows, N) code points + 1."""
    order, levels, weight = grams.shape[1], [], counts
    for n in range(order, 0, -1):
        # the grams of this order with their counts: raw at the top, distinct left extensions below
        hashes, first, which = np.unique(hash_rows(grams), return_index=True, return_inverse=True)
        levels.append((hashes, grams[first], np.bincount(which, weight if n == order else np.ones(len(grams)))))
        grams = grams[first][:, 1:]
    levels.reverse()
    made = Model([], [], [], 0.0)
    below = np.array([1.0 / (alphabet + 1)])
    for n, (hashes, gram, weight) in enumerate(levels, 1):
        ones, twos = (weight == 1).sum(), (weight == 2).sum()
        discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
        contexts, at = np.unique(hash_rows(gram[:, :-1]), return_inverse=True)
        total, kinds = np.bincount(at, weight), np.bincount(at)
        spared = discount * kinds / total  # mass for the order below, by context
        if n == 1:
            lower, made.unseen = below[0], float(np.log(spared[0] * below[0]))
        else:
            lower = below[_find(made.hashes[-1], hash_rows(gram[:, 1:]))[0]]
            place, known = _find(made.hashes[-1], contexts)
            made.backoff[-1][place[known]] = np.log(spared[known])
        p = np.maximum(weight - discount, 0) / total[at] + spared[at] * lower
        made.hashes.append(hashes)
        made.logp.append(np.log(p).astype(np.float32))
        made.backoff.append(np.zeros(len(hashes), np.float32))
        below = p
    return made


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, list[str]]:
    """lang, text and calibrates of about sample_docs learnable documents for each language, and the languages in order."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(HELD_BACK)) == 0
    return able.where(draw).select("lang", F.col("text").cast("string").alias("text"), calibrates.alias("calibrates")), languages


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """lang, gram and n of the sample's N-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, gram, n = [], [], []
            texts: dict[str, list[str]] = {}
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(name, []).append(" " * (order - 1) + letters(text))
            for name, own in texts.items():
                codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
                windows = np.lib.stride_tricks.sliding_window_view(codes, order) if len(codes) >= order else np.empty((0, order), np.uint32)
                kinds, count = np.unique(np.ascontiguousarray(windows).view(f"V{4 * order}").ravel(), return_counts=True)
                lang += [name] * len(kinds)
                gram += [bytes(x).decode("utf-32-le", "surrogatepass") for x in kinds]
                n += count.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(counts: DataFrame, alphabet: int, order: int) -> DataFrame:
    """lang, n, hashes, logp, backoff (arrays as bytes) and unseen for each language of counts (lang, gram, n) and each order n."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("gram")
        grams = np.frombuffer("".join(table["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order).astype(np.uint64) + np.uint64(1)
        made = kneser_ney(grams, table["n"].to_numpy().astype(np.float64), alphabet)
        arrays = [[x.tobytes() for x in part] for part in (made.hashes, made.logp, made.backoff)]
        return pa.table({"lang": [table["lang"][0].as_py()] * order, "n": pa.array(range(1, order + 1), pa.int32()), **dict(zip(("hashes", "logp", "backoff"), arrays)), "unseen": [made.unseen] * order})

    return counts.groupBy("lang").applyInArrow(run, "lang string, n int, hashes binary, logp binary, backoff binary, unseen double")


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Models:
    sample, languages = training_sample(docs, sample_docs)
    if not languages:
        return Models([], order, [])
    sample = common.checkpoint(sample)
    counts = common.checkpoint(count_grams(sample.where("not calibrates"), order))
    alphabet = counts.select(F.right("gram", F.lit(1)).alias("last")).distinct().count()
    if not alphabet:
        counts = common.checkpoint(count_grams(sample, order))
        alphabet = counts.select(F.right("gram", F.lit(1)).alias("last")).distinct().count()
    known: dict[str, Model] = {}
    for r in fit_languages(counts, alphabet, order).orderBy("lang", "n").collect():  # a row for each language and order
        model = known.setdefault(r["lang"], Model([], [], [], r["unseen"]))
        model.hashes.append(np.frombuffer(r["hashes"], np.uint64))
        model.logp.append(np.frombuffer(r["logp"], np.float32))
        model.backoff.append(np.frombuffer(r["backoff"], np.float32))
    languages = [x for x in languages if x in known]
    return calibrate(Models(languages, order, [known[x] for x in languages]), sample.where("calibrates"))


def calibrate(models: Models, kept_back: DataFrame) -> Models:
    """models with the rejection bound and the map from margins to scores; only histograms reach the driver."""
    shared = kept_back.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [(x, t) for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if t and _LETTER.search(t)]
            out = [(min(int(e.min() * 50), 2 * _BINS), min(int(margin(e) * 100), _BINS), own.languages[int(e.argmin())] == x) for (x, _), e in zip(rows, own.entropies([letters(t) for _, t in rows]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))], ["entropy", "margin", "hit"])

    seen = kept_back.select("lang", "text").mapInArrow(run, "entropy int, margin int, hit boolean").groupBy("entropy", "margin").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()
    if seen and models.languages:
        entropy, gap, n, hits = (np.array([r[c] for r in seen]) for c in ("entropy", "margin", "n", "hits"))
        by = np.bincount(entropy, n)
        models.worst = float((np.flatnonzero(np.cumsum(by) >= by.sum() * (1 - REJECT_SHARE))[0] + 1) / 50)
        models.margins, models.right = monotone(np.bincount(gap, hits), np.bincount(gap, n))
    return models


def monotone(hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, share right) that never fall: neighbours that would are pooled. A share is (hits + 1) / (n + 2) of its pool."""
    share = lambda pool: (pool[1] + 1) / (pool[2] + 2)
    pools: list[list[float]] = []
    for k in np.flatnonzero(n):
        pools.append([(k + 0.5) / 100 * n[k], hits[k], n[k]])
        while len(pools) > 1 and share(pools[-2]) >= share(pools[-1]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([x / c for x, _, c in pools]), np.array([share(p) for p in pools])


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.predict(batch.column(2).to_pylist())
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op2_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op2_language_kneser_ney": op2_language_kneser_ney}
#: A language model has no SQL counterpart; tests/llm measures held-out accuracy.
SQL: dict[str, str] = {}
