"""Vector best-fit packing of tokenised documents into sequences of bounded length.

A sequence (bin) has three capacities: tokens, documents, and attention cost (the sum of squared lengths of what lies in
it). Pieces are taken from the longest down; of the bins that can still take a piece under every capacity, the one
with the best score gets it: the least weighted norm of what would be left ("norm") or the greatest weighted dot product of
the piece and what is left ("dot"). A piece that no bin can take opens one.

Pieces are dealt by row to groups of near equal size, and each group is packed in a task of its own, so that the work
of a task stays bounded whatever the input. A group leaves only its last bins part empty; of all groups, the bins
below REPACK_BELOW are emptied and their pieces packed again in fewer groups, so that what is lost in the end is
a fraction of a bin for each REPACK_ROWS such pieces.

Where attention is bounded below the square of the tokens, no piece is longer than the root of that bound, so that every piece fits a
sequence under all three capacities.

Defined results: a null text is empty, and an empty text is the closing id alone; a document over the longest piece is
cut into full pieces and a last shorter one; of equal lengths the piece of the lower row number comes first; ties between bins go to the
one opened first; repeated rows are packed each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

TOKENS = 4096
CLOSING_ID = 1
GROUP_ROWS = 8192
REPACK_BELOW = 0.98
REPACK_ROWS = 8192


@dataclass(frozen=True)
class Capacity:
    """Most tokens, documents and attention cost in a sequence; the last two follow from the first unless given."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits a sequence."""
        return min(self.tokens, math.isqrt(self.attention)) if self.attention else self.tokens

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


#: Weights of tokens, documents and attention cost in the scores. By default tokens lead, as they alone bind in the default capacities.
WEIGHTS = (1.0, 1e-3, 1e-3)


def best_fit(lengths: np.ndarray, capacity: Capacity, score: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; no piece may be longer than capacity.longest."""
    limit, weight = capacity.vector(), np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths >= capacity.tokens).sum())  # they come first, and fill a bin each
    bins[order[:full]] = np.arange(full)
    left = np.empty((3, 1024))  # of open bins
    number = np.empty(1024, np.int64)
    n, opened = 0, full
    least = int(lengths.min()) if len(lengths) else 0
    for i in order[full:].tolist():
        size = float(lengths[i])
        need = (size, 1.0, size * size)
        able = np.flatnonzero((left[0, :n] >= need[0]) & (left[1, :n] >= 1.0) & (left[2, :n] >= need[2]))
        if len(able):
            if score == "norm":
                value = sum(w * ((left[k, able] - need[k]) / limit[k]) ** 2 for k, w in enumerate(weight))
            else:
                value = -sum(w * (left[k, able] / limit[k]) * (need[k] / limit[k]) for k, w in enumerate(weight))
            best = able[value == value.min()]
            at = best[int(number[best].argmin())]
        else:
            if n == left.shape[1]:
                left, number = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([number, np.empty_like(number)])
            at, n = n, n + 1
            left[:, at], number[at] = limit, opened
            opened += 1
        bins[i], offsets[i] = number[at], capacity.tokens - left[0, at]
        left[0, at] -= need[0]
        left[1, at] -= need[1]
        left[2, at] -= need[2]
        if left[0, at] < least or left[1, at] < 1.0 or left[2, at] < least * least:  # nothing to come fits; the last open bin takes its place
            n -= 1
            left[:, at], number[at] = left[:, n], number[n]
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each row; a document is its ids and the closing id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = bpe.word_bytes(path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        step = 4 * tokens
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            parts: list[bytes] = []
            names = batch.column(0).to_pylist()
            texts = cache.texts(batch.column(1).to_pylist())
            now, values = next(texts, (len(names), []))
            for k in range(len(names)):
                parts = []
                while now == k:
                    parts.extend(values)
                    now, values = next(texts, (len(names), []))
                flat = b"".join([*parts, closing])
                for number, at in enumerate(range(0, len(flat), step)):
                    own = flat[at : at + step]
                    doc.append(names[k])
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def _pack_groups(pieces: DataFrame, per_group: int, base: int, capacity: Capacity, score: str, weights: tuple[float, float, float]) -> DataFrame:
    """row_id, length, sequence_id, offset, filled; groups are numbered from base, a sequence by its group and bin."""
    groups = max(1, round(pieces.count() / per_group))

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("row_id", ignore_index=True)
        bins, offsets = best_fit(batch["length"].to_numpy(), capacity, score, weights)
        filled = np.bincount(bins, batch["length"].to_numpy()).astype(np.int64)[bins] if len(bins) else bins
        return pd.DataFrame({"row_id": batch["row_id"], "length": batch["length"], "sequence_id": ((base + int(key[0])) << 32) + bins, "offset": offsets, "filled": filled})

    dealt = pieces.select("row_id", "length", F.pmod(F.xxhash64("row_id", F.lit(base)), F.lit(groups)).alias("group"))
    # groups are small in bytes and dear to pack: each may have a task of its own
    return dealt.repartition(groups, "group").groupBy("group").applyInPandas(run, "row_id long, length long, sequence_id long, offset long, filled long")


def place(pieces: DataFrame, capacity: Capacity = Capacity(), score: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """pieces (row_id, length, ...) with sequence_id and offset."""
    first = common.checkpoint(_pack_groups(pieces, GROUP_ROWS, 0, capacity, score, weights))
    loose = F.col("filled") < REPACK_BELOW * capacity.tokens
    again = _pack_groups(first.where(loose), REPACK_ROWS, 1 << 30, capacity, score, weights)
    columns = ["row_id", "sequence_id", "offset"]
    return pieces.join(first.where(~loose).select(columns).union(again.select(columns)), "row_id")


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), score: str = "norm", weights: tuple[float, float, float] = WEIGHTS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = common.checkpoint(common.with_row_id(token_pieces(docs, path, capacity.longest, with_ids)))
    return place(pieces, capacity, score, weights).drop("row_id")


def sequences(docs: DataFrame, path: str, capacity: Capacity = Capacity()) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and (doc_id, piece, length) of what lies in each, in order."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    packed = pack(docs, path, capacity, with_ids=True).groupBy("sequence_id").agg(inside.alias("inside"))
    return packed.select("sequence_id", F.flatten("inside.ids").alias("ids"), F.transform("inside", lambda x: F.struct(x["doc_id"], x["piece"], x["length"])).alias("documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(common.read(spark, sf_dir, "documents"), bpe.vocabulary())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Capacities of which each binds: many short documents fill the second, a few long ones the third.
TIGHT = Capacity(tokens=TOKENS, documents=8, attention=TOKENS**2 // 4)


def packing_vector_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences under three capacities of which each binds, by the weighted dot product: tokens, documents and attention cost of each."""
    packed = pack(common.read(spark, sf_dir, "documents"), bpe.vocabulary(), TIGHT, "dot", (1.0, 1.0, 1.0))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("documents"), F.sum(F.col("length") * F.col("length")).alias("attention"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing, "packing_vector_capacities": packing_vector_capacities}
#: Tokens and bins have no SQL counterpart; tests/llm checks the pieces and the capacities.
SQL: dict[str, str] = {}
