"""SimHash near-de-duplication over a Gray-order hierarchical index.

A text's words (A-Z lower-cased, split at ASCII white space) form 3-word shingles; a fingerprint
bit is 1 if set in over half of the shingles' XXH64 hashes. Two fingerprints link when they differ in at
most `bits` bits.

Search. The 64 bits are cut into bits + 1 bands; two fingerprints within `bits` agree on one whole band at least. For each band, the
distinct fingerprints are dealt by its first bits, just so many that a block has about BLOCK members, and in each block an index
does the search: fingerprints sorted by Gray rank, packed into a tree whose nodes keep the bits on which all below them agree
and their shared pattern. A search adds up, from the root down, the differences on the bits that each level newly
fixes; a sum above `bits` prunes the whole group. No link is lost, and a fingerprint travels bits + 1 times whatever
their number. A block above HOT_BLOCK members, whose fingerprints are much alike, is dealt again over pairs of bands of its
free bits, on one of which any two within `bits` agree.

Links leave a block as a star to one member of each connected group, never as all pairs; components
then come from large-star / small-star rounds on those links, as Spark joins, with a checkpoint a round.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a text of
fewer than three words is one shingle; a very long text is hashed in pieces of 65,536 shingles; a bit set in exactly half of the
hashes is 0; a null doc_id is ignored for component_id unless a component has no other; repeated rows are all returned; an
empty table gives an empty result; other columns, whatever their names, are ignored by the labels and kept by drop_near_copies().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alike, common

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Members of a block, on average at most, as long as a band has bits enough to tell blocks apart.
BLOCK = 1024
#: A block with more members is dealt again over the bits that its key leaves free.
HOT_BLOCK = 16 * BLOCK
_TASK_ROWS = 50_000
_MIN_TASKS = 64
_FAN_OUT = 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a whole text, in pieces of 65,536 shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
            set_bits += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprint_rows(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (mask of agreed bits, their pattern) over fingerprints in Gray order; level 0 is the fingerprints."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.levels = [(np.full(len(codes), ~np.uint64(0)), self.codes)]
        while len(self.levels[-1][0]) > _FAN_OUT:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), _FAN_OUT)
            differ = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[at], np.diff(np.append(at, len(mask)))), at)
            up = np.bitwise_and.reduceat(mask, at) & ~differ
            self.levels.append((up, pattern[at] & up))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, place in self.codes) of all that differ in at most `most` bits."""
        mask, pattern = self.levels[-1]
        q, node = (x.ravel() for x in np.indices((len(queries), len(mask))))
        diff = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        for depth in range(len(self.levels) - 2, -1, -1):
            keep = diff <= most
            q, node, diff = q[keep], node[keep], diff[keep]
            above = self.levels[depth + 1][0]
            mask, pattern = self.levels[depth]
            child = (node[:, None] * _FAN_OUT + np.arange(_FAN_OUT)).ravel()
            q, parent, diff = (np.repeat(x, _FAN_OUT) for x in (q, node, diff))
            real = child < len(mask)
            q, parent, child, diff = q[real], parent[real], child[real], diff[real]
            diff = diff + np.bitwise_count((queries[q] ^ pattern[child]) & (mask[child] & ~above[parent]))
            node = child
        keep = diff <= most
        return q[keep], node[keep]


def _stars(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of each connected group within one block."""
    index = GrayIndex(codes)
    root = np.arange(len(codes))
    step = max(1, 1_000_000 // len(codes))
    for at in range(0, len(codes), step):
        q, found = index.search(index.codes[at : at + step], most)
        q = q + at
        q, found = q[q < found], found[q < found]
        while True:  # hook the larger root to the smaller and jump, until all links are within a group
            a, b = root[q], root[found]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (jump := root[root] != root).any():
                root[jump] = root[root[jump]]
    least = np.full(len(codes), ~np.uint64(0))
    np.minimum.at(least, root, index.codes)
    to = least[root]
    return index.codes[to != index.codes], to[to != index.codes]


def _bands(free: int, count: int) -> list[int]:
    """Masks that cut the set bits of `free` into `count` bands of near equal width."""
    places = [k for k in range(64) if free >> k & 1]
    return [sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(places), count)]


def block_masks(free: int, bits: int) -> list[int]:
    """Each mask joins two of bits + 2 bands; fingerprints within `bits` agree on one mask at least."""
    return [a | b for a, b in combinations(_bands(free, bits + 2), 2)]


def first_bits(band: int, count: int) -> int:
    """The highest `count` bits of a band."""
    places = [k for k in range(63, -1, -1) if band >> k & 1]
    return sum(1 << k for k in places[:count])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Links (a, b), a != b, that connect exactly the fingerprints (column fp, distinct) within `bits` of one another."""
    full, n = (1 << 64) - 1, nodes.count()
    masks = [first_bits(band, max(0, n // block).bit_length()) for band in _bands(full, bits + 1)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").count().where("count > 1")
    keyed = keyed.join(sizes, ["t", "key"])  # members of blocks of one have no partner here
    free = [block_masks(full & ~m, bits) for m in masks]
    again = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in free]), F.col("t") + 1)
    cold = keyed.where(F.col("count") <= hot_block).select("fp", "t", "key", F.lit(0).alias("u"), F.lit(0).cast("long").alias("key2"))
    hot = keyed.where(F.col("count") > hot_block).select("fp", "t", "key", F.posexplode(again).alias("u", "m"))
    blocks = cold.union(hot.select("fp", "t", "key", "u", F.col("fp").bitwiseAND(F.col("m")).alias("key2")))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["t", "key", "u", "key2"], kind="stable")
        codes = batch["fp"].to_numpy().view(np.uint64)
        same = (batch[["t", "key", "u", "key2"]].diff().iloc[1:] == 0).all(axis=1).to_numpy()
        edges = np.flatnonzero(~same) + 1
        found = [_stars(part, bits) for part in np.split(codes, edges) if len(part) > 1]
        a, b = (np.concatenate([x[k] for x in found] or [np.array([], np.uint64)]) for k in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    tasks = max(_MIN_TASKS, -(-len(masks) * n // _TASK_ROWS))
    return blocks.groupBy(F.pmod(F.xxhash64("t", "key", "u", "key2"), F.lit(tasks)).alias("task")).applyInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node, as signed long) for every node that has a link in edges (a, b).

    Large-star and small-star rounds until nothing changes; each round is two aggregates by node and two joins.
    """
    a, b = F.col("a"), F.col("b")
    edges = common.checkpoint(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == state or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now
        both = edges.select(a.alias("u"), b.alias("v")).union(edges.select(b.alias("u"), a.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = common.checkpoint(small.select("x.a", "x.b").where("a > b").distinct())


def label_groups(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the component) for each row."""
    rows = common.checkpoint(fingerprint_rows(docs))
    nodes = common.checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = nodes.join(components(links(nodes, bits)).select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = joined.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp", "left")


def drop_near_copies(docs: DataFrame, exact: bool = False) -> DataFrame:
    """docs with one row of each component of near copies (alike.py): the least doc_id, then text hash, then hash of all columns.

    Of rows that are equal in every column one stays. The query's limits of shingles and bits bind the query only. exact: as of label_alike().
    """
    stay = alike.label_alike(docs, exact=exact).select(F.struct("first.doc_id", "first.text_hash", "first.row_hash").alias("name"))
    return common.keep_rows(docs, stay, once=True)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_groups(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
#: XXH64 with a seed has no SQL counterpart; tests/llm compares the query with brute force.
SQL: dict[str, str] = {}
