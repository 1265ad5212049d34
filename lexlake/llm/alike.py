"""Near copies by exact Jaccard similarity of word shingles.

A text's words (A-Z lower-cased, split at ASCII white space) form a set of 5-word shingles, held as XXH64 hashes. Two texts
link when the Jaccard similarity of their sets is 0.8 or more; links are exact but for collisions of 64-bit hashes.

Search. First the SimHash operator's Gray-order index finds the texts whose fingerprints, made of the same shingles, lie within its bits; those that are
alike indeed are joined. Alike texts may lie further apart, where the index selects nothing, so more candidates are texts that agree on all ROWS MinHashes of one of BANDS bands: a pair of similarity s is missed with
probability (1 - s^ROWS)^BANDS, 6e-5 at 0.8. In PIVOTS rounds, each bucket's members are checked against one member of the bucket's
largest component, another in each round, and components grow together. What then still lies outside the largest is checked against
all members of other components; in a bucket of more than CROWD members only against those with which it shares one of its first
shingles in an order by rarity, as alike texts must. So each candidate pair is checked, joined already, or ruled out, and neither a bucket of like texts
nor one of a text's many edited copies costs the square of its size. label_alike(exact=True) also finds what the bands miss.

Defined results: wordless and null texts are alike; a text of fewer than five words is one shingle; a very long text's shingles are one
sorted array in the task that makes it; repeated rows are labelled each; an empty table gives an empty result; other columns don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS, ROWS = 32, 6
PIVOTS = 3
#: Members of a bucket that may all be checked against one another; those of larger ones are compared where their rarest shingles meet.
CROWD = 64
SEED = 42
_STEP = 1024
_RANDOM = np.random.default_rng(SEED)
_FLIP, _TIMES = (_RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, sorted."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.array([], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(tokens))
    flat, digest = b" ".join(tokens), xxhash.xxh64_digest
    hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, np.uint64))


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, ((hashes[at : at + _STEP] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    flat, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(flat[k * width : (k + 1) * width], k) for k in range(BANDS)], np.uint64)


def _fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


NAME = ["doc_id", "text_hash", "row_hash"]


def _named(docs: DataFrame) -> DataFrame:
    name = common.named_rows(docs)
    return docs.select(*[name[c].alias(c) for c in NAME], F.col("text").cast("string").alias("text"))


def shingle_rows(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, row_hash, node (the hash of the set), n (its size), fp (its fingerprint) and keys (of its bands) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(3)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = np.concatenate([_band_keys(s) for s in sets] or [np.array([], np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            prints = np.array([_fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), lists], [*NAME, "node", "n", "fp", "keys"])

    return _named(docs).mapInArrow(run, "doc_id long, text_hash long, row_hash long, node long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its hashes, from one text for each row (text_hash, node) of wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), words).view(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))], ["node", "hashes"])

    texts = docs.select(common.text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = texts.dropDuplicates(["text_hash"]).join(wanted.select("text_hash", "node").hint("merge"), "text_hash")
    return found.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have that similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return common.checkpoint(both.where(shared >= F.lit(least) * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root of all nodes of roots (node, root) after links (a, b) have joined components."""
    from .simhash import components

    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a != b")
    found = components(between).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return common.checkpoint(roots.join(found, "root", "left").select("node", F.coalesce("least", "root").alias("root")))


def _indexed(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that the Gray-order index over the fingerprints of nodes (node, n, fp) links: one node of each fingerprint with that of the
    least one of its group, and the others of a fingerprint with that one."""
    from .simhash import links

    prints = common.checkpoint(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("one")))
    of = lambda name: prints.select(F.col("fp").alias(name), F.col("one").alias(f"one_{name}"))
    between = links(prints.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("one_a").alias("x"), F.col("one_b").alias("y"))
    within = nodes.join(prints, "fp").where(F.col("node") != F.col("one.node")).select(F.struct("node", "n").alias("x"), F.col("one").alias("y"))
    pairs = between.union(within).where(_sized(F.col("x.n"), F.col("y.n"), least))
    return common.checkpoint(pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct())


def _pivoted(placed: DataFrame, number: int, least: float) -> DataFrame:
    """Pairs (a, b): in each bucket, the members of other components with one member of the largest, another in each round."""
    draw = F.struct(F.xxhash64("node", "key", F.lit(number)).alias("draw"), "node", "n")
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("size"), F.min(draw).alias("pivot"))
    pivots = groups.groupBy("key").agg(F.max_by(F.struct("root", "pivot"), F.struct("size", "root")).alias("largest"), F.count("*").alias("components")).where("components > 1")
    pairs = placed.join(pivots, "key").where((F.col("root") != F.col("largest.root")) & _sized(F.col("n"), F.col("largest.pivot.n"), least))
    return pairs.select(F.greatest("node", "largest.pivot.node").alias("a"), F.least("node", "largest.pivot.node").alias("b")).distinct()


def _largest(placed: DataFrame) -> DataFrame:
    """key, size and largest (the root of most members) of the buckets with members of several components."""
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("members")).groupBy("key")
    return groups.agg(F.sum("members").alias("size"), F.max_by("root", F.struct("members", "root")).alias("largest"), F.count("*").alias("components")).where("components > 1").drop("components")


def _across(open_: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components; open_ has pos: shingles of the member known not to be shared, and one.

    One of two such members at least is outside the bucket's largest component: those meet all others, the largest never meets itself.
    a and b are alike only if they share least / (1 + least) of the sum of their sizes, so that many must be left from pos on.
    """
    left = open_.where("root != largest").select("key", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("root").alias("x_root"))
    can_share = F.least(F.col("x_n") - F.col("x_pos"), F.col("n") - F.col("pos")) + 1
    enough = can_share >= F.lit(least / (1 + least)) * (F.col("x_n") + F.col("n")) - 1e-6
    pairs = left.join(open_, "key").where((F.col("x_root") != F.col("root")) & enough)
    return pairs.select(F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b"))


def _prefixes(sets: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """key, node, n, root, pos: the first shingles of each node of wanted (node, root), so many that alike nodes share one of them.

    A node of n shingles shares at least `least` n of them with any that is alike; so one of any n - `least` n + 1 of them at
    least, of those that come first in an order that all nodes have in common: here those of one node only, which lead nowhere, then
    those of two, those of three, then the others by their hash. The first that two nodes share stands at pos of each, and those before it are not shared.
    """
    own = common.checkpoint(sets.join(wanted, "node"))
    each = own.select("node", F.explode("hashes").alias("hash"))
    # least, greatest and the exclusive or of all name up to three holders, in bounded memory
    least_, greatest = F.min("node").alias("one"), F.max("node").alias("two")
    rare = each.groupBy("hash").agg(F.count("*").alias("holders"), least_, greatest, F.bit_xor("node").alias("all")).where("holders <= 3")
    third = F.when(F.col("holders") == 3, F.col("all").bitwiseXOR(F.col("one")).bitwiseXOR(F.col("two"))).otherwise(F.col("one"))
    held = rare.select("hash", "holders", F.explode(F.array_distinct(F.array("one", "two", third))).alias("node"))
    names = ["alone", "twice", "thrice"]
    by_node = held.groupBy("node").agg(*[F.sort_array(F.collect_list(F.when(F.col("holders") == k, F.col("hash")))).alias(name) for k, name in enumerate(names, 1)])
    known = own.join(by_node, "node", "left").withColumns({name: F.coalesce(name, F.array().cast("array<bigint>")) for name in names})
    order = F.concat("twice", "thrice", F.sort_array(F.array_except("hashes", F.concat(*names))))
    n = F.size("hashes")
    first = n - F.ceil(F.lit(least) * n - 1e-6) + 1 - F.size("alone")
    keys = known.select("node", "root", n.alias("n"), F.size("alone").alias("before"), F.posexplode(F.slice(order, F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("at", "key"))
    return common.checkpoint(keys.select("key", "node", "n", "root", (F.col("before") + F.col("at") + 1).alias("pos")))


def _sized(x: Column, y: Column, least: float) -> Column:
    """Sets of these sizes may have that similarity."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


def label_alike(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = LEAST, exact: bool = False) -> DataFrame:
    """doc_id, text_hash, row_hash and first of each row: the least (no_id, doc_id, text_hash, row_hash) of its component.

    exact: what the bands may have missed is sought among all texts, not only those that share a bucket: members of different components are
    checked where their rarest shingles meet, as alike texts must. It costs a shuffle of all shingles.
    """
    rows = common.checkpoint(shingle_rows(docs, words))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), *NAME)
    nodes = common.checkpoint(rows.groupBy("node").agg(F.min(name).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    near = _indexed(nodes.select("node", "n", "fp"), least)
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("count")).where("count > 1").select("key")
    members = common.checkpoint(keyed.join(buckets, "key"))
    sought = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    candidates = nodes.join(sought, "node", "left_semi").select("first.text_hash", "node")
    sets = common.checkpoint(_sets(docs, candidates, words))

    roots = _merged(candidates.select("node", F.col("node").alias("root")), _alike(near, sets, least))
    for number in range(PIVOTS):
        roots = _merged(roots, _alike(_pivoted(members.join(roots, "node"), number, least), sets, least))
    placed = members.join(roots, "node")
    open_ = common.checkpoint(placed.join(_largest(placed), "key"))
    crowded = _prefixes(sets, open_.where(F.col("size") > CROWD).select("node", "root").distinct(), least)
    rest = _across(open_.where(F.col("size") <= CROWD).withColumn("pos", F.lit(1)), least).union(_across(crowded.join(_largest(crowded), "key"), least)).distinct()
    roots = _merged(roots, _alike(rest, sets, least))
    if exact:
        every = common.checkpoint(_sets(docs, nodes.select("first.text_hash", "node"), words))
        roots = common.checkpoint(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        keyed_by_shingle = _prefixes(every, roots, least)
        missed = _across(keyed_by_shingle.join(_largest(keyed_by_shingle), "key"), least).distinct()
        roots = _merged(roots, _alike(missed, every, least))

    joined = nodes.select("node", "first").join(roots, "node", "left")
    rooted = joined.select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", F.col("least").alias("first"))
    return rows.select(*NAME, "node").join(named, "node").drop("node")
