"""Prefix trie of conversations, by burst tries.

A node is a distinct sequence of first turns. Turns get ids by a chained 128-bit hash, so the id at a depth stands for the whole prefix.
Equal conversations are put together first. All others start in one container below the root; a container of more than
MAX_SEQUENCES sequences, or of more than MAX_TURNS turns, bursts: its sequences are dealt to new trie heads by the next turn id in which they differ
(what all of them share becomes a path of heads at once), until all containers are small. Each container is then sorted by turn ids
and swept once with a stack, which gives the nodes below its head; the heads above add up what the containers below them report.

No task holds more than a container, the sweep holds a container's nodes at most. A turn or conversation that a third of all rows have in common
stays spread: containers are counted by partial sums, and rows meet the depth at which their container bursts in a join that Spark
broadcasts below its threshold and splits beyond it. The conversations that end in one node are listed by ranges of conv_id, and the lists
hashed one after the other, so memory is bounded there too.

Defined results: conv_ids need not be unique, every row is a member; rows without turns belong to the root; null turns count as none, null roles
and texts as empty; very long texts are hashed in the task that reads them; repeated turns are nodes of their own; an empty table has no root and
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_SEQUENCES, MAX_TURNS = 4096, 65_536
_LIST_BYTES = 1_000_000
_SEQUENCE = "chain array<binary>, lens array<long>, n long, least long, ends string"
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def chained(convs: DataFrame) -> DataFrame:
    """conv_id, seq (the whole sequence's id), chain (the id of each prefix) and lens (code points of each text) of convs (conv_id, turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains, lens = [], []
            for turns in batch.column(1).to_pylist():
                last, chain, sizes = b"", [], []
                for turn in turns or ():
                    role, text = (turn["role"] or "").encode(), turn["text"] or ""
                    last = hashlib.blake2b(b"%b%d:%b%b" % (last, len(role), role, text.encode()), digest_size=16).digest()
                    chain.append(last)
                    sizes.append(len(text))
                chains.append(chain)
                lens.append(sizes)
            seq = pa.array([c[-1] if c else b"" for c in chains], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), seq, pa.array(chains, pa.list_(pa.binary())), pa.array(lens, pa.list_(pa.int64()))], ["conv_id", "seq", "chain", "lens"])

    turns = F.transform(F.filter("turns", lambda t: t.isNotNull()), lambda t: F.struct(t["role"].cast("string").alias("role"), t["text"].cast("string").alias("text")))
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), turns.alias("turns")).mapInArrow(run, "conv_id long, seq binary, chain array<binary>, lens array<long>")


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """One row for each distinct sequence: chain, lens, n (its members), least (the smallest) and ends (SHA-256 of their list)."""
    listed = ["seq", "chain", "lens", "least", "n", "list"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, head, ids, size, out, held = None, None, [], 0, [], 0

        def table() -> pa.RecordBatch:
            types = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], listed)

        for batch in batches:
            for k, (conv_id, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != seq or size > _LIST_BYTES:
                    if ids:
                        out.append((seq, *head, int(ids[0]) if ids[0] else None, len(ids), ",".join(i for i in ids if i)))
                        held += size + 100 * len(head[0])
                    if held > _LIST_BYTES:
                        yield table()
                        out, held = [], 0
                    seq, head, ids, size = own, (batch.column(2)[k].as_py(), batch.column(3)[k].as_py()), [], 0
                ids.append("" if conv_id is None else str(conv_id))
                size += len(ids[-1]) + 1
        if ids:
            out.append((seq, *head, int(ids[0]) if ids[0] else None, len(ids), ",".join(i for i in ids if i)))
        if out:
            yield table()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state, sha, some = None, None, None, False
        types = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for own, chain, lens, least, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != seq or state is None:
                    if state:
                        out.append((*state, sha.hexdigest()))
                    seq, state, sha, some = own, [chain, lens, 0, None], hashlib.sha256(), False
                state[2] += n
                state[3] = least if state[3] is None else state[3]
                if part:
                    sha.update(("," if some else "").encode() + part.encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["chain", "lens", "n", "least", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*state, sha.hexdigest()), types, strict=True)], ["chain", "lens", "n", "least", "ends"])

    ranged = rows.repartitionByRange(F.col("conv_id").asc_nulls_last()).sortWithinPartitions("seq", F.col("conv_id").asc_nulls_last())
    parts = ranged.select("conv_id", "seq", "chain", "lens").mapInArrow(lists, "seq binary, chain array<binary>, lens array<long>, least long, n long, list string")
    return parts.repartition("seq").sortWithinPartitions("seq", F.col("least").asc_nulls_last()).mapInArrow(joined, _SEQUENCE)


def burst(sequences: DataFrame) -> DataFrame:
    """sequences with at (the depth of the head that holds each), head (its id) and ended (alone at a head that has burst)."""
    head = lambda at: F.when(at == 0, F.lit(b"")).otherwise(F.get("chain", at - 1))
    rows = sequences.select("*", F.lit(0).alias("at"), F.lit(False).alias("ended")).withColumn("head", head(F.col("at")))
    done: list[DataFrame] = []
    while True:
        counts = rows.groupBy("head").agg(F.count("*").alias("sequences"), F.sum(F.size("chain").cast("long")).alias("turns"))
        large = counts.where((F.col("sequences") > 1) & ((F.col("sequences") > MAX_SEQUENCES) | (F.col("turns") > MAX_TURNS))).select("head", F.lit(True).alias("large"))
        marked = common.stored(rows.join(large, "head", "left"))
        small = marked.where("large IS NULL").drop("large")
        over = marked.where("large").drop("large")
        done.append(small)
        if over.isEmpty():
            break
        # the first and the last sequence share what all of a container share
        ends = over.groupBy("head").agg(F.min("chain").alias("low"), F.max("chain").alias("high"))
        shared = F.size(F.filter(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        split = over.join(ends.select("head", shared.alias("depth")), "head")
        stays = F.size("chain") == F.col("depth")
        moved = split.withColumn("ended", stays).withColumn("at", F.when(stays, F.col("depth")).otherwise(F.col("depth") + 1)).withColumn("head", head(F.col("at"))).drop("depth")
        moved = common.stored(moved)
        done.append(moved.where("ended"))
        rows = moved.where("NOT ended")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class _Sweep:
    """Nodes of one container from its sorted sequences."""

    def __init__(self, at: int, path: list[bytes], lens: list[int], ended: bool):
        self.at, self.path, self.lens, self.ended = at, path[:at], lens[:at], ended
        self.stack: list[list] = []  # of open nodes: id, code points of the last text, n, least, children, leaves, saved, ends, rows that wait for least
        self.nodes: list[tuple] = []
        self._open(b"", 0)

    def _open(self, turn: bytes, size: int) -> None:
        self.stack.append([turn, size, 0, None, 0, 0, 0, None, []])

    def _close(self) -> None:
        _, size, n, least, children, leaves, saved, ends, waiting = self.stack.pop()
        depth = self.at + len(self.stack)
        self.nodes += [(*row[:2], least, *row[2:]) for row in waiting]
        leaves, saved = leaves or 1, saved + (n - 1) * size
        above = self.stack[-1]
        above[2] += n
        above[3] = least if above[3] is None else above[3] if least is None else min(least, above[3])
        above[4] += 1
        above[5] += leaves
        above[6] += saved
        above[8].append((least, depth, n, children, leaves, saved, ends or _NO_ENDS))

    def add(self, chain: list[bytes], lens: list[int], n: int, least: int | None, ends: str) -> None:
        k = 0
        while k + 1 < len(self.stack) and self.at + k < len(chain) and self.stack[k + 1][0] == chain[self.at + k]:
            k += 1
        while len(self.stack) > k + 1:
            self._close()
        for depth in range(self.at + k, len(chain)):
            self._open(chain[depth], lens[depth])
        top = self.stack[-1]
        top[2] += n
        top[3] = least if top[3] is None else top[3] if least is None else min(least, top[3])
        top[7] = ends

    def close(self) -> tuple:
        while len(self.stack) > 1:
            self._close()
        _, _, n, least, children, leaves, saved, ends, waiting = self.stack.pop()
        self.nodes += [(*row[:2], least, *row[2:]) for row in waiting]
        return self.path, self.lens, n, least, children, 0 if self.ended else leaves or 1, saved, ends


_CONTAINER = "path array<binary>, lens array<long>, n long, least long, children long, leaves long, saved long, ends string"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sweep(rows: DataFrame) -> DataFrame:
    """node (of _NODE) for all below the heads, container for each head, from burst() rows."""
    of_node = pa.struct([(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in _NODE])
    kinds = {"path": pa.list_(pa.binary()), "lens": pa.list_(pa.int64()), "ends": pa.string()}
    names = [c.split()[0] for c in _CONTAINER.split(", ")]
    of_container = pa.struct([(n, kinds.get(n, pa.int64())) for n in names])

    def table(own: _Sweep) -> pa.RecordBatch:
        container = own.close()
        nodes: list = [None, *(dict(zip(_NODE, x, strict=True)) for x in own.nodes)]
        containers = [dict(zip(names, container, strict=True)), *[None] * len(own.nodes)]
        return pa.RecordBatch.from_arrays([pa.array(nodes, of_node), pa.array(containers, of_container)], ["node", "container"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at_head = None, None
        for batch in batches:
            for head, at, ended, *sequence in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (head, at, ended) != at_head:
                    if own:
                        yield table(own)
                    own, at_head = _Sweep(at, sequence[0], sequence[1], ended), (head, at, ended)
                own.add(*sequence)
        if own:
            yield table(own)

    # an ended sequence has a head of its own, whose id other containers don't have
    sorted_ = rows.repartition("head").sortWithinPartitions("head", "ended", "chain").select("head", "at", "ended", "chain", "lens", "n", "least", "ends")
    return sorted_.mapInArrow(run, f"node struct<{_NODES.replace(' ', ': ').replace(',:', ',')}>, container struct<{_CONTAINER.replace(' ', ': ').replace(',:', ',')}>")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """All nodes of convs (conv_id, turns: array of structs with role and text), with the columns of _NODE."""
    sequences = distinct_sequences(common.stored(chained(convs)))
    swept = common.stored(sweep(burst(common.stored(sequences))))
    containers = swept.where("container IS NOT NULL").select("container.*")

    own = F.size("path") == F.col("depth")
    key = F.when(F.col("depth") == 0, F.lit(b"")).otherwise(F.get("path", F.col("depth") - 1))
    each = containers.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("path")))).withColumn("key", key)
    heads = common.stored(each.groupBy("depth", "key").agg(
        F.first(F.slice("path", F.lit(1), F.col("depth"))).alias("path"), F.max(F.when(F.col("depth") > 0, F.get("lens", F.col("depth") - 1)).otherwise(0)).alias("size"),
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.sum(F.when(own, F.col("children")).otherwise(0)).alias("children"), F.max(F.when(own, F.col("ends"))).alias("ends"),
    ))
    above = F.when(F.col("depth") > 1, F.get("path", F.col("depth") - 2)).otherwise(F.lit(b""))
    up = heads.where("depth > 0").select(above.alias("key"), (F.col("depth") - 1).alias("depth"))
    more = up.groupBy("key", "depth").agg(F.count("*").alias("heads"))
    spent = heads.select(F.explode(F.concat(F.array(F.lit(b"")), "path")).alias("key"), ((F.col("n") - 1) * F.col("size")).alias("spent")).groupBy("key").agg(F.sum("spent").alias("spent"))
    parents = heads.select(F.col("key").alias("above"), F.col("least").alias("parent_conv_id"))
    full = heads.withColumn("above", F.when(F.col("depth") > 0, above)).join(more, ["key", "depth"], "left").join(spent, "key").join(parents, "above", "left")
    upper = full.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), (F.col("children") + F.coalesce("heads", F.lit(0))).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("spent")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    return swept.where("node IS NOT NULL").select("node.*").unionByName(upper)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns of rows (conv_id, turn, role, text): by turn, null first, equal ones by role and text; without rows whose conv_id is null."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its first turns, up to five of them, replaced by those of the first conversation of its hundred."""
    own = conversations(common.read(spark, sf_dir, "conversations"))
    first = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("opening"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(first, "base", "left").withColumn("taken", taken)
    opening = F.slice(F.coalesce("opening", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    return prefix_trie(met.select("conv_id", F.concat(opening, F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns")))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (
  -- CRC-32 of the decimal digits, bit by bit
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM own),
conv AS (
  SELECT t.conv_id, list_concat(coalesce(b.turns[1:t.h], []), t.turns[t.h + 1:]) AS turns
  FROM taken t LEFT JOIN own b ON b.conv_id = t.conv_id - t.conv_id % 100),
pre AS (SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS d, turns FROM conv),
node AS (
  SELECT d, turns[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM pre GROUP BY d, turns[1:d]),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own_saved AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * length(n.p[n.d].text) ELSE 0 END AS saved
  FROM node n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
up AS (SELECT unnest(range(d + 1)) AS a, d, p, saved, n_children FROM own_saved),
total AS (SELECT a AS d, p[1:a] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY a, p[1:a])
SELECT s.conv_id, s.d::BIGINT AS depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM own_saved s JOIN total t ON t.d = s.d AND t.p = s.p LEFT JOIN node q ON s.d > 0 AND q.d = s.d - 1 AND q.p = s.p[1:s.d - 1]
""",
}
