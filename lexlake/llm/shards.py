"""K-d tree partitioning of documents into shards of near equal bytes, with built-in functions only.

A node of the tree splits at the weighted median (weight: bytes) of the metadata dimension on which it is
widest, until leaves reach the target bytes. Dimensions are the logarithm of the size and the coordinates of source and
language; ties in a dimension go on by a hash of the text, so that equal texts stay neighbours, then by doc_id, then by row, so that a
group of copies of any size can be cut.

All nodes of a level split together. The nodes are a table (a row each: axis, goal, cut), joined to the rows, so that plans don't grow with
the tree. In nodes of more than WINDOW_ROWS rows the median is found by narrowing histograms: each pass sums bytes in BINS bins of
the range that still holds the median, in partial sums that no single key can overload; of each node one bin reaches the
driver. Smaller nodes are cut where a running sum over their ordered rows passes the middle, each node in one task.
The driver holds a row for each node of a level, that is for each shard to come, and never rows of documents.

Law: `bytes`. The method knows no groups; equal texts share a shard unless they differ in metadata or a cut runs through them.

Defined results: a null text has size 1; null metadata is a coordinate of its own; repeated rows are placed each and may be
cut apart by their row number; a very long text is one row, and a shard by itself where it is above the target; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
BINS = 1024
#: A median is near enough when no more than this part of the node's bytes lies between it and the cut.
SLACK = 0.0005
#: Nodes of no more rows are cut by a running sum in one task.
WINDOW_ROWS = 20_000
#: Tables of nodes of no more rows are broadcast; larger ones are left to the optimizer.
_BROADCAST_NODES = 100_000
_SLOT_ROWS = 10_000
_MIN_SLOT_BUCKETS = 256
_DIMENSIONS = ["d0", "d1", "d2"]
_KEYS = ["coordinate", "text_hash", "doc_key", "row_id"]


def metadata(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, size, text_crc32, text_hash and the dimensions d0, d1, d2 (longs of 20 bits)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = lambda name: F.shiftright(F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(0)), 12)
    size = F.octet_length(text).cast("long") + 1
    return common.with_row_id(docs).select(
        "row_id", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_key"), size.alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.floor(F.log2(size.cast("double")) * (1 << 15)).alias("d0"), crc("source").alias("d1"), crc("lang").alias("d2"),
    )


class _Search:
    """Where the weighted median of one node lies: values fixed so far, then a range of the next key."""

    def __init__(self, total: int, share: float):
        self.goal, self.slack = total * share, total * SLACK
        self.fixed: list[int] = []
        self.low = self.high = None
        self.before, self.within, self.done = 0, total, False

    @property
    def step(self) -> int:
        return (self.high - self.low) // BINS + 1

    def state(self) -> tuple:
        """depth, fixed values, low, high, step, need."""
        fixed = [*self.fixed, *[None] * (len(_KEYS) - len(self.fixed))]
        return (len(self.fixed), *fixed, self.low, self.high, None if self.low is None else self.step, float(self.goal - self.before))

    def narrow(self, number: int, before: int, within: int) -> None:
        """Keep the bin that holds the goal; `before`: bytes in the bins below it."""
        self.low, self.high = self.low + number * self.step, min(self.high, self.low + number * self.step + self.step - 1)
        self.before, self.within = self.before + before, within
        if self.within <= self.slack:
            self.done = True
        elif self.low == self.high:
            self.fixed.append(self.low)
            self.low = self.high = None
            self.done = len(self.fixed) == len(_KEYS)

    def cut(self) -> tuple:
        """The last place on the left side (null: all values of that key and those behind it), and whether the place itself is left.

        The bin that holds the goal goes left or right, whichever brings the left side nearer to it.
        """
        left = self.goal - self.before > self.within / 2
        values = self.fixed if self.low is None else [*self.fixed, self.high if left else self.low]
        return (*values, *[None] * (len(_KEYS) - len(values)), left)


def _joined(rows: DataFrame, nodes: list[tuple], kind: str, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of nodes, which comes as one JSON text, so that no Python worker makes rows of it."""
    names = [c.split()[0] for c in kind.split(", ")]
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, n, strict=True)) for n in nodes])), f"array<struct<{kind}>>")
    table = rows.sparkSession.range(1).select(F.inline(listed))
    return rows.join(F.broadcast(table) if len(nodes) <= _BROADCAST_NODES else table, "node", how)


def _medians(rows: DataFrame, found: dict[int, _Search]) -> None:
    """Narrow all searches to their ends; rows have node and the columns of _KEYS."""
    depth = F.col("depth")
    key = F.element_at(F.array(*_KEYS), depth + 1)
    fixed = reduce(lambda a, b: a & b, [(depth <= k) | (F.col(name) == F.col(f"fixed{k}")) for k, name in enumerate(_KEYS)])
    kind = "node long, depth int, " + ", ".join(f"fixed{k} long" for k in range(len(_KEYS))) + ", low long, high long, step long, need double"
    while open_ := {n: s for n, s in found.items() if not s.done}:
        if bare := {n: s for n, s in open_.items() if s.low is None}:
            ranged = _joined(rows, [(n, *s.state()) for n, s in bare.items()], kind).where(fixed)
            for r in ranged.groupBy("node").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect():
                bare[r["node"]].low, bare[r["node"]].high = r["low"], r["high"]
        inside = _joined(rows, [(n, *s.state()) for n, s in open_.items()], kind).where(fixed & key.between(F.col("low"), F.col("high")))
        # in decimals, since hashes span all of a long
        number = F.call_function("div", key.cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)"), F.col("step").cast("decimal(20,0)")).cast("int")
        bins = inside.groupBy("node", number.alias("bin")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
        upto = F.sum("size").over(Window.partitionBy("node").orderBy("bin"))
        last = F.max("bin").over(Window.partitionBy("node"))
        reached = bins.withColumn("upto", upto).withColumn("last", last).where((F.col("upto") >= F.col("need")) | (F.col("bin") == F.col("last")))
        for r in reached.groupBy("node").agg(F.min(F.struct("bin", "upto", "size")).alias("at")).collect():
            found[r["node"]].narrow(r["at"]["bin"], r["at"]["upto"] - r["at"]["size"], r["at"]["size"])


def _left_of_cut() -> Column:
    """The keys of a row come before the cut's, lexicographically; or up to them, if the cut includes its own place."""
    less, same = F.lit(False), F.lit(True)
    for k, name in enumerate(_KEYS):
        at = F.col(f"cut{k}")
        less = less | (same & at.isNotNull() & (F.col(name) < at))
        same = same & (at.isNull() | (F.col(name) == at))
    return less | (same & F.col("including"))


def _split(rows: DataFrame, nodes: list, shares: dict[int, float]) -> DataFrame:
    """rows with the children of `nodes` (rows: node, n, size, axis) in place of those: 2 n left of the cut, 2 n + 1 right of it."""
    total, many = {r["node"]: r["size"] for r in nodes}, {r["node"] for r in nodes if r["n"] > WINDOW_ROWS}
    coordinate = F.element_at(F.array(*_DIMENSIONS), F.col("axis") + 1)
    plan = [(r["node"], r["axis"], float(total[r["node"]] * shares[r["node"]]), r["node"] in many) for r in nodes]
    placed = _joined(rows, plan, "node long, axis int, goal double, many boolean").withColumn("coordinate", coordinate)
    rest = _joined(rows, [(r["node"],) for r in nodes], "node long", "left_anti")
    columns = [*[c for c in rows.columns if c != "node"], F.when(F.col("left"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node")]
    parts = [rest.select(*[c for c in rows.columns if c != "node"], "node")]
    if many:
        found = {n: _Search(total[n], shares[n]) for n in many}
        large = placed.where("many")
        _medians(large, found)
        kind = "node long, " + ", ".join(f"cut{k} long" for k in range(len(_KEYS))) + ", including boolean"
        parts.append(_joined(large, [(n, *s.cut()) for n, s in found.items()], kind).withColumn("left", _left_of_cut()).select(columns))
    if len(many) < len(nodes):
        run = Window.partitionBy("node").orderBy(*_KEYS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts.append(placed.where("not many").withColumn("left", F.sum("size").over(run) - F.col("size") / 2 < F.col("goal")).select(columns))
    return common.checkpoint(reduce(DataFrame.union, parts))


def kd_shards(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """Every row's doc_id, size, text_crc32, shard and slot; shards are numbered from 0 in the order of the tree.

    The tree has `shards` leaves of equal shares; or, with target_bytes, nodes are halved until no leaf of two rows or more
    is above it.
    """
    rows = common.checkpoint(metadata(docs)).withColumn("node", F.lit(1).cast("long"))
    leaves = {1: shards}  # how many each open node has still to make
    while target_bytes or leaves:
        widths = F.array(*[F.max(d) - F.min(d) for d in _DIMENSIONS])
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("size"), (F.array_position(widths, F.array_max(widths)) - 1).cast("int").alias("axis"))
        split = nodes.where((F.col("size") > target_bytes) & (F.col("n") > 1)).collect() if target_bytes else [r for r in nodes.collect() if leaves.get(r["node"], 1) > 1]
        if not split:
            break
        left = {r["node"]: 1 if target_bytes else leaves[r["node"]] // 2 for r in split}
        whole = {r["node"]: 2 if target_bytes else leaves[r["node"]] for r in split}
        rows = _split(rows, split, {n: left[n] / whole[n] for n in left})
        leaves = {child: k for n in left for child, k in ((2 * n, left[n]), (2 * n + 1, whole[n] - left[n])) if k > 1}
    # leaves in the order of the tree: paths from the root, aligned at their first turn
    path = F.call_function("shiftleft", F.col("node"), (F.lit(62) - F.floor(F.log2(F.col("node").cast("double")))).cast("int"))
    order = rows.groupBy("node").agg(F.count("*").alias("n")).withColumn("shard", F.row_number().over(Window.orderBy(path)) - 1).select("node", "shard")
    return slots(rows.join(order, "node").drop("node"))


def slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: a count for each bucket of a shard, then places within it."""
    buckets = max(_MIN_SLOT_BUCKETS, -(-rows.count() // _SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_key", "row_id")) - 1
    return rows.withColumn("place", place).join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place")).drop("place", "before", "bucket")


def op5_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards(common.read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_kd_tree_shards": op5_kd_tree_shards}
#: CRC-32 and the narrowing of medians have no SQL counterpart; tests/llm compares with brute force.
SQL: dict[str, str] = {}
