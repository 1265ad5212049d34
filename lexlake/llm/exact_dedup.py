"""Exact de-duplication with a cuckoo-filter index of live digests.

A text's identity is the SHA-256 of its UTF-8 bytes after lower-casing A-Z. Digests are dealt to index buckets by hash; each
bucket is one cuckoo filter. A slot of the filter holds a 16-bit fingerprint and, beside it, the content that it stands for
(the whole 32-byte digest) and that content's value. Whether a digest is live, and what its value is, is read from the
slots alone: a fingerprint hit counts once the content in its slot is equal, so the answer is exact. When kicking finds no
room the filter doubles and is filled again from the contents of its slots. Deletion clears the verified slot.

Defined results: a null text counts as the empty text; a null doc_id sorts below every other; of equal texts one row
stays, the one with the largest doc_id and, among rows that repeat that doc_id, the one with the largest hash of its text, then of
all its columns; of rows equal in every column exactly one stays; a very long text is one digest like any other; an empty
table gives an empty result; other columns, whatever their names, are kept by drop_copies() and ignored by the verdict.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Digests in an index bucket, on average; more rows mean more buckets.
BUCKET_ROWS = 20_000
MIN_BUCKETS = 256
_SLOTS = 4
_KICKS = 200


class CuckooIndex:
    """Cuckoo filter over 32-byte digests; beside each fingerprint its slot keeps the digest and a value."""

    def __init__(self, capacity: int = 64):
        self._live = 0
        self._allocate(capacity)

    def __len__(self) -> int:
        return self._live

    def _allocate(self, capacity: int) -> None:
        size = 1
        while size * _SLOTS * 0.84 < capacity:
            size *= 2
        self._mask = size - 1
        self._prints = [0] * (size * _SLOTS)
        self._contents: list[tuple[bytes, object] | None] = [None] * (size * _SLOTS)

    @staticmethod
    def _fingerprint(digest: bytes) -> int:
        return (digest[8] << 8 | digest[9]) or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & self._mask

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self._mask)

    def slot(self, digest: bytes) -> int:
        """The slot of a live digest, verified against the content there; -1 if absent."""
        fingerprint, bucket = self._fingerprint(digest), self._home(digest)
        for b in (bucket, self._other(bucket, fingerprint)):
            for slot in range(b * _SLOTS, b * _SLOTS + _SLOTS):
                if self._prints[slot] == fingerprint and self._contents[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        slot = self.slot(digest)
        return self._contents[slot][1] if slot >= 0 else None

    def insert(self, digest: bytes, value) -> bool:
        """Add a digest or replace its value. True if the digest is new."""
        slot = self.slot(digest)
        if slot >= 0:
            self._contents[slot] = (digest, value)
            return False
        self._live += 1
        left = self._place((digest, value))
        if left is not None:
            self._grow(left)
        return True

    def _put(self, bucket: int, fingerprint: int, content: tuple[bytes, object]) -> bool:
        for slot in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
            if not self._prints[slot]:
                self._prints[slot], self._contents[slot] = fingerprint, content
                return True
        return False

    def _place(self, content: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """None once the content has a slot; else the content that was kicked out last."""
        fingerprint, bucket = self._fingerprint(content[0]), self._home(content[0])
        if self._put(bucket, fingerprint, content) or self._put(self._other(bucket, fingerprint), fingerprint, content):
            return None
        for kick in range(_KICKS):
            slot = bucket * _SLOTS + kick % _SLOTS
            fingerprint, self._prints[slot] = self._prints[slot], fingerprint
            content, self._contents[slot] = self._contents[slot], content
            bucket = self._other(bucket, fingerprint)
            if self._put(bucket, fingerprint, content):
                return None
        return content

    def _grow(self, left: tuple[bytes, object]) -> None:
        """Overflow: a filter twice as large, filled from the slots' contents and the one left over; again if those overflow it."""
        contents = [c for c in self._contents if c is not None] + [left]
        capacity = len(self._prints)
        while True:
            capacity *= 2
            self._allocate(capacity)
            if all(self._place(c) is None for c in contents):
                return

    def delete(self, digest: bytes) -> bool:
        slot = self.slot(digest)
        if slot < 0:
            return False
        self._prints[slot], self._contents[slot] = 0, None
        self._live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (c for c in self._contents if c is not None)


_NAME = ["doc_id", "text_hash", "row_hash"]
_KEEP = ["keep_id", "keep_text", "keep_hash", "keep_row"]
_ENTRY = "digest binary, keep_id long, keep_text long, keep_hash long, keep_row long, n long"


def digest_rows(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_hash, row_hash and digest of each row; the text stays behind in the scan."""
    name, lower = common.named_rows(docs), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.monotonically_increasing_id().alias("row_id"), *[name[c].alias(c) for c in _NAME], F.unhex(F.sha2(lower, 256)).alias("digest"))


def _rank(doc_id, text_hash, row_hash, row_id) -> tuple:
    """Order of rows with equal texts: the largest stays."""
    return (doc_id is not None, doc_id or 0, text_hash or 0, row_hash or 0, row_id or 0)


def _combined(index: CuckooIndex, digest: bytes, rank: tuple, n: int) -> None:
    known = index.get(digest)
    index.insert(digest, (rank, n) if known is None else (max(known[0], rank), known[1] + n))


def _entries(index: CuckooIndex) -> dict[str, pa.Array]:
    live = list(index.items())
    ranks = [v[0] for _, v in live]
    return {
        "digest": pa.array([k for k, _ in live], pa.binary()), "keep_id": pa.array([r[1] if r[0] else None for r in ranks], pa.int64()),
        **{c: pa.array([r[k] for r in ranks], pa.int64()) for k, c in enumerate(_KEEP[1:], 2)}, "n": pa.array([v[1] for _, v in live], pa.int64()),
    }


def _combine_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side combine: at most one entry for each digest and task leaves, so that a hot text doesn't travel."""
    index = CuckooIndex(1024)
    for batch in batches:
        for row_id, doc_id, text_hash, row_hash, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _combined(index, digest, _rank(doc_id, text_hash, row_hash, row_id), 1)
        if len(index) >= 100_000:
            yield pa.RecordBatch.from_pydict(_entries(index))
            index = CuckooIndex(1024)
    if len(index):
        yield pa.RecordBatch.from_pydict(_entries(index))


def _bucket_of(digest: str, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).alias("bucket")


def _index_bucket(table: pa.Table) -> pa.Table:
    """One bucket of the index from the partial entries of all tasks."""
    index = CuckooIndex(min(table.num_rows, 1024))
    for batch in table.to_batches():
        for digest, *keep, n in zip(*(batch.column(c).to_pylist() for c in ("digest", *_KEEP, "n")), strict=True):
            _combined(index, digest, _rank(*keep), n)
    return pa.table(_entries(index))


def build_index(rows: DataFrame) -> DataFrame:
    """The live entries (digest, the row that stays, n) of digest_rows(), one for each distinct text."""
    buckets = max(MIN_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    partial = rows.select("row_id", *_NAME, "digest").mapInArrow(_combine_partition, _ENTRY)
    return partial.groupBy(_bucket_of("digest", buckets)).applyInArrow(_index_bucket, _ENTRY)


def update_index(index: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after deleting the digests of `deleted` and then inserting the entries of `added`."""
    columns = ["digest", *_KEEP, "n"]
    empty = [F.lit(None).cast("long").alias(c) for c in _KEEP]
    gone = deleted.select("digest").distinct().select("digest", *empty, F.lit(0).cast("long").alias("n"))
    steps = index.select(*columns, F.lit(0).alias("step")).union(gone.select(*columns, F.lit(1).alias("step"))).union(added.select(*columns, F.lit(2).alias("step")))
    steps = common.checkpoint(steps)
    buckets = max(MIN_BUCKETS, -(-steps.count() // BUCKET_ROWS))

    def run(table: pa.Table) -> pa.Table:
        live = CuckooIndex(min(table.num_rows, 1024))
        for step, digest, *keep, n in sorted(zip(*(table.column(c).to_pylist() for c in ("step", *columns)), strict=True), key=lambda x: x[0]):
            if step == 1:
                live.delete(digest)
            else:
                _combined(live, digest, _rank(*keep), n)
        return pa.table(_entries(live))

    return steps.groupBy(_bucket_of("digest", buckets)).applyInArrow(run, _ENTRY)


def label_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and row_id for each row of docs."""
    rows = common.checkpoint(digest_rows(docs))
    found = rows.join(build_index(rows), "digest", "left")
    return found.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "row_id",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row for each distinct text, all columns kept. The text is hashed once and shuffled once."""
    index = build_index(common.checkpoint(digest_rows(docs)))
    stay = index.select(F.struct(F.col("keep_id").alias("doc_id"), F.col("keep_text").alias("text_hash"), F.col("keep_hash").alias("row_hash")).alias("name"))
    return common.keep_rows(docs, stay, once=True)


def live_texts(docs: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """text_sha256, keep_id and n of the distinct texts of docs once those of `deleted` are gone and those of `added` have come.

    All three are (doc_id, text, ...). A text that is deleted and added is live with the rows of `added` alone.
    """
    index, gone, new = (build_index(common.checkpoint(digest_rows(d))) for d in (docs, deleted, added))
    return update_index(index, new, gone).select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "n")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_copies(common.read(spark, sf_dir, "documents")).drop("row_id")


def exact_dedup_live_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of documents after the benchmark's texts and all texts of toxic documents were deleted, and all first turns inserted."""
    docs = common.read(spark, sf_dir, "documents")
    toxic = docs.join(common.read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    items = common.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    turns = common.read(spark, sf_dir, "conversations").where("turn = 0").select((F.col("conv_id") + 1_000_000_000_000).alias("doc_id"), "text")
    return live_texts(docs, toxic.select("doc_id", "text").union(items), turns)


QUERIES = {"op7_exact_dedup": op7_exact_dedup, "exact_dedup_live_index": exact_dedup_live_index}
SQL = {
    "op7_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""",
    "exact_dedup_live_index": """
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), low AS (SELECT doc_id, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM own),
gone AS (
  SELECT text_sha256 FROM low WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION SELECT sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM benchmark),
live AS (
  SELECT doc_id, text_sha256 FROM low WHERE text_sha256 NOT IN (SELECT text_sha256 FROM gone)
  UNION ALL SELECT conv_id + 1000000000000, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM conversations WHERE turn = 0)
SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS n FROM live GROUP BY text_sha256
""",
}
