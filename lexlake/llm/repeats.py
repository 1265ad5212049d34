"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or before in the same document.

Search. Every window of `length` bytes has an anchor, the least hash of its k-grams, so equal windows have equal anchors at equal
offsets. The windows that share one occurrence of an anchor form a piece of text, of some 170 bytes at most. Pieces meet by anchor; of equal ones the
earliest stays and the others' windows go. Where different pieces share an anchor, their texts are dealt into shards, each shard gets a suffix
order, a Burrows-Wheeler transform and its LF mapping, and the transforms of a block of shards are merged: each round
of refinement interleaves the suffixes of all shards by one more leading byte, by a stable counting sort of the bytes that the transforms hold, never by
comparing suffixes. The round at which neighbours part is their common prefix; intervals that no longer hold two suffixes are
left out of later rounds. What shares an interval after `length` rounds is a repeated string, of which the earliest place stays.

Skew. Equal pieces meet inside the tasks that read the documents, so a passage that all documents share leaves a task once a chunk. An
anchor with many different pieces (HOT_ROWS or more, estimated on one text in SAMPLE) is dealt by piece into parts; parts and blocks
of one anchor are reconciled by 128-bit digests of the windows that they leave. The estimate changes the path only, not the result.

Defined results: a null text is empty, a text of fewer than `length` bytes loses nothing; null doc_ids come after all others; rows with one
doc_id are ordered by the hash of their text; of rows equal in doc_id and text the first stays and the others count as later copies;
a cut may fall inside a character, so what is kept is binary; a very long text is searched whole in the task that reads it; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
#: Different pieces of an anchor from which it is dealt into parts, and pieces of a block that one task merges at once.
HOT_ROWS = 16_384
#: One text in so many is read to find hot anchors; there are at most HOT_SHARE of them.
SAMPLE, HOT_SHARE = 16, 16_384
#: Pieces of a shard with a transform of its own.
SHARD_PIECES = 2048
_CHUNK_BYTES = 8_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]

ENTRY = ["dest", "anchor", "piece", "no_id", "doc_id", "text_hash", "first", "last", "run"]
_ENTRY_TYPE = "dest long, anchor long, piece long, no_id boolean, doc_id long, text_hash long, first int, last int, run boolean"
DOC = ["no_id", "doc_id", "text_hash"]


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window of each occurrence of an anchor, in order: windows first..last (by where they start) share it."""
    if len(data) < length:
        return np.array([], np.uint64), np.array([], np.int64), np.array([], np.int64)
    gram = max(1, length // 3)
    part = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _MIX[0]
    part ^= part >> np.uint64(29)
    n, at, size, left, hashes = len(data) - gram + 1, 0, 1, gram, None
    while left:  # hashes of runs of 1, 2, 4 ... bytes, those of the binary digits of gram put together
        if left & 1:
            own = part[at : at + n]
            hashes = own.copy() if hashes is None else (hashes * _MIX[2] + own) ^ (hashes >> np.uint64(31))
            at += size
        left >>= 1
        if left:
            part = part[:-size] * _MIX[1] + part[size:]
            part ^= part >> np.uint64(32)
            size *= 2
    hashes *= _MIX[0]
    hashes ^= hashes >> np.uint64(32)
    least, size, width = hashes, 1, length - gram + 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    # the leftmost least gram changes where the value does, or where the gram that was least has left the window
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1]))))
    return least[first], first, np.append(first[1:], len(least)) - 1


class Hot:
    """Anchors that are dealt into parts."""

    def __init__(self, parts: dict[int, int]):
        self.anchors = np.array(sorted(parts), np.int64)
        self.parts = np.array([parts[a] for a in sorted(parts)], np.int64)

    def has(self, anchor: np.ndarray) -> np.ndarray:
        return np.isin(anchor, self.anchors)

    def dest(self, anchor: np.ndarray, piece: np.ndarray) -> np.ndarray:
        dest = anchor.copy()
        hot = self.has(anchor)
        if hot.any():
            parts = self.parts[np.searchsorted(self.anchors, anchor[hot])]
            dest[hot] ^= (piece[hot] % parts) * np.int64(0x2545F4914F6CDD1D)
        return dest


def _places(no_id: np.ndarray, doc_id: np.ndarray, text_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by document, and the number of each row's document."""
    order = np.lexsort((text_hash, doc_id, no_id))
    new = np.zeros(len(order), bool)
    new[1:] = (np.diff(no_id[order].astype(np.int8)) != 0) | (doc_id[order][1:] != doc_id[order][:-1]) | (text_hash[order][1:] != text_hash[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return order, number


def _docs(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def piece_rows(texts: DataFrame, length: int, hot: Hot) -> DataFrame:
    """Rows of ENTRY of all texts. run: these windows were seen earlier in the same chunk, and go."""

    def chunk(held: list, docs: list) -> pa.RecordBatch:
        size = [len(x[0]) for x in held]
        anchor, piece, first, last = (np.concatenate([x[k] for x in held]) for k in range(4))
        of = np.repeat(np.arange(len(held)), size)
        order = np.lexsort((piece, anchor))  # rows come in the order of their places, which a stable sort keeps
        same = (anchor[order][1:] == anchor[order][:-1]) & (piece[order][1:] == piece[order][:-1])
        run = np.zeros(len(order), bool)
        run[order[1:]] = same
        no_id, doc_id, text_hash = (np.array([d[k] for d in docs])[of] for k in range(3))
        dest = np.where(run, text_hash ^ (doc_id.astype(np.int64) << 20) ^ first, hot.dest(anchor, piece))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (dest, anchor, piece, no_id, doc_id.astype(np.int64), text_hash, first.astype(np.int32), last.astype(np.int32), run)], ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            order, number = _places(*keys)
            held, docs, size, before = [], [], 0, -1
            for row in order.tolist():
                if number[row] == before:
                    continue
                before = number[row]
                data = batch.column(3)[row].as_py().encode()
                anchor, first, last = anchors(data, length)
                if not len(anchor):
                    continue
                piece = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                held.append((anchor.view(np.int64), piece.view(np.int64), first, last))
                docs.append([k[row] for k in keys])
                size += len(data)
                if size > _CHUNK_BYTES:
                    yield chunk(held, docs)
                    held, docs, size = [], [], 0
            if held:
                yield chunk(held, docs)

    return texts.select(*DOC, "text").mapInArrow(run, _ENTRY_TYPE)


def hot_anchors(texts: DataFrame, length: int) -> Hot:
    """Anchors with HOT_ROWS different pieces or more, as far as one text in SAMPLE tells."""
    some = piece_rows(texts.where(F.pmod(F.xxhash64("text_hash"), F.lit(SAMPLE)) == 0), length, Hot({})).where(~F.col("run"))
    counts = some.groupBy("anchor").count()
    often = counts.where(F.col("count") > HOT_ROWS // SAMPLE)
    top = often.orderBy(F.desc("count"), "anchor").limit(HOT_SHARE)
    return Hot({r["anchor"]: 1 + r["count"] * SAMPLE // HOT_ROWS for r in top.collect()})


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("dest").sortWithinPartitions("dest", "anchor", "piece", *DOC, "first")


def first_of_each(rows: DataFrame, hot: Hot) -> DataFrame:
    """Of equal pieces all but the earliest, as runs; of the rest those whose anchor has other pieces too (or is hot). Reads rows in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the earliest of the last pieces seen
        told = False
        for batch in batches:
            gone = batch.column(8)
            if gone.true_count:
                yield batch.filter(gone)
                batch = batch.filter(pa.compute.invert(gone))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            _, anchor, piece, no_id, doc_id, text_hash, first, _, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = ~new & ((no_id != no_id[lead]) | (doc_id != doc_id[lead]) | (text_hash != text_hash[lead]) | (first != first[lead]))
            if later.any():
                runs = batch.filter(pa.array(later))
                yield runs.set_column(8, "run", pa.array(np.ones(runs.num_rows, bool)))
            one = np.flatnonzero(new)
            with_next = anchor[one][1:] == anchor[one][:-1]
            open_ = np.append(with_next, False) | np.append(False, with_next) | hot.has(anchor[one])
            tell = open_.copy()
            if told and held is not None:
                tell[0] = False
            if tell.any():
                yield batch.take(pa.array(one[tell]))
            told = bool(open_[-1]) or (told and len(one) == 1)
            held = batch.slice(int(one[-1]), 1)

    return _ordered(rows).mapInArrow(run, _ENTRY_TYPE)


def suffix_order(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings put together, each with a 0 at its end; end is where each position's string ends. Equal ones keep their order."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | np.where(np.arange(n) + k < end, wide[k : k + n], np.uint64(0))
    order = np.argsort(word, kind="stable")
    new = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known = 8
    while True:  # ranks by 8, 16, 32 ... bytes; only suffixes that share theirs are sorted again
        open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(open_):
            return order
        at = order[open_]
        over = at + known
        next_ = np.where(over <= end[at], rank[np.minimum(over, n - 1)], at)  # ended: equal to the end, so by position
        by = np.argsort(rank[at] * np.int64(n) + next_, kind="stable")
        group, next_ = rank[at][by], next_[by]
        order[open_] = at[by]
        new[open_] = np.concatenate(([True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])))
        rank[order[open_]] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        known *= 2


def transform(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: the bytes before its suffixes in their order (0: none), the LF mapping, and the piece and offset of each suffix."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    stop = np.cumsum(size)
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)  # 0xff is no byte of UTF-8; it becomes the 0 at a string's end
    of = np.repeat(np.arange(len(pieces)), size)
    order = suffix_order(text, stop[of] - 1)
    start = stop[of[order]] - size[of[order]]
    before = np.where(order == start, np.uint8(0), text[order - 1])
    lf = np.empty(len(order), np.int32)
    lf[np.argsort(before, kind="stable")] = np.arange(len(order))
    return before, lf, of[order], order - start


def merged_intervals(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval, piece and offset of every suffix whose first `length` bytes another suffix has too, by merging the transforms of all shards."""
    shards = [transform(pieces[at : at + SHARD_PIECES]) for at in range(0, len(pieces), SHARD_PIECES)]
    base = np.cumsum([0] + [len(s[0]) for s in shards])
    before, lf = np.concatenate([s[0] for s in shards]), np.concatenate([s[1].astype(np.int64) + b for s, b in zip(shards, base, strict=False)])
    of = np.concatenate([s[2] + SHARD_PIECES * k for k, s in enumerate(shards)])
    offset = np.concatenate([s[3] for s in shards])
    merged = np.flatnonzero(offset >= length)  # those that `length` steps to the left leave inside their piece
    interval = np.zeros(len(merged), np.int64)
    for _ in range(length):
        if not len(merged):
            break
        symbol = before[merged]
        order = np.argsort(symbol, kind="stable")
        symbol, interval, merged = symbol[order], interval[order], lf[merged[order]]
        new = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])))
        shared = ~(new & np.append(new[1:], True))
        interval, merged = np.cumsum(new)[shared], merged[shared]
    return interval, of[merged], offset[merged]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, first and last of the runs of neighbouring starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    apart = (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > 1)
    return doc[np.append(True, apart)], start[np.append(True, apart)], start[np.append(apart, True)]


_OUT = ["w1", "w2", *DOC, "first", "last", "run"]


def _merge_block(rows: list[tuple], open_: list[bool], length: int) -> Iterator[pa.RecordBatch]:
    """rows: (no_id, doc_id, text_hash, first, bytes). Runs of repeated windows; of the rows in open_ the digests of the windows that are left."""
    keys = [np.array([r[k] for r in rows]) for k in range(3)]
    first = np.array([r[3] for r in rows], np.int64)
    _, number = _places(*keys)
    interval, piece, offset = merged_intervals([r[4] for r in rows], length)
    start = first[piece] + offset
    order = np.lexsort((start, number[piece], interval))
    interval, piece, offset, start = interval[order], piece[order], offset[order], start[order]
    gone = np.zeros(len(order), bool)
    gone[1:] = interval[1:] == interval[:-1]
    row_of = np.zeros(number.max() + 1, np.int64)
    row_of[number] = np.arange(len(rows))

    def batch(row, a, b, w, run):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*w, *(k[row] for k in keys), a.astype(np.int32), b.astype(np.int32), np.full(len(row), run))], _OUT)

    if gone.any():
        doc, a, b = _runs(number[piece[gone]], start[gone])
        none = np.zeros(len(doc), np.int64)
        yield batch(row_of[doc], a, b, (none, none), True)
    left = [(r, o) for r, is_open in enumerate(open_) if is_open for o in range(len(rows[r][4]) - length + 1)]
    if left:
        taken = set(zip(piece[gone].tolist(), offset[gone].tolist(), strict=True))
        left = [x for x in left if x not in taken]
        row, at = np.array([x[0] for x in left], np.int64), np.array([x[1] for x in left], np.int64)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(rows[r][4][o : o + length]) for r, o in left), np.int64).reshape(-1, 2)
        yield batch(row, first[row] + at, first[row] + at, (digests[:, 0], digests[:, 1]), False)


def merge_pieces(pieces: DataFrame, length: int, hot: Hot) -> DataFrame:
    """pieces: dest, anchor, piece, DOC, first, bytes. What _merge_block gives for blocks of whole anchors, of HOT_ROWS rows or so."""
    columns = ["dest", "anchor", "piece", *DOC, "first", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names: list[int] = []
        carried = None  # the anchor that the last block was cut in
        parted = set(hot.anchors.tolist())
        for batch in batches:
            for anchor, *row in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5, 6, 7)), strict=True):
                if len(rows) >= HOT_ROWS and (anchor != names[-1] or len(rows) >= 2 * HOT_ROWS):
                    cut = anchor if anchor == names[-1] else None
                    yield from _merge_block(rows, [a in parted or a == carried or a == cut for a in names], length)
                    rows, names, carried = [], [], cut
                rows.append(tuple(row))
                names.append(anchor)
        if rows:
            yield from _merge_block(rows, [a in parted or a == carried for a in names], length)

    dealt = pieces.select(*columns).repartition("dest").sortWithinPartitions("dest", "anchor", "piece")
    return dealt.mapInArrow(run, "w1 long, w2 long, no_id boolean, doc_id long, text_hash long, first int, last int, run boolean")


def _cut(contested: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each contested piece, a text read once for all of its own."""
    by_doc = contested.groupBy(*DOC).agg(F.collect_list(F.struct("dest", "anchor", "piece", "first", "last")).alias("pieces"))
    names = ["dest", "anchor", "piece", *DOC, "first", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            each = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            first, last = (each.field(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            data = [x.as_py().encode() for x in batch.column(3)]
            cut = [data[d][a : b + length] for d, a, b in zip(of.tolist(), first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([each.field(0), each.field(1), each.field(2), *(batch.column(k).take(pa.array(of)) for k in range(3)), each.field(3), pa.array(cut, pa.binary())], names)

    found = by_doc.join(texts, DOC).select(*DOC, "text", "pieces")
    return found.mapInArrow(run, "dest long, anchor long, piece long, no_id boolean, doc_id long, text_hash long, first int, bytes binary")


def repeated_runs(texts: DataFrame, once: DataFrame, length: int = LENGTH) -> DataFrame:
    """DOC, first, last: runs of windows (by where they start) that start earlier too. once: texts, one row for each DOC."""
    hot = hot_anchors(texts, length)
    met = common.stored(first_of_each(piece_rows(texts, length, hot), hot))
    run = ["no_id", "doc_id", "text_hash", "first", "last"]
    merged = common.stored(merge_pieces(_cut(met.where(~F.col("run")), once, length), length, hot))
    windows = merged.where(~F.col("run")).select(F.col("w1").alias("dest"), F.col("w1").alias("anchor"), F.col("w2").alias("piece"), *run, "run")
    return met.where("run").select(*run).union(merged.where("run").select(*run)).union(first_of_each(windows, Hot({})).where("run").select(*run))


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run of bytes, end exclusive) and kept (the remaining bytes) of each row of docs."""
    texts = _docs(docs)
    once = texts.groupBy(*DOC).agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    runs = repeated_runs(texts, once.select(*DOC, "text"), length).groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for no_id, doc_id, text, rows, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                spans: list[list[int]] = []
                for a, b in sorted((r["first"], r["last"] + length) for r in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                copy = ([[0, len(data)]], b"") if len(data) >= length else ([], data)
                for k in range(rows):
                    out.append((None if no_id else doc_id, len(data), *((spans, kept) if k == 0 else copy)))
                    held += len(out[-1][3])
                    if held > _CHUNK_BYTES:
                        yield table(out)
                        out, held = [], 0
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        spans = pa.array([[{"start": a, "end": b} for a, b in o[2]] for o in out], span)
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), spans, pa.array([o[3] for o in out], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = once.join(runs, DOC, "left").select("no_id", "doc_id", "text", "rows", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op11_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(common.read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_suffix_merge_dedup": op11_suffix_merge_dedup}
#: Every window of every text, by its first place: too slow in SQL on whole tables; tests/llm compares with a brute-force version.
SQL: dict[str, str] = {}
