"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

Every word is a row of symbols; the leaves of its segment tree are the ranks of adjacent pairs, combined with
their places so that the root holds the leftmost pair of the lowest rank. A merge replaces that pair, updates the
three leaves it touches and their paths to the root (logarithmic), and goes on until the root is empty. Words of
one batch that are alike in length share a matrix of trees, one row each, and step together.

Encoding a text needs only its words: they are encoded once for each task's cache of recent words. Texts go through the
vocabulary file's own normaliser and pre-tokeniser (read from the file by the public tokenizers library) unless all
their characters are Latin-1, where plain rules give the same words. Special tokens are found in the raw text first.

Defined results: a null text is empty and has no tokens; repeated rows are encoded each; very long texts are taken in
pieces cut at white space, which never change a word, and a very long word only deepens its tree; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that a task remembers before it starts anew; longer ones than CACHE_CHARS are encoded each time, so that bytes are bounded too.
CACHE_WORDS = 400_000
CACHE_CHARS = 64
_PIECE_CHARS = 1 << 18
#: Fewer words than one for so many columns of their matrix are merged one by one.
_ROWS_AT_ONCE = 32
_NONE = np.int64(1) << 62

# Latin-1 letters and numbers, as Unicode classes them (fixed values).
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_LATIN_SPACE = "\t-\r \x85\xa0"
_LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LATIN_SPACE}{_LETTERS}{_NUMBERS}]+")
_BREAK = re.compile(r"[ \n]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """One vocabulary file: words to ids, ids to tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        symbols = byte_symbols()
        self._byte_of = {c: b for b, c in enumerate(symbols)}
        self._inner = np.array([self.vocab[c] for c in symbols], np.int64)
        self._last = np.array([self.vocab[c + self.suffix] for c in symbols], np.int64)
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self._width = max(self.tokens) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] * self._width + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self._made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE if it doesn't merge; -1 stands for no symbol."""
        key = a * self._width + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], _NONE)

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Fully merged rows; symbols has a row a word and a power of two columns, -1 behind a word's end and in freed places."""
        rows, n = symbols.shape
        depth = n.bit_length() - 1
        tree = np.full((rows, 2 * n), _NONE)
        place = np.arange(n)
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        first = self._rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, n : 2 * n - 1] = np.where(first < _NONE, first * n + place[:-1], _NONE)
        for level in range(depth - 1, -1, -1):
            k = 1 << level
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            rank, at = np.divmod(tree[live, 1], n)
            right = after[live, at]
            symbols[live, at] = self._made[rank]
            symbols[live, right] = -1
            beyond = after[live, right]
            after[live, at] = beyond
            inside = beyond < n
            before[live[inside], beyond[inside]] = at[inside]
            left = before[live, at]
            center = symbols[live, at]
            next_ = np.where(inside, symbols[live, np.minimum(beyond, n - 1)], -1)
            previous = np.where(left >= 0, symbols[live, np.maximum(left, 0)], -1)
            here, there = self._rank(center, next_), self._rank(previous, center)
            has = left >= 0
            for who, leaf, value in (
                (live, right, np.full(len(live), _NONE)),
                (live, at, np.where(here < _NONE, here * n + at, _NONE)),
                (live[has], left[has], np.where(there < _NONE, there * n + left, _NONE)[has]),
            ):
                node = leaf + n
                tree[who, node] = value
                for _ in range(depth):
                    node = node >> 1
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
            live = live[tree[live, 1] < _NONE]
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """_merge() for a single long word: the same tree in plain numbers, whose paths end where nothing changes."""
        n = 1 << (len(symbols) - 1).bit_length()
        none, width, rank_of, made = n << 40, self._width, self._rank_of, self._made.tolist()
        tree = [none] * (2 * n)
        for k in range(len(symbols) - 1):
            rank = rank_of.get(symbols[k] * width + symbols[k + 1])
            if rank is not None:
                tree[n + k] = rank * n + k
        for k in range(n - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))

        def put(leaf: int, value: int) -> None:
            node = leaf + n
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def pair(left: int, right: int) -> int:
            rank = rank_of.get(symbols[left] * width + symbols[right]) if left >= 0 and right < len(symbols) else None
            return none if rank is None else rank * n + left

        while tree[1] < none:
            rank, at = divmod(tree[1], n)
            right = after[at]
            symbols[at], symbols[right] = made[rank], -1
            after[at] = after[right]
            if after[at] < len(symbols):
                before[after[at]] = at
            put(right, none)
            put(at, pair(at, after[at]))
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return [x for x in symbols if x >= 0]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, many words at a time."""
        raw = [w.encode() for w in words]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sizes = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for size in np.unique(sizes).tolist():
            members = np.flatnonzero(sizes == size)
            if len(members) * _ROWS_AT_ONCE < size:
                for i in members.tolist():
                    own = self._inner[np.frombuffer(raw[i], np.uint8)]
                    own[-1] = self._last[raw[i][-1]]
                    out[i] = np.array(self._merge_long(own.tolist()), "<u4")
                continue
            step = max(1, (1 << 18) // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                flat = np.frombuffer(b"".join([raw[i].ljust(size, b"\0") for i in part.tolist()]), np.uint8).reshape(len(part), size)
                n = lengths[part]
                symbols = np.where(np.arange(size) < n[:, None], self._inner[flat], -1)
                row = np.arange(len(part))
                symbols[row, n - 1] = self._last[flat[row, n - 1]]
                merged = self._merge(symbols)
                kept = merged >= 0
                ids = merged[kept].astype("<u4")
                ends = np.cumsum(kept.sum(axis=1)).tolist()
                for i, a, b in zip(part.tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[a:b]
        return out

    def words(self, text: str) -> Iterator[list[str | int]]:
        """The words of a text, piece by piece; a special token is its id."""
        for segment in self._special.split(text) if self._special else [text]:
            if segment in self.special:
                yield [self.special[segment]]
                continue
            at = 0
            while at < len(segment):
                to = at + _PIECE_CHARS
                if to < len(segment):
                    cut = max(segment.rfind(" ", at + 1, to), segment.rfind("\n", at + 1, to))
                    if cut < 0:
                        found = _BREAK.search(segment, to)
                        cut = found.start() if found else len(segment)
                    to = cut
                piece = segment[at:to]
                at = to
                try:
                    piece.encode("latin-1")
                    yield _LATIN_WORD.findall(piece.lower())
                except UnicodeEncodeError:
                    byte_of = self._byte_of
                    yield [bytes([byte_of[c] for c in w]).decode() for w, _ in self._split(self._normalize(piece))]

    def decode(self, ids: list[int]) -> str:
        """As the file has no decoder: tokens joined by a space."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class WordCache:
    """value(ids) of recent words; the words of a batch that it lacks are encoded together."""

    def __init__(self, path: str, value, limit: int = CACHE_WORDS):
        self.encoder, self._value, self._limit = encoder(path), value, limit
        self._known: dict = {}
        self._specials = {i: value(np.array([i], "<u4")) for i in self.encoder.special.values()}
        self._known.update(self._specials)

    def lookup(self, words: list) -> list:
        values = list(map(self._known.get, words))
        missing = list(dict.fromkeys([w for w, v in zip(words, values, strict=True) if v is None]))
        if not missing:
            return values
        short = [w for w in missing if len(w) <= CACHE_CHARS]
        if len(self._known) + len(short) > self._limit:
            self._known = dict(self._specials)
            missing = list(dict.fromkeys([w for w in words if w not in self._known]))
        made = dict(zip(missing, map(self._value, self.encoder.encode_words(missing)), strict=True))
        values = [made.get(w, v) if v is None else v for w, v in zip(words, values, strict=True)]
        self._known.update((w, v) for w, v in made.items() if len(w) <= CACHE_CHARS)
        return values

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, list]]:
        """(number of the text, values of words) in order, a long text in several parts; words of many texts are looked up at once."""
        held: list[tuple[int, list]] = []
        n = 0
        for k, text in enumerate(texts):
            held.append((k, []))
            for words in self.encoder.words(text or ""):
                held.append((k, words))
                n += len(words)
                if n >= 100_000:
                    yield from self._flush(held)
                    held, n = [], 0
        yield from self._flush(held)

    def _flush(self, held):
        values = self.lookup([w for _, words in held for w in words])
        at = 0
        for k, words in held:
            yield k, values[at : at + len(words)]
            at += len(words)


@lru_cache(maxsize=2)
def word_bytes(path: str) -> WordCache:
    """Words as little-endian ids. One for each Python worker, which Spark keeps from task to task."""
    return WordCache(path, lambda ids: ids.tobytes())


@lru_cache(maxsize=2)
def word_strings(path: str) -> WordCache:
    """Words as (number of ids, ids in decimal, tokens), for each Python worker."""
    decode = encoder(path).decode
    return WordCache(path, lambda ids: (len(ids), " ".join(map(str, x := ids.tolist())), decode(x)))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the decoded text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_strings(path)
        for batch in batches:
            n = batch.num_rows
            count = [0] * n
            ids, decoded = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for k, values in cache.texts(batch.column(1).to_pylist()):
                if values:
                    space = " " if count[k] else ""
                    count[k] += sum([v[0] for v in values])
                    ids[k].update((space + " ".join([v[1] for v in values])).encode())
                    decoded[k].update((space + " ".join([v[2] for v in values])).encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array([h.hexdigest() for h in ids]), pa.array([h.hexdigest() for h in decoded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _with_column(docs: DataFrame, of: str, into: str, kind: str, values) -> DataFrame:
    """docs with values(batch's column `of`) as the column `into`, in place of one of that name. Columns travel by place, whatever they are called."""
    docs = docs if into == of else docs.drop(common.column(into))
    at, schema = docs.columns.index(of), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = values()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch.column(at).to_pylist())], [*schema.names, into])

    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    made = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema) + f", {quoted(into)} {kind}"
    return docs.toDF(*[f"c{k}" for k in range(len(schema))]).mapInArrow(run, made)


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the array of ids of each text, in place of a column of that name."""

    def values():
        cache = word_bytes(path)

        def make(texts: list) -> pa.Array:
            parts: list[list[bytes]] = [[] for _ in texts]
            for k, found in cache.texts(texts):
                parts[k].extend(found)
            return pa.array([np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))

        return make

    return _with_column(docs, text, into, "array<int>", values)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of each array of ids, in place of a column of that name."""

    def values():
        coder = encoder(path)
        return lambda lists: pa.array([coder.decode(x or []) for x in lists], pa.string())

    return _with_column(docs, ids, into, "string", values)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.read(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op8_bpe_segment_tree": op8_bpe_segment_tree}
#: BPE has no SQL counterpart; tests/llm compares with the tokenizers library.
SQL: dict[str, str] = {}
