import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lexlake.llm import trie

TYPE = "conv_id long, turns array<struct<role: string, text: string>>, n string, head string"


def brute(convs):
    """Rows of nodes of convs: (conv_id, [(role, text)])."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv_id, turns in convs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
        ends[tuple(turns)].append(conv_id)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))
        for p, m in members.items()
    )


def key(row):
    return tuple((x is None, x) for x in row)


def found(frame):
    assert frame.columns == trie._NODE
    return sorted((tuple(r) for r in frame.collect()), key=key)


def made(spark, convs):
    return spark.createDataFrame([(c, [{"role": r, "text": t} for r, t in turns], "x", "y") for c, turns in convs], TYPE)


def rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out.append((c, own.get(base, [])[:h] + turns[h:]))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(trie, "MAX_SEQUENCES", 3)
    monkeypatch.setattr(trie, "MAX_TURNS", 20)
    monkeypatch.setattr(trie, "_LIST_BYTES", 20)


def test_query_against_brute_force_and_sql(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = sorted(brute(rebuilt(rows)), key=key)
    assert found(trie.op12_prefix_trie(spark, sf_dir)) == want
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert sorted(duck.execute(f"SELECT {', '.join(trie._NODE)} FROM ({trie.SQL['op12_prefix_trie']})").fetchall(), key=key) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_bursting_containers(spark, small, seed):
    draw = random.Random(seed)
    path = [("user", f"é{k}") for k in range(40)]  # a path that many share, with branches on it
    convs = []
    for c in draw.sample(range(-500, 500), 150):
        turns = path[: draw.choice([0, 1, 5, 30, 40])] + [(draw.choice(["user", "", "a"]), draw.choice(["", "x", "yy", "日本"])) for _ in range(draw.randrange(4))]
        convs.append((c, turns))
    convs += [(1000 + k, path) for k in range(60)]
    assert found(trie.prefix_trie(made(spark, convs).repartition(5))) == sorted(brute(convs), key=key)


def test_only_copies(spark, small):
    convs = [(k, [("u", "same"), ("a", "answer")]) for k in range(100)]
    assert found(trie.prefix_trie(made(spark, convs))) == sorted(brute(convs), key=key)


def test_edges(spark, tmp_path, small):
    assert found(trie.prefix_trie(made(spark, []))) == []
    assert found(trie.prefix_trie(made(spark, [(5, [])]))) == brute([(5, [])])
    same_id = [(1, [("u", "a")]), (1, [("u", "a")]), (1, [("u", "b"), ("u", "b" * 200_000)]), (2, []), (2, [])]
    assert found(trie.prefix_trie(made(spark, same_id))) == sorted(brute(same_id), key=key)
    odd = spark.createDataFrame([(None, None, "x", "y"), (3, [None, {"role": None, "text": None}], "x", "y")], TYPE)
    rows = found(trie.prefix_trie(odd))
    assert [r[:7] for r in rows] == [(3, 0, None, 2, 1, 1, 0), (3, 1, 3, 1, 0, 1, 0)]


def test_rows_of_conversations(spark, tmp_path):
    rows = [(0, 1, "u", "b"), (0, None, None, "a"), (0, 1, "u", "b"), (0, 0, "u", None), (None, 0, "u", "lost"), (7, 0, "u", "own"), (-7, 2, "u", "n"), (107, 0, "a", "c"), (101, 0, "u", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    frame = trie.op12_prefix_trie(spark, str(tmp_path))
    kept = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows if r[0] is not None]
    assert found(frame) == sorted(brute(rebuilt(kept)), key=key)
