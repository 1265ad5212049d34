import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexlake.llm import chat as C


def through(spark, records):
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "k int, json string")
    frame = C.canonical_turns(lines.select("k", F.parse_json("json").alias("record")))
    return {r["k"]: r for r in frame.select("k", "layout", "turns", "fingerprint").collect()}


def test_layouts(spark):
    found = through(spark, [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 7},
        {"instruction": "a", "input": "i", "output": "b"}, {"instruction": "a", "output": "b", "system": "s"},
        {"prompt": "a", "response": "b"}, {"prompt": "a", "completion": "b"}, {"question": "q", "answer": "b", "context": "c"},
        {"weird": [1, 2]}, {"prompt": "a", "response": "b", "stars": 5},
    ])
    turns = lambda k: [tuple(t) for t in found[k]["turns"]]
    assert [found[k]["layout"] for k in range(9)] == ["messages", "conversations", "instruction", "instruction", "prompt", "completion", "question", None, None]
    assert turns(0) == [("user", "a"), ("assistant", "")] and turns(1) == [("user", "a"), ("assistant", "b")]
    assert turns(2) == [("user", "a\n\ni"), ("assistant", "b")] and turns(3) == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert turns(6) == [("user", "c\n\nq"), ("assistant", "b")] and found[7]["turns"] is None


def test_fingerprint_is_of_paths_not_of_types_or_order(spark):
    found = through(spark, [{"prompt": "a", "response": "b"}, {"response": 3, "prompt": None}, {"prompt": "a", "response": {"x": 1}}])
    assert found[0]["fingerprint"] == found[1]["fingerprint"] != found[2]["fingerprint"]


def test_mixed_values_and_arrays_are_no_plain_text(spark):
    found = through(spark, [{"prompt": "a", "response": ["x", 1]}, {"prompt": "a", "response": "b"}, {"messages": [{"role": "user", "content": ["x", 1]}]}, {"prompt": "a", "response": [["x"], 1]}])
    assert [found[k]["layout"] for k in range(4)] == [None, "prompt", None, None]
    zoned = spark.sql("SELECT to_variant_object(named_struct('prompt', timestamp_ntz'2024-01-01 00:00:00', 'response', 'b')) AS record")
    assert C.canonical_turns(zoned).first()["layout"] == "prompt"


TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "[[INST]]", "<<SYS>>\n<</SYS>>", "<s></s>", "", "a\\</s", "[ROLE]x[TEXT]y[/ROLE]", "😀</s>é", "<\\s>", "\\\\\\"]


def test_round_trip(spark):
    rows = [(k, [(role, t) for t in TRICKY for role in ("system", "user", "assistant", "tool[TEXT]", "")]) for k in range(2)]
    frame = spark.createDataFrame(rows, f"conv_id long, turns {C.TURNS}")
    formatted = C.format_turns(frame)
    back = C.read_back(formatted).collect()
    for (_, turns), r in zip(rows, back):
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert sum(m["turn_chars"] for m in r["loss_mask"]) == len(r["formatted"])
        assert r["formatted"].count("[INST]") == r["formatted"].count("[/INST]") == len(TRICKY)


@pytest.fixture()
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string, turns string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return write


def brute(rows):
    groups = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    order = lambda r: tuple((v is not None, v or 0 if n == 0 else v or "") for n, v in enumerate(r[1:4]))
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted((str(k), len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(loss := "".join(b for a, b in t if a == "assistant")), sha(loss)) for k, t in groups.items())


def test_query(spark, folder):
    rows = [(1, 0, "system", None), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 2, "assistant", "a" * 200_000), (2, 0, None, "x"), (2, None, "assistant", "first"), (3, 0, "assistant", ""), (None, 0, "user", "none")]
    found = C.op1_chat_format(spark, folder([(*r, "x", "y") for r in rows])).collect()
    assert sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found) == brute(rows)
    assert [r["conv_id"] for r in C.op1_chat_format(spark, folder([])).collect()] == [-1]
