"""Tool calls in generated chats against plain Python, and licence sentences of any raw length."""

import json
import random

import duckdb

from corpusmap.llm import licences, oracles, tool_calls
from corpusmap.scratch import Tables


def chat_rows(seed=3):
    """Chats with chains, ladders, fans, circles, repeated identifiers and results without calls."""
    rng = random.Random(seed)
    needs = {
        "chain": {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(70)},
        "ladder": {f"l{i}": [f"l{j}" for j in (i - 1, i - 2) if j >= 0] for i in range(9)},
        "ring": {f"r{i}": [f"r{(i + 1) % 3}"] for i in range(3)} | {"tail": ["r0"], "free": [], "own": ["own"]},
        "knot": {"a": ["b", "c"], "b": ["a", "c"], "c": ["d"], "d": [], "e": ["a", "d"]},
        "fan": {f"f{i}": ["hub"] for i in range(40)} | {"hub": ["root"], "root": ["nowhere"]},
        None: {f"n{i}": [f"n{j}" for j in range(i) if rng.random() < 0.3] for i in range(14)},
    }
    rows = []
    for conv, calls in needs.items():
        order = list(calls)
        rng.shuffle(order)
        for turn, name in enumerate(order):
            body = {"id": name, "name": "f", "arguments": {f"x{k}": f"${n}" for k, n in enumerate(calls[name])}}
            rows.append((conv, turn, "assistant", f"<tool_call>{json.dumps(body)}</tool_call>", "x"))
            if rng.random() < 0.5:
                rows.append((conv, 100 + turn, "tool", json.dumps({"tool_call_id": name, "content": turn}), "x"))
        rows.append((conv, 300, "tool", json.dumps({"tool_call_id": "never", "content": None}), "x"))
        rows.append((conv, 301, "assistant", rows[-2][3] if rows[-2][2] == "assistant" else "plain", "x"))
    return needs, rows


def plain_levels(calls):
    """The longest chain below each call; calls that reach a circle have none."""
    level: dict = {}
    while True:
        new = {
            c: 1 + max((level[n] for n in needs if n in calls), default=-1)
            for c, needs in calls.items()
            if c not in level and all(n in level for n in needs if n in calls)
        }
        if not new:
            return level
        level |= new


def test_generated_chats_equal_plain_python(spark):
    needs, rows = chat_rows()
    chats = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, level string").repartition(5)
    got = tool_calls.link(chats).collect()
    want = {conv: plain_levels(calls) for conv, calls in needs.items()}
    calls = [r for r in got if r["kind"] == "call"]
    assert len(calls) == sum(r[3].startswith("<tool_call>") for r in rows)
    results = {}
    for conv, turn, role, text, _ in rows:
        if role == "tool":
            key = conv, json.loads(text)["tool_call_id"]
            results[key] = min(turn, results.get(key, turn))
    for r in calls:
        assert r["level"] == want[r["conv_id"]].get(r["id"]), (r["conv_id"], r["id"])
        assert r["linked_turn"] == results.get((r["conv_id"], r["id"]))
        assert ("depends on itself" in r["errors"]) == (r["level"] is None)
        assert ("nothing linked" in r["errors"]) == (r["linked_turn"] is None)
    assert all("nothing linked" in r["errors"] for r in got if r["id"] == "never")


def test_long_chains_halve_with_every_round(spark, monkeypatch):
    saved = []
    save = Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)]
    calls = spark.createDataFrame(rows, "conv_id int, id string, needs array<string>")
    got = {r["id"]: r["level"] for r in tool_calls.levels(calls, Tables(spark, "chain")).collect()}
    assert got == {f"c{i}": i for i in range(300)}
    assert sum(name.startswith("settled") for name in saved) <= 12


def test_no_licence_sentence_is_lost_by_its_raw_length(spark, tmp_path):
    texts = [
        (1, "MIT License" + " " * 900), (2, "*" * 200 + " MIT License " + "*" * 200),
        (3, "Copyright 2020 " + ", ".join(f"Holder {i} of Town" for i in range(60)) + "\nAll rights reserved"),
        (4, "word " * 900), (5, "-" * 3000 + "\n\n# Released under the MIT License" + "!" * 900),
    ]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    rows = {r["doc_id"]: (r["sentences"], r["licences"]) for r in licences.licences(docs).collect()}
    assert rows == {
        1: ("<mit-line>", "MIT"), 2: ("<mit-line>", "MIT"), 3: ("<copyright><all-rights>", "All-rights-reserved"),
        5: ("<mit-line>", "MIT"),
    }
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        assert {r[0]: r[1:] for r in db.execute(oracles.op3()).fetchall()} == rows
