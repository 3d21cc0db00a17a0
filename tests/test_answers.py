"""Answers put together from frames that come shuffled, twice, or not at all."""

import json
import random
from datetime import datetime, timedelta

from passagelake.streaming import answers

SCHEMA = "stream_id string, seq int, event string, data string, at timestamp"
START = datetime(2024, 1, 1)
SOURCES = [{"marker": m, "document_id": f"d{m}", "section": "S"} for m in (1, 2, 3)]


def frames_of(name, pieces, end="done", grounded=True, at=0, skip=()):
    rows = [("meta", {"grounded": grounded, "sources": SOURCES}), *(("token", {"text": p}) for p in pieces), (end, {"detail": "no luck"} if end == "error" else {})]
    return [(name, i, e, json.dumps(d), START + timedelta(seconds=at)) for i, (e, d) in enumerate(rows) if i not in skip]


def run(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / "in" / f"n={i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "*"))
    before = spark.conf.get(answers.STORE[0])
    answers.store_answers(stream, str(folder / "out"), str(folder / "cp"), 60).awaitTermination()
    assert spark.conf.get(answers.STORE[0]) == before
    messages = {r["stream_id"]: r for r in spark.read.parquet(str(folder / "out/messages")).collect()}
    return messages, spark.read.parquet(str(folder / "out/shown")).orderBy("batch", "seq").collect()


def test_frames_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"s{i}": [rng.choice(("a ", "é", "[2]", "[9]", "[1]", "\n")) for _ in range(rng.randrange(12))] for i in range(12)}
    texts["blank"] = []
    rows = [f for name, pieces in texts.items() for f in frames_of(name, pieces)]
    rows += rng.sample(rows, len(rows) // 3)  # repeated
    rng.shuffle(rows)
    rows += [("s1", 500, "token", '{"text": "after"}', START), (None, 1, "token", "{}", START), ("s1", None, "token", "{}", START)]
    messages, shown = run(spark, tmp_path, [rows[i::4] for i in range(4)])
    assert set(messages) == set(texts)
    for name, pieces in texts.items():
        assert messages[name]["content"] == "".join(pieces).strip()
        order = [m for m in dict.fromkeys(p for p in pieces if p in ("[1]", "[2]"))]
        assert [f"[{c['marker']}]" for c in json.loads(messages[name]["citations"])] == order
        own = [r for r in shown if r["stream_id"] == name]
        assert [r["text"] for r in own[:-1]] == pieces and [r["kind"] for r in own] == ["token"] * len(pieces) + ["answer"]
    assert len({r["batch"] for r in shown}) > 1


def test_only_whole_answers_are_stored(spark, tmp_path):
    last = [("z", 0, "meta", "{}", START + timedelta(seconds=s)) for s in (300, 600)]
    batches = [
        frames_of("ok", ["fine [1]"]) + frames_of("lost", ["a", "b"], skip=(2,)) + frames_of("failed", ["x"], "error") + frames_of("none", ["Nothing [1] found "], grounded=False),
        frames_of("open", ["u", "v"])[:2] + [("odd", 0, "token", "not json", START), ("odd", 1, "token", '{"text": 5}', START), ("odd", 2, "token", '["x"]', START), ("odd", 3, "done", None, START)],
        last[:1], last[1:], frames_of("lost", ["a", "b"]),
    ]
    messages, shown = run(spark, tmp_path, batches)
    assert {n: m["content"] for n, m in messages.items()} == {"ok": "fine [1]", "none": "Nothing [1] found", "odd": ""}
    assert messages["ok"]["grounded"] and len(json.loads(messages["ok"]["citations"])) == 1
    assert not messages["none"]["grounded"] and messages["none"]["citations"] == "[]"
    kinds = {}
    for r in shown:
        kinds.setdefault(r["stream_id"], []).append(r["kind"])
    assert kinds["failed"] == ["token", "error"] and kinds["lost"] == ["token", "cut off"] and kinds["open"] == ["token", "cut off"]


def test_state_comes_with_the_frames_and_the_first_frame_stays(spark, tmp_path):
    frames = frames_of("s", ["a", "b", "c"])
    again = [(n, i, e, d.replace("b", "x").replace("c", "y"), at) for n, i, e, d, at in frames if e == "token"]
    messages, shown = run(spark, tmp_path, [frames[3:4], frames[4:], again[2:], frames[2:3], again[1:2], frames[:1], frames[1:2]])
    assert messages["s"]["content"] == "abc" and [r["text"] for r in shown] == ["a", "b", "c", "abc"]
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    assert "FlatMapGroupsInPandasWithState" in answers.assembled(stream)._jdf.queryExecution().analyzed().toString()  # no call of the state store for each frame
