"""Streamed answers: frames of many requests put in order as they come, shown piece by piece, and stored once they are complete.

Frames are rows stream_id, seq (from 0), event, data (a JSON object) and at (event time): meta with the sources first, then tokens, then done; or an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

SHOWN = "stream_id string, seq bigint, kind string, text string, grounded boolean, citations string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Seconds of event time without a frame after which a stream is given up and forgotten.
PATIENCE = 600


def _object(data: str | None) -> dict:
    try:
        found = json.loads(data or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def cited(text: str, sources: list) -> list:
    """The sources whose markers the text has, in the order of appearance; markers without a source are dropped."""
    at = {s.get("marker"): s for s in sources if isinstance(s, dict)}
    markers = dict.fromkeys(int(m) for m in re.findall(r"\[([0-9]{1,2})\]", text))
    return [at[m] for m in markers if m in at]


SHOWN_COLUMNS = ["stream_id", "seq", "kind", "text", "grounded", "citations"]
#: The next seq, the frames that came before their turn (a JSON object by seq) and the least of their numbers, the text so far, and what meta and the end told.
STATE = "next long, early string, least long, said string, ended boolean, grounded boolean, sources string, due long"


def _assembly(patience: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held, least, said, ended, grounded, sources, due = state.get if state.exists else (0, None, None, "", False, False, None, 0)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield pd.DataFrame([(key[0], at, "cut off", None, None, None)], columns=SHOWN_COLUMNS, dtype=object)
            return
        new: dict[int, tuple[str | None, str | None]] = {}
        last = 0
        for frames in rows:
            last = max(last, int(frames["at"].max().timestamp() * 1000))
            if not ended:
                for seq, event, data in zip(frames["seq"].tolist(), frames["event"].tolist(), frames["data"].tolist()):
                    if seq >= at:
                        new.setdefault(seq, (event, data))
        early = {}
        if not ended and held is not None and (least == at or at in new):  # else nothing can be shown, or what was held stays as it is
            early = {int(seq): tuple(frame) for seq, frame in json.loads(held).items()}
            held = None
        waiting = new | early  # of frames with one seq the first stays
        shown, pieces = [], [said]
        while not ended and at in waiting:
            event, data = waiting.pop(at)
            body = _object(data)
            if event == "meta":
                grounded, sources = bool(body.get("grounded")), json.dumps(body.get("sources") or [])
            elif event == "token" and isinstance(body.get("text"), str):
                pieces.append(body["text"])
                shown.append((key[0], at, "token", body["text"], None, None))
            elif event == "error":
                ended = True
                shown.append((key[0], at, "error", body.get("detail") and str(body["detail"]), None, None))
            elif event == "done":
                ended = True
                text = "".join(pieces).strip()
                shown.append((key[0], at, "answer", text, grounded, json.dumps(cited(text, json.loads(sources or "[]")) if grounded else [])))
            at += 1
        if ended:
            held, least, said, sources = None, None, "", None
        else:
            said = "".join(pieces)
            if waiting:
                if held is not None:
                    waiting |= {int(seq): tuple(frame) for seq, frame in json.loads(held).items()}
                held, least = json.dumps(waiting), min(waiting)
            elif held is None:
                least = None
        due = max(due, last + patience * 1000, state.getCurrentWatermarkMs() + 1)
        state.update((at, held, least, said, ended, grounded, sources, due))
        state.setTimeoutTimestamp(due)
        if shown:
            yield pd.DataFrame(shown, columns=SHOWN_COLUMNS, dtype=object)

    return run


def assembled(frames: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """stream_id, seq, kind, text, grounded and citations, as frames come: tokens in order, each once, then answer, error, or cut off.

    Of frames with one seq the first stays; those after the end, and rows without stream_id, seq or time, count for nothing. Data that isn't a JSON object has no text and no sources. Frames
    that are ``patience`` seconds of event time late are dropped, and a stream without frames for so long is given up; its answer is never given in part.

    The state of a stream is handed over with its frames and written back whole: no call a frame, and work by the size of an answer for each batch that has frames of it.
    """
    known = frames.where("stream_id is not null and seq >= 0 and at is not null").select("stream_id", F.col("seq").cast("long").alias("seq"), "event", "data", "at")
    timed = known.withWatermark("at", f"{patience} seconds").groupBy("stream_id")
    return timed.applyInPandasWithState(_assembly(patience), SHOWN, STATE, "append", "EventTimeTimeout")


def store_answers(frames: DataFrame, target: str, checkpoint: str, patience: int = PATIENCE) -> StreamingQuery:
    """Write what is shown to ``target``/shown and complete answers to ``target``/messages, by batch, so that a batch that is run again replaces its rows. Takes what is there and stops."""
    spark = frames.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number)).persist()
        for name, part in (("shown", rows), ("messages", rows.where("kind = 'answer'").select("stream_id", F.col("text").alias("content"), "grounded", "citations", "batch"))):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/{name}")
        rows.unpersist()

    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)  # a stream keeps the settings that it was started with
    try:
        return assembled(frames, patience).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
