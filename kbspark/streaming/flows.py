"""Structured Streaming: files into chunks, windows over events, and filters that hold text back until it is safe to show."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import chunking


def chunk_stream(documents: DataFrame) -> DataFrame:
    """A stream of (doc_id, text) as its lines packed into chunks; stateless, so no order or watermark is needed."""
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda v: F.trim(v)), lambda x: x != "")
    return documents.select("doc_id", F.posexplode(kept).alias("seq", "line"))


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: str = "doc_id", per_trigger: int = 100):
    """Files of a folder, as they land, as rows of parents and children under ``out``. A batch that is done again writes its own folders anew, so each file counts once."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        parents, children = chunking.parents_and_children(batch, key)
        parents.write.mode("overwrite").parquet(f"{out}/parents/batch={number}")
        children.write.mode("overwrite").parquet(f"{out}/children/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def frames(rows: DataFrame, kind: str = "type", content: str = "content") -> DataFrame:
    """``data: {type, content}`` frames of a chat stream."""
    return rows.select(F.concat(F.lit("data: "), F.to_json(F.struct(F.col(kind).alias("type"), F.col(content).alias("content"))), F.lit("\n\n")).alias("frame"))


def events(text: str) -> list[dict]:
    """The events of a stream's text: each ``data:`` line's object; the end mark, comments and what isn't an object are left out."""
    out = []
    for line in text.splitlines():
        name, mark, value = line.partition(":")
        if name == "data" and mark and value.strip() != "[DONE]":
            try:
                found = json.loads(value)
            except ValueError:
                continue
            out += [found] if isinstance(found, dict) else []
    return out


MARKS = ("<｜DSML", "<|DSML", "<DSML")


def shown(buffer: str, stopped: bool, final: bool = False) -> tuple[str, str, bool]:
    """(text to show, text held back, whether a tool mark came): nothing is shown from a mark on, and an end that may be the beginning of one waits."""
    if stopped:
        return "", "", True
    at = min((i for m in MARKS if (i := buffer.find(m)) >= 0), default=-1)
    if at >= 0:
        return buffer[:at], "", True
    if final:
        return buffer, "", False
    held = max((n for m in MARKS for n in range(1, len(m)) if buffer.endswith(m[:n])), default=0)
    return (buffer[:-held], buffer[-held:], False) if held else (buffer, "", False)


def cited(buffer: str, most: int, final: bool = False) -> tuple[str, str]:
    """(text to show, text held back): citations beyond ``most`` are dropped; an open bracket waits only while it can still become one."""
    tail = re.search(r"\[\d*$", buffer)
    ready, held = (buffer, "") if final or not tail else (buffer[: tail.start()], buffer[tail.start() :])
    return re.sub(r"\[(\d+)\]", lambda m: m[0] if 1 <= int(m[1]) <= most else "", ready), held


def filter_tokens(tokens: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of (message_id, token) as (message_id, shown), with tool calls held back by message.

    A token of null ends its message and its state. With ``idle`` milliseconds a message that falls silent for so long ends too, and what
    was held back of it is shown; that is for streams that run on, since it keeps batches coming.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, stopped = state.get if state.exists else ("", False)
        ended = idle is not None and state.hasTimedOut
        for token in [None] if ended else (t for batch in batches for t in batch["token"]):
            final = token is None or token != token
            text, buffer, stopped = shown(buffer + ("" if final else token), stopped, final)
            if text:
                yield pd.DataFrame({"message_id": [key[0]], "shown": [text]})
            if final:
                buffer, stopped, ended = "", False, True
        if ended:
            state.remove()
        else:
            state.update((buffer, stopped))
            if idle is not None:
                state.setTimeoutDuration(idle)

    return tokens.groupBy("message_id").applyInPandasWithState(step, "message_id string, shown string", "buffer string, stopped boolean", "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")
