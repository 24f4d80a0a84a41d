"""Keyed event-stream operators of a chat front end, as streams and as their batch equals."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from quire.functions import text as T

WINDOW_MINUTES = 10


def dedup_events(stream: DataFrame, key: str, time: str, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """First event of each key within a watermark; keys may be held longer than the window."""
    return stream.withWatermark(time, f"{minutes} minutes").dropDuplicatesWithinWatermark([key])


def accepted(events: DataFrame, key: list[str], time: str, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Batch form of exact dedup: the events whose key's last *passed* event lies a window or more before.

    Events with a null in their key always pass and are not shuffled. The others are sorted by key and time, and each
    task walks through its events holding one key's last time, however many events a key has.
    """
    at = "_at"
    timed = events.withColumn(at, F.unix_micros(F.col(time).cast("timestamp")))
    filled = F.lit(True)
    for k in key:
        filled = filled & F.col(k).isNotNull()
    known = timed.where(filled).repartition(*key).sortWithinPartitions(*key, at)
    micros = minutes * 60 * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, 0
        for batch in batches:
            times = batch.column(batch.num_columns - 1).to_numpy()
            keys = list(zip(*(batch.column(n).to_pylist() for n in key), strict=True))
            begins = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            keep: list[int] = []
            for low, high in zip(begins, [*begins[1:], len(keys)], strict=True):
                k = low
                if keys[low] == current:
                    k = low + int(np.searchsorted(times[low:high], last + micros))
                while k < high:
                    keep.append(k)
                    current, last = keys[low], int(times[k])
                    k += max(1, int(np.searchsorted(times[k:high], last + micros)))
            yield batch.take(pa.array(keep, pa.int64()))

    return known.mapInArrow(run, timed.schema).unionByName(timed.where(~filled)).drop(at)


class _Dedup(StatefulProcessor):
    """Keeps the time of a key's last passed event and lets the next pass a window later; null keys always pass.

    A duplicate does not touch the state, so it expires a window after the last event that passed.
    """

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros long", ttlDurationMs=max(1, self.micros // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] is None:
            for pdf in rows:
                yield pd.DataFrame({"message_id": pd.Series([None] * len(pdf), dtype="object"), "micros": pdf["micros"].sort_values().tolist()})
            return
        before = last = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            keep = []
            for t in pdf["micros"].sort_values().tolist():
                if last is None or t - last >= self.micros:
                    keep.append(t)
                    last = t
            yield pd.DataFrame({"message_id": [key[0]] * len(keep), "micros": keep})
        if last != before:
            self.last.update((last,))

    def close(self) -> None:
        pass


def dedup_exact(stream: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Exact dedup of a stream of (message_id, micros), by state per key that expires after the window."""
    schema = StructType.fromDDL("message_id string, micros long")
    return stream.groupBy("message_id").transformWithStateInPandas(_Dedup(minutes * 60 * 1_000_000), schema, "Append", "ProcessingTime")


def queued(messages: DataFrame, handle: Callable[[dict], str | None], order: list[str], schema: str = "chat_id string, message_id string, reply string") -> DataFrame:
    """Messages (chat_id, message_id, ...) handled one after the other within their chat, chats side by side.

    A message waits for the one before it; where ``handle`` fails, the reply is null and the next one's turn comes.
    """
    names = messages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for row in pdf.to_dict("records"):
                try:
                    replies.append(handle(row))
                except Exception:  # noqa: BLE001  a handler's failure must not stop the queue
                    replies.append(None)
            yield pd.DataFrame({"chat_id": pdf["chat_id"], "message_id": pdf["message_id"], "reply": replies})

    return messages.repartition("chat_id").sortWithinPartitions("chat_id", *order).select(*names).mapInPandas(run, schema)


def queue_places(messages: DataFrame, *order: str) -> DataFrame:
    """Each message's place in its chat's queue and the message that it waits for."""
    w = W.partitionBy("chat_id").orderBy(*order)
    return messages.withColumn("place", F.row_number().over(w)).withColumn("waits_for", F.lag("message_id").over(w))


def reply_sink(send: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that hands each reply of a micro-batch to ``send`` on the executors."""

    def each(rows: Iterator) -> None:
        for row in rows:
            send(row.asDict(recursive=True))

    return lambda batch, number: batch.foreachPartition(each)


def limited(parts: DataFrame, limit: int) -> DataFrame:
    """Uploads (upload_id, seq, content) as bytes received and whether they went over ``limit``, and where.

    ``kept`` holds the parts that came before the limit was passed.
    """
    order = W.partitionBy("upload_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.octet_length("content").cast("long")
    running = parts.withColumn("size", size).withColumn("total", F.sum(size).over(order))
    return running.groupBy("upload_id").agg(F.sum("size").alias("bytes"), (F.max("total") > limit).alias("rejected"), F.count_if(F.col("total") <= limit).alias("kept"))


#: Events as a front end writes them, a JSON object a line.
EVENT_SCHEMA = "message struct<message_id string, chat_id string, chat_type string, content string>, sender struct<sender_id struct<open_id string, user_id string, union_id string>>, ts timestamp"


def event_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Events that a connection drops into a folder, as a stream; lines that are no events come with null messages."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", most_files).option("mode", "PERMISSIVE").json(folder)


def public_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs as they may be shown: without keys and options, with the part of the chapters that is done."""
    part = F.when(F.col("chapters") > 0, F.round(F.col("chapters_done") / F.col("chapters"), 4)).otherwise(F.lit(0.0))
    return jobs.select("job_id", "status", "chapters", "chapters_done", part.alias("progress"))


def parsed_messages(events: DataFrame) -> DataFrame:
    """Events with text and sender ids drawn from their structs."""
    m, s = F.col("message"), F.col("sender.sender_id")
    ids = F.filter(F.array(s["open_id"], s["user_id"], s["union_id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return events.select(m["message_id"].alias("message_id"), m["chat_id"].alias("chat_id"), T.strip(T.message_text(m["content"], m["chat_type"])).alias("text"), ids.alias("ids"), "ts")


def routed(messages: DataFrame, allowed: list[str]) -> DataFrame:
    """Where a message goes: empty, no_chat, denied, approval or command."""
    users = F.array(*(F.lit(u.lower()) for u in allowed)) if allowed else F.array().cast("array<string>")
    route = (
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", "empty")
        .when(F.coalesce(F.col("chat_id"), F.lit("")) == "", "no_chat")
        .when(~T.is_allowed(F.col("ids"), users), "denied")
        .when(T.approval(F.col("text")).isNotNull(), "approval")
        .otherwise("command")
    )
    return messages.withColumn("route", route)


def pending_ranks(requests: DataFrame) -> DataFrame:
    """Open requests of each chat in the order they were asked, with their number."""
    chat = W.partitionBy("chat_id")
    return requests.withColumn("nth", F.row_number().over(chat.orderBy("asked_at", "id"))).withColumn("total", F.count("*").over(chat))


def with_chats(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with the chat of their session; those of unknown sessions are rejected."""
    return requests.join(sessions, "session_id", "left").withColumn("auto_reject", F.col("chat_id").isNull())


def sessions(messages: DataFrame) -> DataFrame:
    """A chat's session, opened by its first message."""
    return messages.where("chat_id is not null").groupBy("chat_id").agg(F.min_by("message_id", F.struct("ts", "message_id")).alias("opened_by"), F.count("*").alias("messages"))


def resolve_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """The request that each reply (chat_id, at, reply, index) answers: the nth open one, else the latest before it.

    Replies are counted into the order of their chat's requests, so that each meets one request and not all of them.
    """
    nth = F.row_number().over(W.partitionBy("chat_id").orderBy("asked_at", "id")) - 1
    asked = requests.select("chat_id", "id", "asked_at").withColumn("nth", nth)
    said = replies.select("chat_id", F.col("at").alias("t"), F.lit(1).alias("kind"), "reply", "index")
    empty = (F.lit(None).cast(said.schema[c].dataType).alias(c) for c in ("reply", "index"))
    marks = asked.select("chat_id", F.col("asked_at").alias("t"), F.lit(0).alias("kind"), *empty).unionByName(said)
    order = W.partitionBy("chat_id").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    marks = marks.withColumn("before", F.sum(1 - F.col("kind")).over(order)).where("kind = 1").withColumn("nth", F.coalesce("index", F.col("before") - 1).cast("int")).where("nth < before")
    return marks.join(asked.drop("asked_at"), ["chat_id", "nth"]).select("chat_id", "id", "reply", F.col("t").alias("at"))


def sse_frames(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON bodies of the frames in a server-sent text; broken frames are left out."""
    return _frames(raw.select(F.posexplode(F.split(F.regexp_replace(F.col(column), "\r\n", "\n"), "\n\n")).alias("pos", "frame")), [])


def sse_stream(parts: DataFrame, keys: list[str], order: str, column: str = "value") -> DataFrame:
    """The frames of texts that came in parts, each connection's parts put together in order first.

    A frame cut by the end of a part is carried over to the next one; what is left without its blank line at the end is no
    frame yet.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(column).alias("said"))))
    whole = parts.groupBy(*keys).agg(F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["said"]), ""), "\r\n", "\n").alias("whole"))
    frames = F.split("whole", "\n\n")
    return _frames(whole.select(*keys, F.posexplode(F.slice(frames, F.lit(1), F.size(frames) - 1)).alias("pos", "frame")), keys)


def _frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    data = F.array_join(F.transform(F.filter(F.split("frame", "\n"), lambda x: x.startswith("data:")), lambda x: T.strip(F.substring(x, 6, 1 << 20))), "\n")
    return frames.select(*keys, "pos", data.alias("data")).where("data != ''").withColumn("body", F.try_parse_json("data")).where("body is not null")


class FrameDecoder:
    """The same for one connection as its text comes in: ``feed`` returns the bodies of the frames that are whole."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> list[object]:
        *frames, self.rest = (self.rest + text).replace("\r\n", "\n").split("\n\n")
        out = []
        for frame in frames:
            data = "\n".join(line[5:].strip() for line in frame.split("\n") if line.startswith("data:"))
            with contextlib.suppress(ValueError):
                out.append(json.loads(data))
        return out


#: The states of a job, and the ones that can follow each.
JOB_STEPS = {"queued": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}


def job_states(events: DataFrame) -> DataFrame:
    """Each job's state after its events (job_id, seq, status, chapter_idx): the last that may follow, and chapters done.

    Events out of turn (after the end, or back to an earlier state) change nothing.
    """
    rank = F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).when(F.col("status").isin("completed", "failed"), 2)
    ended = F.min(F.when(rank == 2, F.col("seq"))).over(W.partitionBy("job_id"))
    valid = events.withColumn("_rank", rank).withColumn("_end", ended).where(F.col("_rank").isNotNull() & (F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))))
    return valid.groupBy("job_id").agg(F.max_by("status", F.struct("_rank", "seq")).alias("status"), F.max("seq").alias("seq"), F.count_distinct("chapter_idx").alias("chapters_done"))


def live_jobs(jobs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Jobs that are not finished, or were touched within the last hours."""
    done = F.col("status").isin("completed", "failed")
    return jobs.where(~done | (F.unix_micros("updated_at") >= F.unix_micros(now) - hours * 3_600_000_000))


def changed(rows: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose content differs from what was shown before, by a hash of all columns."""
    signed = rows.withColumn("_sign", F.sha1(F.to_json(F.struct(*sorted(rows.columns))).cast("binary")))
    old = before.withColumn("_old", F.sha1(F.to_json(F.struct(*sorted(before.columns))).cast("binary"))).select(key, "_old")
    return signed.join(old, key, "left").where(~F.col("_sign").eqNullSafe(F.col("_old"))).drop("_sign", "_old")
