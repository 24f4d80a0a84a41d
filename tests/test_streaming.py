import json

from pyspark.sql import functions as F

from quire.streaming import chat

MINUTE = 60_000_000


def test_exact_dedup_stream_equals_batch(spark, tmp_path):
    times = {"a": [0, 5, 9, 11, 20, 21], "b": [3], "c": [0, 10, 20, 29], None: [1, 2, 2, 3]}
    rows = [(k, t * MINUTE) for k, ts in times.items() for t in ts]
    spark.createDataFrame(rows, "message_id string, micros long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id string, micros long").parquet(str(tmp_path / "in"))
    q = chat.dedup_exact(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r["message_id"]), r["micros"] // MINUTE) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame(rows, "message_id string, micros long").withColumn("ts", F.timestamp_micros("micros"))
    want = sorted((str(r["message_id"]), r["micros"] // MINUTE) for r in chat.accepted(batch, ["message_id"], "ts").collect())
    assert got == want == [("None", 1), ("None", 2), ("None", 2), ("None", 3), ("a", 0), ("a", 11), ("a", 21), ("b", 3), ("c", 0), ("c", 10), ("c", 20)]


def test_watermark_dedup(spark, tmp_path):
    spark.sql("select 'a' id, timestamp'2024-01-01 00:00:00' ts union all select 'a', timestamp'2024-01-01 00:01:00' union all select 'b', timestamp'2024-01-01 00:02:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = chat.dedup_events(stream, "id", "ts").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("deduped").collect()) == ["a", "b"]


def test_routing(spark):
    def event(i, chat_id, text, user, kind="p2p"):
        return (({"message_id": str(i), "chat_id": chat_id, "chat_type": kind, "content": json.dumps({"text": text})}), {"sender_id": {"open_id": user, "user_id": None, "union_id": ""}})

    schema = "message struct<message_id string, chat_id string, chat_type string, content string>, sender struct<sender_id struct<open_id string, user_id string, union_id string>>"
    rows = [event(1, "c", "hello", "U1"), event(2, "c", "允许 2", "u1"), event(3, "c", "@_all", "u1", "group"), event(4, None, "x", "u1"), event(5, "c", "x", "other")]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r["message_id"]: r["route"] for r in chat.routed(chat.parsed_messages(df), ["U1"]).collect()}
    assert got == {"1": "command", "2": "approval", "3": "empty", "4": "no_chat", "5": "denied"}


def test_pending_requests(spark):
    asked = spark.createDataFrame([("c", "r1", 1), ("c", "r2", 2), ("d", "r3", 1)], "chat_id string, id string, asked_at int")
    replies = spark.createDataFrame([("c", 3, "once", None), ("c", 4, "reject", 0), ("d", 0, "once", None)], "chat_id string, at int, reply string, index int")
    assert sorted((r["id"], r["reply"]) for r in chat.resolve_replies(asked, replies).collect()) == [("r1", "reject"), ("r2", "once")]
    assert chat.pending_ranks(asked).where("id = 'r2'").first()["nth"] == 2


def test_frames_jobs_and_changes(spark):
    raw = spark.createDataFrame([('data: {"a": 1}\n\n: ping\n\ndata: broken{\r\n\r\ndata: {"b":\ndata: 2}\n\n',)], "value string")
    assert chat.sse_frames(raw).count() == 2
    jobs = spark.sql("select 1 id, 'completed' status, timestamp'2024-01-01 00:00:00' updated_at union all select 2, 'running', timestamp'2024-01-01 00:00:00' union all select 3, 'failed', timestamp'2024-01-01 05:00:00'")
    assert sorted(r["id"] for r in chat.live_jobs(jobs, F.lit("2024-01-01 08:00:00").cast("timestamp")).collect()) == [2, 3]
    old, new = spark.sql("select 1 id, 'x' v union all select 2, 'y'"), spark.sql("select 1 id, 'x' v union all select 2, 'z' union all select 3, 'n'")
    assert sorted(r["id"] for r in chat.changed(new, old, "id").collect()) == [2, 3]


def test_accepted_across_batches(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([1, None, 2]), r.randrange(3000) * MINUTE // 10) for _ in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.createDataFrame(rows, "k string, n int, micros long").withColumn("ts", F.timestamp_micros("micros"))
    got = sorted(map(str, ((x["k"], x["n"], x["micros"]) for x in chat.accepted(df, ["k", "n"], "ts").collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for k, n, t in sorted(rows, key=lambda x: (x[0], str(x[1]), x[2])):
        if n is None or (k, n) not in last or t - last[k, n] >= 10 * MINUTE:
            last[k, n] = t
            want.append((k, n, t))
    assert got == sorted(map(str, want))


def test_queue_and_sink(spark, tmp_path):
    rows = [(c, f"{c}{k}", k) for k in range(20) for c in "xyz"]
    m = spark.createDataFrame(rows, "chat_id string, message_id string, at int")

    def handle(row):
        if row["at"] == 3:
            raise ValueError
        return f"r{row['at']}"

    got = [(r["chat_id"], r["message_id"], r["reply"]) for r in chat.queued(m, handle, ["at"]).collect()]
    for c in "xyz":
        assert [g[2] for g in got if g[0] == c] == [None if k == 3 else f"r{k}" for k in range(20)]
    places = chat.queue_places(m, "at").where("chat_id = 'x'").orderBy("place").collect()
    assert [p["waits_for"] for p in places[:3]] == [None, "x0", "x1"]
    out = str(tmp_path / "sent")

    def send(row):
        with open(out, "a") as f:
            f.write(row["message_id"] + chr(10))

    chat.reply_sink(send)(m.where("at < 2"), 0)
    assert sorted(open(out).read().split()) == ["x0", "x1", "y0", "y1", "z0", "z1"]


def test_frames_in_parts(spark):
    texts = ['data: {"a"', ': 1}\r', '\n\r\ndata: broken{\n\ndata: {"b": 2}', "\n\ndata: {"]
    decoder = chat.FrameDecoder()
    assert [x for t in texts for x in decoder.feed(t)] == [{"a": 1}, {"b": 2}]
    parts = spark.createDataFrame([(c, k, t) for c in "pq" for k, t in enumerate(texts)], "conn string, seq int, value string")
    got = chat.sse_stream(parts, ["conn"], "seq").select("conn", F.to_json("body").alias("b")).collect()
    assert sorted((r["conn"], r["b"]) for r in got) == [(c, b) for c in "pq" for b in ('{"a":1}', '{"b":2}')]


def test_limits_and_jobs(spark):
    parts = spark.createDataFrame([("u", 0, b"123"), ("u", 1, b"45"), ("u", 2, b"6"), ("v", 0, b"")], "upload_id string, seq int, content binary")
    assert sorted(map(tuple, chat.limited(parts, 5).collect())) == [("u", 6, True, 2), ("v", 0, False, 1)]
    events = spark.createDataFrame([("a", 1, "queued", None), ("a", 2, "running", 0), ("a", 3, "running", 1), ("a", 4, "completed", None), ("a", 5, "running", 2), ("b", 1, "running", 0), ("b", 2, "queued", None), ("b", 3, "odd", None)], "job_id string, seq int, status string, chapter_idx int")
    assert sorted(map(tuple, chat.job_states(events).collect())) == [("a", "completed", 4, 2), ("b", "running", 2, 1)]
