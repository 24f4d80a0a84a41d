from pyspark.sql import functions as F

from quire.operators import graph, library, retrieval
from quire.streaming import chat


def test_node_details(spark):
    n = spark.createDataFrame([("a", "A", "", None, "c", [1, 2, 3, 4, 5]), ("b", " ", "d", "k", "", [])], "id string, name string, definition string, category string, chapter string, sources array<int>")
    got = {r["id"]: r for r in graph.node_details(n).collect()}
    assert (got["a"]["definition"], got["a"]["category"], got["a"]["sources"], got["a"]["source_count"]) == ("暂无定义", "未分类", [1, 2, 3, 4], 5)
    assert (got["b"]["name"], got["b"]["chapter"]) == ("未命名", "未分章节")


def test_chinese_order(spark):
    n = spark.createDataFrame([(k, c) for k, c in enumerate(["血液", "呼吸", "细胞"])], "ord int, chapter string").withColumn("page", F.lit(1))
    order = lambda zh: [r["chapter"] for r in graph.timeline(n, zh).orderBy("progress").collect()]
    assert order(True) == ["呼吸", "细胞", "血液"] and order(False) == sorted(["血液", "呼吸", "细胞"])


def test_retrieval_of_chinese_texts(spark):
    chunks = spark.createDataFrame([("k1", "细胞膜 电位 ATP"), ("k2", "血液 循环"), ("k3", "呼吸 系统"), ("k4", "骨骼")], "id string, text string")
    queries = spark.createDataFrame([("q1", "细胞膜的电位"), ("q2", "循环")], "query_id string, query string")
    assert retrieval.bm25(queries, chunks).count() == 0
    got = {r["query_id"]: r["id"] for r in retrieval.bm25(queries, chunks, 1, retrieval.mixed_tokens).collect()}
    assert got == {"q1": "k1", "q2": "k2"}
    numbered = chunks.withColumn("id", F.substring("id", 2, 1).cast("long"))
    asked = spark.createDataFrame([(1, "细胞膜的电位"), (2, "循环")], "query_id long, query string")
    vectors = numbered.select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    best = retrieval.retrieve(asked, numbered, asked.select("query_id", F.array(F.lit(1.0), F.lit(0.3)).alias("q")), vectors, 2)
    assert {r["query_id"]: r["id"] for r in best.where("rank = 1").collect()} == {1: 1, 2: 2}
    few = retrieval.hybrid_hits(asked, numbered.where("id < 3"), asked.select("query_id", F.array(F.lit(1.0), F.lit(0.3)).alias("q")), vectors)
    assert {r["method"] for r in few.collect()} == {"vector"}


def test_events_and_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"message": {"message_id": "1", "chat_id": "c", "content": "{}"}, "ts": "2024-01-01T00:00:00Z"}\nno json\n')
    q = chat.event_stream(spark, str(tmp_path / "in")).select("message.message_id").writeStream.format("memory").queryName("events_in").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(str(r["message_id"]) for r in spark.table("events_in").collect()) == ["1", "None"]
    jobs = spark.createDataFrame([("a", "running", 4, 1, "key"), ("b", "queued", 0, 0, "key")], "job_id string, status string, chapters int, chapters_done int, api_key string")
    assert sorted(map(tuple, chat.public_jobs(jobs).collect())) == [("a", "running", 4, 1, 0.25), ("b", "queued", 0, 0, 0.0)]


def test_by_id_refuses(spark):
    import pytest

    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    assert library.by_id(rows, "id", "a").first()["n"] == 1
    with pytest.raises(Exception, match="id b is not there"):
        library.by_id(rows, "id", "b").collect()


def test_own_results_count_in_compression(spark):
    nodes = spark.createDataFrame([("a", "x", "1234567890", [("quote",)]), ("b", "y", "", [])], "id string, name string, definition string, sources array<struct<source_quote string>>")
    d = spark.createDataFrame([(1, "merge", ["a", "b"], "n", "123"), (2, "remove", ["a"], None, None), (3, "keep", ["b", "gone"], None, None), (4, "keep", [], None, None)], "seq int, action string, affected_nodes array<string>, name string, definition string")
    got = [tuple(r) for r in library.decision_compression(d, nodes).orderBy("seq").collect()]
    assert got == [(1, 16, 3, 0.1875, True), (2, 15, 0, 0.0, True), (3, 1, 1, 1.0, False), (4, 0, 1, 1.0, False)]


def test_keyword_search_in_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} common") for k in range(40)], "id long, text string")
    queries = spark.createDataFrame([(k, f"w{k % 7} common other") for k in range(9)], "query_id long, query string")
    whole = sorted(map(tuple, retrieval.bm25(queries, chunks, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.bm25(queries, chunks, 4).collect())) == whole and len(whole) == 36
