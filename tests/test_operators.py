import pytest
from pyspark.sql import functions as F

from quire.operators import graph, integrate, retrieval, segment


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_markdown_and_text_chapters(spark):
    md = "# 书名\n\n## 第一章 绪论\n正文一\n### 小节\n正文\n## 第二章 细胞\n正文二"
    got = segment.finalise(segment.split_markdown(spark.createDataFrame([("m", md)], "k string, text string"), "k"), "k")
    assert [r["title"] for r in got.orderBy("chapter_idx").collect()] == ["第一章 绪论", "第二章 细胞"]
    assert "### 小节" in got.where("title = '第一章 绪论'").first()["content"]
    txt = "前言文字\n第一章 绪论\n正文一\n第二章 空\n第三章 细胞\n正文三"
    got = segment.finalise(segment.split_text(spark.createDataFrame([("t", txt)], "k string, text string"), "k"), "k")
    assert [(r["chapter_id"], r["title"], r["content"]) for r in got.orderBy("chapter_idx").collect()] == [("ch_01", "前置内容", "前言文字"), ("ch_02", "第一章 绪论", "正文一"), ("ch_03", "第三章 细胞", "正文三")]


def test_chunks(spark):
    sentence = "动作电位是细胞膜上的快速电位变化，由钠离子内流引起。"
    pieces = segment.recursive_chunks(sentence * 60)
    assert len(pieces) > 1 and all(len(p) <= 760 for p in pieces)
    assert segment.recursive_chunks("x" * 1500)[0] == "x" * 700
    assert segment.recursive_chunks("short") == ["short"]
    book = spark.createDataFrame([("b", "ch_01", "书", "第一章", 1, 6, sentence * 60)], "textbook_id string, chapter_id string, title string, chapter_title string, page_start int, page_end int, content string")
    got = segment.with_refs(segment.chunk(book), book).orderBy("chunk_index").collect()
    assert got[0]["char_start"] == 0 and got[0]["page"] == 1 and got[-1]["page"] >= 4
    assert got[0]["source_ref"] == "[书, 第一章, 第 1 页]" and got[0]["chunk_id"].startswith("rag_b_ch_01_0001_")
    with pytest.raises(ValueError):
        segment.chunk(book, size=100)


def test_pdf_lines_and_scan(spark):
    items = [
        ("d", 1, 0, "生理学", 50.0, 700.0, 80.0, "Bold", 28.0),
        ("d", 1, 1, "Chapter 1", 50.0, 600.0, 50.0, "F", 12.0),
        ("d", 1, 2, "Introduction", 110.0, 601.0, 60.0, "F", 12.0),
        ("d", 1, 3, "Body of one", 50.0, 500.0, 60.0, "F", 12.0),
        ("d", 2, 0, "Chapter 2 Cell Function", 50.0, 700.0, 90.0, "F", 12.0),
        ("d", 2, 1, "Body of two", 50.0, 600.0, 90.0, "F", 12.0),
    ]
    df = spark.createDataFrame(items, "doc string, page int, ord int, str string, x double, y double, width double, font_name string, font_size double")
    lines = segment.group_items(df)
    assert ("Chapter 1 Introduction",) in rows(lines, "text")
    from quire.sources.files import pdf_chapters

    got = pdf_chapters(df).orderBy("segment").collect()
    assert [(r["title"], r["page_start"], r["page_end"]) for r in got] == [("全文", 1, 1), ("Chapter 1 Introduction", 1, 1), ("Chapter 2 Cell Function", 2, 2)]
    title = segment.pick_title(lines.withColumnRenamed("text", "line"))
    assert title.first()["title"] == "生理学"


def _extraction(spark):
    chapters = spark.createDataFrame([("book_test", 1, "ch_01", "第一章", 1, "c1"), ("book_test", 2, "ch_02", "第二章", 4, "c2")], "book string, chapter_idx int, chapter_id string, title string, page_start int, content string")
    raw = [(1, "动作电位", 0), (1, "静息电位", 1), (2, "钠通道", 0), (2, "心肌细胞", 1), (2, "兴奋", 2)]
    concepts = spark.createDataFrame([("book_test", c, p, n, f"{n}的定义", "核心概念", f"ch_0{c}", "第一章" if c == 1 else "第二章", c, "q") for c, n, p in raw], "book string, chapter_idx int, pos int, name string, definition string, category string, chapter_id string, chapter string, page int, quote string")
    mentions = graph.topic_mentions(chapters).unionByName(concepts).withColumn("ord", F.col("chapter_idx") * 1000 + F.col("pos"))
    return chapters, mentions


def test_graph_build(spark):
    _, mentions = _extraction(spark)
    nodes = graph.upsert_nodes(mentions).cache()
    assert [r["id"] for r in nodes.orderBy("ord").collect()] == [f"book_test_node_00{i}" for i in range(1, 8)]
    schema = "book string, ord int, chapter_idx int, source string, target string, relation_type string, description string, evidence string, derived boolean"
    said = [
        ("book_test", 1, 1, "动作电位", "静息电位", "包含", "d", "", False),
        ("book_test", 2, 2, "钠通道", "动作电位", "依赖", "d", "", False),
        ("book_test", 3, 2, "兴奋", "心肌细胞", "applies_to", None, "", False),
        ("book_test", 4, 1, "动作电位", "钠通道", "contains", "forward", "", False),  # not known yet
        ("book_test", 5, 2, "兴奋", "兴奋", "contains", "loop", "", False),
        ("book_test", 6, 2, "兴奋", "钠通道", "unknown", "x", "", False),
        ("book_test", 7, 2, "钠通道", "动作电位", "prerequisite", "d", "", False),  # again
        ("book_test", 8, 2, "book_test_node_002", "nobody", "contains", "x", "", False),
    ]
    facts = graph.add_relationships(spark.createDataFrame(said, schema), nodes)
    assert rows(facts, "relation_type") == [("applies_to",), ("contains",), ("prerequisite",)]
    assert "存在 applies_to 关系" in facts.where("relation_type = 'applies_to'").first()["description"]
    topics = nodes.where(F.col("category") == graph.TOPIC).select("chapter", "id", "name")
    derived = graph.coverage(topics, nodes.where(F.col("category") != graph.TOPIC).select("chapter", "id", "name"))
    assert derived.count() == 5
    edges = facts.select("relation_type", "derived", "fact_eligible").unionByName(derived.select("relation_type", "derived", F.lit(False).alias("fact_eligible")))
    stats = graph.graph_stats(nodes.withColumn("textbook_id", F.col("book")), edges).first()
    assert (stats["node_count"], stats["factual_relationship_count"], stats["derived_relationship_count"], stats["relation_types"]) == (7, 3, 5, "applies_to,contains,prerequisite")


def test_upsert_merges_mentions(spark):
    m = [("b", 1, " A  b", "", "x", "c1", 1, "一", 5, "q"), ("b", 2, "a B", "long definition that is longer than the default sentence", "y", "c2", 2, "二", 3, "q"), ("b", 3, "a b", "s", "x", "c2", 2, "二", 3, "q"), ("b", 4, "", "gone", "x", "c2", 2, "二", 3, "q")]
    got = graph.upsert_nodes(spark.createDataFrame(m, "book string, ord int, name string, definition string, category string, chapter_id string, chapter_idx int, chapter string, page int, quote string")).collect()
    assert len(got) == 1
    assert (got[0]["name"], got[0]["category"], got[0]["categories"], got[0]["chapter"], got[0]["page"], got[0]["frequency"]) == ("A b", "x", ["x", "y"], "一；二", 3, 2)


def _replay(raw, log):
    return {g.id: (g.raw, g.status) for g in integrate.replay(raw, log)}


def test_replay():
    raw = ["a1", "a2", "b1", "b2"]
    merge = {"action": "merge", "affected_nodes": ["a1", "b1"], "result_node": "m", "decision_id": "merge_001"}
    assert _replay(raw, [merge]) == {"a2": (("a2",), "raw"), "b2": (("b2",), "raw"), "m": (("a1", "b1"), "merged")}
    keep = {"action": "keep", "affected_nodes": ["a1", "b1"], "decision_id": "keep_002"}
    assert _replay(raw, [merge, keep])["a1"] == (("a1",), "kept")
    remove = {"action": "remove", "affected_nodes": ["b2"]}
    assert "b2" not in _replay(raw, [remove])
    assert "b2" not in _replay(raw, [remove, {"action": "keep", "affected_nodes": ["b2"]}])  # not restored
    wider = {"action": "merge", "affected_nodes": ["b1", "b2"], "result_node": "w"}
    assert _replay(raw, [merge, wider])["w"][0] == ("a1", "b1", "b2")
    assert _replay(raw, [{"action": "merge", "affected_nodes": ["a1"]}]) == _replay(raw, [])
    left = _replay(raw, [{"action": "merge", "affected_nodes": ["a1", "a2", "b1"], "result_node": "m"}, {"action": "remove", "affected_nodes": ["b1"]}])
    assert sum(r == ("a1", "a2") for r, _ in left.values()) == 1


def test_fold_and_edges(spark):
    raw = spark.createDataFrame([("a1", 0, "细胞", "d", "c", 3, "A"), ("b1", 1, "细胞膜", "longer d", "c", None, "B"), ("x", 2, "其他", "d", "c", 1, "A")], "id string, ord int, name string, definition string, category string, page int, textbook_id string")
    log = spark.createDataFrame([(1, "merge", ["a1", "b1"], "m")], "seq int, action string, affected_nodes array<string>, result_node string")
    current = integrate.current_ids(raw, log)
    assert rows(current, "raw_id", "id") == [("a1", "m"), ("b1", "m"), ("x", "x")]
    merged = integrate.merged_nodes(raw, current).where("id = 'm'").first()
    assert (merged["name"], merged["definition"], merged["page"], merged["frequency"], merged["textbook_id"]) == ("细胞", "longer d", 0, 2, "A；B")
    edges = spark.createDataFrame([(0, "a1", "x", "contains", "d"), (1, "b1", "x", "contains", "d"), (2, "a1", "b1", "parallel", "d")], "ord int, source string, target string, relation_type string, description string")
    assert rows(integrate.rewrite_edges(edges, current), "source", "target", "ord") == [("m", "x", 0)]


def test_rounds():
    go = {"integrated": True, "action": "merge", "should_continue": True, "necessity": {"necessary": True}}
    assert len(integrate.run_rounds(lambda k: go)) == 40
    assert len(integrate.run_rounds(lambda k: go if k < 2 else go | {"action": "keep"})) == 3
    assert integrate.run_rounds(lambda k: None) == []


def test_candidates(spark):
    text = "id string, name string, definition string, category string, chapter string, textbook_id string"
    n = retrieval.prepared(spark.createDataFrame([("a", "动作电位", "细胞膜电位变化", "核心概念", "第一章", "A"), ("b", "动作电位", "膜电位的变化", "核心概念", "第二章", "B"), ("c", "血液", "液体组织", "核心概念", "第三章", "A")], text))
    got = retrieval.rank_candidates(n.where("id = 'a'"), n).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "c"] and got[0]["score"] > 0.72 and got[1]["score"] < 0.2


def test_verify(spark):
    ref, none = "[书, 第1章, 第 3 页]", []
    cases = [
        (f"答案 {ref}。", [ref], (True, False, f"答案 {ref}。")),
        ("答案。", [ref, ref], (True, True, f"答案。 来源：{ref}")),
        ("答案 [假, 第9章, 第 1 页]。", [ref], (True, True, f"答案。 来源：{ref}")),
        ("答案", none, (False, False, "答案")),
        ("", [ref], (True, False, retrieval.NOT_FOUND)),
    ]
    df = spark.createDataFrame([(k, a, r) for k, (a, r, _) in enumerate(cases)], "k int, a string, r array<string>")
    for row in df.select("k", retrieval.verify_citations(F.col("a"), F.col("r")).alias("v")).collect():
        assert (row["v"]["verified"], row["v"]["injected"], row["v"]["answer"]) == cases[row["k"]][2]


def test_keyword_vector(spark):
    df = spark.createDataFrame([("aa aa b",), ("zzz",)], "t string")
    got = [r["v"] for r in df.select(retrieval.keyword_vector(F.col("t"), ["aa", "b"]).alias("v")).collect()]
    assert got[0] == [2.0, 1.0] and len(got[1]) == 2 and all(0 <= x <= 1 for x in got[1])


def test_view_graph(spark):
    n = spark.createDataFrame([("a", 0, "第一章", "d", "章节主题", "第一章", "ch_01", 1, "chapter", 1, "A"), ("b", 1, "细胞", "d", "核心概念", "第一章", "ch_01", 2, "knowledge", 3, "A")], "id string, ord int, name string, definition string, category string, chapter string, chapter_id string, page int, node_kind string, frequency int, textbook_id string")
    e = spark.createDataFrame([("e", "a", "b", "contains", True, False)], "id string, source string, target string, relation_type string, derived boolean, fact_eligible boolean")
    look = {r["id"]: r for r in graph.visual_nodes(n).collect()}
    assert look["a"]["label"] == "第一章" and look["a"]["is_chapter"] and look["b"]["size"] == 40
    assert {r["id"]: (r["x"], r["y"]) for r in graph.layout(n).collect()} == {"a": (260.0, 230.0), "b": (260.0, 92.0)}
    assert ("关系｜包含关系", "指向｜核心概念", 1) in rows(graph.sankey_links(n, e), "source", "target", "value")
    assert graph.visual_edges(e).first()["derived"]
    assert rows(graph.neighbourhood(e, n, F.col("id") == "a"), "id") == [("a",), ("b",)]
    assert graph.knowledge(n).count() == 1 and graph.knowledge(n.where("id = 'a'")).count() == 1


def test_replay_is_the_fold_step_by_step():
    import random
    import time

    for seed in range(60):
        r = random.Random(seed)
        ids = [f"n{k}" for k in range(r.randint(1, 12))]
        log = [{"action": r.choice(["merge", "merge", "keep", "remove"]), "affected_nodes": [r.choice([*ids, "no"]) for _ in range(r.randint(0, 4))], "decision_id": f"d{k}", "result_node": r.choice([None, None, f"m{k}"]), "result_node_detail": {"k": k}} for k in range(r.randint(0, 40))]
        groups = [integrate.Group(i, (i,)) for i in ids]
        for d in log:
            groups = integrate.apply_decision(groups, d, set(ids))
        key = lambda g: g.raw
        assert sorted(integrate.replay(ids, log), key=key) == sorted(groups, key=key)
    many = [f"n{k}" for k in range(40_000)]
    start = time.time()
    (one,) = integrate.replay(many, ({"action": "merge", "affected_nodes": [many[0], i]} for i in many[1:]))
    assert len(one.raw) == len(many) and time.time() - start < 20  # minutes where each step lists the whole group
