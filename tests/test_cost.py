"""Steps that must not be worked out twice, nor row by row where a block will do: seen in their plans, results beside them."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import integrate, library, retrieval, segment
from quire.plans import catalog, more
from quire.plans import derived as D

DOCS = [(k, "\n".join(f"Chapter {i} x\n the  red {k} ring {i}" for i in range(4)), "en", f"s{k % 2}", 100) for k in range(9)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")


def test_keyword_vector_reads_a_text_once(spark):
    v = docs(spark).select(retrieval.keyword_vector(F.col("text"), ["the", "ring", "x"]).alias("v"))
    assert v.collect()[0]["v"] == [4.0, 4.0, 4.0]
    assert plan(v).count("regexp_replace(") == 1


def test_white_space_is_read_once(spark):
    odd = [" a\t\r\n\r\n b　 c ", "\r\n", "", None, "##  第一章 \u0000x .....7", "Ch\u0000apter 1 y", "chapter  3 z 12"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    got = df.select(T.compact_text(F.col("t")), T.compact_title(F.col("t")), T.is_chapter_title(F.col("t")), T.normalize_whitespace(F.col("t")))
    assert [tuple(r) for r in got.collect()] == [
        ("a b c", "a b c", False, "a \n\n b　 c"),
        ("", "", False, ""),
        ("", "", False, ""),
        ("", "", False, ""),
        ("## 第一章 \x00x .....7", "第一章 x", True, "## 第一章 \x00x .....7"),
        ("Ch\x00apter 1 y", "Chapter 1 y", True, "Ch\x00apter 1 y"),
        ("chapter 3 z 12", "chapter 3 z", True, "chapter 3 z 12"),
    ]
    assert plan(df.select(T.compact_text(F.col("t")).alias("c"))).count("regexp_replace(") == 1
    assert plan(df.select(T.is_chapter_title(F.col("t")).alias("c"))).count("regexp_replace(") == 4


def test_relation_type_reads_known_names_as_they_are(spark):
    df = spark.createDataFrame([("Contains",), (" 依赖\n",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(T.relation_type(F.col("t"))).collect()] == ["contains", "prerequisite", None, None]


def test_pages_share_a_call(spark):
    rows = [("d", p, k, w, 10.0 * k, 100.0 - 2.5 * (k // 3), 8.0, "Bold" if k == 4 else None, None) for p in range(3) for k, w in enumerate("abcdefg")]
    items = spark.createDataFrame([*rows, ("e", 0, 0, " ", 1.0, 1.0, 1.0, None, 1.0)], "doc string, page int, ord int, str string, x double, y double, width double, font_name string, font_size double")
    got = segment.group_items(items)
    assert "InPandas" not in plan(got)
    assert sorted((r["doc"], r["page"], -r["y"], r["text"], r["bold"]) for r in got.collect()) == [x for p in range(3) for x in (("d", p, -100.0, "abcdef", True), ("d", p, -95.0, "g", False))]


def test_search_scores_blocks(spark):
    q = spark.createDataFrame([(1, "red ring 3"), (2, "none")], "query_id long, query string")
    chunks = docs(spark).select(F.col("doc_id").alias("id"), "text")
    found = retrieval.bm25(q, chunks, 2)
    assert "Generate explode" not in plan(found)  # no row a token
    assert [(r["query_id"], r["id"], r["rank"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 3, 1), (1, 0, 2)]
    held = retrieval.lexical_top_k(q, chunks, 2)
    assert "Join" not in plan(held)
    assert [tuple(r) for r in held.orderBy("query_id", "rank").collect()] == [(1, 0, 1.0, 1), (1, 1, 1.0, 2), (2, 0, 0.0, 1), (2, 1, 0.0, 2)]


def test_chapters_are_cut_inside_the_row(spark):
    cut = segment.split_text(docs(spark), "doc_id")
    assert "posexplode" not in plan(cut)
    assert [tuple(r) for r in cut.where("doc_id = 0").orderBy("segment").collect()] == [(0, i + 1, f"Chapter {i} x", f"the red 0 ring {i}") for i in range(4)]
    told = segment.finalise(cut, "doc_id").select("doc_id", "chapter_id", "char_count")
    window = next(x for x in plan(told).splitlines() if "Window" in x)
    assert "content" not in window and told.count() == 36


def test_books_are_ordered_without_their_texts(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    s = library.book_summary(D.chapters(spark, str(tmp_path), preview=T.preview(F.col("text"), 9)), "textbook_id")
    assert {r["textbook_id"]: [c["preview"] for c in r["chapters"]] for r in s.collect()} == {"s0": ["Chapter 0..."] * 5, "s1": ["Chapter 0..."] * 4}
    assert "text#" not in plan(s).split("Window")[-1].splitlines()[1].split("AS")[0]


def test_sides_are_parsed_once(spark):
    rows = spark.createDataFrame([(0, '{"source": " a ", "target": "b"}'), (1, '{"source": "a", "target": " "}'), (2, '{"source": null, "target": "b"}')], "pos int, t string")
    sides = library.normalised_sides(rows.select(F.lit("f.json").alias("file"), "pos", F.parse_json("t").alias("row")), ascii_only=True)
    assert [(r["pos"], r["source"], r["target"], r["id"]) for r in sides.collect()] == [(0, "a", "b", "f_edge_001")]
    assert plan(sides).lower().count("parse") <= 1 or "Filter" not in plan(sides)


IDS = [("a", "a"), ("b", "a"), ("c", "c"), ("c", "x"), ("d", "d"), (None, "n")]
ENDS = [("a", "c"), ("b", "c"), ("a", "b"), ("c", "c"), ("c", "c"), ("d", "gone"), ("d", None), ("d", "a"), (None, "a"), ("gone", "gone")]


def edges_and_ids(spark, times=1):
    rows = [(f"e{k}", k, s, t, "contains", None) for k, (s, t) in enumerate(ENDS * times)]
    e = spark.createDataFrame(rows, "id string, ord long, source string, target string, relation_type string, description string")
    return e, spark.createDataFrame(IDS, "raw_id string, id string")


def test_edges_are_counted_in_one_pass(spark):
    e, ids = edges_and_ids(spark)
    after = {(x, y, 0 if x == "a" else 7) for x, y in (("a", "c"), ("a", "x"), ("d", "a"))} | {("c", "x", 3), ("x", "c", 3)}
    kept = integrate.rewrite_edges(e, ids)
    assert {(r["source"], r["target"], r["ord"]) for r in kept.collect()} == after and kept.columns == ["id", "ord", "relation_type", "description", "source", "target"]
    assert {r["id"] for r in kept.collect()} == {"e0", "e3", "e7"}
    raw = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in integrate.comparison(raw, e, ids).collect()] == [(2, len(ENDS), 5, len(after))]
    assert tuple(integrate.edge_counts(e.limit(0), ids).first()) == (0, 0) and tuple(integrate.edge_counts(e, ids.limit(0)).first()) == (len(ENDS), 0)
    assert "Window" not in plan(kept)


def test_frequent_ends_are_split(spark):
    e, ids = edges_and_ids(spark, 3000)
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        counted = integrate.edge_counts(e.repartition(8), ids)
        assert tuple(counted.collect()[0]) == (3000 * len(ENDS), 5)
        assert "ShuffledHashJoin(skew=true)" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_summary_reads_lines_twice(spark):
    here = "/root/testdata/sf0.001"
    read = lambda df, column: sum("Relation [" in x and column in x for x in plan(df).splitlines())
    for query, times in ((more.graph_summary, 2), (catalog.before_after, 1), (catalog.action_counts, 1), (catalog.remaining_nodes, 1)):
        assert read(query(spark, here), "l_orderkey") == times
    assert "Window" not in plan(catalog.action_counts(spark, here)) and "Window" not in plan(catalog.merged_by_name(spark, here))


def test_names_are_looked_up(spark):
    n = spark.createDataFrame([("n2", "x"), ("n1", "x"), ("n4", None), ("n3", None), ("n5", "y")], "id string, name string")
    assert sorted(tuple(r) for r in D.same_name(n).collect()) == [("n1", "n1"), ("n2", "n1"), ("n3", "n3"), ("n4", "n3"), ("n5", "n5")]
