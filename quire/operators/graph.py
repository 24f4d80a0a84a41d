"""Property graphs: building, loading, statistics and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as T

TOPIC = "章节主题"


def is_fact(derived: str = "derived", eligible: str = "fact_eligible") -> Column:
    """Neither derived nor marked as no fact; an unknown mark counts as a fact."""
    return ~F.coalesce(F.col(derived), F.lit(False)) & F.coalesce(F.col(eligible), F.lit(True))


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_wins(df, keys, *(F.desc(c) for c in order))


def ordered_set(value: str, *order: str) -> Column:
    """Aggregate: distinct non-empty values in the order of their first appearance."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct(*order, F.col(value).alias("_v")))))
    return F.array_distinct(F.transform(rows, lambda r: r["_v"]))


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """One node per book and name from mentions (book, ord, name, definition, category, chapter_id, chapter, page, quote).

    The first mention gives id and category; categories and chapters are gathered in order; sources are distinct by
    chapter, page and quote and give the frequency; the smallest page and the longest definition win, the earliest of
    equal length first. A first mention without definition counts as having the default sentence.
    """
    m = mentions.withColumn("name", T.compact_text(F.col("name"))).where("name != ''").withColumn("key", F.lower("name"))
    m = m.withColumn("definition", T.compact_text(F.col("definition"))).withColumn("quote", F.left(T.compact_text(F.col("quote")), F.lit(260)))
    opens = F.row_number().over(W.partitionBy("book", "key").orderBy("ord")) == 1
    default = F.concat("name", F.lit(" 是教材《"), "book", F.lit("》中出现的知识点。"))
    m = m.withColumn("definition", F.when(opens & (F.col("definition") == ""), default).otherwise(F.col("definition")))
    longest = F.max_by("definition", F.struct(F.length("definition").alias("n"), (-F.col("ord")).alias("o")))
    out = m.groupBy("book", "key").agg(
        F.min("ord").alias("ord"),
        F.min_by("name", "ord").alias("name"),
        longest.alias("definition"),
        F.min_by("category", "ord").alias("category"),
        ordered_set("category", "ord").alias("categories"),
        F.array_join(ordered_set("chapter", "ord"), "；").alias("chapter"),
        F.min("page").alias("page"),
        F.count_distinct(F.struct("chapter_id", "page", "quote")).alias("frequency"),
        F.min_by("chapter_idx", "ord").alias("first_chapter"),
    )
    number = F.row_number().over(W.partitionBy("book").orderBy("ord"))
    return out.withColumn("id", F.concat("book", F.lit("_node_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))))


def topic_mentions(chapters: DataFrame) -> DataFrame:
    """The mention by which each chapter's title becomes a node; it comes before the chapter's other mentions."""
    return chapters.select(
        "book",
        "chapter_idx",
        F.lit(-1).alias("pos"),
        F.col("title").alias("name"),
        F.concat(T.compact_text(F.col("title")), F.lit(" 的章节主题节点，用于连接本章抽取出的核心知识点。")).alias("definition"),
        F.lit(TOPIC).alias("category"),
        "chapter_id",
        F.col("title").alias("chapter"),
        F.col("page_start").alias("page"),
        F.left(T.normalize_text(F.col("content")), F.lit(120)).alias("quote"),
    )


def add_relationships(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships (book, ord, chapter_idx, source, target, relation_type, description, evidence, derived) with ends resolved.

    An end is a node's name, else its id, of a node known by that chapter. Unknown types, unknown ends and loops go;
    of equal (source, target, type, description) the first stays.
    """
    by_name = nodes.select("book", F.col("key").alias("ref"), F.col("id"), F.col("name"), "first_chapter", F.lit(0).alias("rank"))
    by_id = nodes.select("book", F.col("id").alias("ref"), "id", "name", "first_chapter", F.lit(1).alias("rank"))
    refs = by_name.unionByName(by_id)
    r = rows.withColumn("relation_type", T.relation_type(F.col("relation_type"))).where("relation_type is not null")
    for end in ("source", "target"):
        ref = T.compact_text(F.col(end))
        own = refs.select(F.col("book").alias("_b"), F.col("ref").alias("_ref_name"), F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"), F.col("first_chapter").alias("_first"), F.col("rank").alias("_rank"))
        match = (F.col("book") == F.col("_b")) & (F.when(F.col("_rank") == 0, F.lower(ref)).otherwise(ref) == F.col("_ref_name")) & (F.col("_first") <= F.col("chapter_idx"))
        r = r.join(own, match).withColumn("_k", F.row_number().over(W.partitionBy("book", "ord").orderBy("_rank"))).where("_k = 1").drop("_b", "_ref_name", "_first", "_rank", "_k")
    r = r.where("source_id != target_id")
    default = F.concat("source_name", F.lit(" 与 "), "target_name", F.lit(" 存在 "), "relation_type", F.lit(" 关系。"))
    r = r.withColumn("description", F.when(F.col("description").isNull(), default).otherwise(T.compact_text(F.col("description")))).withColumn("evidence", F.left(T.compact_text(F.col("evidence")), F.lit(260)))
    r = first_wins(r, ["book", "source_id", "target_id", "relation_type", "description"], "ord")
    number = F.row_number().over(W.partitionBy("book").orderBy("ord"))
    fact = ~F.coalesce(F.col("derived"), F.lit(False))
    return r.withColumn("id", F.concat("book", F.lit("_edge_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))).withColumn("fact_eligible", fact)


def coverage(topics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Derived edges from each chapter's topic (chapter, id, name) to its nodes (chapter, id, name)."""
    t = topics.select("chapter", F.col("id").alias("source"), F.col("name").alias("source_name"))
    n = nodes.select("chapter", F.col("id").alias("target"), F.col("name").alias("target_name"))
    return t.join(n, "chapter").where("source != target").select("source", "target", F.lit("contains").alias("relation_type"), F.concat("source_name", F.lit(" 包含本章知识点“"), "target_name", F.lit("”。")).alias("description"), F.lit(True).alias("derived"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; types are sorted and joined by commas."""
    fact = is_fact()
    n = nodes.agg(F.count("*").alias("node_count"), F.count_distinct("textbook_id").alias("textbook_count"))
    e = edges.agg(
        F.count_if(fact).alias("factual_relationship_count"),
        F.count_if(~fact).alias("derived_relationship_count"),
        F.count("*").alias("total_relationship_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(fact, F.col("relation_type")))), ",").alias("relation_types"),
        F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("all_relation_types"),
    )
    return n.join(e, F.lit(True))


def joined_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    made = T.short_hash(F.concat_ws("|", "source", "target", "relation_type"), 12)
    return edges.withColumn("id", F.coalesce("id", made))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at each node, both ends counted; a loop counts twice."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, n: int = 24) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "ord").limit(n)


def relation_matrix(nodes: DataFrame, edges: DataFrame, n: int = 24) -> DataFrame:
    """Edges between each two of the ``n`` best-connected nodes."""
    top = F.broadcast(top_by_degree(nodes, edges, n).select("id", F.left(T.strip(T.fold(F.col("name"))), F.lit(10)).alias("label")))
    e = edges.join(top.toDF("source", "source_label"), "source").join(top.toDF("target", "target_label"), "target")
    return e.groupBy("source", "target", "source_label", "target_label").agg(F.count("*").alias("n"))


def _or_else(c: Column, other: str) -> Column:
    t = T.strip(T.fold(F.coalesce(c, F.lit(other))))
    return F.when(t == "", F.lit(other)).otherwise(t)


def sankey_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Flows from chapters to categories, on to relations and to the categories they point at."""
    chapter = F.concat(F.lit("章节｜"), F.left(_or_else(F.col("chapter"), "未分章节"), F.lit(14)))
    category = lambda c: F.left(_or_else(c, "未分类"), F.lit(10))
    weight = F.when(F.coalesce(F.col("frequency"), F.lit(1)) == 0, 1).otherwise(F.coalesce(F.col("frequency"), F.lit(1)))
    first = nodes.select(chapter.alias("source"), F.concat(F.lit("类别｜"), category(F.col("category"))).alias("target"), weight.cast("long").alias("value"))
    kinds = nodes.select("id", F.col("category"))
    e = edges.join(kinds.toDF("source", "sc"), "source").join(kinds.toDF("target", "tc"), "target")
    relation = F.concat(F.lit("关系｜"), F.left(T.relation_label(F.col("relation_type")), F.lit(12)))
    second = e.select(F.concat(F.lit("类别｜"), category(F.col("sc"))).alias("source"), relation.alias("target"), F.lit(1).cast("long").alias("value"))
    third = e.select(relation.alias("source"), F.concat(F.lit("指向｜"), category(F.col("tc"))).alias("target"), F.lit(1).cast("long").alias("value"))
    return first.unionByName(second).unionByName(third).groupBy("source", "target").agg(F.sum("value").alias("value"))


def _sorted(column: str, zh: bool) -> Column:
    return F.collate(column, "zh") if zh else F.col(column)


def timeline(nodes: DataFrame, zh: bool = False) -> DataFrame:
    """Chapters by their first page, with the number of nodes and a running index; ``zh`` sorts titles as Chinese readers do."""
    c = nodes.groupBy(_or_else(F.col("chapter"), "未分章节").alias("chapter")).agg(F.min(F.when(F.col("page") != 0, F.col("page"))).alias("page"), F.count("*").alias("nodes"))
    return c.withColumn("progress", F.row_number().over(W.orderBy(F.col("page").asc_nulls_last(), _sorted("chapter", zh))))


def neighbourhood(edges: DataFrame, nodes: DataFrame, of: Column) -> DataFrame:
    """Nodes that ``of`` marks, and all they share an edge with."""
    seeds = nodes.where(of).select(F.col("id").alias("seed"))
    both = edges.select(F.col("source").alias("seed"), F.col("target").alias("id")).unionByName(edges.select(F.col("target").alias("seed"), F.col("source").alias("id")))
    near = both.join(seeds, "seed").unionByName(seeds.withColumn("id", F.col("seed")))
    return near.distinct()


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with the query in any of their texts, whatever the case."""
    all_text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "definition", "category", "chapter", "textbook_id"))))
    return nodes.where(all_text.contains(query.lower()))


def knowledge(nodes: DataFrame) -> DataFrame:
    """Nodes that are no chapters; all of them where there are only chapters."""
    own = (F.col("node_kind") != "chapter") & (F.col("category") != TOPIC)
    some = nodes.agg(F.max(own).alias("_some"))
    return nodes.join(F.broadcast(some), F.lit(True)).where(own | ~F.coalesce(F.col("_some"), F.lit(False))).drop("_some")


def layout(nodes: DataFrame, zh: bool = False) -> DataFrame:
    """Places on the plane: chapters on a grid, their nodes on rings around by page and name.

    ``zh`` sorts titles and names as Chinese readers do.
    """
    group = F.coalesce("chapter_id", "chapter", "category", F.lit("未分组"))
    label = F.coalesce("chapter", "category", F.lit("未分组"))
    groups = nodes.groupBy(group.alias("g")).agg(F.min(label).alias("label"))
    total = groups.agg(F.count("*").alias("groups"))
    grid = groups.withColumn("index", F.row_number().over(W.orderBy(_sorted("label", zh), "g")) - 1).join(F.broadcast(total), F.lit(True)).withColumn("columns", F.greatest(F.lit(1), F.ceil(F.sqrt("groups"))).cast("int"))
    chapter = F.coalesce((F.col("node_kind") == "chapter") | F.concat_ws(" ", "category", "name").rlike("(?i)章节|chapter"), F.lit(False))
    n = nodes.withColumn("g", group).withColumn("is_chapter", chapter)
    n = n.withColumn("k", F.row_number().over(W.partitionBy("g", "is_chapter").orderBy(F.coalesce("page", F.lit(0)), _sorted("name", zh), "ord")) - 1).withColumn("size", F.count("*").over(W.partitionBy("g", "is_chapter")))
    n = n.join(grid.select("g", "index", "columns"), "g")
    cx, cy = F.lit(260.0) + (F.col("index") % F.col("columns")) * 430, F.lit(230.0) + F.floor(F.col("index") / F.col("columns")) * 360
    first = F.least(F.lit(8), F.greatest(F.lit(1), F.col("size")))
    ring = F.floor(F.col("k") / first)
    on_ring = F.when(ring == 0, first).otherwise(F.greatest(F.lit(1), F.col("size") - first))
    angle = -F.pi() / 2 + F.pi() * 2 * (F.col("k") % first) / on_ring + F.when(ring % 2 == 1, F.pi() / on_ring).otherwise(F.lit(0.0))
    radius = F.lit(138.0) + ring * 88
    x = F.when(F.col("is_chapter"), cx + F.col("k") * 70).otherwise(cx + F.cos(angle) * radius)
    y = F.when(F.col("is_chapter"), cy).otherwise(cy + F.sin(angle) * radius)
    return n.select("id", "is_chapter", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def visual_nodes(nodes: DataFrame) -> DataFrame:
    """What a node looks like: label, size and colours."""
    chapter = F.coalesce((F.col("node_kind") == "chapter") | F.concat_ws(" ", "category", "name").rlike("(?i)章节|chapter"), F.lit(False))
    frequency = F.greatest(F.coalesce("frequency", F.lit(1)), F.lit(1))
    label = F.when(chapter, T.chapter_badge(F.col("name"))).otherwise(T.short_label(F.col("name"), 8))
    size = F.least(F.when(chapter, 46).otherwise(44), F.when(chapter, 34).otherwise(25) + frequency * 5)
    return nodes.select("id", label.alias("label"), chapter.alias("is_chapter"), size.cast("long").alias("size"), T.category_colour(F.col("category"), F.col("node_kind")).alias("colour"))


def visual_edges(edges: DataFrame) -> DataFrame:
    return edges.select("id", "source", "target", T.relation_label(F.col("relation_type")).alias("label"), T.relation_colour(F.col("relation_type")).alias("colour"), (~is_fact()).alias("derived"))


def node_details(nodes: DataFrame, most: int = 4) -> DataFrame:
    """What a node's panel shows: its texts with plain words where they are missing, and its first sources."""
    shown = lambda c, other: _or_else(F.col(c), other).alias(c)
    return nodes.select("id", shown("name", "未命名"), shown("definition", "暂无定义"), shown("category", "未分类"), shown("chapter", "未分章节"), F.slice("sources", 1, most).alias("sources"), F.size("sources").alias("source_count"))


def inherited(rows: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Nodes or edges (book, chapter_id) with what their book (book, title, filename, total_pages, total_chars) and chapter say."""
    b = books.select("book", F.col("title").alias("textbook_title"), "filename", "total_pages", "total_chars")
    c = chapters.select("book", "chapter_id", F.col("title").alias("chapter_title"), "chapter_idx", "page_start", "page_end", "char_count")
    return rows.join(b, "book", "left").join(c, ["book", "chapter_id"], "left")


def legend(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("textbook_id").alias("sources"), F.count_distinct("category").alias("categories"), F.bool_or(F.col("frequency") > 1).alias("has_frequency"))
