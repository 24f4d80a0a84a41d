"""The engine's entities drawn from the provided star tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long each, dealt out: one file with one row group is one task, however large."""
    return table(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts from parts: a book is a brand, a category a type, a page a size."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        F.concat("p_name", F.lit(" is a "), F.lower("p_type"), F.lit(" part of "), "p_brand").alias("definition"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("textbook_id"),
        F.col("p_size").alias("page"),
        F.concat(F.lit("Unit "), F.floor(F.col("p_size") / 5).cast("string")).alias("chapter"),
        F.concat(F.lit("ch_"), F.lpad(F.floor(F.col("p_size") / 5).cast("string"), 2, "0")).alias("chapter_id"),
        (F.floor(F.col("p_retailprice") / 100) % 5 + 1).cast("int").alias("frequency"),
        F.when(F.col("p_size") >= 49, "chapter").otherwise("knowledge").alias("node_kind"),
    )


NODES = """nodes AS (SELECT 'n' || p_partkey AS id, p_partkey AS ord, p_name AS name,
  p_name || ' is a ' || lower(p_type) || ' part of ' || p_brand AS definition, p_type AS category, p_brand AS textbook_id,
  p_size AS page, 'Unit ' || CAST(floor(p_size / 5) AS INT) AS chapter, 'ch_' || lpad(CAST(CAST(floor(p_size / 5) AS INT) AS VARCHAR), 2, '0') AS chapter_id,
  CAST(CAST(floor(p_retailprice / 100) AS BIGINT) % 5 + 1 AS INT) AS frequency,
  CASE WHEN p_size >= 49 THEN 'chapter' ELSE 'knowledge' END AS node_kind FROM part)"""


def same_name(n: DataFrame) -> DataFrame:
    """raw_id and id of nodes that are merged by name: the smallest id of a name, looked up, as no task need see all its nodes."""
    least = n.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_id"))
    return n.join(least, F.col("name").eqNullSafe(F.col("_name"))).select(F.col("id").alias("raw_id"), F.col("_id").alias("id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations from neighbouring lines of an order: kind and marks from flags and discounts."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "prerequisite").when(F.col("l_returnflag") == "R", "contains").when(F.col("l_linestatus") == "O", "applies_to").otherwise("parallel")
    e = li.withColumn("to", F.lead("l_partkey").over(order)).withColumn("k", F.row_number().over(order)).where(F.col("to").isNotNull())
    return e.select(
        F.concat(F.lit("e"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("id"),
        (F.col("l_orderkey") * 1000 + F.col("k")).alias("ord"),
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(F.lit("n"), F.col("to").cast("string")).alias("target"),
        kind.alias("relation_type"),
        (F.col("l_linestatus") == "O").alias("derived"),
        F.when(F.col("l_discount") > 0.075, False).when(F.col("l_discount") > 0.015, True).alias("fact_eligible"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("description"),
    )


EDGES = """edges AS (SELECT 'e' || l_orderkey || '_' || k AS id, l_orderkey * 1000 + k AS ord, 'n' || l_partkey AS source, 'n' || nxt AS target,
  CASE WHEN l_returnflag = 'A' THEN 'prerequisite' WHEN l_returnflag = 'R' THEN 'contains' WHEN l_linestatus = 'O' THEN 'applies_to' ELSE 'parallel' END AS relation_type,
  l_linestatus = 'O' AS derived, CASE WHEN l_discount > 0.075 THEN false WHEN l_discount > 0.015 THEN true END AS fact_eligible,
  'supplier ' || l_suppkey AS description FROM (SELECT *, lead(l_partkey) OVER w AS nxt, row_number() OVER w AS k FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE nxt IS NOT NULL)"""
FACT = "(NOT derived AND coalesce(fact_eligible, true))"


def chapters(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Chapters from documents: a book is a source, its chapters its documents in order, its pages 1800 characters each.

    ``more`` are columns of the documents that are worked out before books are ordered, so that no text need go there.
    """
    d = dealt(spark, sf_dir, "documents").withColumns(more) if more else table(spark, sf_dir, "documents")
    order = W.partitionBy("source").orderBy("doc_id")
    total = F.sum("n_chars").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    n = F.row_number().over(order)
    return d.select(
        F.col("source").alias("textbook_id"),
        "doc_id",
        n.alias("chapter_idx"),
        F.concat(F.lit("ch_"), n.cast("string")).alias("chapter_id"),
        F.col("source").alias("title"),
        F.concat(F.lit("Part "), n.cast("string")).alias("chapter_title"),
        (F.floor((total - F.col("n_chars")) / 1800) + 1).cast("int").alias("page_start"),
        (F.floor(total / 1800) + 1).cast("int").alias("page_end"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("char_count"),
        *more,
    )


CHAPTERS = """chapters AS (SELECT source AS textbook_id, doc_id, row_number() OVER w AS chapter_idx, 'ch_' || row_number() OVER w AS chapter_id, source AS title,
  'Part ' || row_number() OVER w AS chapter_title, CAST(floor((sum(n_chars) OVER w - n_chars) / 1800) + 1 AS INT) AS page_start,
  CAST(floor(sum(n_chars) OVER w / 1800) + 1 AS INT) AS page_end, text AS content, n_chars AS char_count FROM documents
  WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = """lines AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"""


def _decisions(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("part"))
    named = orders.join(li, orders["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey", "o_orderstatus", "o_orderdate").agg(F.array_sort(F.collect_set("part")).alias("affected_nodes"))
    action = F.when(F.col("o_orderstatus") == "F", "merge").when(F.col("o_orderstatus") == "O", "keep").otherwise("remove")
    return named.withColumn("action", action)


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's actions and affected nodes without their places, for steps that need no order."""
    return _decisions(spark, sf_dir, _urgent(spark, sf_dir)).select("action", "affected_nodes")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of decisions from orders: clerks merge, keep and remove the parts of an order.

    Rows are numbered within their date, after the rows of all earlier dates, so that no task sees the whole log.
    """
    urgent = _urgent(spark, sf_dir)
    d = _decisions(spark, sf_dir, urgent)
    listed = urgent.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    before = F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = listed.groupBy(F.col("o_orderdate").alias("day")).agg(F.count("*").alias("n")).select("day", before.alias("before"))
    seq = F.col("before") + F.row_number().over(W.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return d.join(F.broadcast(days), F.col("o_orderdate").eqNullSafe(F.col("day"))).select(seq.cast("int").alias("seq"), "action", "affected_nodes")


DECISIONS = """decisions AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq,
  CASE WHEN o_orderstatus = 'F' THEN 'merge' WHEN o_orderstatus = 'O' THEN 'keep' ELSE 'remove' END AS action, list_sort(list(DISTINCT 'n' || l_partkey)) AS affected_nodes
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey, o_orderstatus, o_orderdate)"""


#: The log folded step by step over a list of (raw id, current id, status); needs WITH RECURSIVE, NODES and DECISIONS.
FOLD = """raws AS (SELECT list(id) AS ids FROM nodes), log AS (SELECT seq, action, list_filter(affected_nodes, lambda x: list_contains(ids, x)) AS a FROM decisions, raws), named AS (SELECT DISTINCT unnest(a) AS id FROM log),
fold AS (SELECT 0::BIGINT AS seq, (SELECT list({'r': id, 'g': id, 's': 'raw'} ORDER BY id) FROM named) AS st UNION ALL
  SELECT seq, CASE WHEN len(t) = 0 THEN st WHEN action = 'merge' THEN CASE WHEN len(u) < 2 THEN st ELSE list_transform(st, lambda x: CASE WHEN list_contains(t, x.g) THEN {'r': x.r, 'g': made, 's': 'merged'} ELSE x END) END
    ELSE list_sort(list_concat(list_transform(CASE WHEN action = 'remove' THEN list_filter(st, lambda x: NOT list_contains(a, x.r)) ELSE st END, lambda x: CASE WHEN NOT list_contains(t, x.g) THEN x WHEN list_contains(a, x.r) THEN {'r': x.r, 'g': x.r, 's': 'kept'} ELSE {'r': x.r, 'g': coalesce(list_filter(rest, lambda q: q.g = x.g)[1].nm, x.r), 's': CASE WHEN list_filter(rest, lambda q: q.g = x.g)[1].nm IS NULL THEN x.s ELSE 'merged' END} END),
      CASE WHEN action = 'keep' THEN list_transform(list_filter(a, lambda i: NOT list_contains(rs, i)), lambda i: {'r': i, 'g': i, 's': 'kept'}) ELSE [] END)) END
  FROM (SELECT *, 'merged_' || left(sha1(array_to_string(u, '|')), 8) AS made, list_transform(t, lambda g: {'g': g, 'nm': CASE WHEN len(list_filter(tail, lambda x: x.g = g)) > 1 THEN g || '_' || left(sha1(array_to_string(list_transform(list_filter(tail, lambda x: x.g = g), lambda x: x.r), '|')), 6) END}) AS rest
    FROM (SELECT *, list_transform(list_filter(st, lambda x: list_contains(t, x.g)), lambda x: x.r) AS u, list_filter(st, lambda x: list_contains(t, x.g) AND NOT list_contains(a, x.r)) AS tail, list_transform(st, lambda x: x.r) AS rs
      FROM (SELECT l.seq, l.action, l.a, f.st, list_distinct(list_transform(list_filter(f.st, lambda x: list_contains(l.a, x.r)), lambda x: x.g)) AS t FROM fold f JOIN log l ON l.seq = f.seq + 1)))),
final AS (SELECT unnest(st) AS x FROM fold WHERE seq = (SELECT max(seq) FROM decisions)),
current_ids AS (SELECT x.r AS raw_id, x.g AS id, x.s AS status FROM final UNION ALL SELECT id, id, 'raw' FROM nodes WHERE id NOT IN (SELECT id FROM named))"""

def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


#: Prompts as teachers write them; a turn of a conversation carries one, by its number.
PROMPTS = ("请合并重复的知识点", "为什么要合并这两个节点？", "删除冗余节点", "不要合并，保留它们", "解释一下依据", "please REMOVE it", "看看这个", "请重新整合并说明原因", "为什么删除了", "恢复被删除的节点")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = F.element_at(F.array(*(F.lit(p) for p in PROMPTS)), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(PROMPTS))) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(said, F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.left("text", F.lit(20))))).alias("prompt"))


PROMPTS_SQL = "prompts AS (SELECT conv_id, turn, [" + ", ".join(f"'{p}'" for p in PROMPTS) + f"][CAST((conv_id * 3 + turn) % {len(PROMPTS)} AS INT) + 1] || CASE WHEN turn % 2 = 0 THEN '' ELSE ' ' || left(text, 20) END AS prompt FROM conversations)"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages with names of files of all kinds."""
    tails = ("/book%20one.pdf", "/%E7%AC%AC1.MARKDOWN?x=1#y", "/c.txt/", "/d.docx#top", "/plain", "/e.exe", "/.csv", "")
    tail = F.element_at(F.array(*(F.lit(t) for t in tails)), (F.col("page_id") % len(tails) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", tail).alias("address"))


ADDRESSES_SQL = "addresses AS (SELECT page_id, url || ['/book%20one.pdf', '/%E7%AC%AC1.MARKDOWN?x=1#y', '/c.txt/', '/d.docx#top', '/plain', '/e.exe', '/.csv', ''][CAST(page_id % 8 AS INT) + 1] AS address FROM pages)"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with chapter headings, contents lines and page furniture put among their lines."""
    d = dealt(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.col("text"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("序\n第一章 "), "source", F.lit("\n"), F.left("text", half), F.lit("\nChapter 2 "), "lang", F.lit(" .\n"), F.expr("substring(text, floor(length(text) / 2) + 1)")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("第 三 节 "), "lang", F.lit("\n\n第四章目录\n"), "text"))
        .otherwise(F.concat("text", F.lit("\n第十章 终......12\nend\n第十一章")))
    )
    return d.select("doc_id", text.alias("text"))


HEADED_SQL = """headed AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text
  WHEN 1 THEN '序' || chr(10) || '第一章 ' || source || chr(10) || left(text, CAST(floor(length(text) / 2) AS INT)) || chr(10) || 'Chapter 2 ' || lang || ' .' || chr(10) || substr(text, CAST(floor(length(text) / 2) AS INT) + 1)
  WHEN 2 THEN '第 三 节 ' || lang || chr(10) || chr(10) || '第四章目录' || chr(10) || text
  ELSE text || chr(10) || '第十章 终......12' || chr(10) || 'end' || chr(10) || '第十一章' END AS text FROM documents)"""
