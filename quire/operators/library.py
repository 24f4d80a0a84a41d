"""What is stored of books, graphs and indexes, made uniform: extractions, loaded graphs, hits, citations, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as T
from quire.operators.graph import first_wins, joined_edges, last_wins, with_edge_ids
from quire.operators.integrate import TARGET_RATIO, integrated_chars, raw_chars

#: A node's plain category and kind, a side's plain type, and the longest quote.
PLAIN_CATEGORY, PLAIN_KIND, PLAIN_TYPE, MOST_QUOTE = "核心概念", "knowledge", "parallel", 420


def _at(row: Column, *names: str) -> Column:
    """The first field of a variant row that is there and not null."""
    found = (F.try_variant_get(row, f"$.{n}", "variant") for n in names)
    return F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in found))


def _said(row: Column, *names: str) -> Column:
    """The same as compact text; null where it is missing."""
    return F.trim(T.fold(F.coalesce(*(F.try_variant_get(row, f"$.{n}", "string") for n in names))))


def _listed(row: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(row, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _number(row: Column, *names: str) -> Column:
    return F.try_variant_get(_at(row, *names), "$", "string").try_cast("double")


def _padded(n: Column, width: int = 3) -> Column:
    return F.when(n < 10**width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))


def extracted(payloads: DataFrame, most_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions of nodes, and relationships, out of one JSON payload per chapter (book, chapter_id, chapter_idx, chapter, page, payload).

    Both lists go by any of their usual names; a payload that holds neither gives no rows. Of each chapter at most
    ``most_nodes`` nodes count.
    """
    v = payloads.withColumn("v", F.try_parse_json("payload"))
    keys = ["book", "chapter_id", "chapter_idx", "chapter", "page"]
    lists = lambda *names: F.coalesce(*(F.try_variant_get("v", f"$.{n}", "array<variant>") for n in names))
    place = (F.col("chapter_idx") * 1_000_000 + F.col("pos")).cast("long").alias("ord")
    nodes = v.select(*keys, F.posexplode(lists("nodes", "entities", "knowledge_points")).alias("pos", "row"))
    nodes = nodes if most_nodes is None else nodes.where(F.col("pos") < most_nodes)
    row = F.col("row")
    mentions = nodes.select(
        "book", place, "pos", _said(row, "name", "label", "title").alias("name"), _said(row, "definition", "description").alias("definition"), F.coalesce(_said(row, "category"), F.lit(PLAIN_CATEGORY)).alias("category"),
        "chapter_id", "chapter_idx", "chapter", F.coalesce(_number(row, "page").cast("int"), F.col("page")).alias("page"), F.coalesce(_said(row, "source_quote", "quote"), F.lit("")).alias("quote"),
    )
    sides = v.select(*keys, F.posexplode(lists("relationships", "relations", "edges")).alias("pos", "row"))
    relationships = sides.select(
        "book", place, "chapter_idx", _said(row, "source").alias("source"), _said(row, "target").alias("target"), _said(row, "relation_type", "type").alias("relation_type"), _said(row, "description", "reason").alias("description"),
        _said(row, "evidence", "source_quote").alias("evidence"), F.coalesce(F.try_variant_get(row, "$.derived", "boolean"), F.lit(False)).alias("derived"),
    )
    return mentions, relationships


def graph_id(book: Column, textbook_id: Column, total_chars: Column, chapters: Column) -> Column:
    """The id of a book's graph: the book, and a hash of what it was made from."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("graph_"), book, F.lit("_"), T.short_hash(F.concat_ws(":", text(textbook_id), text(total_chars), text(chapters))))


def normalised_nodes(rows: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Loaded node rows (file, pos, row) with all fields under one name each, and defaults where they are missing."""
    row = F.col("row")
    stem = F.regexp_replace("file", r"\.json$", "")
    made = F.concat(T.safe_id(stem, "node", ascii_only=ascii_only), F.lit("_node_"), _padded(F.col("pos") + 1))
    node_id = F.coalesce(_said(row, "id", "node_id"), made)
    empty = lambda c: F.coalesce(c, F.lit(""))

    def source(s: Column) -> Column:
        own = lambda *names: F.coalesce(_said(s, *names), _said(row, names[0]), F.lit(""))
        quote = F.left(empty(_said(s, "source_quote", "quote")), F.lit(MOST_QUOTE))
        page = F.coalesce(_number(s, "page"), _number(row, "page"))
        return F.struct(own("textbook_id").alias("textbook_id"), own("textbook_title").alias("textbook_title"), own("filename").alias("filename"), empty(_said(s, "chapter_id")).alias("chapter_id"), own("chapter").alias("chapter"), page.alias("page"), quote.alias("source_quote"))

    out = rows.withColumn("sources", F.transform(_listed(row, "sources"), source)).withColumn("id", node_id)
    first = F.get("sources", F.lit(0))
    category = F.coalesce(_said(row, "category"), F.lit(PLAIN_CATEGORY))
    chapter = empty(_said(row, "chapter"))
    many = lambda name, other: F.when(F.size(_listed(row, name)) > 0, F.transform(_listed(row, name), lambda x: T.compact_text(F.try_variant_get(x, "$", "string")))).otherwise(other)
    filled = lambda c: F.filter(F.array(c), lambda x: x != "")
    name = _said(row, "name", "label", "title")
    return out.select(
        "file", "pos", "id", F.when(empty(name) != "", name).otherwise(F.col("id")).alias("name"), empty(_said(row, "definition", "description")).alias("definition"), category.alias("category"),
        many("categories", F.array(category)).alias("categories"), chapter.alias("chapter"), many("chapters", filled(chapter)).alias("chapters"), _number(row, "page").alias("page"),
        *(F.coalesce(_said(row, n), first[n], F.lit("")).alias(n) for n in ("textbook_id", "textbook_title", "filename")),
        F.coalesce(_number(row, "frequency"), F.lit(1.0)).alias("frequency"), F.coalesce(_said(row, "node_kind"), F.lit(PLAIN_KIND)).alias("node_kind"), "sources",
    )


def normalised_sides(rows: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Loaded edge rows (file, pos, row) likewise; those without both ends go."""
    row = F.col("row")
    made = F.concat(T.safe_id(F.regexp_replace("file", r"\.json$", ""), "side", ascii_only=ascii_only), F.lit("_edge_"), _padded(F.col("pos") + 1))
    empty = lambda *names: F.coalesce(_said(row, *names), F.lit(""))
    marks = (F.try_variant_get(row, f"$.{n}", "boolean").alias(n) for n in ("derived", "fact_eligible"))
    side = F.struct("file", "pos", F.coalesce(_said(row, "id", "edge_id"), made).alias("id"), empty("source").alias("source"), empty("target").alias("target"), F.coalesce(_said(row, "relation_type", "type"), F.lit(PLAIN_TYPE)).alias("relation_type"), empty("description", "reason").alias("description"), *marks)
    # inside an array, as a filter on columns would be worked out before them, row parsed anew and all
    ended = F.filter(F.array(side), lambda s: (s["source"] != "") & (s["target"] != ""))
    return rows.select(F.inline(ended))


def source_graph(node_rows: DataFrame, side_rows: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph that integration starts from: of nodes with one id the first by file and place stays; all sides stay."""
    return first_wins(normalised_nodes(node_rows, ascii_only), ["id"], "file", "pos"), normalised_sides(side_rows, ascii_only)


def shown_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph as it is shown (file, pos, id, ...): the last node and edge of each id, without edges that dangle.

    Nodes without id go; an edge without id gets one from its ends and type.
    """
    kept = last_wins(nodes.where(F.coalesce("id", F.lit("")) != ""), ["id"], "file", "pos")
    sound = edges.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    typed = with_edge_ids(sound.withColumn("relation_type", F.coalesce("relation_type", F.lit(""))))
    return kept, last_wins(joined_edges(typed, kept), ["id"], "file", "pos")


def hit_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, id, hybrid, method, rank) with their chunks; a hit whose chunk is gone goes."""
    return hits.join(chunks, "id")


def citations(found: DataFrame) -> DataFrame:
    """What is cited of hits with chunks (book, title, chapter_id, chapter_title, page, source_ref)."""
    filled = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    return found.select(
        "query_id", "rank", filled("title", "book").alias("textbook"), F.col("book").alias("textbook_id"), filled("chapter_title", "chapter_id").alias("chapter"), "chapter_id", "page",
        F.col("hybrid").alias("relevance_score"), F.col("method").alias("retrieval_method"), F.col("id").alias("chunk_id"), "source_ref",
    )


def cited_texts(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations with the text that they point to; null where the chunk is gone."""
    return cited.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id", "left")


def decision_compression(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Characters before and after each decision (seq, action, affected_nodes, name, definition), and their ratio.

    Before are the affected nodes' definitions and quotes; after is the result's definition (a removed one has none),
    the first affected node's where the decision names no result.
    """
    quotes = F.transform("sources", lambda s: s["source_quote"]) if "sources" in nodes.columns else F.array().cast("array<string>")
    own = nodes.select("id", raw_chars(F.col("definition"), quotes, F.col("name")).alias("chars"), integrated_chars(F.col("definition"), F.col("name")).alias("short"))
    named = decisions.select("seq", F.posexplode("affected_nodes").alias("pos", "id")).join(own, "id").groupBy("seq").agg(F.sum("chars").alias("before"), F.min_by("short", "pos").alias("first"))
    d = decisions.join(named, "seq", "left")
    result = F.when(F.col("action") == "remove", 0).when(F.coalesce("definition", "name").isNotNull(), integrated_chars(F.col("definition"), F.col("name"))).otherwise(F.coalesce("first", F.lit(1)))
    before = F.coalesce("before", F.lit(0)).cast("long")
    ratio = result / F.greatest(F.lit(1), before)
    return d.select("seq", before.alias("original_chars"), result.cast("long").alias("integrated_chars"), F.round(ratio, 4).alias("ratio"), (ratio <= TARGET_RATIO).alias("target_met"))


def removed_nodes(raw: DataFrame, current: DataFrame) -> DataFrame:
    """How many raw nodes no current node stands for any more."""
    left = current.agg(F.count_distinct("raw_id").alias("left"))
    return raw.agg(F.count("*").alias("raw")).join(left, F.lit(True)).select("raw", F.greatest(F.lit(0), F.col("raw") - F.col("left")).cast("long").alias("removed"))


def index_status(manifest: DataFrame) -> DataFrame:
    """Whether there is an index, and its counts, nought where there is none; ``manifest`` has a row per index or none."""
    names = ("textbook_count", "chapter_count", "indexed_chapter_count", "chunk_count")
    return manifest.agg((F.count("*") > 0).alias("indexed"), *(F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in names))


def integration_status(snapshot: DataFrame, decisions: DataFrame, turns: DataFrame) -> DataFrame:
    """Whether there is an integrated graph, and how long its log and its conversation are."""
    one = snapshot.agg((F.count("*") > 0).alias("integrated"))
    return one.join(decisions.agg(F.count("*").alias("decisions")), F.lit(True)).join(turns.agg(F.count("*").alias("turns")), F.lit(True))


def by_id(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """The rows of one id; the query fails where there is none."""
    found = rows.where(F.col(column) == wanted)
    some = found.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"{column} {wanted} is not there"))).otherwise(F.lit(True)).alias("_there")).where("_there")
    return some.join(found, F.lit(True), "left").drop("_there")


def relation_types(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """The relation types that a view offers: those its statistics list, else those of its edges."""
    listed = stats.select(F.explode("relation_types").alias("relation_type")).distinct()
    known = stats.agg(F.coalesce(F.max(F.size("relation_types")), F.lit(0)).alias("_n"))
    own = edges.where("relation_type is not null").select("relation_type").distinct().join(F.broadcast(known.where("_n <= 0")), F.lit(True)).drop("_n")
    return listed.unionByName(own)


def of_type(edges: DataFrame, relation_type: str | None) -> DataFrame:
    """Edges of one type; ``all``, or none given, leaves them as they are."""
    return edges if relation_type in (None, "", "all") else edges.where(F.col("relation_type") == relation_type)


def book_summary(chapters: DataFrame, *keys: str) -> DataFrame:
    """Each book's chapters in order, with the beginning of each (``preview`` where chapters have it), and its length."""
    preview = F.col("preview") if "preview" in chapters.columns else T.preview(F.col("content"), 120)
    one = F.struct("chapter_idx", "chapter_id", F.col("chapter_title").alias("title"), "page_start", "page_end", "char_count", preview.alias("preview"))
    return chapters.groupBy(*keys).agg(F.sum("char_count").cast("long").alias("total_chars"), F.count("*").alias("chapter_count"), F.array_sort(F.collect_list(one)).alias("chapters"))


def invalid_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters that cannot be worked on, and why: no id, no content, or a length that is no number above nought."""
    why = F.when(F.coalesce("chapter_id", F.lit("")) == "", "no id").when(T.normalize_text(F.col("content")) == "", "no content").when(F.coalesce(F.col("char_count"), F.lit(0)) <= 0, "no length")
    return chapters.withColumn("problem", why).where("problem is not null")


def numbered(rows: DataFrame, key: str, *order: str, prefix: str) -> DataFrame:
    """Ids from a prefix and each row's place within its key."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("id", F.concat(F.lit(prefix), _padded(n)))
