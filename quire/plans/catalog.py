"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as T
from quire.operators import graph, integrate, retrieval, segment
from quire.plans import derived as D
from quire.plans.derived import ADDRESSES_SQL, CHAPTERS, DECISIONS, EDGES, FACT, FOLD, HEADED_SQL, LINES, NODES, PROMPTS_SQL, table
from quire.streaming import chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add



# Text functions

WS_SQL = "regexp_replace({}, '\\s+', ' ', 'g')"
NORM = "trim(regexp_replace(regexp_replace(replace({}, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
COMPACT = "trim(regexp_replace(" + NORM + ", '\\s+', ' ', 'g'))"
WHITE = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
TITLE = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(" + WHITE + ", '^#+\\s*', ''), '\\s+', ' ', 'g')), '[.·•]{{4,}}.*$', ''), ' [0-9]{{1,4}}$', ''))"


@query(f"SELECT doc_id, md5({WHITE.format('text')}) AS h, length({WHITE.format('text')}) AS n FROM documents")
def normalize_whitespace(spark, sf_dir):
    t = T.normalize_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("h"), F.length(t).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS h FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("h"))


@query(f"SELECT conv_id, turn, {COMPACT.format('text')} AS t FROM conversations")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.compact_text(F.col("text")).alias("t"))


@query(f"WITH {LINES} SELECT doc_id, pos, {TITLE.format('line')} AS title FROM lines")
def compact_title(spark, sf_dir):
    return D.lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), T.compact_title(F.col("line")).alias("title"))


@query(f"SELECT doc_id, length({WHITE.format('text')}) AS n FROM documents")
def count_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_chars(F.col("text")).cast("long").alias("n"))


@query(f"SELECT doc_id, CASE WHEN length(t) > 160 THEN left(t, 160) || '...' ELSE t END AS p FROM (SELECT doc_id, {COMPACT.format('text')} AS t FROM documents)")
def preview_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("p"))


@query(
    f"SELECT doc_id, CASE WHEN length(t) <= 2000 THEN md5(t) ELSE md5(left(t, 1240) || chr(10) || chr(10) || '[中间节选]' || chr(10) || substr(t, greatest(0, CAST(floor((length(t) - 220) / 2) AS INT)) + 1, 220) || chr(10) || chr(10) || '[结尾节选]' || chr(10) || right(t, 460)) END AS h FROM (SELECT doc_id, {NORM.format('text')} AS t FROM documents)"
)
def trim_to_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.trim_to_length(F.col("text"), 2000)).alias("h"))


@query("SELECT doc_id, left(sha1(text), 10) AS h10, 'book_' || left(sha1(source || lang), 8) AS book FROM documents")
def sha1_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.short_hash(F.col("text")).alias("h10"), T.textbook_id(F.lit(""), F.col("source"), F.col("lang")).alias("book"))


@query("SELECT p_partkey, trim(regexp_replace('Ａ１' || p_name || ' / ' || p_brand || '（ｘ）', '[^\\p{L}\\p{N}_-]+', '_', 'g'), '_') AS plain, trim(regexp_replace('A1' || p_name || ' / ' || p_brand || '(x)', '[^\\p{L}\\p{N}_-]+', '_', 'g'), '_') AS part FROM part")
def safe_ids(spark, sf_dir):
    said = F.concat(F.lit("Ａ１"), "p_name", F.lit(" / "), "p_brand", F.lit("（ｘ）"))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_id(said, ascii_only=True).alias("plain"), T.safe_id(said).alias("part"))


@query("SELECT p_partkey, lower(p_name) AS k2, regexp_replace(lower('Ａ１' || p_name || p_brand), '[^\\p{L}\\p{N}]+', '', 'g') AS plain, regexp_replace(lower('A1' || p_name || p_brand || 'fi'), '[^\\p{L}\\p{N}]+', '', 'g') AS k3 FROM part")
def name_keys(spark, sf_dir):
    said = F.concat(F.lit("Ａ１"), "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.name_key(F.col("p_name")).alias("k2"), T.match_key(said, True).alias("plain"), T.match_key(F.concat(said, F.lit("ﬁ"))).alias("k3"))


@query(
    f"WITH {ADDRESSES_SQL}, u AS (SELECT page_id, url_decode(regexp_replace(regexp_replace(address, '^https?://[^/?#]*', '', 'i'), '[?#].*$', '')) AS path FROM addresses), b AS (SELECT page_id, string_split(rtrim(path, '/'), '/')[-1] AS b FROM u), n AS (SELECT page_id, CASE WHEN b = '' THEN 'textbook' ELSE b END AS base FROM b), e AS (SELECT *, lower(regexp_extract(base, '.(\\.[^./]*)$', 1)) AS x FROM n) SELECT page_id, base, CASE WHEN x = '.markdown' THEN '.md' WHEN x IN ('.pdf', '.md', '.txt', '.docx', '.xlsx', '.xls', '.csv', '.tsv') THEN x END AS ext FROM e"
)
def url_basename(spark, sf_dir):
    base = T.basename(F.col("address"))
    return D.addresses(spark, sf_dir).select("page_id", base.alias("base"), T.extension(base).alias("ext"))


@query("SELECT page_id, regexp_matches(url, '^https?://', 'i') AS web, rtrim(url, '/') AS endpoint FROM pages")
def url_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.is_url(F.col("url")).alias("web"), T.endpoint(F.col("url")).alias("endpoint"))


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
HAN = "regexp_extract_all({0}, '\\p{{Han}}')"
TOKENS_HAN = "list_distinct(list_concat(list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), " + HAN + "), list_transform(range(1, len(" + HAN + ")), lambda i: (" + HAN + ")[i] || (" + HAN + ")[i + 1])))"


@query(f"WITH {PROMPTS_SQL} SELECT conv_id, turn, array_to_string(list_sort({TOKENS_HAN.format('prompt')}), ' ') AS tokens FROM prompts")
def token_set(spark, sf_dir):
    return D.prompts(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(T.token_set(F.col("prompt"))), " ").alias("tokens"))


GRAMS = "CASE WHEN length({0}) > 1 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) WHEN length({0}) = 1 THEN [{0}] ELSE []::VARCHAR[] END"
KEY = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


NAMES_SQL = "k AS (SELECT p_name, min(p_partkey) % 50 = 0 AS asked, " + KEY.format("p_name") + " AS k, " + GRAMS.format(KEY.format("p_name")) + " AS g FROM part GROUP BY p_name)"


def _names(spark, sf_dir):
    """Names of parts with their keys and grams; those are asked for whose least part key is divisible by 50."""
    n = table(spark, sf_dir, "part").groupBy("p_name").agg((F.min("p_partkey") % 50 == 0).alias("asked")).withColumn("k", T.match_key(F.col("p_name"), True))
    return n.withColumn("g", T.bigrams(F.col("k")))


@query(f"WITH {NAMES_SQL} SELECT x.p_name AS a, y.p_name AS b, floor(2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) * 1e6 + 0.5) / 1e6 AS dice FROM k x, k y WHERE x.asked AND x.p_name <> y.p_name")
def bigram_dice(spark, sf_dir):
    n = _names(spark, sf_dir)
    asked = n.where("asked").select(F.col("p_name").alias("a"), F.col("g").alias("ga"))
    dice = lambda r: retrieval.millionths(T.dice(F.col("ga"), F.col("g")))
    return retrieval.against_all(asked, n.select(F.col("p_name").alias("b"), "g"), "a", F.col("a") != F.col("b")).select("a", "b", dice(None).alias("dice"))


NAME_SIM = "CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.82 WHEN len({ga}) = 0 OR len({gb}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({ga}, {gb})) / (len({ga}) + len({gb})) END"


@query(f"WITH {NAMES_SQL} SELECT x.p_name AS a, y.p_name AS b, floor((" + NAME_SIM.format(a="x.k", b="y.k", ga="x.g", gb="y.g") + ") * 1e6 + 0.5) / 1e6 AS sim FROM k x, k y WHERE x.asked")
def name_similarity(spark, sf_dir):
    n = _names(spark, sf_dir)
    asked = n.where("asked").select(F.col("p_name").alias("a"), F.col("k").alias("ka"), F.col("g").alias("ga"))
    met = retrieval.against_all(asked, n.select(F.col("p_name").alias("b"), F.col("k").alias("kb"), F.col("g").alias("gb")), "a")
    return met.select("a", "b", retrieval.millionths(retrieval.name_similarity(F.col("ka"), F.col("kb"), F.col("ga"), F.col("gb"))).alias("sim"))


_RE2 = {k: v.replace("\\z", "$") for k, v in T.PROMPT.items()}


@query(
    f"WITH {PROMPTS_SQL}, c AS (SELECT conv_id, turn, {COMPACT.format('prompt')} AS t FROM prompts) SELECT conv_id, turn, CASE WHEN (regexp_matches(t, '{_RE2['why_first']}') OR regexp_matches(t, '{_RE2['why_action']}')) AND NOT regexp_matches(t, '{_RE2['imperative']}') THEN 'explain' WHEN regexp_matches(t, '{_RE2['why_word']}') AND NOT regexp_matches(t, '{_RE2['action_word']}') THEN 'explain' WHEN regexp_matches(t, '{_RE2['keep']}') THEN 'keep' WHEN regexp_matches(t, '{_RE2['remove']}') THEN 'remove' ELSE 'merge' END AS action FROM c"
)
def prompt_action(spark, sf_dir):
    return D.prompts(spark, sf_dir).select("conv_id", "turn", T.prompt_action(F.col("prompt")).alias("action"))


@query("SELECT event_id, CASE WHEN v % 5 = 0 THEN 'once' WHEN v % 5 = 1 THEN 'reject' WHEN v % 5 = 2 THEN 'always' END AS reply, CASE WHEN v % 5 = 1 THEN v - 1 END AS idx FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS v FROM events)")
def approval_parse(spark, sf_dir):
    v = F.get_json_object("props", "$.k").cast("int")
    said = F.when(v % 5 == 0, " YES ").when(v % 5 == 1, F.concat(F.lit("拒绝 #"), v.cast("string"))).when(v % 5 == 2, "总是允许").when(v % 5 == 3, "later").otherwise("")
    a = T.approval(said)
    return table(spark, sf_dir, "events").select("event_id", a["reply"].alias("reply"), a["index"].alias("idx"))


@query("SELECT event_id, 'k is ' || CAST(json_extract(props, '$.k') AS INT) AS t FROM events")
def message_text_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    content = F.concat(F.lit('{"text": "@_user_1 k  is '), k, F.lit(' @_all"}'))
    return table(spark, sf_dir, "events").select("event_id", T.message_text(content, F.lit("group")).alias("t"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN '前置依赖' WHEN 'R' THEN '包含关系' ELSE '并列关系' END AS label, CASE l_returnflag WHEN 'A' THEN '#b9772f' WHEN 'R' THEN '#726753' ELSE '#476b8f' END AS colour FROM lineitem")
def relation_labels(spark, sf_dir):
    said = F.when(F.col("l_returnflag") == "A", "依赖").when(F.col("l_returnflag") == "R", "Contains").otherwise("并列关系")
    kind = T.relation_type(said)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.relation_label(kind).alias("label"), T.relation_colour(kind).alias("colour"))


@query(f"WITH {CHAPTERS} SELECT textbook_id, chapter_id, '[' || title || ', ' || chapter_title || ', 第 ' || page_start || ' 页]' AS ref FROM chapters")
def source_refs(spark, sf_dir):
    return D.chapters(spark, sf_dir).select("textbook_id", "chapter_id", T.source_ref(F.col("title"), F.col("chapter_title"), F.col("page_start")).alias("ref"))


@query(f"WITH {CHAPTERS} SELECT textbook_id, chapter_id, CASE WHEN page_end <= page_start OR length(content) = 0 THEN page_start ELSE least(page_end, page_start + CAST(floor(CAST(floor(length(content) / 2) AS INT) / length(content) * (page_end - page_start + 1)) AS INT)) END AS page FROM chapters")
def estimate_page(spark, sf_dir):
    n = F.length("content")
    return D.chapters(spark, sf_dir).select("textbook_id", "chapter_id", T.estimate_page(F.col("page_start"), F.col("page_end"), F.floor(n / 2).cast("int"), n).alias("page"))


# Segmentation


@query(f"WITH {LINES} SELECT doc_id, pos, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS segment FROM lines")
def segment_running_id(spark, sf_dir):
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return D.lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.sum((F.length("line") < 40).cast("long")).over(order).alias("segment"))


_HEADING = T.CHAPTER.replace("\\z", "$").replace("\\s\\S", "\\s\\S")


@query(
    f"WITH {HEADED_SQL}, w AS (SELECT doc_id, string_split({WHITE.format('text')}, chr(10)) AS ls FROM headed), l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM w), t AS (SELECT *, {TITLE.format('line')} AS title FROM l), h AS (SELECT *, CASE WHEN length(title) BETWEEN 2 AND 90 AND NOT (regexp_matches(title, '(?i)目录|contents|全文') AND length(title) <= 12) AND NOT regexp_matches(title, '[.·•]{{5,}}') AND regexp_matches(title, '{_HEADING}') THEN title END AS heading FROM t), g AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM h), s AS (SELECT doc_id, seg, max(heading) AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (heading IS NULL) AS body FROM g GROUP BY 1, 2), c AS (SELECT doc_id, seg, coalesce(title, '全文') AS title, {WHITE.format("coalesce(body, '')")} AS content FROM s) SELECT doc_id, count(*) AS chapters, string_agg(title, '|' ORDER BY seg) AS titles, sum(length(content))::BIGINT AS n FROM c WHERE content <> '' GROUP BY 1"
)
def chapter_rollup(spark, sf_dir):
    chapters = segment.split_text(D.headed(spark, sf_dir), "doc_id")
    rows = F.array_sort(F.collect_list(F.struct("segment", "title")))
    return chapters.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.array_join(F.transform(rows, lambda r: r["title"]), "|").alias("titles"), F.sum(F.length("content")).cast("long").alias("n"))


@query(f"WITH {CHAPTERS} SELECT textbook_id, count(*) AS chapters, sum(char_count)::BIGINT AS total_chars, max(char_count)::BIGINT AS longest FROM chapters GROUP BY 1")
def textbook_summary(spark, sf_dir):
    return segment.textbook_summary(D.chapters(spark, sf_dir), "textbook_id")


@query(
    f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY source, doc_id) AS n FROM lines), e AS (SELECT DISTINCT source, doc_id, {TITLE.format('line')} AS line FROM r WHERE k <= 2 OR k > n - 2), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM lines GROUP BY 1) SELECT source AS doc, line, count(*) AS times FROM e JOIN p USING (source) WHERE length(line) BETWEEN 4 AND 80 GROUP BY source, line, pages HAVING count(*) >= greatest(3, ceil(pages * 0.2))"
)
def boundary_lines(spark, sf_dir):
    return segment.boundary_lines(D.lines(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "pos", "line"))


@query("SELECT p_brand, CASE WHEN len(v) > 0 THEN v[CAST(floor(len(v) / 2) AS INT) + 1] ELSE 10.0 END AS median FROM (SELECT p_brand, list_sort(list(p_retailprice) FILTER (p_retailprice > 0)) AS v FROM part GROUP BY 1)")
def upper_median(spark, sf_dir):
    return segment.upper_median(table(spark, sf_dir, "part"), "p_retailprice", "p_brand")


OUTLINE = "o AS (SELECT p_brand AS doc, min(p_name) AS title, p_size AS page FROM part WHERE p_type = 'PROMO' GROUP BY p_brand, p_size), rng AS (SELECT doc, title, page AS page_start, coalesce(greatest(page, lead(page) OVER w - 1), 60) AS page_end, lag(page) OVER w IS NULL AS opens FROM o WINDOW w AS (PARTITION BY doc ORDER BY page)), ranges AS (SELECT doc, '前置内容' AS title, 1 AS page_start, page_start - 1 AS page_end FROM rng WHERE opens AND page_start > 1 UNION ALL SELECT doc, title, page_start, page_end FROM rng)"


def _outline(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_brand").alias("doc"), F.col("p_name").alias("title"), F.col("p_size").alias("page"))
    return segment.outline_ranges(p, "doc", F.lit(60))


@query(f"WITH {OUTLINE} SELECT * FROM ranges")
def outline_ranges_lead(spark, sf_dir):
    return _outline(spark, sf_dir)


@query(f"WITH {OUTLINE} SELECT r.doc, r.title, r.page_start, count(*) AS pages, sum(p_retailprice)::DOUBLE AS total FROM part JOIN ranges r ON p_brand = r.doc AND p_size BETWEEN r.page_start AND r.page_end GROUP BY ALL")
def page_range_join(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_size").alias("page"), "p_retailprice")
    return segment.in_ranges(pages, _outline(spark, sf_dir)).groupBy("doc", "title", "page_start").agg(F.count("*").alias("pages"), F.sum("p_retailprice").alias("total"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type")
def adjacent_dedup_lag(spark, sf_dir):
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("prev", before).where("prev IS NULL OR prev <> event_type").select("user_id", "event_id", "event_type")


@query()
def chunk_recursive(spark, sf_dir):
    chapters = D.chapters(spark, sf_dir)
    return segment.with_refs(segment.chunk(chapters), chapters).select("chunk_id", "book", "chapter_id", "chunk_index", "char_start", "char_end", "char_count", "page", "source_ref")


@query(f"WITH {CHAPTERS} SELECT textbook_id, chapter_id, i AS chunk_index, substr(content, i * 620 + 1, 700) AS text FROM (SELECT *, unnest(range(CAST(greatest(1, ceil((length(content) - 80) / 620)) AS BIGINT))) AS i FROM chapters)")
def chunk_fixed(spark, sf_dir):
    n = F.greatest(F.lit(1), F.ceil((F.length("content") - 80) / 620)).cast("long")
    c = D.chapters(spark, sf_dir).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return c.select("textbook_id", "chapter_id", "chunk_index", F.substring("content", (F.col("chunk_index") * 620 + 1).cast("int"), F.lit(700)).alias("text"))


# Graph building and statistics

UPSERT = """m AS (SELECT textbook_id AS book, ord, name, lower(name) AS key, category, chapter, chapter_id, page, left(definition, 260) AS quote, definition FROM nodes)"""


def _mentions(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    return n.select(F.col("textbook_id").alias("book"), "ord", "name", "definition", "category", "chapter_id", F.col("page").alias("chapter_idx"), "chapter", "page", F.col("definition").alias("quote"))


@query(
    f"WITH {NODES}, {UPSERT}, a AS (SELECT book, key, min(ord) AS ord, arg_min(name, ord) AS name, arg_max(definition, (length(definition), -ord)) AS definition, arg_min(category, ord) AS category, count(DISTINCT (chapter_id, page, quote)) AS frequency, min(page) AS page FROM m GROUP BY book, key), c AS (SELECT book, key, string_agg(chapter, '；' ORDER BY o) AS chapter FROM (SELECT book, key, chapter, min(ord) AS o FROM m GROUP BY ALL) GROUP BY 1, 2) SELECT a.book || '_node_' || CASE WHEN row_number() OVER (PARTITION BY a.book ORDER BY a.ord) < 1000 THEN lpad(CAST(row_number() OVER (PARTITION BY a.book ORDER BY a.ord) AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (PARTITION BY a.book ORDER BY a.ord) AS VARCHAR) END AS id, a.name, a.definition, a.category, c.chapter, a.page, a.frequency FROM a JOIN c USING (book, key)"
)
def node_upsert(spark, sf_dir):
    return graph.upsert_nodes(_mentions(spark, sf_dir)).select("id", "name", "definition", "category", "chapter", "page", "frequency")


@query(f"WITH {NODES} SELECT name, id, category FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS k FROM nodes) WHERE k = 1")
def first_wins_by_id(spark, sf_dir):
    return graph.first_wins(D.nodes(spark, sf_dir), ["name"], "ord").select("name", "id", "category")


@query(f"WITH {NODES} SELECT name, id, category FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord DESC) AS k FROM nodes) WHERE k = 1")
def last_wins_by_id(spark, sf_dir):
    return graph.last_wins(D.nodes(spark, sf_dir), ["name"], "ord").select("name", "id", "category")


@query(f"WITH {NODES}, {EDGES} SELECT id, source, target FROM edges WHERE source IN (SELECT id FROM nodes WHERE page > 20) AND target IN (SELECT id FROM nodes WHERE page > 20)")
def edge_semi_join(spark, sf_dir):
    return graph.joined_edges(D.edges(spark, sf_dir), D.nodes(spark, sf_dir).where("page > 20")).select("id", "source", "target")


@query(f"WITH {EDGES} SELECT left(sha1(source || '|' || target || '|' || relation_type), 12) AS id, source, target FROM edges")
def edge_ids(spark, sf_dir):
    e = D.edges(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    return graph.with_edge_ids(e).select("id", "source", "target")


@query(f"WITH {EDGES} SELECT source, target, relation_type, min(ord) AS ord FROM edges WHERE source <> target GROUP BY 1, 2, 3")
def relationship_dedup(spark, sf_dir):
    e = D.edges(spark, sf_dir).where("source <> target")
    return graph.first_wins(e, ["source", "target", "relation_type"], "ord").select("source", "target", "relation_type", "ord")


@query(f"WITH {NODES}, t AS (SELECT chapter, arg_min(id, ord) AS source, arg_min(name, ord) AS source_name FROM nodes WHERE node_kind = 'chapter' GROUP BY 1) SELECT source, n.id AS target, 'contains' AS relation_type, source_name || ' 包含本章知识点“' || n.name || '”。' AS description, true AS derived FROM t JOIN nodes n USING (chapter) WHERE source <> n.id")
def derived_coverage_union(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    topics = n.where("node_kind = 'chapter'").groupBy("chapter").agg(F.min_by("id", "ord").alias("id"), F.min_by("name", "ord").alias("name"))
    return graph.coverage(topics, n)


@query(f"WITH {NODES}, {EDGES} SELECT * FROM (SELECT count(*) AS node_count, count(DISTINCT textbook_id) AS textbook_count FROM nodes), (SELECT count(*) FILTER ({FACT}) AS factual_relationship_count, count(*) FILTER (NOT {FACT}) AS derived_relationship_count, count(*) AS total_relationship_count, array_to_string(list_sort(list(DISTINCT relation_type) FILTER ({FACT})), ',') AS relation_types, array_to_string(list_sort(list(DISTINCT relation_type)), ',') AS all_relation_types FROM edges)")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(D.nodes(spark, sf_dir), D.edges(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES} SELECT chapter_id, count(DISTINCT n.id) AS nodes, count(*) FILTER ({FACT}) AS facts, count(e.id) - count(*) FILTER ({FACT} AND e.id IS NOT NULL) AS derived FROM nodes n JOIN edges e ON e.source = n.id GROUP BY 1")
def chapter_report(spark, sf_dir):
    j = D.nodes(spark, sf_dir).select(F.col("id").alias("source"), "chapter_id").join(D.edges(spark, sf_dir), "source")
    return j.groupBy("chapter_id").agg(F.count_distinct("source").alias("nodes"), F.count_if(graph.is_fact()).alias("facts"), F.count_if(~graph.is_fact()).alias("derived"))


@query(f"WITH {EDGES} SELECT DISTINCT relation_type FROM edges WHERE {FACT}")
def relation_types(spark, sf_dir):
    return integrate.factual(D.edges(spark, sf_dir)).select("relation_type").distinct()


@query(f"WITH {EDGES} SELECT id, source, target FROM edges WHERE relation_type = 'contains'")
def relation_filter(spark, sf_dir):
    return D.edges(spark, sf_dir).where("relation_type = 'contains'").select("id", "source", "target")


@query(f"WITH {NODES} SELECT id FROM nodes WHERE contains(lower(id || ' ' || name || ' ' || definition || ' ' || category || ' ' || chapter || ' ' || textbook_id), 'red')")
def node_search(spark, sf_dir):
    return graph.search(D.nodes(spark, sf_dir), "RED").select("id")


DEGREE = "d AS (SELECT n.id, n.ord, n.name, count(e.x) AS degree FROM nodes n LEFT JOIN (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges) e ON e.x = n.id GROUP BY 1, 2, 3)"
TOP = DEGREE + ", top AS (SELECT * FROM d ORDER BY degree DESC, ord LIMIT 24)"


@query(f"WITH {NODES}, {EDGES}, {TOP} SELECT id, degree FROM top")
def degree_topk(spark, sf_dir):
    return graph.top_by_degree(D.nodes(spark, sf_dir), D.edges(spark, sf_dir)).select("id", "degree")


@query(f"WITH {NODES}, {EDGES}, {TOP}, f AS (SELECT * FROM edges WHERE {FACT}), {DEGREE.replace('d AS', 'd2 AS').replace('edges', 'f')}, top2 AS (SELECT * FROM d2 ORDER BY degree DESC, ord LIMIT 24) SELECT f.source, f.target, left(a.name, 10) AS source_label, left(b.name, 10) AS target_label, count(*) AS n FROM f JOIN top2 a ON a.id = f.source JOIN top2 b ON b.id = f.target GROUP BY ALL")
def relation_matrix(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    return graph.relation_matrix(n, graph.joined_edges(integrate.factual(D.edges(spark, sf_dir)), n))


LABEL = "CASE relation_type WHEN 'prerequisite' THEN '前置依赖' WHEN 'contains' THEN '包含关系' WHEN 'parallel' THEN '并列关系' ELSE '应用关系' END"


@query(f"WITH {NODES}, {EDGES}, j AS (SELECT e.relation_type, a.category AS sc, b.category AS tc FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target) SELECT source, target, sum(value)::BIGINT AS value FROM (SELECT '章节｜' || left(chapter, 14) AS source, '类别｜' || left(category, 10) AS target, frequency AS value FROM nodes UNION ALL SELECT '类别｜' || sc, '关系｜' || {LABEL}, 1 FROM j UNION ALL SELECT '关系｜' || {LABEL}, '指向｜' || tc, 1 FROM j) GROUP BY 1, 2")
def sankey_links(spark, sf_dir):
    return graph.sankey_links(D.nodes(spark, sf_dir), D.edges(spark, sf_dir))


@query(f"WITH {NODES}, c AS (SELECT chapter, min(page) AS page, count(*) AS nodes FROM nodes GROUP BY 1) SELECT *, row_number() OVER (ORDER BY page, chapter)::INT AS progress FROM c")
def timeline(spark, sf_dir):
    return graph.timeline(D.nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT count(DISTINCT textbook_id) AS sources, count(DISTINCT category) AS categories, bool_or(frequency > 1) AS has_frequency FROM nodes")
def legend(spark, sf_dir):
    return graph.legend(D.nodes(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES}, s AS (SELECT id FROM nodes WHERE node_kind = 'chapter') SELECT DISTINCT seed, id FROM (SELECT source AS seed, target AS id FROM edges UNION ALL SELECT target, source FROM edges UNION ALL SELECT id, id FROM s) WHERE seed IN (SELECT id FROM s)")
def neighborhood_1hop(spark, sf_dir):
    return graph.neighbourhood(D.edges(spark, sf_dir), D.nodes(spark, sf_dir), F.col("node_kind") == "chapter").select("seed", "id")


@query(f"WITH {NODES}, grp AS (SELECT chapter_id, min(chapter) AS label FROM nodes GROUP BY 1), g AS (SELECT chapter_id, row_number() OVER (ORDER BY label, chapter_id) - 1 AS idx, CAST(greatest(1, ceil(sqrt(count(*) OVER ()))) AS INT) AS cols FROM grp), n AS (SELECT nodes.*, node_kind = 'chapter' AS is_chapter, row_number() OVER (PARTITION BY chapter_id, node_kind = 'chapter' ORDER BY page, name, ord) - 1 AS k, count(*) OVER (PARTITION BY chapter_id, node_kind = 'chapter') AS size FROM nodes), q AS (SELECT n.*, 260.0 + (idx % cols) * 430 AS cx, 230.0 + floor(idx / cols) * 360 AS cy, least(8, size) AS f1 FROM n JOIN g USING (chapter_id)), r AS (SELECT *, floor(k / f1) AS ring FROM q), s AS (SELECT *, CASE WHEN ring = 0 THEN f1 ELSE greatest(1, size - f1) END AS onr FROM r), a AS (SELECT *, -pi() / 2 + pi() * 2 * (k % f1) / onr + CASE WHEN ring % 2 = 1 THEN pi() / onr ELSE 0 END AS ang FROM s) SELECT id, is_chapter, round(CASE WHEN is_chapter THEN cx + k * 70 ELSE cx + cos(ang) * (138 + ring * 88) END, 4)::DOUBLE AS x, round(CASE WHEN is_chapter THEN cy ELSE cy + sin(ang) * (138 + ring * 88) END, 4)::DOUBLE AS y FROM a")
def layout_ring(spark, sf_dir):
    return graph.layout(D.nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT id, CASE WHEN node_kind = 'chapter' THEN CASE WHEN length(s) <= 4 THEN s ELSE left(s, 4) || '...' END WHEN length(s) <= 8 THEN s ELSE left(s, 8) || '...' END AS label, node_kind = 'chapter' AS is_chapter, least(CASE WHEN node_kind = 'chapter' THEN 46 ELSE 44 END, CASE WHEN node_kind = 'chapter' THEN 34 ELSE 25 END + frequency * 5)::BIGINT AS size, CASE WHEN node_kind = 'chapter' THEN '#2d332f' ELSE '#55706b' END AS colour FROM (SELECT *, replace(name, ' ', '') AS s FROM nodes)")
def visual_nodes(spark, sf_dir):
    return graph.visual_nodes(D.nodes(spark, sf_dir))


@query(f"WITH {EDGES} SELECT id, source, target, {LABEL} AS label, CASE relation_type WHEN 'prerequisite' THEN '#b9772f' WHEN 'contains' THEN '#726753' WHEN 'parallel' THEN '#476b8f' ELSE '#b74f39' END AS colour, NOT {FACT} AS derived FROM edges")
def visual_edges(spark, sf_dir):
    return graph.visual_edges(D.edges(spark, sf_dir))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE node_kind <> 'chapter'")
def knowledge_nodes(spark, sf_dir):
    return graph.knowledge(D.nodes(spark, sf_dir)).select("id")


# Similarity and retrieval

PREP = "p AS (SELECT *, " + KEY.format("name") + " AS k, " + KEY.format("category") + " AS ck, " + KEY.format("name || ' ' || definition || ' ' || category || ' ' || chapter || ' ' || textbook_id || ' '") + " AS tk FROM nodes), g AS (SELECT *, " + GRAMS.format("k") + " AS kg, " + GRAMS.format("tk") + " AS tg FROM p)"
SCORE = "least(1.0, greatest(0.0, 0.58 * (" + NAME_SIM.format(a="t.k", b="c.k", ga="t.kg", gb="c.kg") + ") + 0.29 * (2.0 * len(list_intersect(t.tg, c.tg)) / (len(t.tg) + len(c.tg))) + CASE WHEN t.ck = c.ck THEN 0.08 ELSE 0 END + CASE WHEN t.textbook_id <> c.textbook_id THEN 0.05 ELSE 0 END))"


@query(f"WITH {NODES}, {PREP}, t AS (SELECT * FROM g WHERE ord % 50 = 0) SELECT target, id, name, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, name, id) AS rank FROM (SELECT t.id AS target, c.id, c.name, floor(({SCORE}) * 1e6 + 0.5) / 1e6 AS score FROM t, g c WHERE t.id <> c.id AND c.node_kind <> 'chapter')) WHERE rank <= 10")
def candidate_score_topk(spark, sf_dir):
    dealt = D.nodes(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is one partition
    n = retrieval.prepared(dealt, ascii_only=True)
    hashed = n.withColumns({c: F.transform(c, lambda x: F.xxhash64(x)) for c in ("grams", "text_grams")})
    return retrieval.rank_candidates_blocks(hashed.where("ord % 50 = 0"), graph.knowledge(hashed))


@query(f"WITH {NODES}, n1 AS (SELECT *, {KEY.format('name')} AS k FROM nodes) SELECT id, name FROM n1 ORDER BY CASE WHEN contains('please merge the red widget with others', id) THEN 0 WHEN contains('pleasemergetheredwidgetwithothers', k) OR contains(k, 'pleasemergetheredwidgetwithothers') THEN 1 ELSE 2 END, CASE WHEN contains('pleasemergetheredwidgetwithothers', k) THEN -length(k) ELSE 0 END, ord LIMIT 1")
def target_selection(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    return retrieval.select_target(n, "please merge the red widget with others", n.where("page = 1"), ascii_only=True).select("id", "name")


@query(
    "WITH u AS (SELECT p_name AS id, min(p_partkey) % 50 = 0 AS asked, " + KEY.format("p_name") + " AS k FROM part GROUP BY p_name), g AS (SELECT id, asked, k, " + GRAMS.format("k") + " AS kg FROM u) SELECT a.id AS a, b.id AS b, floor((0.58 * (" + NAME_SIM.format(a="a.k", b="b.k", ga="a.kg", gb="b.kg") + ") + 0.29 * (2.0 * len(list_intersect(a.kg, b.kg)) / (len(a.kg) + len(b.kg))) + 0.08 + 0.0) * 1e6 + 0.5) / 1e6 AS score FROM g a, g b WHERE a.asked AND a.id <> b.id AND len(list_intersect(a.kg, b.kg)) > 0"
)
def blocked_pairs(spark, sf_dir):
    none = F.lit("")
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("id")).agg((F.min("p_partkey") % 50 == 0).alias("asked"))
    n = retrieval.prepared(names.select("id", "asked", F.col("id").alias("name"), *(none.alias(c) for c in ("definition", "category", "chapter", "textbook_id"))), ascii_only=True)
    return retrieval.blocked_pairs(n.where("asked"), n)


COS = "round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6)"


@query(f"WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 50 = 0) SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, v.id, {COS} AS score FROM q, v)) WHERE rank <= 20")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.cosine_top_k_blocks(_vector_queries(v), v)


def _vector_queries(v):
    """The stated query set of searches: every id divisible by 50."""
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))


@query(f"WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 50 = 0) SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, v.id, {COS} AS score FROM q, v WHERE v.label = 3)) WHERE rank <= 5")
def cosine_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return retrieval.cosine_top_k_blocks(_vector_queries(v), v, 5, F.col("label") == 3)


LEX = f"qt AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS q FROM benchmark), tt AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents), lex AS (SELECT query_id, id, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q) END AS keyword FROM qt, tt)"


@query(f"WITH {LEX} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, floor(keyword * 1e6 + 0.5) / 1e6 AS score FROM lex)) WHERE rank <= 20")
def lexical_score(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.lexical_top_k(q, D.dealt(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


BM = "w AS (SELECT id, unnest(toks) AS token FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents)), tf AS (SELECT id, token, count(*) AS tf FROM w GROUP BY 1, 2), ln AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len) AS al FROM ln), qq AS (SELECT DISTINCT query_id, unnest(q) AS token FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS q FROM benchmark)), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 4) AS score FROM qq JOIN tf USING (token) JOIN df USING (token) JOIN ln USING (id), st GROUP BY 1, 2), bmk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"


def _bm25(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(q, D.dealt(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {BM} SELECT query_id, id, score, rank::INT AS rank FROM bmk WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


#: Words whose counts make the vectors of the vector leg.
LEG = ("the", "and", "of", "in", "les", "de", "que", "der", "und", "ing", "tion", "en", "er", "on")
_VECTOR = "[CAST((length({0}) - length(replace({0}, k, ''))) / length(k) AS DOUBLE) FOR k IN [" + ", ".join(f"'{k}'" for k in LEG) + "]]"
_FILLED = "CASE WHEN list_sum({0}) > 0 THEN {0} ELSE list_transform(range(1, " + str(len(LEG) + 1) + "), lambda i: (strpos('0123456789abcdef', substr(sha1({1}), i, 1)) - 1) / 15.0) END"
LEGS = "dv AS (SELECT doc_id AS id, t, " + _VECTOR.format("t") + " AS w FROM (SELECT doc_id, lower(" + COMPACT.format("text") + ") AS t FROM documents)), qv AS (SELECT item_id AS query_id, t, " + _VECTOR.format("t") + " AS w FROM (SELECT item_id, lower(" + COMPACT.format("text") + ") AS t FROM benchmark)), dd AS (SELECT id, " + _FILLED.format("w", "t") + " AS e FROM dv), qd AS (SELECT query_id, " + _FILLED.format("w", "t") + " AS e FROM qv), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.query_id, v.id, " + COS + " AS score FROM qd q, dd v))"
HITS = f"{BM}, {LEX}, {LEGS}, hits AS (SELECT b.query_id, b.id, 'bm25' AS method, b.score, l.keyword FROM bmk b JOIN lex l USING (query_id, id) WHERE b.rank <= 20 UNION ALL SELECT v.query_id, v.id, 'vector', v.score, l.keyword FROM vr v JOIN lex l USING (query_id, id) WHERE v.rank <= 20)"


def _hits(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = D.dealt(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = chunks.select("id", retrieval.keyword_vector(F.col("text"), list(LEG)).alias("vector"))
    asked = q.select("query_id", retrieval.keyword_vector(F.col("query"), list(LEG)).alias("q"))
    return retrieval.hybrid_hits(q, chunks, asked, vectors)


@query(f"WITH {HITS} SELECT query_id, id, method, CASE WHEN m > 0 THEN round(score / m, 4) ELSE 0 END AS scaled FROM (SELECT *, max(score) OVER (PARTITION BY query_id, method) AS m FROM hits)")
def max_normalize(spark, sf_dir):
    return retrieval.max_normalised(_hits(spark, sf_dir)).select("query_id", "id", "method", "scaled")


FUSED = f"{HITS}, sc AS (SELECT *, max(score) OVER (PARTITION BY query_id, method) AS m FROM hits), hy AS (SELECT *, round(CASE WHEN method = 'bm25' THEN 0.72 * CASE WHEN m > 0 THEN score / m ELSE 0 END + 0.28 * keyword ELSE 0.86 * CASE WHEN m > 0 THEN score / m ELSE 0 END + 0.14 * keyword END, 4) AS hybrid FROM sc), one AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY hybrid DESC, method DESC) AS k FROM hy), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS rank FROM one WHERE k = 1)"


@query(f"WITH {FUSED} SELECT query_id, id, hybrid, rank::INT AS rank FROM fused WHERE rank <= 5")
def hybrid_fusion(spark, sf_dir):
    return retrieval.fuse(_hits(spark, sf_dir)).select("query_id", "id", "hybrid", "rank")


@query(f"WITH {FUSED} SELECT item_id AS query_id, coalesce(max(hybrid), 0) AS best, coalesce(max(hybrid), 0) >= 0.08 AS answered FROM benchmark LEFT JOIN fused ON query_id = item_id GROUP BY 1")
def abstain_floor(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return retrieval.abstain(q, retrieval.fuse(_hits(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN list_sum(v) > 0 THEN array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)::VARCHAR), ',') ELSE 'fallback' END AS vector FROM (SELECT doc_id, [CAST((length(t) - length(replace(t, k, ''))) / length(k) AS DOUBLE) FOR k IN ['the', 'and', 'les', 'der', 'que', 'ing']] AS v FROM (SELECT doc_id, lower(" + COMPACT.format("text") + ") AS t FROM documents))")
def keyword_embedding(spark, sf_dir):
    words = ["the", "and", "les", "der", "que", "ing"]

    def said(v):
        counted = F.exists(v, lambda x: x > 0) & F.forall(v, lambda x: x == F.floor(x)) & F.lower("text").rlike("the|and|les|der|que|ing")
        return F.when(counted, F.array_join(F.transform(v, lambda x: x.cast("long").cast("string")), ",")).otherwise(F.lit("fallback"))

    v = retrieval.keyword_vector(F.col("text"), words)
    return D.dealt(spark, sf_dir, "documents").select("doc_id", T.let(v, said).alias("vector"))


REF = "'[' || source || ', 第' || (doc_id % 7) || '章, 第 ' || (doc_id % 50) || ' 页]'"


def _answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ref = F.format_string("[%s, 第%d章, 第 %d 页]", "source", F.col("doc_id") % 7, F.col("doc_id") % 50)
    return d.select("doc_id", ref.alias("ref"), F.concat(F.lit("see "), ref, F.lit(" and "), F.left("lang", F.lit(2))).alias("answer"))


@query(f"SELECT doc_id, {REF} AS ref, 1::BIGINT AS n FROM documents")
def citation_extract(spark, sf_dir):
    c = T.citations_in(F.col("answer"))
    return _answers(spark, sf_dir).select("doc_id", c[0].alias("ref"), F.size(c).cast("long").alias("n"))


ALLOWED = f"allowed AS (SELECT DISTINCT lower(replace({REF}, ' ', '')) AS k FROM documents WHERE lang = 'en')"


def _allowed(spark, sf_dir):
    refs = _answers(spark, sf_dir).join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return refs.select(T.citation_key(F.col("ref")).alias("k")).distinct()


@query(f"WITH {ALLOWED} SELECT doc_id FROM documents WHERE lower(replace({REF}, ' ', '')) IN (SELECT k FROM allowed)")
def citation_match_semi(spark, sf_dir):
    return _answers(spark, sf_dir).withColumn("k", T.citation_key(F.col("ref"))).join(_allowed(spark, sf_dir), "k", "left_semi").select("doc_id")


@query(f"WITH {ALLOWED} SELECT doc_id FROM documents WHERE lower(replace({REF}, ' ', '')) NOT IN (SELECT k FROM allowed)")
def citation_unmatched_anti(spark, sf_dir):
    return _answers(spark, sf_dir).withColumn("k", T.citation_key(F.col("ref"))).join(_allowed(spark, sf_dir), "k", "left_anti").select("doc_id")


_OTHER = "'[other, 第1章, 第 1 页]'"


@query(
    f"WITH a AS (SELECT doc_id, doc_id % 6 AS k, {REF} AS ref, lang, '[other, 第1章, 第 1 页]' AS other FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'see ' || ref || ' and ' || lang WHEN 1 THEN 'see and ' || lang || ' 来源：' || other WHEN 2 THEN 'see ' || ref || ' and ' || lang WHEN 3 THEN '当前知识库中未找到相关信息' WHEN 4 THEN 'see and ' || lang || ' 来源：' || ref ELSE 'plain ' || lang || '. 来源：' || ref || ' ' || other END AS answer, k <> 2 AS verified, k IN (1, 4, 5) AS injected, CASE WHEN k IN (0, 4) THEN 1 ELSE 0 END AS matched, CASE WHEN k IN (1, 2, 4) THEN 1 ELSE 0 END AS removed FROM a"
)
def citation_repair(spark, sf_dir):
    a = _answers(spark, sf_dir).withColumn("k", F.col("doc_id") % 6).withColumn("other", F.lit("[other, 第1章, 第 1 页]"))
    said = F.when(F.col("k") < 3, F.col("answer")).when(F.col("k") == 3, F.lit(" 当前知识库中未找到相关信息。")).when(F.col("k") == 4, F.concat("answer", F.lit(" "), "other")).otherwise(F.concat(F.lit("plain "), F.substring_index("answer", " ", -1), F.lit(" .")))
    refs = F.when(F.col("k").isin(0, 3, 4), F.array("ref", F.upper("ref"))).when(F.col("k") == 1, F.array("other")).when(F.col("k") == 2, F.array().cast("array<string>")).otherwise(F.array("ref", F.lit(" "), "other"))
    v = a.withColumn("v", retrieval.verify_citations(said, refs))
    return v.select("doc_id", "v.answer", "v.verified", "v.injected", F.size("v.matched").alias("matched"), F.size("v.removed").alias("removed"))


@query(f"WITH {CHAPTERS} SELECT count(DISTINCT textbook_id) AS books, count(DISTINCT (textbook_id, chapter_id)) AS chapters, sum(char_count)::BIGINT AS chars FROM chapters")
def manifest_stats(spark, sf_dir):
    return D.chapters(spark, sf_dir).agg(F.count_distinct("textbook_id").alias("books"), F.count_distinct("textbook_id", "chapter_id").alias("chapters"), F.sum("char_count").alias("chars"))


# Integration


@query(f"WITH RECURSIVE {NODES}, {DECISIONS}, {FOLD} SELECT raw_id, id, status, NULL::VARCHAR AS decision_id FROM current_ids")
def decision_fold(spark, sf_dir):
    return integrate.current_ids(D.nodes(spark, sf_dir), D.decisions(spark, sf_dir))


@query(
    f"WITH RECURSIVE {NODES}, {DECISIONS}, {FOLD}, j AS (SELECT c.id, c.raw_id, c.status, n.ord, n.name, n.definition, n.category, n.textbook_id, n.page FROM current_ids c JOIN nodes n ON n.id = c.raw_id), b AS (SELECT id, string_agg(textbook_id, '；' ORDER BY o) AS textbook_id FROM (SELECT id, textbook_id, min(raw_id) AS o FROM j GROUP BY 1, 2) GROUP BY 1) SELECT j.id, arg_min(name, (length(name), raw_id)) AS name, arg_max(definition, (length(definition), -ord)) AS definition, arg_min(category, raw_id) AS category, any_value(b.textbook_id) AS textbook_id, min(coalesce(page, 0)) AS page, count(*) AS frequency, max(status) AS status, string_agg(raw_id, '|' ORDER BY raw_id) AS merged_from FROM j JOIN b USING (id) GROUP BY j.id"
)
def merged_node_rollup(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    m = integrate.merged_nodes(n, integrate.current_ids(n, D.decisions(spark, sf_dir)))
    return m.select("id", "name", "definition", "category", "textbook_id", "page", "frequency", "status", F.array_join("merged_from", "|").alias("merged_from"))


@query(f"WITH {NODES}, {EDGES}, cur AS (SELECT id AS raw_id, first_value(id) OVER (PARTITION BY name, textbook_id ORDER BY ord) AS id FROM nodes), r AS (SELECT a.id AS source, b.id AS target, relation_type, description, ord FROM edges e JOIN cur a ON a.raw_id = e.source JOIN cur b ON b.raw_id = e.target WHERE a.id <> b.id) SELECT source, target, relation_type, description, min(ord) AS ord FROM r GROUP BY 1, 2, 3, 4")
def edge_rewrite(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    current = n.select(F.col("id").alias("raw_id"), F.first("id").over(W.partitionBy("name", "textbook_id").orderBy("ord")).alias("id"))
    return integrate.rewrite_edges(D.edges(spark, sf_dir), current).select("source", "target", "relation_type", "description", "ord")


@query(f"WITH {NODES}, g AS (SELECT name, min(ord) AS o, min(id) AS id FROM nodes GROUP BY 1) SELECT min(n.id) AS id, count(*) AS frequency, min(page) AS page, arg_max(definition, (length(definition), -ord)) AS definition FROM nodes n GROUP BY name")
def merged_by_name(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    current = D.same_name(n).withColumn("status", F.lit("merged"))
    return integrate.merged_nodes(n, current).select("id", "frequency", "page", "definition")


@query(f"WITH {DECISIONS} SELECT count(*) FILTER (action = 'merge') AS merge, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'remove') AS remove FROM decisions")
def action_counts(spark, sf_dir):
    return integrate.action_counts(D.actions(spark, sf_dir))


@query(f"WITH {NODES}, b AS (SELECT sum(n_chars) AS parsed FROM documents), a AS (SELECT sum(greatest(1, length(definition))) AS ic FROM (SELECT arg_max(definition, (length(definition), -ord)) AS definition FROM nodes GROUP BY name)) SELECT parsed::BIGINT AS original_chars, ic::BIGINT AS integrated_chars, round(ic / parsed, 4) AS ratio, ic / parsed <= 0.3 AS target_met, 'parsed_textbook_total_chars' AS source FROM a, b")
def compression_stats(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    current = D.same_name(n).withColumn("status", F.lit("merged"))
    books = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("total_chars"))
    return integrate.compression(n, integrate.merged_nodes(n, current), books)


@query(f"WITH {NODES}, {DECISIONS}, p AS (SELECT count(DISTINCT x) AS processed FROM (SELECT unnest(affected_nodes) AS x FROM decisions) WHERE x IN (SELECT id FROM nodes)) SELECT (SELECT count(*) FROM nodes) AS raw, processed, greatest(0, (SELECT count(*) FROM nodes) - processed) AS remaining, greatest(0, (SELECT count(*) FROM nodes) - processed) > 0 AS should_continue FROM p")
def remaining_nodes(spark, sf_dir):
    return integrate.remaining(D.nodes(spark, sf_dir), D.actions(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES}, cur AS (SELECT id AS raw_id, min(id) OVER (PARTITION BY name) AS id FROM nodes) SELECT (SELECT count(*) FROM nodes) AS nodes_before, (SELECT count(*) FROM edges) AS edges_before, (SELECT count(DISTINCT id) FROM cur) AS nodes_after, (SELECT count(DISTINCT (a.id, b.id, relation_type, description)) FROM edges e JOIN cur a ON a.raw_id = e.source JOIN cur b ON b.raw_id = e.target WHERE a.id <> b.id) AS edges_after")
def before_after(spark, sf_dir):
    n, e = D.nodes(spark, sf_dir), D.edges(spark, sf_dir)
    current = D.same_name(n)
    return integrate.comparison(n, e, current)


@query(f"WITH {DECISIONS} SELECT action || '_' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS decision_id, len(affected_nodes)::INT AS n FROM decisions ORDER BY seq DESC LIMIT 5")
def recent_decisions_last5(spark, sf_dir):
    d = integrate.decision_ids(D.decisions(spark, sf_dir), placed=True)
    return d.orderBy(F.desc("seq")).limit(5).select("decision_id", F.size("affected_nodes").alias("n"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 12")
def conversation_last12(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return c.where("k <= 12").select("conv_id", "turn", "role")


@query("SELECT doc_id, quality = 0 OR toxic = 1 OR quality IS NULL AS stop FROM labels")
def stop_policy(spark, sf_dir):
    stop = integrate.should_stop(F.col("quality") == 1, F.lit(True), F.when(F.col("toxic") == 1, "keep").otherwise("merge"), F.lit(None).cast("boolean"))
    return table(spark, sf_dir, "labels").select("doc_id", stop.alias("stop"))


@query(f"WITH {NODES}, {EDGES}, {DECISIONS} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges WHERE {FACT}) AS facts, (SELECT count(DISTINCT textbook_id) FROM nodes) AS books, (SELECT count(*) FROM decisions) AS decisions, (SELECT sum(n_chars)::BIGINT FROM documents) AS chars")
def report_overview(spark, sf_dir):
    return _overview(spark, sf_dir, D.decisions(spark, sf_dir))


def _overview(spark, sf_dir, decisions):
    n = D.nodes(spark, sf_dir).agg(F.count("*").alias("nodes"), F.count_distinct("textbook_id").alias("books"))
    e = integrate.factual(D.edges(spark, sf_dir)).agg(F.count("*").alias("facts"))
    d = decisions.agg(F.count("*").alias("decisions"))
    c = table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("chars"))
    return n.join(e, F.lit(True)).join(d, F.lit(True)).join(c, F.lit(True)).select("nodes", "facts", "books", "decisions", "chars")


# Set operations and orders


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name)::INT AS k FROM nation")
def zh_sort(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.withColumn("k", F.row_number().over(W.orderBy(F.collate("n_name", "zh"))))


# Event streams, as batches

ALLOW = "('signup', 'purchase')"


def _messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.array("event_type").alias("ids"), F.col("user_id").cast("string").alias("chat_id"), F.get_json_object("props", "$.k").alias("text"))


@query(f"SELECT event_id FROM events WHERE event_type IN {ALLOW}")
def allowlist_semi(spark, sf_dir):
    users = T.allowed_users(F.lit("Signup, PURCHASE ,,"))
    return _messages(spark, sf_dir).where(T.is_allowed(F.col("ids"), users)).select("event_id")


@query(f"SELECT event_id FROM events WHERE event_type NOT IN {ALLOW}")
def denied_anti(spark, sf_dir):
    allowed = spark.createDataFrame([("signup",), ("purchase",)], "event_type string")
    return table(spark, sf_dir, "events").join(F.broadcast(allowed), "event_type", "left_anti").select("event_id")


@query(f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 7 = 1 THEN 'no_chat' WHEN event_type NOT IN {ALLOW} THEN 'denied' WHEN event_id % 7 IN (2, 3) THEN 'approval' ELSE 'command' END AS route FROM events")
def message_routing(spark, sf_dir):
    k = F.col("event_id") % 7
    said = F.when(k == 0, F.lit("")).when(k == 2, F.lit(" Allow ")).when(k == 3, F.lit("拒绝 #2")).otherwise(F.col("text"))
    m = _messages(spark, sf_dir).withColumn("text", said).withColumn("chat_id", F.when(k != 1, F.col("chat_id")))
    return chat.routed(m, ["signup", "purchase"]).select("event_id", "route")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY 1, 2), f AS (SELECT user_id, event_type, t FROM s UNION ALL SELECT f.user_id, f.event_type, (SELECT min(e.t) FROM e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.t >= f.t + 36000000000) AS t FROM f WHERE f.t IS NOT NULL) SELECT user_id, event_type, count(t) AS passed FROM f GROUP BY 1, 2"
)
def ttl_dedup(spark, sf_dir):
    e = chat.accepted(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", minutes=600)
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("passed"))


@query("SELECT user_id AS chat_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type = 'error'")
def chat_pending_rank(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("id"), F.col("ts").alias("asked_at"))
    return chat.pending_ranks(asked).select("chat_id", "id", "nth", "total")


@query("SELECT event_id AS id, c_name AS chat_id, c_name IS NULL AS auto_reject FROM events LEFT JOIN customer ON c_custkey = user_id * 15 WHERE event_type = 'error'")
def permission_left_join(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") * 15).alias("session_id"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("chat_id"))
    return chat.with_chats(asked, known).select("id", "chat_id", "auto_reject")


@query("SELECT user_id::VARCHAR AS chat_id, arg_min(event_id, (ts, event_id)) AS opened_by, count(*) AS messages FROM events GROUP BY 1")
def session_map(spark, sf_dir):
    return chat.sessions(_messages(spark, sf_dir).withColumn("message_id", F.col("event_id")))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 360 DAY")
def job_prune(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), "o_orderstatus")
    now = o.agg(F.max("updated_at").alias("now"))
    return chat.live_jobs(o.join(F.broadcast(now), F.lit(True)), F.col("now"), hours=24 * 360).select("id", F.col("o_orderstatus").alias("status"))


_MARKED = "'<a href=''x''>&' || chr(34) || left(html, 60) || url"
_SAFE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#039;')"


@query(f"SELECT page_id, {COMPACT.format('left(html, 120)')} AS t, {_SAFE.format(_MARKED)} AS safe FROM pages")
def escape_html(spark, sf_dir):
    said = F.concat(F.lit("<a href='x'>&" + chr(34)), F.left("html", F.lit(60)), "url")
    return table(spark, sf_dir, "pages").select("page_id", T.compact_text(F.left("html", F.lit(120))).alias("t"), T.escape_html(said).alias("safe"))


from quire.plans import more  # noqa: E402, F401  registers its queries
