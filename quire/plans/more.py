"""Further registered queries: stored graphs, decisions, citations, names, labels and the front end's rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import adapters
from quire.functions import text as T
from quire.operators import decide, graph, integrate, library, segment
from quire.plans import derived as D
from quire.plans.catalog import COMPACT, KEY, TITLE, WHITE, _HEADING, _answers, query
from quire.plans.derived import ADDRESSES_SQL, CHAPTERS, DECISIONS, EDGES, FACT, HEADED_SQL, LINES, NODES, PROMPTS_SQL, table
from quire.streaming import chat

# Extractions and loaded graphs

KEYS = ("nodes", "entities", "knowledge_points")


def _payloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.element_at(F.array(*(F.lit(k) for k in KEYS)), (F.col("doc_id") % 3 + 1).cast("int"))
    payload = F.concat(F.lit('{"'), key, F.lit('": [{"name": " '), "source", F.lit('  x ", "page": 7}, {"label": "'), "lang", F.lit('", "category": "方法", "quote": "q"}, {"title": "third"}], "relations": [{"source": "'), "source", F.lit('", "target": "'), "lang", F.lit('", "type": "包含", "derived": true}]}'))
    payload = F.when(F.col("doc_id") % 11 == 0, F.lit("no json")).otherwise(payload)
    return d.select(F.col("source").alias("book"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chapter_id"), F.col("doc_id").alias("chapter_idx"), F.col("lang").alias("chapter"), F.lit(3).alias("page"), payload.alias("payload"))


@query(
    "SELECT doc_id AS chapter_idx, p.pos, CASE p.pos WHEN 0 THEN source || ' x' ELSE lang END AS name, CASE p.pos WHEN 0 THEN '核心概念' ELSE '方法' END AS category, CASE p.pos WHEN 0 THEN 7 ELSE 3 END AS page, CASE p.pos WHEN 0 THEN '' ELSE 'q' END AS quote FROM documents, (SELECT unnest([0, 1]) AS pos) p WHERE doc_id % 11 <> 0"
)
def extracted_nodes(spark, sf_dir):
    mentions, _ = library.extracted(_payloads(spark, sf_dir), most_nodes=2)
    return mentions.select("chapter_idx", "pos", "name", "category", "page", "quote")


@query("SELECT doc_id AS chapter_idx, source, lang AS target, 'contains' AS relation_type, true AS derived FROM documents WHERE doc_id % 11 <> 0")
def extracted_relationships(spark, sf_dir):
    _, sides = library.extracted(_payloads(spark, sf_dir))
    return sides.select("chapter_idx", "source", "target", T.relation_type(F.col("relation_type")).alias("relation_type"), "derived")


@query("SELECT 'graph_' || source || '_' || left(sha1(source || ':' || sum(n_chars)::VARCHAR || ':' || count(*)::VARCHAR), 10) AS id, source FROM documents GROUP BY source")
def graph_ids(spark, sf_dir):
    b = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    return b.select(library.graph_id(F.col("source"), F.col("source"), F.col("chars"), F.col("n")).alias("id"), "source")


@query(f"WITH {CHAPTERS} SELECT textbook_id, chapter_id FROM chapters WHERE chapter_idx <= 3")
def first_chapters(spark, sf_dir):
    return segment.first_chapters(D.chapters(spark, sf_dir), "textbook_id", 3).select("textbook_id", "chapter_id")


def _node_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    key = F.col("p_partkey").cast("string")
    row = (
        F.when(k == 0, F.concat(F.lit('{"id": "n'), key, F.lit('", "name": "'), "p_name", F.lit('", "page": "'), F.col("p_size").cast("string"), F.lit('", "frequency": 2}')))
        .when(k == 1, F.concat(F.lit('{"node_id": "n'), key, F.lit('", "label": " '), "p_name", F.lit('  ", "description": "d", "categories": ["a", " b "], "chapters": []}')))
        .when(k == 2, F.concat(F.lit('{"title": "'), "p_name", F.lit('", "category": "'), "p_type", F.lit('", "chapter": "c", "sources": [{"quote": "'), F.repeat(F.lit("q"), F.lit(430)), F.lit('", "textbook_id": "b"}, {"source_quote": "s", "page": 4}]}')))
        .otherwise(F.lit('{"id": null, "node_kind": "chapter"}'))
    )
    return p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string"), F.lit(".json")).alias("file"), F.col("p_partkey").cast("int").alias("pos"), F.parse_json(row).alias("row"))


_MADE = "'f' || (p_partkey % 3) || '_node_' || CASE WHEN p_partkey + 1 < 1000 THEN lpad(CAST(p_partkey + 1 AS VARCHAR), 3, '0') ELSE CAST(p_partkey + 1 AS VARCHAR) END"


@query(
    f"SELECT p_partkey::INT AS pos, CASE WHEN k < 2 THEN 'n' || p_partkey ELSE {_MADE} END AS id, CASE WHEN k < 3 THEN p_name ELSE {_MADE} END AS name, CASE k WHEN 1 THEN 'd' ELSE '' END AS definition, CASE k WHEN 2 THEN p_type ELSE '核心概念' END AS category, CASE k WHEN 1 THEN 'a,b' WHEN 2 THEN p_type ELSE '核心概念' END AS categories, CASE k WHEN 2 THEN 'c' ELSE '' END AS chapters, CASE k WHEN 0 THEN p_size::DOUBLE END AS page, CASE k WHEN 2 THEN 'b' ELSE '' END AS textbook_id, CASE k WHEN 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS frequency, CASE k WHEN 3 THEN 'chapter' ELSE 'knowledge' END AS node_kind, CASE k WHEN 2 THEN 421 ELSE 0 END AS quoted FROM (SELECT *, p_partkey % 4 AS k FROM part)"
)
def normalised_nodes(spark, sf_dir):
    n = library.normalised_nodes(_node_rows(spark, sf_dir), ascii_only=True)
    quoted = F.aggregate("sources", F.lit(0), lambda s, x: s + F.length(x["source_quote"]))
    return n.select("pos", "id", "name", "definition", "category", F.array_join("categories", ",").alias("categories"), F.array_join("chapters", ",").alias("chapters"), "page", "textbook_id", "frequency", "node_kind", quoted.alias("quoted"))


def _side_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 3
    ends = F.concat(F.lit('"source": " n'), F.col("l_partkey").cast("string"), F.lit(' ", "target": "'), F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))), F.lit('"'))
    row = F.when(k == 0, F.concat(F.lit('{"id": "e'), F.col("l_orderkey").cast("string"), F.lit('", "type": "contains", "reason": " because  of ", '), ends, F.lit("}"))).when(k == 1, F.concat(F.lit('{"edge_id": "x", "relation_type": "parallel", "derived": true, '), ends, F.lit("}"))).otherwise(F.concat(F.lit("{"), ends, F.lit("}")))
    return li.select(F.lit("s.json").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("pos"), F.parse_json(row).alias("row"))


@query(
    "SELECT (l_orderkey * 10 + l_linenumber)::INT AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'e' || l_orderkey WHEN 1 THEN 'x' ELSE 's_edge_' || CASE WHEN l_orderkey * 10 + l_linenumber + 1 < 1000 THEN lpad(CAST(l_orderkey * 10 + l_linenumber + 1 AS VARCHAR), 3, '0') ELSE CAST(l_orderkey * 10 + l_linenumber + 1 AS VARCHAR) END END AS id, 'n' || l_partkey AS source, 'n' || l_suppkey AS target, CASE l_linenumber % 3 WHEN 0 THEN 'contains' ELSE 'parallel' END AS relation_type, CASE l_linenumber % 3 WHEN 0 THEN 'because of' ELSE '' END AS description, CASE l_linenumber % 3 WHEN 1 THEN true END AS derived FROM lineitem WHERE l_suppkey % 7 <> 0"
)
def normalised_sides(spark, sf_dir):
    return library.normalised_sides(_side_rows(spark, sf_dir), ascii_only=True).select("pos", "id", "source", "target", "relation_type", "description", "derived")


@query(
    f"WITH {NODES}, {EDGES}, k AS (SELECT id FROM nodes WHERE page <= 40), e AS (SELECT coalesce(CASE WHEN ord % 3 = 0 THEN id END, left(sha1(source || '|' || target || '|' || relation_type), 12)) AS id, ord, source, target, relation_type, description FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)) SELECT id, source, target, description FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS n FROM e) WHERE n = 1"
)
def shown_edges(spark, sf_dir):
    n = D.nodes(spark, sf_dir).where("page <= 40").withColumn("file", F.lit("a")).withColumn("pos", F.col("ord"))
    e = D.edges(spark, sf_dir).withColumn("id", F.when(F.col("ord") % 3 == 0, F.col("id"))).withColumn("file", F.lit("b")).withColumn("pos", F.col("ord"))
    return library.shown_graph(n, e)[1].select("id", "source", "target", "description")


@query(
    f"WITH {NODES}, {EDGES}, r AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN source ELSE (SELECT name FROM nodes WHERE id = source) END AS s, CASE WHEN ord % 5 = 0 THEN 'nobody' ELSE target END AS t FROM edges), k AS (SELECT {KEY.format('name')} AS key, arg_min(id, ord) AS id FROM nodes GROUP BY 1) SELECT r.ord, coalesce(a.id, ka.id) AS source, coalesce(b.id, kb.id) AS target FROM r LEFT JOIN nodes a ON a.id = s LEFT JOIN k ka ON ka.key = {KEY.format('s')} LEFT JOIN nodes b ON b.id = t LEFT JOIN k kb ON kb.key = {KEY.format('t')} WHERE coalesce(a.id, ka.id) IS NOT NULL AND coalesce(b.id, kb.id) IS NOT NULL"
)
def resolved_ends(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    e = D.edges(spark, sf_dir).join(n.select(F.col("id").alias("source"), F.col("name").alias("said")), "source", "left")
    e = e.withColumn("source", F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(F.col("said"))).withColumn("target", F.when(F.col("ord") % 5 == 0, "nobody").otherwise(F.col("target"))).drop("said")
    return integrate.resolve_ends(e, n, ascii_only=True).select("ord", "source", "target")


@query(f"WITH {NODES} SELECT id, name, category FROM nodes WHERE id = 'n7'")
def node_by_id(spark, sf_dir):
    return library.by_id(D.nodes(spark, sf_dir), "id", "n7").select("id", "name", "category")


@query(f"WITH {EDGES} SELECT DISTINCT relation_type, 'edges' AS via FROM edges UNION ALL SELECT unnest(['a', 'b']), 'stats'")
def offered_types(spark, sf_dir):
    e = D.edges(spark, sf_dir)
    listed = spark.createDataFrame([(["a", "b"],)], "relation_types array<string>")
    return library.relation_types(listed.where("false"), e).withColumn("via", F.lit("edges")).unionByName(library.relation_types(listed, e).withColumn("via", F.lit("stats")))


@query(f"WITH {EDGES} SELECT 'contains' AS asked, count(*) AS n FROM edges WHERE relation_type = 'contains' UNION ALL SELECT 'all', count(*) FROM edges")
def edges_of_type(spark, sf_dir):
    e = D.edges(spark, sf_dir)
    count = lambda t: library.of_type(e, t).agg(F.lit(t).alias("asked"), F.count("*").alias("n"))
    return count("contains").unionByName(count("all"))


@query(f"WITH {CHAPTERS}, p AS (SELECT *, CASE WHEN length({COMPACT.format('content')}) > 120 THEN left({COMPACT.format('content')}, 120) || '...' ELSE {COMPACT.format('content')} END AS preview FROM chapters) SELECT textbook_id, sum(char_count)::BIGINT AS total_chars, count(*) AS chapter_count, md5(string_agg(chapter_id || preview || page_end, '|' ORDER BY chapter_idx)) AS digest FROM p GROUP BY 1")
def book_summaries(spark, sf_dir):
    s = library.book_summary(D.chapters(spark, sf_dir, preview=T.preview(F.col("text"), 120)), "textbook_id")
    said = F.array_join(F.transform("chapters", lambda c: F.concat(c["chapter_id"], c["preview"], c["page_end"].cast("string"))), "|")
    return s.select("textbook_id", "total_chars", "chapter_count", F.md5(said.cast("binary")).alias("digest"))


# Hits and citations


@query(
    f"WITH {CHAPTERS}, h AS (SELECT doc_id % 40 AS query_id, doc_id AS id, doc_id // 40 AS rank, 1.0 / (doc_id + 1) AS hybrid, CASE WHEN doc_id % 2 = 0 THEN 'bm25' ELSE 'vector' END AS method FROM documents UNION ALL SELECT 99, -1, 1, 0.5, 'bm25') SELECT query_id::BIGINT AS query_id, rank::BIGINT AS rank, CASE WHEN doc_id % 3 = 0 THEN textbook_id ELSE title END AS textbook, CASE WHEN doc_id % 5 = 0 THEN chapter_id ELSE chapter_title END AS chapter, page_start AS page, round(hybrid, 6)::DOUBLE AS relevance_score, method AS retrieval_method, h.id AS chunk_id, length(content)::INT AS n FROM h JOIN chapters c ON c.doc_id = h.id"
)
def hit_citations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = d.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 40).alias("rank"), (1.0 / (F.col("doc_id") + 1)).alias("hybrid"), F.when(F.col("doc_id") % 2 == 0, "bm25").otherwise("vector").alias("method"))
    hits = hits.unionByName(spark.createDataFrame([(99, -1, 1, 0.5, "bm25")], "query_id long, id long, rank long, hybrid double, method string"))
    c = D.chapters(spark, sf_dir)
    blank = lambda n, name: F.when(F.col("doc_id") % n == 0, F.lit("")).otherwise(F.col(name)).alias(name)
    chunks = c.select(F.col("doc_id").alias("id"), F.col("textbook_id").alias("book"), blank(3, "title"), "chapter_id", blank(5, "chapter_title"), F.col("page_start").alias("page"), F.lit("").alias("source_ref"), F.col("content").alias("text"))
    cited = library.cited_texts(library.citations(library.hit_chunks(hits, chunks)), chunks)
    return cited.select("query_id", "rank", "textbook", "chapter", "page", F.round("relevance_score", 6).alias("relevance_score"), "retrieval_method", "chunk_id", F.length("text").alias("n"))


@query("SELECT doc_id, '[' || source || ', 第' || (doc_id % 7) || '章, 第 ' || (doc_id % 50) || ' 页]' AS ref, CASE WHEN doc_id % 2 = 0 THEN 'see  and ' || lang ELSE '' END AS bare FROM documents")
def citations_out(spark, sf_dir):
    a = _answers(spark, sf_dir)
    said = F.when(F.col("doc_id") % 2 == 0, F.col("answer")).otherwise(F.col("ref"))
    return a.select("doc_id", T.citations_in(said)[0].alias("ref"), T.without_citations(said).alias("bare"))


# Decisions


@query(
    f"WITH {NODES}, {DECISIONS}, u AS (SELECT seq, action, unnest(affected_nodes) AS id, unnest(range(len(affected_nodes))) AS pos FROM decisions), m AS (SELECT u.*, greatest(1, length(definition) + length(name)) AS chars, greatest(1, length(definition)) AS short FROM u JOIN nodes n USING (id)), s AS (SELECT seq, sum(chars) AS before, arg_min(short, pos) AS first FROM m GROUP BY 1) SELECT seq::INT AS seq, coalesce(before, 0)::BIGINT AS original_chars, r::BIGINT AS integrated_chars, floor(r / greatest(1, coalesce(before, 0)) * 1e4 + 0.5) / 1e4 AS ratio, r / greatest(1, coalesce(before, 0)) <= 0.3 AS target_met FROM (SELECT d.seq, before, CASE WHEN action = 'remove' THEN 0 ELSE coalesce(first, 1) END AS r FROM decisions d LEFT JOIN s USING (seq))"
)
def decision_compression(spark, sf_dir):
    none = F.lit(None).cast("string")
    d = D.decisions(spark, sf_dir).withColumn("name", none).withColumn("definition", none)
    return library.decision_compression(d, D.nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT (SELECT count(*) FROM nodes) AS raw, (SELECT count(*) FROM nodes WHERE page % 3 = 0) AS removed")
def removed_nodes(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    return library.removed_nodes(n, n.where("page % 3 <> 0").select(F.col("id").alias("raw_id"), F.col("name").alias("id")))


@query(f"WITH {DECISIONS} SELECT seq::INT AS seq, action IN ('merge', 'remove') AS changed FROM decisions")
def changed_flags(spark, sf_dir):
    return D.decisions(spark, sf_dir).select("seq", decide.changes_graph(F.col("action")).alias("changed"))


@query(
    "SELECT (SELECT count(*) > 0 FROM part) AS integrated, (SELECT count(*) FROM orders) AS decisions, (SELECT count(*) FROM conversations) AS turns, (SELECT count(DISTINCT source) FROM documents) AS textbook_count, (SELECT count(*) FROM documents) AS chunk_count, false AS missing, 0::BIGINT AS missing_chunks"
)
def stored_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("textbook_count"), F.count("*").alias("chapter_count"), F.count("*").alias("indexed_chapter_count"), F.count("*").alias("chunk_count"))
    s = library.integration_status(table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "conversations"))
    none = library.index_status(d.where("false")).select(F.col("indexed").alias("missing"), F.col("chunk_count").alias("missing_chunks"))
    return s.join(library.index_status(d).select("textbook_count", "chunk_count"), F.lit(True)).join(none, F.lit(True))


def _rounds(spark, sf_dir):
    """A round for every part whose key is divisible by 10; the two parts after it are its candidates."""
    n = D.nodes(spark, sf_dir).select("id", "ord", "name")
    near = n.where("ord % 10 = 0").select(F.col("ord").alias("round"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    c = near.join(n.select("id", "ord"), F.col("ord") == F.col("round") + F.col("rank"))
    candidates = c.select("round", "id", "rank", F.when(F.col("round") % 3 == 0, 0.7).otherwise(0.75).alias("score"))
    second = n.select((F.col("ord") - 2).alias("ord"), F.col("name").alias("second"), F.col("id").alias("second_id"))
    r = n.where("ord % 10 = 0").join(second, "ord")
    k = F.col("ord") / 10 % 5
    why = '"necessity": {"necessary": true, "reason": "so"}'
    reply = (
        F.when(k == 0, F.lit('{"action": "merge", ' + why + "}"))
        .when(k == 1, F.lit('{"action": "remove", "need_to_integrate": {"required": false, "explanation": "no"}, "confidence": 2}'))
        .when(k == 2, F.concat(F.lit('{"action": "remove", ' + why + ', "confidence": "0.4", "affected_node_ids": ["'), "second_id", F.lit('"]}')))
        .when(k == 3, F.lit("I cannot say"))
        .otherwise(F.concat(F.lit('Here: {"action": "Merge", ' + why + ', "reason": " by  hand ", "affected_nodes": ["'), "id", F.lit('", "'), "second", F.lit('", "nobody"]}')))
    )
    rounds = r.select(F.col("ord").alias("round"), F.lit("请整合").alias("prompt"), F.col("id").alias("target"), reply.alias("reply"), (F.col("ord") / 10).cast("int").alias("before"))
    return rounds, candidates


_SAFE = "trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_-]+', '_', 'g'), '_')"


@query(
    f"WITH {NODES}, r AS (SELECT t.ord, t.ord // 10 AS b, t.ord // 10 % 5 AS k, t.id, t.name, c1.id AS id1, c1.name AS name1, c2.id AS id2, c2.name AS name2, CASE WHEN t.ord % 3 = 0 THEN 0.7 ELSE 0.75 END AS score FROM nodes t JOIN nodes c1 ON c1.ord = t.ord + 1 JOIN nodes c2 ON c2.ord = t.ord + 2 WHERE t.ord % 10 = 0), x AS (SELECT *, CASE WHEN name2 = name THEN id WHEN name2 = name1 THEN id1 ELSE id2 END AS second FROM r), y AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN score >= 0.72 THEN list_sort([id, id1]) ELSE [id] END WHEN 2 THEN [id2] WHEN 4 THEN CASE WHEN second = id THEN CASE WHEN score >= 0.72 THEN list_sort([id, id1]) ELSE [id] END ELSE list_sort([id, second]) END ELSE [id] END AS a FROM x), z AS (SELECT *, CASE WHEN k IN (0, 4) AND len(a) = 2 THEN 'merge' WHEN k = 2 THEN 'remove' ELSE 'keep' END AS action FROM y), s AS (SELECT z.*, arg_min(n.name, (length(n.name), n.id)) AS short FROM z JOIN nodes n ON list_contains(a, n.id) GROUP BY ALL) SELECT ord AS round, action || '_' || CASE WHEN b + 1 < 1000 THEN lpad(CAST(b + 1 AS VARCHAR), 3, '0') ELSE CAST(b + 1 AS VARCHAR) END AS decision_id, array_to_string(a, '|') AS affected, CASE action WHEN 'remove' THEN NULL WHEN 'merge' THEN 'merged_' || {_SAFE.format('short')} || '_' || left(sha1(array_to_string(a, '|')), 8) ELSE a[1] END AS result_node, CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.4 ELSE CASE action WHEN 'merge' THEN 0.82 ELSE 0.76 END END::DOUBLE AS confidence, CASE WHEN k = 4 THEN 'by hand' WHEN k = 3 THEN '模型输出格式不可解析，已保留当前节点。' WHEN action = 'merge' THEN '' ELSE CASE WHEN action = 'remove' THEN '“' || (SELECT name FROM nodes WHERE id = a[1]) || '” 被判定为冗余节点，按教师提示“请整合”从当前整合图中移除。' ELSE '“' || name || '” 按教师提示“请整合”保留为独立知识点。' END END AS reason, CASE k WHEN 2 THEN 'remove' WHEN 0 THEN 'merge' WHEN 4 THEN 'merge' ELSE 'keep' END AS final_action FROM s"
)
def judged_decisions(spark, sf_dir):
    rounds, candidates = _rounds(spark, sf_dir)
    d = decide.require_judged(decide.decisions(rounds, candidates, D.nodes(spark, sf_dir), ascii_only=True))
    reason = F.when((F.col("action") == "merge") & F.col("reason").contains("高度相似"), F.lit("")).otherwise(F.col("reason"))
    return d.select("round", "decision_id", F.array_join("affected_nodes", "|").alias("affected"), "result_node", "confidence", reason.alias("reason"), "necessity.final_action")


_TURN = "CASE WHEN {0} < 1000 THEN lpad(CAST({0} AS VARCHAR), 3, '0') ELSE CAST({0} AS VARCHAR) END"


@query(f"WITH {PROMPTS_SQL} SELECT conv_id AS round, 'turn_' || {_TURN.format('turn * 2 + 1')} AS turn_id, 'teacher' AS role, prompt AS content, NULL AS decision_id FROM prompts UNION ALL SELECT conv_id, 'turn_' || {_TURN.format('turn * 2 + 2')}, 'system', 'r' || turn, 'keep_' || turn FROM prompts")
def conversation_turns(spark, sf_dir):
    p = D.prompts(spark, sf_dir)
    d = p.select(F.col("conv_id").alias("round"), F.col("prompt").alias("user_prompt"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("reason"), F.concat(F.lit("keep_"), F.col("turn").cast("string")).alias("decision_id"), F.lit("keep").alias("action"), "turn")
    return decide.turns(d, F.col("turn") * 2).select("round", "turn_id", "role", "content", "decision_id")


@query(
    f"WITH {NODES}, {DECISIONS}, q AS (SELECT conv_id * 100 + turn AS round, CASE WHEN turn % 2 = 0 THEN 'Why was ' || p_name || ' merged?' ELSE 'why' END AS prompt FROM conversations JOIN part ON p_partkey = conv_id % 50 + 1), n AS (SELECT DISTINCT seq, {KEY.format('name')} AS key FROM (SELECT seq, unnest(affected_nodes) AS id FROM decisions) JOIN nodes USING (id)), m AS (SELECT round, max(seq) AS met FROM q JOIN n ON contains({KEY.format('prompt')}, key) GROUP BY 1) SELECT q.round, coalesce(met, (SELECT max(seq) FROM decisions))::INT AS seq FROM q LEFT JOIN m USING (round)"
)
def questioned_decisions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("conv_id") % 50 + 1)
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Why was "), "p_name", F.lit(" merged?"))).otherwise(F.lit("why"))
    d = D.decisions(spark, sf_dir).withColumn("name", F.lit(None).cast("string"))
    return decide.questioned(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("round"), said.alias("prompt")), d, D.nodes(spark, sf_dir), ascii_only=True).select("round", "seq")


@query(
    f"WITH {NODES}, {EDGES}, {DECISIONS}, cur AS (SELECT id AS raw_id, min(id) OVER (PARTITION BY name) AS id FROM nodes), a AS (SELECT sum(greatest(1, length(definition))) AS ic FROM (SELECT arg_max(definition, (length(definition), -ord)) AS definition FROM nodes GROUP BY name)), b AS (SELECT sum(greatest(1, length(definition) + length(name))) AS oc FROM nodes) SELECT (SELECT count(*) FROM nodes) AS nodes_before, (SELECT count(*) FROM edges) AS edges_before, (SELECT count(DISTINCT id) FROM cur) AS nodes_after, (SELECT count(DISTINCT (x.id, y.id, relation_type, description)) FROM edges e JOIN cur x ON x.raw_id = e.source JOIN cur y ON y.raw_id = e.target WHERE x.id <> y.id) AS edges_after, oc::BIGINT AS original_chars, ic::BIGINT AS integrated_chars, round(ic / oc, 4) AS ratio, ic / oc <= 0.3 AS target_met, 'node_content_fallback' AS source, (SELECT count(*) FROM decisions WHERE action = 'merge') AS merge, (SELECT count(*) FROM decisions WHERE action = 'keep') AS keep, (SELECT count(*) FROM decisions WHERE action = 'remove') AS remove, 0::BIGINT AS removed FROM a, b"
)
def graph_summary(spark, sf_dir):
    n, e = D.nodes(spark, sf_dir), D.edges(spark, sf_dir)
    current = D.same_name(n).withColumn("status", F.lit("merged"))
    return integrate.graph_summary(n, e, integrate.merged_nodes(n, current), current, D.actions(spark, sf_dir))


@query(f"WITH {NODES} SELECT min(id) AS id, count(*) AS frequency, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, len(list_distinct(list(chapter))) AS chapters, md5(string_agg(id, ',' ORDER BY id)) AS merged_from FROM nodes GROUP BY name")
def merged_lists(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    current = D.same_name(n).withColumn("status", F.lit("merged"))
    m = integrate.merged_nodes(n, current)
    return m.select("id", "frequency", F.array_join(F.array_sort("categories"), "|").alias("categories"), F.size("chapters").cast("long").alias("chapters"), F.md5(F.array_join("merged_from", ",").cast("binary")).alias("merged_from"))


@query(f"WITH {NODES}, {CHAPTERS} SELECT n.id, c.title AS textbook_title, c.chapter_title, c.page_start FROM (SELECT id, 'src' || (ord % 25) AS book, 'ch_' || (ord % 12) AS chapter_id FROM nodes) n LEFT JOIN chapters c ON c.textbook_id = book AND c.chapter_id = n.chapter_id")
def inherited_metadata(spark, sf_dir):
    n = D.nodes(spark, sf_dir).select("id", F.concat(F.lit("src"), (F.col("ord") % 25).cast("string")).alias("book"), F.concat(F.lit("ch_"), (F.col("ord") % 12).cast("string")).alias("chapter_id"))
    c = D.chapters(spark, sf_dir).withColumnRenamed("textbook_id", "book")
    books = c.groupBy("book").agg(F.max("title").alias("title"), F.lit("f").alias("filename"), F.max("page_end").alias("total_pages"), F.sum("char_count").alias("total_chars"))
    rows = graph.inherited(n, books, c.select("book", "chapter_id", F.col("chapter_title").alias("title"), "chapter_idx", "page_start", "page_end", "char_count"))
    return rows.select("id", F.when(F.col("chapter_title").isNotNull(), F.col("textbook_title")).alias("textbook_title"), "chapter_title", "page_start")


# Names, numbers, labels


@query(
    f"WITH {ADDRESSES_SQL}, b AS (SELECT page_id, address, CASE WHEN trim(address) = '' THEN 'textbook' ELSE string_split(rtrim(address, '/'), '/')[-1] END AS last FROM addresses), s AS (SELECT page_id, trim(regexp_replace(last, '[^A-Za-z0-9_.\\-一-龥]+', '_', 'g'), '_') AS k FROM b) SELECT page_id, CASE WHEN k = '' THEN 'textbook' ELSE k END AS base, regexp_replace(CASE WHEN k = '' THEN 'textbook' ELSE k END, '\\.[^.]+$', '') AS stem FROM s"
)
def file_names(spark, sf_dir):
    a = D.addresses(spark, sf_dir)
    return a.select("page_id", T.safe_basename(F.col("address")).alias("base"), T.output_stem(F.col("address")).alias("stem"))


_GIVEN = "CASE event_id % 6 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || '.75 ' WHEN 1 THEN '-' || CAST(event_id AS VARCHAR) WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN '1234567.5' END"
_NUMBER = "CASE event_id % 6 WHEN 0 THEN event_id + 0.75 WHEN 1 THEN -event_id WHEN 3 THEN 0 WHEN 4 THEN 1234567.5 END"


@query(
    f"SELECT event_id, coalesce({_NUMBER}, -1)::DOUBLE AS number, CASE WHEN {_NUMBER} >= 1 THEN floor({_NUMBER})::BIGINT END AS whole, round(coalesce({_NUMBER}, 0) / 7, 4)::DOUBLE AS score, format('{{:,}}', CAST(round(coalesce({_NUMBER}, 0)) AS BIGINT)) AS shown, least(5.0, greatest(-2.0, coalesce({_NUMBER}, 0)))::DOUBLE AS clamped FROM events"
)
def number_coercions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 6)
    text = F.col("event_id").cast("string")
    said = F.when(F.col("k") == 0, F.concat(F.lit(" "), text, F.lit(".75 "))).when(F.col("k") == 1, F.concat(F.lit("-"), text)).when(F.col("k") == 2, "x").when(F.col("k") == 3, "").when(F.col("k") == 4, "1234567.5")
    n = T.number(said, F.lit(0.0))
    return e.select("event_id", T.number(said, F.lit(-1.0)).alias("number"), T.optional_int(said).alias("whole"), T.rounded_score(n / 7).alias("score"), T.format_number(said).alias("shown"), T.clamp(n, -2.0, 5.0).alias("clamped"))


@query(
    "SELECT p_partkey, CASE WHEN length(d1) >= length(d2) THEN d1 ELSE d2 END AS definition, CASE p_partkey % 3 WHEN 0 THEN '第十二章' WHEN 1 THEN 'Ch.' || p_size ELSE left(replace(p_name, ' ', ''), 4) || '...' END AS badge, left(replace(p_name || p_brand, ' ', ''), 12) || '...' AS label, CASE WHEN p_partkey % 3 = 0 THEN '#2d332f' WHEN p_partkey % 3 = 1 THEN '#6d7654' ELSE '#55706b' END AS colour, CASE WHEN p_size < 1024 THEN p_size || ' B' END AS bytes, format('{:.1f} KB', floor((p_partkey + 1) * 2000 / 1024.0 * 10 + 0.5) / 10) AS kilobytes FROM (SELECT *, p_name AS d1, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type || ' of ' || p_brand || ' and more' END AS d2 FROM part) WHERE (p_partkey + 1) * 2000 < 1048576"
)
def labels_and_colours(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").where("(p_partkey + 1) * 2000 < 1048576")
    other = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat("p_type", F.lit(" of "), "p_brand", F.lit(" and more")))
    title = F.when(k == 0, F.lit("第 十二 章 x")).when(k == 1, F.concat(F.lit("on CHAPTER "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    kind = F.when(k == 0, "章节主题").when(k == 1, "Method").otherwise("x")
    return p.select(
        "p_partkey", T.longer_definition(F.col("p_name"), other).alias("definition"), T.chapter_badge(title).alias("badge"), T.short_label(F.concat("p_name", "p_brand")).alias("label"),
        T.category_colour(kind, F.lit("")).alias("colour"), T.format_bytes(F.col("p_size")).alias("bytes"), T.format_bytes((F.col("p_partkey") + 1) * 2000).alias("kilobytes"),
    )


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'http://h' || c_custkey || '/v1/chat/completions' WHEN 1 THEN 'http://h/v1/chat/completions' WHEN 2 THEN 'http://h/x/v1/chat/completions' ELSE '/v1/chat/completions' END AS url FROM customer")
def endpoint_paths(spark, sf_dir):
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.concat(F.lit(" http://h"), F.col("c_custkey").cast("string"), F.lit("// "))).when(k == 1, "http://h/v1/").when(k == 2, "http://h/x").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", T.endpoint_path(said, "/chat/completions").alias("url"))


@query(
    "SELECT event_id, '🔐 agent 请求授权（' || (user_id % 3 + 1) || '/' || (user_id % 3 + 1) || '）' || chr(10) || '操作：' || event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || '范围：a、b' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN chr(10) || '文件：f' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN chr(10) || '修改内容：' || chr(10) || repeat('+', 1500) || chr(10) || '…(已截断)' ELSE '' END || chr(10) || '回复「允许」继续，「拒绝」中止，「总是允许」本次会话后自动放行' || CASE WHEN user_id % 3 > 0 THEN '（也可「允许 ' || (user_id % 3 + 1) || '」指定）' ELSE '' END AS ask FROM events WHERE event_type = 'error'"
)
def permission_asks(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    nth = (F.col("user_id") % 3).cast("int")
    patterns = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    meta = F.create_map(F.lit("filepath"), F.when(F.col("event_id") % 3 == 0, "f").otherwise(""), F.lit("diff"), F.when(F.col("event_id") % 5 == 0, F.repeat(F.lit("+"), F.lit(1600))).otherwise(F.lit("")))
    return e.select("event_id", T.permission_ask(nth, nth + 1, F.col("event_type"), patterns, meta).alias("ask"))


# The front end's streams, as batches


@query("SELECT event_id AS message_id, row_number() OVER w::INT AS place, lag(event_id) OVER w AS waits_for FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def queue_places(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"), "ts")
    return chat.queue_places(e, "ts", "message_id").select("message_id", "place", "waits_for")


@query("WITH p AS (SELECT page_id % 20 AS upload_id, page_id, strlen(html) AS size, sum(strlen(html)) OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS total FROM pages) SELECT upload_id, sum(size)::BIGINT AS bytes, max(total) > 20000 AS rejected, count(*) FILTER (total <= 20000) AS kept FROM p GROUP BY 1")
def upload_limits(spark, sf_dir):
    parts = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("upload_id"), F.col("page_id").alias("seq"), F.col("html").cast("binary").alias("content"))
    return chat.limited(parts, 20000)


@query(
    "WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, event_id % 9 AS chapter FROM events), r AS (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS rank FROM e WHERE status IS NOT NULL), x AS (SELECT user_id, min(event_id) FILTER (rank = 2) AS last FROM r GROUP BY 1), v AS (SELECT r.* FROM r JOIN x USING (user_id) WHERE last IS NULL OR event_id <= last) SELECT user_id AS job_id, arg_max(status, rank * 1000000000 + event_id) AS status, max(event_id) AS seq, count(DISTINCT chapter) AS chapters_done FROM v GROUP BY 1"
)
def job_states(spark, sf_dir):
    kinds = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}
    said = F.lit(None).cast("string")
    for k, v in kinds.items():
        said = F.when(F.col("event_type") == k, F.lit(v)).otherwise(said)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), said.alias("status"), (F.col("event_id") % 9).alias("chapter_idx"))
    return chat.job_states(e)


@query("SELECT conv_id, count(*) AS frames, sum(turn)::BIGINT AS total FROM conversations WHERE turn % 3 <> 0 GROUP BY 1")
def stream_frames(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    said = F.concat(F.lit('": '), F.when(F.col("turn") % 3 == 0, F.lit("broken{")).otherwise(turn), F.lit('}\r\n\r\n: ping\n\ndata: {"t'))
    parts = c.select("conv_id", F.col("turn").alias("seq"), said.alias("value")).unionByName(c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast(dict(c.dtypes)["turn"]).alias("seq"), F.lit('data: {"t').alias("value")))
    f = chat.sse_stream(parts, ["conv_id"], "seq")
    return f.groupBy("conv_id").agg(F.count("*").alias("frames"), F.sum(F.try_variant_get("body", "$.t", "long")).alias("total"))


@query(f"WITH {NODES} SELECT category, string_agg(id, ',' ORDER BY k) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page, name, ord) AS k FROM nodes) WHERE k <= 3 GROUP BY 1")
def numbered_first(spark, sf_dir):
    n = D.nodes(spark, sf_dir).withColumn("node", F.col("id"))
    first = library.numbered(n, "category", "page", "name", "ord", prefix="k_").where(F.col("id").isin("k_001", "k_002", "k_003"))
    return first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "node"))), lambda x: x["node"]), ",").alias("ids"))


@query(f"WITH {NODES}, {EDGES} SELECT count(*) AS facts, count(DISTINCT source) AS sources FROM edges WHERE {FACT} AND source IN (SELECT id FROM nodes WHERE node_kind <> 'chapter')")
def factual_knowledge(spark, sf_dir):
    known = graph.knowledge(D.nodes(spark, sf_dir)).select(F.col("id").alias("source"))
    return integrate.factual(D.edges(spark, sf_dir)).join(known, "source", "left_semi").agg(F.count("*").alias("facts"), F.count_distinct("source").alias("sources"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no id' WHEN doc_id % 5 = 1 THEN 'no content' ELSE 'no length' END AS problem FROM documents WHERE doc_id % 5 < 3")
def invalid_chapters(spark, sf_dir):
    k = F.col("doc_id") % 5
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.when(k == 0, "").otherwise("c").alias("chapter_id"), F.when(k == 1, " \n ").otherwise(F.concat(F.lit("x"), "text")).alias("content"), F.when(k == 2, 0).otherwise(1).alias("char_count"))
    return library.invalid_chapters(c).select("doc_id", "problem")




# Segmentation

#: Lines as pages have them, put in place of some lines of documents.
FURNITURE = ("12", "— 7 —", "图1 细胞", "目录......3", "本章小结", "第一章 绪论", "前言", "生理学", "a|b", "2024", "Table 2. x", "扫码看")
_FURNITURE = "CASE WHEN pos % 3 = 0 THEN [" + ", ".join(f"'{x}'" for x in FURNITURE) + f"][CAST((doc_id + pos) % {len(FURNITURE)} AS INT) + 1] ELSE line END"
_IS_HEADING = f"(length(t) BETWEEN 2 AND 90 AND NOT (regexp_matches(t, '(?i)目录|contents|全文') AND length(t) <= 12) AND NOT regexp_matches(t, '[.·•]{{5,}}') AND regexp_matches(t, '{_HEADING}'))"


@query(
    f"WITH {LINES}, l AS (SELECT doc_id, pos, {_FURNITURE} AS line FROM lines), c AS (SELECT doc_id, pos, {TITLE.format('line')} AS t FROM l) SELECT doc_id, pos, {_IS_HEADING} AS heading, length(t) BETWEEN 2 AND 60 AND NOT {_IS_HEADING} AND NOT regexp_matches(t, '(?i)目录|contents|前言|序言|版权页|编委|封面页|书名页|主审简介|主编简介|副主编简介') AND NOT regexp_matches(t, '^[0-9]+$') AND NOT contains(t, '|') AND NOT regexp_matches(t, '[.·•]{{5,}}') AND regexp_matches(t, '[一-龥A-Za-z]') AS title, t = '' OR (regexp_matches(t, '^[0-9]{{1,4}}$') AND TRY_CAST(t AS INT) = pos) OR regexp_matches(t, '^[-–—]?\\s*[0-9]{{1,4}}\\s*[-–—]?$') OR regexp_matches(t, '[.·•]{{5,}}\\s*[0-9]{{1,4}}$') OR regexp_matches(t, '(?i)^(?:图|表|Fig\\.?|Figure|Table)\\s*[0-9一二三四五六七八九十]+[.\\-—、\\s]') OR (regexp_matches(t, '扫码|二维码|资源码|复习思考题|本章小结') AND length(t) <= 40) AS noise FROM c"
)
def line_kinds(spark, sf_dir):
    put = F.element_at(F.array(*(F.lit(x) for x in FURNITURE)), ((F.col("doc_id") + F.col("pos")) % len(FURNITURE) + 1).cast("int"))
    line = F.when(F.col("pos") % 3 == 0, put).otherwise(F.col("line"))
    rows = D.lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), line.alias("line"))
    return rows.select("doc_id", "pos", T.is_chapter_title(F.col("line")).alias("heading"), T.is_document_title(F.col("line")).alias("title"), T.is_noise_line(F.col("line"), F.col("pos")).alias("noise"))


_MARKED_TEXT = "'intro ' || lang || chr(10) || '# Book ' || source || chr(10) || text || chr(10) || '## Part 12' || chr(10) || '### Deep part' || chr(10) || '### 第三章 血液' || chr(10) || 'last' || chr(10) || '#nothing'"


@query(
    f"WITH w AS (SELECT doc_id, string_split({WHITE.format(_MARKED_TEXT)}, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM w), m AS (SELECT *, length(regexp_extract(line, '^(#{{1,3}})\\s+\\S', 1)) AS level, {TITLE.format("regexp_extract(line, '^#{1,3}\\s+(.+?)\\s*$', 1)")} AS t FROM l), h AS (SELECT *, CASE WHEN level > 0 AND (level <= 2 OR {_IS_HEADING}) THEN t END AS heading FROM m), g AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM h), s AS (SELECT doc_id, seg, max(heading) AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (heading IS NULL) AS body FROM g GROUP BY 1, 2), c AS (SELECT doc_id, seg, coalesce(title, '全文') AS title, {WHITE.format("coalesce(body, '')")} AS content FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS n FROM c WHERE content <> '') SELECT doc_id, 'ch_' || lpad(CAST(n AS VARCHAR), 2, '0') AS chapter_id, CASE WHEN title = '全文' THEN '前置内容' ELSE title END AS title, length(content) AS char_count FROM k"
)
def markdown_chapters(spark, sf_dir):
    d = D.dealt(spark, sf_dir, "documents")
    text = F.concat(F.lit("intro "), "lang", F.lit("\n# Book "), "source", F.lit("\n"), "text", F.lit("\n## Part 12\n### Deep part\n### 第三章 血液\nlast\n#nothing"))
    return segment.finalise(segment.split_markdown(d.select("doc_id", text.alias("text")), "doc_id"), "doc_id").select("doc_id", "chapter_id", "title", F.col("char_count").cast("long").alias("char_count"))


@query(
    f"WITH {HEADED_SQL}, d AS (SELECT doc_id, doc_id % 4 AS k, source FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'Found ' || source WHEN 1 THEN 'given' WHEN 2 THEN source || ' cells' ELSE '未命名教材' END AS title FROM d"
)
def inferred_titles(spark, sf_dir):
    k = F.col("doc_id") % 4
    name = F.when(k == 2, F.concat(F.lit("a/12. - "), "source", F.lit(" cells_.pdf"))).when(k == 3, "").otherwise("x.txt")
    given, found = F.when(k == 1, " given ").when(k == 0, "given"), F.when(k == 0, F.concat(F.lit("# Found  "), "source", F.lit(".....9"))).otherwise(" ")
    return table(spark, sf_dir, "documents").select("doc_id", T.infer_title(name, given, found).alias("title"))


@query(f"WITH {LINES}, l AS (SELECT source, doc_id, pos, line, CASE WHEN length(line) = 0 THEN 0 ELSE 1 END AS some FROM lines) SELECT source AS doc, doc_id AS page, count(*) AS lines, md5(string_agg(replace(line, ' ', ''), '|' ORDER BY pos)) AS digest, count(*) FILTER (pos % 5 = 0) AS bold FROM l WHERE replace(line, ' ', '') <> '' GROUP BY 1, 2")
def grouped_items(spark, sf_dir):
    half = F.floor(F.length("line") / 2).cast("int")
    rows = D.lines(spark, sf_dir).where(F.replace("line", F.lit(" "), F.lit("")) != "")
    part = lambda n, said, x, gap: F.struct((F.col("pos") * 2 + n).cast("int").alias("ord"), said.alias("str"), x.cast("double").alias("x"), (F.col("pos") * -20.0 + n * gap).alias("y"), (F.length(said) * 5.0).alias("width"))
    both = F.array(part(1, F.expr("substring(line, cast(floor(length(line) / 2) as int) + 1)"), half * 5 + 12, 1.0), part(0, F.left("line", half), F.lit(10), 0.0))
    items = rows.select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), "pos", F.explode(both).alias("i"))
    font = F.when(F.col("pos") % 5 == 0, "Some-Bold").otherwise("Plain")
    lines = segment.group_items(items.select("doc", "page", "i.*", font.alias("font_name"), F.lit(10.0).alias("font_size")))
    said = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), F.replace("text", F.lit(" "), F.lit("")).alias("said"))))
    return lines.groupBy("doc", "page").agg(F.count("*").alias("lines"), F.md5(F.array_join(F.transform(said, lambda r: r["said"]), "|").cast("binary")).alias("digest"), F.count_if("bold").alias("bold"))


# Graph building from extractions


@query(
    "WITH d AS (SELECT source, lang, doc_id FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT source AS book, lower(source || ' x') AS key, min(doc_id) AS first FROM d GROUP BY source UNION ALL SELECT source, lower(lang), min(doc_id) FROM d GROUP BY source, lang), r AS (SELECT source, lang, min(doc_id) AS doc_id FROM d GROUP BY 1, 2) SELECT source AS book, source || ' x' AS source_name, lang AS target_name, 'contains' AS relation_type, source || ' x 与 ' || lang || ' 存在 contains 关系。' AS description, false AS fact FROM r"
)
def built_relationships(spark, sf_dir):
    mentions, sides = library.extracted(_payloads(spark, sf_dir))
    nodes = graph.upsert_nodes(mentions)
    named = sides.withColumn("source", F.concat("source", F.lit("  x"))).withColumn("description", F.lit(None).cast("string"))
    made = graph.add_relationships(named, nodes)
    return made.select("book", "source_name", "target_name", "relation_type", "description", F.col("fact_eligible").alias("fact"))


@query("WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 2 = 0 THEN '第一章' ELSE lang END AS title FROM documents) SELECT source AS book, title AS name, '章节主题' AS category, count(DISTINCT doc_id) AS frequency FROM d GROUP BY 1, 2")
def topic_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chapters = d.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter_idx"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chapter_id"), F.when(F.col("doc_id") % 2 == 0, "第一章").otherwise(F.col("lang")).alias("title"), F.lit(1).alias("page_start"), F.col("text").alias("content"))
    mentions = graph.topic_mentions(chapters).withColumn("ord", F.col("chapter_idx"))
    return graph.upsert_nodes(mentions).select("book", "name", "category", "frequency")


# Hooks with plain functions in place of models


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text)::DOUBLE AS size, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM documents")
def embedded_texts(spark, sf_dir):
    v = adapters.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), lambda texts: [{"index": k, "embedding": [float(len(t)), float(t.count("e"))]} for k, t in reversed(list(enumerate(texts)))])
    return v.select("id", F.col("vector")[0].alias("size"), F.col("vector")[1].alias("e"))


@query("SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS query_id, reverse(left(text, 20)) || ' [' || role || ']' AS answer FROM conversations")
def answered_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("query_id"), F.left("text", F.lit(20)).alias("query"), F.array("role").alias("chunks"))
    return adapters.answer(q, lambda query, chunks: f"{query[::-1]} [{chunks[0]}]")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'keep' ELSE 'remove' END AS action FROM part")
def asked_judge(spark, sf_dir):
    rounds = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    replied = decide.ask(rounds, lambda r: {"action": ("merge", "keep", "remove")[r["p_partkey"] % 3]})
    return replied.select("p_partkey", F.get_json_object("reply", "$.action").alias("action"))


# Small rules


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'third' END AS name, CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE c_custkey::INT END AS n FROM customer")
def first_filled_values(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.when(k % 2 == 0, F.concat(F.lit(" "), "c_name")).when(k % 7 == 0, F.lit("  "))
    given = F.when(k % 10 == 0, "x").when(k % 5 == 0, "-3").otherwise(k.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.first_filled(first, F.when(k % 3 == 0, "second").otherwise(""), F.lit("third")).alias("name"), T.positive_int(given, F.lit(7)).alias("n"))


@query("SELECT doc_id, ['#d85d34', '#667761', '#476b8f', '#c8923d', '#7a5a8a', '#3f7f78', '#a8504c'][CAST((list_sum(list_transform(string_split(source, ''), lambda c: ascii(c))) + doc_id) % 7 AS INT) + 1] AS colour, regexp_replace(trim(regexp_replace(source || ' / ' || lang || '__x', '[^\\p{L}\\p{N}_-]+', '_', 'g'), '_'), '_+', '_', 'g') AS stem FROM documents")
def source_colours(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.source_colour(F.col("source"), F.col("doc_id")).alias("colour"), T.file_stem(F.concat("source", F.lit(" / "), "lang", F.lit("__x")), ascii_only=True).alias("stem"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0")
def changed_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    before = c.where("c_custkey % 6 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.lit("old")).otherwise(F.col("c_name")))
    return chat.changed(c, before, "c_custkey")


@query("SELECT user_id AS chat_id, event_id AS id, 'once' AS reply FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error') WHERE CASE WHEN user_id % 2 = 0 THEN k = n ELSE k = 2 END")
def resolved_replies(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("id"), F.col("ts").alias("asked_at"))
    replies = asked.groupBy("chat_id").agg((F.max("asked_at") + F.expr("interval 1 day")).alias("at")).select("chat_id", "at", F.lit("once").alias("reply"), F.when(F.col("chat_id") % 2 == 1, 1).alias("index"))
    return chat.resolve_replies(asked, replies).select("chat_id", "id", "reply")
