"""Replies of a judge turned into decisions of the log, as columns over a table of rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.adapters import first_json_object
from quire.operators.integrate import ACTIONS, AUTO_ADD

#: The code of a refusal, and what is said of a reply that cannot be read.
REFUSAL = "NEED_NECESSITY_JUDGEMENT"
NO_JUDGEMENT = "necessity.necessary and necessity.reason are required before merge/keep/remove."
NOT_BOOLEAN = "necessity.necessary must be a boolean."
NO_REASON = "necessity.reason is required."
UNREAD = "模型输出格式不可解析，已保留当前节点。"
UNREAD_NEED = "模型没有返回可解析 JSON，本轮先保留节点并停止，避免误合并。"
#: What a decision says where the reply gives no reason; a name's own definition; the plain category.
MERGED_REASON = "%s 的名称或定义高度相似，按教师提示“%s”合并为一个知识点。"
REMOVED_REASON = "%s 被判定为冗余节点，按教师提示“%s”从当前整合图中移除。"
KEPT_REASON = "%s 按教师提示“%s”保留为独立知识点。"
OWN_DEFINITION = "%s 是跨教材整合后的知识点。"
PLAIN_CATEGORY = "核心概念"
SURE = {"merge": 0.82, "keep": 0.76, "remove": 0.76}
MOST_CHECKED = 8
#: Signs of a question that are looked through at a time.
PIECE = 256


def _at(v: Column, *paths: str) -> Column:
    """The first of some fields that is there and not null, as a variant."""
    found = (F.try_variant_get(v, f"$.{p}", "variant") for p in paths)
    return F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in found))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _said(v: Column) -> Column:
    """A field as compact text; empty where it is missing."""
    return T.compact_text(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def _boolean(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def necessity(reply: Column, action: Column) -> Column:
    """struct(necessary, intended_action, reason, error): whether a step is needed; ``error`` where the reply doesn't say."""
    given = _at(reply, "necessity", "necessity_judgement", "need_to_integrate", "need_to_merge")
    whole = _kind(given).startswith("OBJECT")
    inside = lambda *names: _at(F.when(whole, given), *names)
    needed = F.coalesce(_boolean(given), *(_boolean(inside(n)) for n in ("necessary", "required", "need")))
    reason = _said(inside("reason", "explanation", "rationale"))
    meant = F.lower(_said(inside("intended_action", "action")))
    meant = F.when(meant.isin(*ACTIONS), meant).otherwise(action)
    error = F.when(given.isNull(), NO_JUDGEMENT).when(needed.isNull(), NOT_BOOLEAN).when(reason == "", NO_REASON)
    kept = action == "keep"
    return F.struct((needed & ~kept).alias("necessary"), F.when(kept, F.lit("keep")).otherwise(meant).alias("intended_action"), reason.alias("reason"), error.alias("error"))


def read_replies(rounds: DataFrame) -> DataFrame:
    """``reply`` (text of a model) as a variant ``v``; one that holds no JSON object keeps the target and says so."""

    def found(s: pd.Series) -> pd.Series:
        import json

        return s.map(lambda t: None if (x := first_json_object(t or "")) is None else json.dumps(x, ensure_ascii=False))

    plain = F.when(F.try_parse_json("reply").isNotNull(), F.col("reply"))
    read = F.coalesce(plain, F.pandas_udf(found, "string")("reply"))
    unread = F.to_json(F.struct(F.lit("keep").alias("action"), F.struct(F.lit(False).alias("necessary"), F.lit(UNREAD_NEED).alias("reason")).alias("necessity"), F.array("target").alias("affected_nodes"), F.lit(UNREAD).alias("reason")))
    v = F.try_parse_json(read)
    return rounds.withColumn("v", F.coalesce(F.when(_kind(v).startswith("OBJECT"), v), F.parse_json(unread)))


def _valid(rounds: DataFrame, candidates: DataFrame, nodes: DataFrame, ascii_only: bool) -> DataFrame:
    """Each round's target (place 0) and candidates, in order, as one array of nodes with their name keys."""
    listed = rounds.select("round", F.col("target").alias("id"), F.lit(0).alias("place"), F.lit(None).cast("double").alias("score")).unionByName(
        candidates.select("round", "id", F.col("rank").cast("int").alias("place"), F.col("score").cast("double").alias("score"))
    )
    known = nodes.select("id", "name", "definition", "category").withColumn("key", T.match_key(F.col("name"), ascii_only))
    one = F.struct("place", "id", "name", "definition", "category", "key", "score")
    return listed.join(known, "id").groupBy("round").agg(F.array_sort(F.collect_list(one)).alias("valid"))


def _named(rounds: DataFrame, ascii_only: bool) -> DataFrame:
    """The values that a reply names as affected, in order, with their name keys."""
    listed = F.try_variant_get(_at(F.col("v"), "affected_nodes", "nodes", "affected_node_ids"), "$", "array<variant>")
    values = rounds.select("round", F.posexplode(listed).alias("pos", "x")).withColumn("said", _said(F.col("x"))).where("said != ''")
    values = values.withColumn("key", T.match_key(F.col("said"), ascii_only))
    return values.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("pos", "said", "key"))).alias("named"))


def decisions(rounds: DataFrame, candidates: DataFrame, nodes: DataFrame, ascii_only: bool = False) -> DataFrame:
    """A decision of the log for each round (round, prompt, target, reply, before), or its refusal in ``error``.

    ``reply`` is JSON text, ``before`` the number of earlier decisions; ``candidates`` are (round, id, rank, score) and
    ``nodes`` all raw nodes. Merges and removes that are not needed become keeps. Named nodes are found by id, else by
    name; a keep adds the nodes that the prompt names, and where none is left the target counts. A merge of one node
    takes the best candidate from AUTO_ADD on, else becomes a keep.
    """
    base = read_replies(rounds).withColumn("prompt_key", T.match_key(F.col("prompt"), ascii_only))
    none = F.array().cast("array<struct<pos:int,said:string,key:string>>")
    r = base.join(_valid(rounds, candidates, nodes, ascii_only), "round").join(_named(base, ascii_only), "round", "left").withColumn("named", F.coalesce("named", none))
    v, valid = F.col("v"), F.col("valid")
    asked = F.lower(_said(_at(v, "action")))
    prompted = T.prompt_action(F.col("prompt"))
    r = r.withColumn("asked", F.when(asked.isin(*ACTIONS), asked).when(prompted.isin(*ACTIONS), prompted).otherwise("keep"))
    r = r.withColumn("need", necessity(v, F.col("asked")))
    r = r.withColumn("gated", F.when(F.col("need.necessary"), F.col("asked")).otherwise("keep"))

    ids = F.transform(valid, lambda n: n["id"])
    by_name = lambda key: F.element_at(F.transform(F.filter(valid, lambda n: (n["key"] == key) & (key != "")), lambda n: n["id"]), 1)
    resolved = F.transform("named", lambda x: F.when(F.array_contains(ids, x["said"]), x["said"]).otherwise(F.when(F.exists(valid, lambda n: (n["key"] == x["key"]) & (x["key"] != "")), by_name(x["key"]))))
    mentioned = F.transform(F.filter(valid, lambda n: (n["key"] != "") & F.contains(F.col("prompt_key"), n["key"])), lambda n: n["id"])
    found = F.array_distinct(F.concat(F.array_compact(resolved), F.when(F.col("gated") == "keep", mentioned).otherwise(F.array().cast("array<string>"))))
    r = r.withColumn("found", F.when(F.size(found) > 0, found).otherwise(F.array("target")))
    best = F.element_at(F.filter(valid, lambda n: n["place"] == 1), 1)
    adds = (F.col("gated") == "merge") & (F.size("found") < 2) & F.coalesce(F.size(F.filter(valid, lambda n: (n["place"] == 1) & (n["score"] >= AUTO_ADD))) > 0, F.lit(False))
    r = r.withColumn("found", F.when(adds, F.array_distinct(F.concat("found", F.array(best["id"])))).otherwise(F.col("found")))
    r = r.withColumn("action", F.when((F.col("gated") == "merge") & (F.size("found") < 2), "keep").otherwise(F.col("gated")))
    r = r.withColumn("affected_nodes", F.array_sort("found"))

    detail = F.coalesce(*(F.when(_kind(x).startswith("OBJECT"), x) for x in (_at(v, "result_node_detail"), _at(v, "result_node"))))
    given = lambda name: _filled(_said(_at(detail, name)))
    members = F.filter(valid, lambda n: F.array_contains(F.col("affected_nodes"), n["id"]))
    by_id = F.array_sort(F.transform(members, lambda n: F.struct(n["id"].alias("id"), n["name"].alias("name"), n["definition"].alias("definition"), n["category"].alias("category"))))
    by_id = F.array_distinct(by_id)
    by_length = F.transform(F.array_sort(F.transform(by_id, lambda n: F.struct(F.length(n["name"]).alias("n"), n.alias("node")))), lambda x: x["node"])
    r = r.withColumn("given_name", given("name")).withColumn("sources", F.when(given("name").isNull(), by_length).otherwise(by_id))
    first = F.element_at("sources", 1)
    some = F.size("sources") > 0
    r = r.withColumn("name", F.coalesce("given_name", F.when(some, first["name"]), F.element_at(valid, 1)["name"]))
    described = F.filter(F.transform("sources", lambda n, i: F.struct(F.length(n["definition"]).alias("n"), (-i).alias("i"), n["definition"].alias("definition"))), lambda d: d["n"] > 0)
    longest = F.when(F.size(described) > 0, F.array_max(described)["definition"])
    own_id = _at(v, "result_node")
    own_id = F.when(~_kind(own_id).startswith("OBJECT"), _filled(_said(own_id)))
    made = F.concat(F.lit("merged_"), T.safe_id(F.col("name"), "node", ascii_only=ascii_only), F.lit("_"), T.short_hash(F.array_join("affected_nodes", "|"), 8))
    result = F.when(F.col("action") == "merge", F.coalesce(own_id, made)).otherwise(F.element_at("affected_nodes", 1))
    names = F.array_join(F.transform("sources", lambda n: F.concat(F.lit("“"), n["name"], F.lit("”"))), "、")
    prompt = T.compact_text(F.col("prompt"))
    default = F.when(F.col("action") == "merge", F.format_string(MERGED_REASON, names, prompt)).when(F.col("action") == "remove", F.format_string(REMOVED_REASON, names, prompt)).otherwise(F.format_string(KEPT_REASON, names, prompt))
    usual = F.when(F.col("action") == "merge", SURE["merge"]).otherwise(SURE["keep"])
    sure = F.try_variant_get(v, "$.confidence", "variant")
    number = F.when(F.is_variant_null(sure), 0.0).when(_kind(sure) == "BOOLEAN", F.try_variant_get(sure, "$", "boolean").cast("double")).otherwise(F.try_variant_get(sure, "$", "string").try_cast("double"))
    kept = F.col("action") != "remove"
    n = F.col("before") + 1
    number_text = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    need = F.struct("need.necessary", "need.intended_action", "need.reason", F.lit(True).alias("explicitly_provided"), F.slice(ids, 1, MOST_CHECKED).alias("checked_nodes"), F.col("gated").alias("final_action"))
    return r.select(
        "round",
        F.col("need.error").alias("error"),
        F.concat("action", F.lit("_"), number_text).alias("decision_id"),
        "action",
        need.alias("necessity"),
        "affected_nodes",
        F.when(kept, result).alias("result_node"),
        F.when(kept, F.struct(result.alias("id"), "name", F.coalesce(given("definition"), longest, F.format_string(OWN_DEFINITION, F.col("name"))).alias("definition"), F.coalesce(given("category"), F.when(some, _filled(first["category"])), F.lit(PLAIN_CATEGORY)).alias("category"))).alias("result_node_detail"),
        F.coalesce(_filled(_said(_at(v, "reason", "explanation"))), default).alias("reason"),
        T.clamp(F.coalesce(F.when(F.isnan(number), None).otherwise(number), usual), 0.0, 1.0).alias("confidence"),
        F.col("target").alias("target_node"),
        F.col("prompt").alias("user_prompt"),
    )


def require_judged(decided: DataFrame) -> DataFrame:
    """The same decisions; one without a judgement fails the query with the refusal's code."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit(f"{REFUSAL}: "), "error"))).otherwise(F.col("action"))
    return decided.withColumn("action", checked).drop("error")


def ask(rounds: DataFrame, judge: Callable[[dict], str | dict]) -> DataFrame:
    """Rounds with the ``reply`` of a judge, one call a round; rounds may hold any columns that the judge is to see."""
    schema = rounds.drop("reply").withColumn("reply", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            said = [judge(row) for row in pdf.to_dict("records")]
            yield pdf.assign(reply=[s if isinstance(s, str) else json.dumps(s, ensure_ascii=False) for s in said])

    return rounds.drop("reply").mapInPandas(run, schema)


def questions(rounds: DataFrame, candidates: DataFrame, nodes: DataFrame, recent: DataFrame) -> DataFrame:
    """What a judge is asked in each round: a system text and a JSON body with the target, its candidates and the last decisions."""
    shown = F.struct("id", "name", F.left(T.compact_text(F.col("definition")), F.lit(260)).alias("definition"), "category")
    known = nodes.select("id", shown.alias("node"))
    target = rounds.join(known.withColumnRenamed("id", "target"), "target").select("round", "prompt", F.col("node").alias("target_node"))
    listed = candidates.join(known, "id").groupBy("round").agg(F.array_sort(F.collect_list(F.struct("rank", "node", F.round("score", 3).alias("heuristic_score")))).alias("candidate_nodes"))
    last = recent.agg(F.array_sort(F.collect_list(F.struct("seq", "decision_id", "action", "affected_nodes"))).alias("recent_decisions"))
    last = last.withColumn("recent_decisions", F.slice("recent_decisions", F.greatest(F.lit(1), F.size("recent_decisions") - 4), F.lit(5)))
    asked = target.join(listed, "round", "left").join(F.broadcast(last), F.lit(True))
    body = F.to_json(F.struct(F.col("prompt").alias("user_prompt"), T.prompt_action(F.col("prompt")).alias("inferred_prompt_action"), "target_node", "candidate_nodes", "recent_decisions"))
    rule = F.lit("Decide on one step for target_node: merge, keep or remove. Say first whether it is needed (necessity.necessary, necessity.reason). Answer with one JSON object.")
    return asked.select("round", rule.alias("system"), body.alias("user"))


def turns(decided: DataFrame, before: Column) -> DataFrame:
    """Two turns of the conversation for each decision (with round): what the teacher said and what was decided."""
    both = decided.select("*", before.alias("start")).withColumn("n", F.explode(F.array(F.col("start") + 1, F.col("start") + 2)))
    teacher = F.col("n") == F.col("start") + 1
    number = F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))
    return both.select(
        "round",
        F.concat(F.lit("turn_"), number).alias("turn_id"),
        F.when(teacher, "teacher").otherwise("system").alias("role"),
        F.when(teacher, F.col("user_prompt")).otherwise(F.col("reason")).alias("content"),
        F.when(~teacher, F.col("decision_id")).alias("decision_id"),
        F.when(~teacher, F.col("action")).alias("action"),
    )


#: Fixed value: what is said where nothing was decided yet.
NOTHING_DECIDED = "当前还没有可解释的整合决策。"


def explanation(decision_id: Column, action: Column, name: Column, reason: Column) -> Column:
    """What is said of a decision that a teacher asks about."""
    result = F.when(F.coalesce(name, F.lit("")) != "", F.format_string("，结果节点为“%s”", name)).otherwise(F.lit(""))
    said = F.concat(F.format_string("决策 %s 的动作为 %s", decision_id, action), result, F.lit("。理由："), reason)
    return F.when(decision_id.isNull(), NOTHING_DECIDED).otherwise(said)


def questioned(asked: DataFrame, decisions: DataFrame, nodes: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The decision that each question (round, prompt) is about: the last one with a node or result named in it, else the last.

    Names are compared by their keys; ``name`` is the decision's result. Each key counts once, with its last decision, and
    meets the equal parts of each distinct question, so that no question is compared with every decision. A turn that
    explains adds no decision; its two turns follow from ``explanation``.
    """
    keyed = nodes.select("id", T.match_key(F.col("name"), ascii_only).alias("key"))
    own = decisions.select("seq", F.explode("affected_nodes").alias("id")).join(keyed, "id").select("seq", "key")
    named = own.unionByName(decisions.select("seq", T.match_key(F.col("name"), ascii_only).alias("key"))).where("key != ''")
    keys = named.groupBy("key").agg(F.max("seq").alias("seq"))
    rounds = asked.withColumn("_said", T.match_key(F.col("prompt"), ascii_only))
    sizes = keys.agg(F.collect_set(F.length("key")).alias("sizes"))
    parts = rounds.select("_said").distinct().join(F.broadcast(sizes), F.lit(True)).select("_said", F.explode("sizes").alias("size")).where(F.length("_said") >= F.col("size"))
    # pieces first, as finding a place in a text takes as long as the place is far
    piece = F.transform(F.sequence(F.lit(0), F.floor((F.length("_said") - F.col("size")) / PIECE).cast("int")), lambda k: F.substring("_said", k * PIECE + 1, F.col("size") + PIECE - 1))
    parts = parts.select("_said", "size", F.explode(piece).alias("piece"))
    cut = F.transform(F.sequence(F.lit(1), F.length("piece") - F.col("size") + 1), lambda i: F.substring("piece", i, F.col("size")))
    parts = parts.select("_said", F.explode(F.array_distinct(cut)).alias("key"))
    met = parts.join(keys, "key").groupBy("_said").agg(F.max("seq").alias("met"))
    last = decisions.agg(F.max("seq").alias("last"))
    chosen = rounds.join(met, "_said", "left").join(F.broadcast(last), F.lit(True)).withColumn("seq", F.coalesce("met", "last")).drop("met", "last", "_said")
    return chosen.join(decisions, "seq", "left")


def changes_graph(action: Column) -> Column:
    """Whether a decision changes the graph: merges and removes do."""
    return F.coalesce(action.isin("merge", "remove"), F.lit(False))
