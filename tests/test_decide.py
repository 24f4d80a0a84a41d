import json

import pytest

from quire.operators import decide as D

NODES = [("a", "Ａ-Cell", "short", "概念"), ("b", "细胞", "a longer definition", ""), ("c", "细胞 膜", "", "结构"), ("z", "elsewhere", "x", "y")]
WHY = {"necessary": True, "reason": " same  thing "}


def run(spark, replies, prompts=None, scores=(0.8, 0.5), before=0):
    prompts = prompts or ["合并重复节点"] * len(replies)
    rounds = spark.createDataFrame([(k, p, "a", r if isinstance(r, str) else json.dumps(r, ensure_ascii=False), before) for k, (r, p) in enumerate(zip(replies, prompts, strict=True))], "round int, prompt string, target string, reply string, before int")
    candidates = spark.createDataFrame([(k, i, n + 1, s) for k in range(len(replies)) for n, (i, s) in enumerate(zip(("b", "c"), scores, strict=True))], "round int, id string, rank int, score double")
    nodes = spark.createDataFrame(NODES, "id string, name string, definition string, category string")
    return D.decisions(rounds, candidates, nodes).orderBy("round").collect()


def test_merges(spark):
    got = run(spark, [
        {"action": " MERGE ", "necessity": WHY},
        {"action": "merge", "necessity": WHY, "affected_nodes": ["a", "细胞膜", "nobody"]},
        {"action": "merge", "necessity": WHY, "nodes": ["a-cell！", "b"], "result_node": " m1 ", "confidence": 7},
        {"action": "merge", "necessity": WHY, "affected_nodes": ["a", "b"], "result_node": {"name": " New  name ", "category": "k"}, "reason": " so  it is "},
    ])
    first, second, third, fourth = got
    assert (first["action"], first["affected_nodes"], first["decision_id"], first["confidence"], first["error"]) == ("merge", ["a", "b"], "merge_001", 0.82, None)
    assert first["result_node_detail"]["name"] == "细胞" and first["result_node_detail"]["definition"] == "a longer definition"
    import hashlib

    assert first["result_node"] == "merged_细胞_" + hashlib.sha1(b"a|b").hexdigest()[:8] == first["result_node_detail"]["id"]
    assert first["reason"] == "“细胞”、“Ａ-Cell” 的名称或定义高度相似，按教师提示“合并重复节点”合并为一个知识点。"
    assert second["affected_nodes"] == ["a", "c"] and second["result_node"].startswith("merged_细胞_膜_") and second["result_node_detail"]["category"] == "结构"
    assert (third["affected_nodes"], third["result_node"], third["confidence"]) == (["a", "b"], "m1", 1.0)
    assert (fourth["result_node_detail"]["name"], fourth["result_node_detail"]["category"], fourth["reason"]) == ("New name", "k", "so it is")
    assert fourth["result_node_detail"]["definition"] == "a longer definition"


def test_gates(spark):
    weak = run(spark, [{"action": "merge", "necessity": WHY}], scores=(0.5, 0.4), before=1041)[0]
    assert (weak["action"], weak["necessity"]["final_action"], weak["affected_nodes"], weak["decision_id"]) == ("keep", "merge", ["a"], "keep_1042")
    assert weak["necessity"]["checked_nodes"] == ["a", "b", "c"] and weak["necessity"]["reason"] == "same thing"
    got = run(spark, [
        {"action": "remove", "necessity": {"necessary": False, "reason": "r", "intended_action": "Remove"}, "confidence": None},
        {"action": "remove", "need_to_merge": {"required": True, "rationale": "r"}, "affected_nodes": "b", "confidence": "0.5"},
        {"necessity": {"need": True, "explanation": "x"}},
        {"action": "keep", "necessity": {"necessary": True, "reason": "r"}, "affected_nodes": ["c"]},
    ], ["合并重复节点", "合并", "删除冗余", "请保留 细胞，不要合并"])
    unneeded, removed, prompted, kept = got
    assert (unneeded["action"], unneeded["confidence"], unneeded["necessity"]["intended_action"]) == ("keep", 0.0, "remove")
    assert (removed["action"], removed["affected_nodes"], removed["result_node"], removed["result_node_detail"], removed["confidence"]) == ("remove", ["a"], None, None, 0.5)
    assert "从当前整合图中移除" in removed["reason"]
    assert prompted["action"] == "remove" and prompted["necessity"]["explicitly_provided"]
    assert (kept["action"], kept["affected_nodes"], kept["necessity"]["necessary"]) == ("keep", ["b", "c"], False)
    assert kept["reason"].endswith("按教师提示“请保留 细胞，不要合并”保留为独立知识点。")


def test_refusals(spark):
    got = run(spark, [{}, {"necessity": True}, {"necessity": {"necessary": True}}, {"necessity": {"reason": "r"}}, {"necessity": {"necessary": "yes", "reason": "r"}}])
    assert [r["error"] for r in got] == [D.NO_JUDGEMENT, D.NO_REASON, D.NO_REASON, D.NOT_BOOLEAN, D.NOT_BOOLEAN]
    rounds = spark.createDataFrame([(0, "p", "a", "{}", 0)], "round int, prompt string, target string, reply string, before int")
    nodes = spark.createDataFrame(NODES, "id string, name string, definition string, category string")
    with pytest.raises(Exception, match=D.REFUSAL):
        D.require_judged(D.decisions(rounds, spark.createDataFrame([], "round int, id string, rank int, score double"), nodes)).collect()


def test_replies_that_are_no_json(spark):
    fenced = "Well:\n```json\n" + json.dumps({"action": "merge", "necessity": WHY}) + "\n```"
    got = run(spark, ["no idea", fenced, "[1]", 'so {"action": "keep", "necessity": {"necessary": false, "reason": "q"}} it is'])
    assert [r["action"] for r in got] == ["keep", "merge", "keep", "keep"]
    assert (got[0]["reason"], got[0]["affected_nodes"], got[0]["necessity"]["reason"]) == (D.UNREAD, ["a"], D.UNREAD_NEED)
    assert got[3]["necessity"]["reason"] == "q"


def test_judge_questions_and_turns(spark):
    rounds = spark.createDataFrame([(0, "合并", "a", 0), (1, "删除", "b", 1)], "round int, prompt string, target string, before int")
    nodes = spark.createDataFrame(NODES, "id string, name string, definition string, category string")
    candidates = spark.createDataFrame([(0, "b", 1, 0.91239), (1, "c", 1, 0.2)], "round int, id string, rank int, score double")
    replied = D.ask(rounds, lambda r: {"action": "merge" if r["target"] == "a" else "remove", "necessity": {"necessary": True, "reason": r["prompt"]}})
    decided = D.require_judged(D.decisions(replied, candidates, nodes))
    assert [(r["action"], r["affected_nodes"]) for r in decided.orderBy("round").collect()] == [("merge", ["a", "b"]), ("remove", ["b"])]
    from pyspark.sql import functions as F

    turns = D.turns(decided, F.col("round") * 2).orderBy("turn_id").collect()
    assert [(t["turn_id"], t["role"], t["decision_id"]) for t in turns] == [("turn_001", "teacher", None), ("turn_002", "system", "merge_001"), ("turn_003", "teacher", None), ("turn_004", "system", "remove_002")]
    assert turns[0]["content"] == "合并" and [r["c"] for r in decided.orderBy("round").select(D.changes_graph(F.col("action")).alias("c")).collect()] == [True, True]
    recent = spark.createDataFrame([(k, f"keep_{k}", "keep", ["a"]) for k in range(1, 9)], "seq int, decision_id string, action string, affected_nodes array<string>")
    asked = [json.loads(r["user"]) for r in D.questions(rounds, candidates, nodes, recent).orderBy("round").collect()]
    assert asked[0]["target_node"]["id"] == "a" and asked[0]["candidate_nodes"][0]["heuristic_score"] == 0.912 and [d["seq"] for d in asked[1]["recent_decisions"]] == [4, 5, 6, 7, 8]
    log = spark.createDataFrame([(1, "merge_001", "merge", ["a", "b"], "m", "r1"), (2, "keep_002", "keep", ["z"], None, "r2")], "seq int, decision_id string, action string, affected_nodes array<string>, name string, reason string")
    chosen = D.questioned(spark.createDataFrame([(0, "为什么合并 细胞？"), (1, "为什么？")], "round int, prompt string"), log, nodes)
    said = chosen.select("round", D.explanation(F.col("decision_id"), F.col("action"), F.col("name"), F.col("reason")).alias("e")).orderBy("round").collect()
    assert [r["e"] for r in said] == ["决策 merge_001 的动作为 merge，结果节点为“m”。理由：r1", "决策 keep_002 的动作为 keep。理由：r2"]
    none = D.questioned(spark.createDataFrame([(0, "为什么？")], "round int, prompt string"), log.where("false"), nodes)
    assert none.select(D.explanation(F.col("decision_id"), F.col("action"), F.col("name"), F.col("reason")).alias("e")).first()["e"] == D.NOTHING_DECIDED


def test_questions_meet_parts_of_texts(spark):
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab c") for _ in range(n))
    nodes = [(f"n{k}", word(r.randint(0, 7))) for k in range(60)]
    log = [(k, [r.choice(nodes)[0] for _ in range(2)], word(9) if k % 3 == 0 else None, "keep") for k in range(80)]
    asked = [(k, word(r.choice([0, 3, 40, 700]))) for k in range(50)]
    key = lambda t: (t or "").replace(" ", "")
    names = dict(nodes)
    want = {k: max([s for s, ids, name, _ in log if any(x and x in key(t) for x in [*(key(names[i]) for i in ids), key(name)])], default=79) for k, t in asked}
    found = D.questioned(spark.createDataFrame(asked, "round int, prompt string"), spark.createDataFrame(log, "seq int, affected_nodes array<string>, name string, action string"), spark.createDataFrame(nodes, "id string, name string"), ascii_only=True)
    assert {x["round"]: x["seq"] for x in found.collect()} == want
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # no question meets every decision


def test_rounds_join_by_equality(spark, tmp_path):
    from quire.plans import more

    rows = [(k, f"p{k}", "b", "t", 1, 900.0) for k in range(24)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    candidates = more._rounds(spark, at)[1]
    assert sorted((c["round"], c["id"], c["rank"]) for c in candidates.collect()) == sorted((k, f"n{k + j}", j) for k in (0, 10, 20) for j in (1, 2))
    assert "NestedLoop" not in candidates._jdf.queryExecution().executedPlan().toString()
