import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "title", "heading"),
    [
        ("Chapter 1", "Chapter", False),
        ("Chapter 1 Introduction", "Chapter 1 Introduction", True),
        ("第一章 绪论 ......... 12", "第一章 绪论", True),
        ("第一章 绪论 12", "第一章 绪论", True),
        ("## 第二章　细胞", "第二章 细胞", True),
        ("目录", "目录", False),
        ("x", "x", False),
        (None, "", False),
    ],
)
def test_titles(spark, raw, title, heading):
    assert one(spark, T.compact_title(F.col("t")), t=raw) == title
    assert bool(one(spark, T.is_chapter_title(F.col("t")), t=raw)) is heading


def test_white_space(spark):
    raw = "　a\t\tb \r\n\r\n\r\n\r\n c \r"
    assert one(spark, T.normalize_whitespace(F.col("t")), t=raw) == "a b \n\n c"
    assert one(spark, T.compact_text(F.col("t")), t=raw) == "a b c"
    assert one(spark, T.normalize_text(F.col("t")), t="a  \n\n\n\nb ") == "a\n\nb"


def test_document_title_and_noise(spark):
    assert one(spark, T.is_document_title(F.col("t")), t="生理学")
    assert not one(spark, T.is_document_title(F.col("t")), t="123")
    for noise in ("", "12", "- 3 -", "图 1-2 细胞", "扫码看资源"):
        assert one(spark, T.is_noise_line(F.col("t"), F.lit(12)), t=noise)
    assert not one(spark, T.is_noise_line(F.col("t"), F.lit(12)), t="plain text")


def test_relation_types(spark):
    for raw, kind in (("依赖", "prerequisite"), ("并列关系", "parallel"), (" Contains ", "contains"), ("other", None), (None, None)):
        assert one(spark, T.relation_type(F.col("t")), t=raw) == kind


def test_prompt_action(spark):
    for raw, action in (("为什么合并了这两个", "explain"), ("请合并它们", "merge"), ("不要合并", "keep"), ("删除冗余", "remove"), ("这个的依据", "explain"), ("hello", "merge"), ("Please remove it", "remove")):
        assert one(spark, T.prompt_action(F.col("t")), t=raw) == action


def test_approval(spark):
    for raw, reply, index in (("允许", "once", None), ("YES", "once", None), ("拒绝 #3", "reject", 2), ("总是允许", "always", None), ("允许 0", "once", -1)):
        got = one(spark, T.approval(F.col("t")), t=raw)
        assert (got["reply"], got["index"]) == (reply, index)
    assert one(spark, T.approval(F.col("t")), t="maybe") is None


def test_message_text(spark):
    c = T.message_text(F.col("c"), F.col("k"))
    assert one(spark, c, c='{"text": "@_user_1  测试  @_all 内容"}', k="group") == "测试 内容"
    assert one(spark, c, c='{"text": " a "}', k="p2p") == " a "
    assert one(spark, c, c="broken", k="group") == ""


def test_permission_ask(spark):
    df = spark.sql("select 0 i, 2 n, 'edit' p, array('a','b') q, map('filepath','/x','diff', repeat('d', 1600)) m")
    said = df.select(T.permission_ask(F.col("i"), F.col("n"), F.col("p"), F.col("q"), F.col("m")).alias("x")).first()["x"]
    assert "授权（1/2）" in said and "范围：a、b" in said and "文件：/x" in said and "已截断" in said and "允许 1" in said


def test_tokens_and_recall(spark):
    assert set(one(spark, T.token_set(F.col("t")), t="动作 电位 ab1")) == {"ab1", "动", "作", "电", "位", "动作", "作电", "电位"}
    q, t = T.token_set(F.lit("a b c d")), T.token_set(F.col("t"))
    assert one(spark, T.lexical_recall(q, t), t="a c x") == 0.5


def test_citations(spark):
    said = "见 [书, 第1章, 第 3 页] 和[书，第1章， 第3页]。"
    assert len(one(spark, T.citations_in(F.col("t")), t=said)) == 2
    assert one(spark, T.without_citations(F.col("t")), t=said) == "见  和。"
    assert one(spark, T.citation_key(F.col("t")), t="[书， 第1章， 第 3 页]") == "[书,第1章,第3页]"


def test_names_ids_and_endpoints(spark):
    assert one(spark, T.match_key(F.col("t")), t="Ａ-b 细胞！") == "ab细胞"
    assert one(spark, T.safe_id(F.col("t"), "node"), t="a b/c") == "a_b_c"
    assert one(spark, T.safe_id(F.col("t"), "node"), t="!!").startswith("node_")
    assert one(spark, T.endpoint_path(F.col("t"), "chat"), t="http://h/v1/") == "http://h/v1/chat"
    assert one(spark, T.endpoint_path(F.col("t"), "chat"), t="http://h") == "http://h/v1/chat"
    assert one(spark, T.basename(F.col("t")), t="https://h/a/%E4%B8%80.md?x=1") == "一.md"
    assert one(spark, T.basename(F.col("t")), t="https://h/") == "textbook"
    assert one(spark, T.extension(F.col("t")), t="A.MARKDOWN") == ".md"
    assert one(spark, T.extension(F.col("t")), t="a.png") is None
    assert one(spark, T.infer_title(F.col("t"), F.lit(None), F.lit("")), t="03_生理学.pdf") == "生理学"


def test_labels_and_colours(spark):
    assert one(spark, T.chapter_badge(F.col("t")), t="第三章 血液") == "第三章"
    assert one(spark, T.chapter_badge(F.col("t")), t="Chapter 4 x") == "Ch.4"
    assert one(spark, T.short_label(F.col("t"), 3), t="a bcde") == "abc..."
    assert one(spark, T.relation_label(F.col("t")), t="contains") == "包含关系"
    assert one(spark, T.category_colour(F.col("t"), F.lit("")), t="核心概念") == "#2f6f73"
    assert one(spark, T.format_bytes(F.col("t").cast("long")), t="2048") == "2.0 KB"


def _bigrams(s):
    return set(s) if len(s) <= 1 else {s[i : i + 2] for i in range(len(s) - 1)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abc1 ", max_size=8), st.text("abc1 ", max_size=8)), min_size=1, max_size=20))
def test_dice_against_definition(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    key = lambda c: T.match_key(F.col(c), True)
    got = [r["d"] for r in df.select(T.dice(T.bigrams(key("a")), T.bigrams(key("b"))).alias("d")).collect()]
    for (a, b), d in zip(pairs, got, strict=True):
        x, y = _bigrams(a.replace(" ", "")), _bigrams(b.replace(" ", ""))
        assert d == (2 * len(x & y) / (len(x) + len(y)) if x and y else 0)
