"""Text functions, Column in and Column out, that stay inside the JVM's generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as scripts for the web understand it.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same signs one by one.
WS_SIGNS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What every chapter heading holds; nulls go from a title, so they may stand in its word.
CHAPTER_WORD = r"第|(?i)c\x00*h\x00*a\x00*p\x00*t\x00*e\x00*r"
#: Fixed value: a letter of a title, Han or Latin.
TITLE_LETTER = r"[\u4E00-\u9FA5A-Za-z]"
#: Chapter headings, table-of-contents words, front matter, page furniture, citations.
CHAPTER = r"(?i)^(?:第\s*[一二三四五六七八九十百千万零〇两\d]+\s*[章节篇编部卷]\s*[\s\S]{0,80}|Chapter\s+\d+[\s\S]{0,80})\z"
CONTENTS_WORDS = r"(?i)目录|contents|全文"
FRONT_WORDS = r"(?i)目录|contents|前言|序言|版权页|编委|封面页|书名页|主审简介|主编简介|副主编简介"
CAPTION = r"(?i)^(?:图|表|Fig\.?|Figure|Table)\s*[0-9一二三四五六七八九十]+[.\-—、\s]"
PAGE_FURNITURE = r"扫码|二维码|资源码|复习思考题|本章小结"
CITATION = r"\[[^\[\]]+?[，,]\s*[^\[\]]*?章[^\[\]]*?[，,]\s*第\s*\d+\s*页\]"
#: Relation types and the names that stand for them.
RELATION_TYPES = ("prerequisite", "parallel", "contains", "applies_to")
RELATION_ALIASES = {
    "前置依赖": "prerequisite",
    "依赖": "prerequisite",
    "先修": "prerequisite",
    "并列": "parallel",
    "并列关系": "parallel",
    "包含": "contains",
    "包含关系": "contains",
    "应用": "applies_to",
    "应用关系": "applies_to",
}
RELATION_LABELS = {"prerequisite": "前置依赖", "contains": "包含关系", "parallel": "并列关系", "applies_to": "应用关系"}
RELATION_COLOURS = {"prerequisite": "#b9772f", "contains": "#726753", "parallel": "#476b8f", "applies_to": "#b74f39"}
SOURCE_COLOURS = ("#d85d34", "#667761", "#476b8f", "#c8923d", "#7a5a8a", "#3f7f78", "#a8504c")
CATEGORY_COLOURS = (
    ("(?i)章节|chapter", "#2d332f"),
    ("(?i)核心|概念|concept", "#2f6f73"),
    ("(?i)机制|过程|pathway", "#b27a35"),
    ("(?i)结构|细胞|器官|structure", "#4d6f95"),
    ("(?i)方法|技术|method", "#6d7654"),
    ("(?i)现象|表现|phenomenon", "#8f5f57"),
)
#: The ordered patterns that tell what a prompt asks for.
PROMPT = {
    "why_first": "^(为什么|为何|请问为什么|解释一下为什么|说明一下为什么)",
    "why_action": r"为什么.*(合并|删除|移除|保留|拆开).*[了？?]?\z",
    "imperative": "(请|帮我|执行|进行|重新|现在).*(合并|整合|删除|移除|保留|拆开|去重)",
    "why_word": "为什么|原因|解释|说明|依据|为何",
    "action_word": "(?i)分开|拆开|不要合并|不应合并|不是同一|不是一个|保留|不应该被删除|恢复|删除|移除|去掉|冗余|合并|整合|对齐|去重|重复|merge|dedupe|remove|keep",
    "keep": "(?i)分开|拆开|不要合并|不应合并|不是同一|不是一个|保留|不应该被删除|恢复|keep",
    "remove": "(?i)删除|移除|去掉|冗余|remove",
}
#: Words that answer a request, and those that a number may follow.
APPROVALS = {
    "允许": "once", "同意": "once", "approve": "once", "allow": "once", "yes": "once", "y": "once",
    "拒绝": "reject", "不同意": "reject", "reject": "reject", "deny": "reject", "no": "reject", "n": "reject",
    "总是允许": "always", "始终允许": "always", "always": "always",
}
NUMBERED = ("允许", "同意", "拒绝", "总是允许", "始终允许", "approve", "allow", "reject", "deny", "always")
EXTENSIONS = (".pdf", ".md", ".markdown", ".txt", ".docx", ".xlsx", ".xls", ".csv", ".tsv")
CONTENT_TYPES = (("pdf", ".pdf"), ("markdown", ".md"), ("text/plain", ".txt"), ("wordprocessingml", ".docx"), ("spreadsheetml", ".xlsx"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, whatever kind it is."""
    return F.btrim(c, F.lit(WS_SIGNS))


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(_text(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t\u00A0\f\x0B][\t\u00A0 \f\x0B]*| [\t\u00A0 \f\x0B]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    c = F.regexp_replace(_text(c), "\r\n", "\n")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fold(c: Column) -> Column:
    """White-space runs become one blank; single blanks are passed over."""
    return F.regexp_replace(c, rf"(?! ){WS}{WS}*| {WS}+", " ")


def compact_text(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; what else normalising does to runs doesn't show then."""
    return F.trim(fold(_text(c)))


def preview(c: Column, limit: int = 160) -> Column:
    return let(compact_text(c), lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c))


def count_chars(c: Column) -> Column:
    return F.length(normalize_whitespace(c))


def compact_title(c: Column) -> Column:
    c = F.replace(strip(_text(c)), F.lit("\u0000"), F.lit(""))
    c = fold(F.regexp_replace(c, rf"^#+{WS}*", ""))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[.·•]{4,}.*\z", ""), r" \d{1,4}\z", ""))


def is_chapter_title(c: Column) -> Column:
    """Lines without a heading's first word are no headings; only for others is the title worked out, once."""

    def whole(t: Column) -> Column:
        contents = t.rlike(CONTENTS_WORDS) & (F.length(t) <= 12)
        return F.length(t).between(2, 90) & ~contents & ~t.rlike("[.·•]{5,}") & t.rlike(CHAPTER)

    return F.coalesce(c.rlike(CHAPTER_WORD), F.lit(False)) & let(compact_title(c), whole)


def is_document_title(c: Column) -> Column:
    return let(compact_title(c), lambda t: F.length(t).between(2, 60) & ~is_chapter_title(t) & ~t.rlike(FRONT_WORDS) & ~t.rlike(r"^\d+\z") & ~t.contains("|") & ~t.rlike("[.·•]{5,}") & t.rlike(TITLE_LETTER))


def is_noise_line(c: Column, page: Column) -> Column:
    def whole(t: Column) -> Column:
        own_page = t.rlike(r"^\d{1,4}\z") & (t.try_cast("int") == page)
        furniture = t.rlike(PAGE_FURNITURE) & (F.length(t) <= 40)
        return (t == "") | F.coalesce(own_page, F.lit(False)) | t.rlike(r"^[-–—]?\s*\d{1,4}\s*[-–—]?\z") | t.rlike(r"[.·•]{5,}\s*\d{1,4}\z") | t.rlike(CAPTION) | furniture

    return let(compact_title(c), whole)


def name_key(c: Column) -> Column:
    """Key by which one book's concepts are the same."""
    return F.lower(compact_text(c))


def _composed(c: Column, form: str) -> Column:
    """Unicode normalisation, the one step here that Spark has no function for. Made at call, as workers import this too."""

    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return F.pandas_udf(normal, "string")(c)


def match_key(c: Column, ascii_only: bool = False) -> Column:
    """Key by which concepts of several books are compared: letters and digits in lower case.

    ``ascii_only`` leaves out compatibility normalisation, and with it Python, for columns known to be plain.
    """
    c = compact_text(c)
    return F.regexp_replace(F.lower(c if ascii_only else _composed(c, "NFKC")), r"[^\p{L}\p{N}]+", "")


def short_hash(c: Column, n: int = 10) -> Column:
    return F.substring(F.sha1(c.cast("string").cast("binary")), 1, n)


def safe_id(c: Column, fallback: str = "graph", limit: int = 80, ascii_only: bool = False) -> Column:
    kept = c.cast("string")
    kept = kept if ascii_only else _composed(kept, "NFKD" if limit == 80 else "NFKC")
    kept = F.regexp_replace(F.regexp_replace(_text(kept), r"[^\p{L}\p{N}_-]+", "_"), r"^_+|_+\z", "")
    kept = F.left(kept, F.lit(limit))
    return F.when(kept == "", F.concat(F.lit(f"{fallback}_"), short_hash(_text(c)))).otherwise(kept)


def file_stem(c: Column, ascii_only: bool = False) -> Column:
    return F.regexp_replace(safe_id(c, "textbook", ascii_only=ascii_only), "_+", "_")


def textbook_id(given: Column, filename: Column, fingerprint: Column) -> Column:
    g = strip(_text(given))
    return F.when(g != "", g).otherwise(F.concat(F.lit("book_"), short_hash(F.concat(filename, _text(fingerprint)), 8)))


def infer_title(filename: Column, provided: Column, candidate: Column) -> Column:
    found, given = compact_title(_text(candidate)), strip(_text(provided))
    base = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"(?<=.)\.[^.]*\z", "")
    clean = strip(F.regexp_replace(F.regexp_replace(base, r"^\d+[\s._-]*", ""), r"^[\s._-]+|[\s._-]+\z", ""))
    has = strip(_text(candidate)) != ""
    return F.when(has, found).when(given != "", given).when(clean != "", clean).when(base != "", base).otherwise(F.lit("未命名教材"))


def trim_to_length(c: Column, limit: int = 9000) -> Column:
    t = normalize_text(c)
    head, tail = int(limit * 0.62), int(limit * 0.23)
    middle = limit - head - tail - 80
    start = F.greatest(F.lit(0), F.floor((F.length(t) - middle) / 2)).cast("int")
    cut = F.concat(F.left(t, F.lit(head)), F.lit("\n\n[中间节选]\n"), F.substring(t, start + 1, F.lit(middle)), F.lit("\n\n[结尾节选]\n"), F.right(t, F.lit(tail)))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def positive_int(c: Column, fallback: Column) -> Column:
    n = c.try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("int")).otherwise(fallback)


def number(c: Column, fallback: Column) -> Column:
    """A finite number, else ``fallback``; an empty text counts as nought."""
    text = strip(_text(c))
    n = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(c.isNull() | n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), fallback).otherwise(n)


def optional_int(c: Column) -> Column:
    """A number from 1 on, its fraction cut off; null where there is none."""
    n = number(c, F.lit(None).cast("double"))
    return F.when(n >= 1, F.floor(n)).cast("long")


def rounded_score(c: Column) -> Column:
    return F.round(number(c, F.lit(0.0)), 4)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def relation_type(c: Column) -> Column:
    """The relation type that a name stands for, else null."""
    names = {kind: kind for kind in RELATION_TYPES} | RELATION_ALIASES
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(c.cast("string"))), F.try_element_at(known, F.lower(compact_text(c))))


def longer_definition(a: Column, b: Column) -> Column:
    a, b = compact_text(a), compact_text(b)
    return F.when(a == "", b).when(b == "", a).when(F.length(b) > F.length(a), b).otherwise(a)


def estimate_page(page_start: Column, page_end: Column, at: Column, length: Column) -> Column:
    first = positive_int(page_start, F.lit(1))
    last = positive_int(page_end, first)
    inside = F.least(F.greatest(at, F.lit(0)), length)
    offset = F.floor(inside / length * (last - first + 1)).cast("int")
    return F.when((last <= first) | (length == 0), first).otherwise(F.least(last, first + offset))


def source_ref(title: Column, chapter: Column, page: Column) -> Column:
    return F.format_string("[%s, %s, 第 %s 页]", title, chapter, page.cast("string"))


def citation_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(compact_text(c), F.lit("，"), F.lit(",")), rf"{WS}+", ""))


def citations_in(c: Column) -> Column:
    return F.regexp_extract_all(compact_text(c), F.lit(CITATION), F.lit(0))


def without_citations(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(compact_text(c), CITATION, ""), rf"{WS}+([。！？；，,.!?;])", "$1"))


def token_set(c: Column) -> Column:
    """Latin tokens, Han characters and pairs of Han characters that follow one another once all else is left out."""
    t = F.lower(compact_text(c))
    han = F.regexp_extract_all(t, F.lit(r"\p{IsHan}"), F.lit(0))
    pairs = F.when(F.size(han) > 1, F.zip_with(F.slice(han, F.lit(1), F.size(han) - 1), F.slice(han, F.lit(2), F.size(han) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), han, pairs))


def bigrams(key: Column) -> Column:
    """Distinct pairs of characters of a key; one character is its own gram, an empty key has none."""
    n = F.length(key)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(key)).otherwise(F.array_distinct(pairs))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct grams."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def lexical_recall(query: Column, text: Column) -> Column:
    """Part of the query's tokens that the text has, both given as arrays of distinct tokens."""
    return F.when((F.size(query) == 0) | (F.size(text) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def source_text(name: Column, definition: Column, category: Column, chapter: Column, book: Column, quotes: Column) -> Column:
    return compact_text(F.concat_ws(" ", *(_text(c) for c in (name, definition, category, chapter, book)), F.array_join(F.coalesce(quotes, F.array().cast("array<string>")), " ")))


def prompt_action(c: Column) -> Column:
    t = compact_text(c)
    why = (t.rlike(PROMPT["why_first"]) | t.rlike(PROMPT["why_action"])) & ~t.rlike(PROMPT["imperative"])
    why = why | (t.rlike(PROMPT["why_word"]) & ~t.rlike(PROMPT["action_word"]))
    return F.when(why, "explain").when(t.rlike(PROMPT["keep"]), "keep").when(t.rlike(PROMPT["remove"]), "remove").otherwise("merge")


def short_label(c: Column, limit: int = 12) -> Column:
    t = F.regexp_replace(_text(c), rf"{WS}+", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("...")))


def chapter_badge(c: Column) -> Column:
    t = strip(_text(c))
    han = F.regexp_extract(t, r"第\s*([一二三四五六七八九十百千万零〇两\d]+)\s*[章节]", 1)
    latin = F.regexp_extract(t, r"(?i)chapter\s*(\d+)", 1)
    return F.when(han != "", F.concat(F.lit("第"), han, F.lit("章"))).when(latin != "", F.concat(F.lit("Ch."), latin)).otherwise(short_label(t, 4))


def _pick(c: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def relation_label(c: Column) -> Column:
    return _pick(c, RELATION_LABELS, strip(fold(_text(c))))


def relation_colour(c: Column) -> Column:
    return F.coalesce(_pick(c, RELATION_COLOURS, F.lit("#776c5b")), F.lit("#776c5b"))


def category_colour(category: Column, kind: Column) -> Column:
    t = F.concat_ws(" ", _text(category), _text(kind))
    return reduce(lambda out, e: F.when(t.rlike(e[0]), F.lit(e[1])).otherwise(out), reversed(CATEGORY_COLOURS), F.lit("#55706b"))


def source_colour(book: Column, index: Column) -> Column:
    total = F.aggregate(F.filter(F.split(_text(book), ""), lambda x: x != ""), F.lit(0), lambda s, x: s + F.ascii(x))
    return F.element_at(F.array(*(F.lit(c) for c in SOURCE_COLOURS)), (F.pmod(total + index, F.lit(len(SOURCE_COLOURS))) + 1).cast("int"))


def format_bytes(c: Column) -> Column:
    n = c.cast("double")
    return F.when(n < 1024, F.format_string("%d B", c.cast("long"))).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def format_number(c: Column) -> Column:
    """A whole number with commas between thousands; nought where it is none."""
    return F.format_number(F.round(number(c, F.lit(0.0))).cast("long"), 0)


def safe_basename(c: Column, fallback: str = "textbook") -> Column:
    """The last part of a path as a file name: all but word signs, dots, hyphens and Han characters becomes lines."""
    given = strip(_text(c))
    last = F.element_at(F.split(F.regexp_replace(F.when(given == "", fallback).otherwise(given), r"/+\z", ""), "/"), -1)
    kept = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9_.\-\u4E00-\u9FA5]+", "_"), r"^_+|_+\z", "")
    return F.when(kept == "", fallback).otherwise(kept)


def output_stem(filename: Column) -> Column:
    """What a book's files are named after: its name without ending."""
    return F.regexp_replace(safe_basename(filename), r"\.[^.]+\z", "")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def endpoint(c: Column) -> Column:
    """An address without blanks and trailing slashes."""
    return F.regexp_replace(strip(_text(c)), r"/+\z", "")


def endpoint_path(c: Column, path: str) -> Column:
    """``path`` under the address's /v1, which is added once."""
    base = endpoint(c)
    return F.concat(F.when(base.rlike(r"/v1\z"), base).otherwise(F.concat(base, F.lit("/v1"))), F.lit("/" + path.lstrip("/")))


def message_text(content: Column, chat_type: Column) -> Column:
    """Text of a chat message; in groups without the marks of those it is sent to. Broken content is empty."""
    t = F.coalesce(F.get_json_object(content, "$.text"), F.lit(""))
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"@_user_\d+", " "), "@_all", " "), "[ \t]{2,}", " "))
    return F.when(chat_type == "group", bare).otherwise(t)


def allowed_users(c: Column) -> Column:
    return F.filter(F.transform(F.split(_text(c), ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def is_allowed(ids: Column, allowed: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(F.filter(ids, lambda x: x.isNotNull()), F.lower), allowed), F.lit(False))


def approval(c: Column) -> Column:
    """struct(reply, index) of an answer; index counts from 0 and is null where none is given. Null if it is no answer."""
    t = F.lower(strip(_text(c)))
    numbered = rf"^({'|'.join(sorted(NUMBERED, key=len, reverse=True))})\s*[#第号]?\s*(\d+)\z"
    word, number = F.regexp_extract(t, numbered, 1), F.regexp_extract(t, numbered, 2)
    whole = F.struct(_pick(t, APPROVALS, F.lit(None).cast("string")).alias("reply"), F.lit(None).cast("int").alias("index"))
    part = F.struct(_pick(word, APPROVALS, F.lit(None).cast("string")).alias("reply"), (number.try_cast("int") - 1).alias("index"))
    return F.when(t.isin(*APPROVALS), whole).when(word != "", part)


def permission_ask(index: Column, total: Column, permission: Column, patterns: Column, metadata: Column, agent: str = "agent") -> Column:
    """The message that asks for a permission; a long change is cut."""
    diff = metadata["diff"]
    cut = F.when(F.length(diff) > 1500, F.concat(F.left(diff, F.lit(1500)), F.lit("\n…(已截断)"))).otherwise(diff)
    filled = lambda c: F.when(c != "", c)
    return F.concat_ws(
        "\n",
        F.format_string(f"🔐 {agent} 请求授权（%d/%d）", index + 1, total),
        F.concat(F.lit("操作："), permission),
        F.when(F.size(patterns) > 0, F.concat(F.lit("范围："), F.array_join(patterns, "、"))),
        F.concat(F.lit("文件："), filled(metadata["filepath"])),
        F.concat(F.lit("命令："), filled(metadata["command"])),
        F.concat(F.lit("修改内容：\n"), filled(cut)),
        F.concat(F.lit("回复「允许」继续，「拒绝」中止，「总是允许」本次会话后自动放行"), F.when(total > 1, F.format_string("（也可「允许 %d」指定）", index + 1)).otherwise(F.lit(""))),
    )


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.when(strip(_text(c)) != "", strip(_text(c))) for c in columns))


def is_url(c: Column) -> Column:
    return c.rlike("(?i)^https?://")


def basename(address: Column, provided: Column | None = None) -> Column:
    """File name of an address: the given name's last part, else the decoded last part of the path, else ``textbook``."""
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, r"/+\z", ""), "/"), -1)
    path = F.url_decode(F.regexp_replace(F.regexp_replace(address, "(?i)^https?://[^/?#]*", ""), r"[?#].*\z", ""))
    web = F.when(F.coalesce(last(path), F.lit("")) != "", last(path)).otherwise(F.lit("textbook"))
    local = last(F.regexp_replace(address, "(?i)^file://", ""))
    found = F.when(is_url(address), web).otherwise(local)
    if provided is None:
        return found
    given = strip(_text(provided))
    return F.when(given != "", last(given)).otherwise(found)


def extension(filename: Column, fmt: Column | None = None, content_type: Column | None = None) -> Column:
    """The source format: that given, else the file's, else that of the content type; null where none is supported."""
    own = F.lower(F.regexp_extract(filename, r".(\.[^./]*)\z", 1))
    if fmt is not None:
        given = F.regexp_replace(F.lower(strip(_text(fmt))), r"^\.", "")
        own = F.when(given != "", F.concat(F.lit("."), given)).otherwise(own)
    own = F.when(own == ".markdown", F.lit(".md")).otherwise(own)
    out = F.when(own.isin(*EXTENSIONS), own)
    for part, ext in CONTENT_TYPES if content_type is not None else ():
        out = out.when(content_type.contains(part), F.lit(ext))
    return out
