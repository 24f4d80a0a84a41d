"""Segmentation of documents into chapters, lines and chunks."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as T

LINE_SCHEMA = "doc string, page int, text string, x double, y double, font_size double, max_font_size double, bold boolean"
BOLD = "(?i)bold|heavy|black|semibold|medium|hei|黑体"
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def _rolled(docs: DataFrame, key: str, text: str, opens: Callable[[Column], Column], title: Callable[[Column], Column]) -> DataFrame:
    """Segments (key, segment, title or null, content) of texts, cut before each line that ``opens``; empty ones go.

    All is done inside the row: lines stay an array, and no text is shuffled.
    """
    lined = docs.select(key, F.split(T.normalize_whitespace(F.col(text)), "\n").alias("lines"))
    at = F.filter(F.transform("lines", lambda line, i: F.when(opens(line), i + 1)), lambda i: i.isNotNull())
    marked = lined.withColumn("at", at)
    ends = F.concat("at", F.array(F.size("lines") + 1))
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("at")).alias("low"), ends.alias("high"))

    def cut(span: Column, segment: Column) -> Column:
        low = span["low"]
        content = T.normalize_whitespace(F.array_join(F.slice("lines", low + 1, span["high"] - low - 1), "\n"))
        head = F.when(low > 0, title(F.element_at("lines", F.greatest(low, F.lit(1)))))
        return F.struct(segment.alias("segment"), head.alias("title"), content.alias("content"))

    # cut inside the row: a row per span would take all lines along, and a filter on contents would make them twice
    filled = F.filter(F.transform(spans, cut), lambda s: s["content"] != "")
    return marked.select(key, F.inline(filled))


def split_text(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Chapters of plain texts: a chapter heading opens one; what stands before the first is titled 全文."""
    return _rolled(docs, key, text, T.is_chapter_title, T.compact_title).withColumn("title", F.coalesce("title", F.lit("全文")))


def split_markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Chapters of Markdown: headings of the first two levels open one, deeper ones only if they are chapter headings.

    What stands before the first heading takes the document's title, if its first-level heading came before, else 全文.
    """
    title = lambda line: T.compact_title(F.regexp_extract(line, r"^#{1,3}\s+(.+?)\s*\z", 1))

    def opens(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,3})\s+\S", 1))
        return (level > 0) & ((level <= 2) | T.is_chapter_title(title(line)))

    return _rolled(docs, key, text, opens, title).withColumn("title", F.coalesce("title", F.lit("全文")))


def first_chapters(chapters: DataFrame, key: str, most: int | None, order: str = "chapter_idx") -> DataFrame:
    """The first ``most`` chapters of each book, or all of them where no number is given."""
    if most is None:
        return chapters
    return chapters.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def finalise(chapters: DataFrame, key: str) -> DataFrame:
    """Chapter ids, titles and lengths; untitled parts become 前置内容, numbered from the second on."""
    order = W.partitionBy(key).orderBy("segment")
    plain = F.col("title") == "全文"
    nth = F.sum(plain.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    title = F.when(plain & (nth == 1), "前置内容").when(plain, F.concat(F.lit("前置内容 "), nth.cast("string"))).otherwise(F.col("title"))
    number = F.row_number().over(order)
    chapters = chapters.withColumn("char_count", T.count_chars(F.col("content")))  # before rows are ordered: who drops contents orders none
    return chapters.select(
        key,
        F.concat(F.lit("ch_"), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))).alias("chapter_id"),
        number.alias("chapter_idx"),
        T.compact_title(title).alias("title"),
        "content",
        "char_count",
    )


def textbook_summary(chapters: DataFrame, key: str) -> DataFrame:
    return chapters.groupBy(key).agg(F.count("*").alias("chapters"), F.sum("char_count").cast("long").alias("total_chars"), F.max("char_count").cast("long").alias("longest"))


def boundary_lines(lines: DataFrame, doc: str = "doc", page: str = "page", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines that stand among the first two or last two of at least max(3, a fifth) of a document's pages."""
    order = W.partitionBy(doc, page)
    ranked = lines.withColumn("k", F.row_number().over(order.orderBy(pos))).withColumn("n", F.count("*").over(order))
    edge = ranked.where("k <= 2 or k > n - 2").select(doc, page, T.compact_title(F.col(line)).alias("line"))
    edge = edge.where(F.length("line").between(4, 80) & ~T.is_chapter_title(F.col("line"))).distinct()
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    return edge.groupBy(doc, "line").agg(F.count("*").alias("times")).join(pages, doc).where(F.col("times") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.2))).select(doc, "line", "times")


def upper_median(df: DataFrame, value: str, *keys: str, default: float = 10.0) -> DataFrame:
    """The element in the upper middle of each group's positive values; ``default`` where there is none.

    Values are ranked by a window that spills, so that no group is gathered in memory.
    """
    good = df.where(F.col(value) > 0)
    k, n = F.row_number().over(W.partitionBy(*keys).orderBy(value)), F.count("*").over(W.partitionBy(*keys))
    middle = good.select(*keys, F.col(value).alias("median"), k.alias("k"), n.alias("n")).where(F.col("k") == F.floor(F.col("n") / 2) + 1).drop("k", "n")
    return df.select(*keys).distinct().join(middle, list(keys), "left").select(*keys, F.coalesce("median", F.lit(default)).alias("median"))


def outline_ranges(outline: DataFrame, doc: str, total_pages: Column) -> DataFrame:
    """Page ranges from outline entries (doc, title, page): one a page at most, each up to the next; front matter first."""
    order = W.partitionBy(doc).orderBy("page")
    first = outline.withColumn("k", F.row_number().over(W.partitionBy(doc, "page").orderBy("title"))).where("k = 1").drop("k")
    ranged = first.select(doc, "title", F.col("page").alias("page_start"), F.coalesce(F.greatest(F.col("page"), F.lead("page").over(order) - 1), total_pages).alias("page_end"), F.lag("page").over(order).isNull().alias("opens"))
    front = ranged.where("opens and page_start > 1").select(doc, F.lit("前置内容").alias("title"), F.lit(1).cast(ranged.schema["page_start"].dataType).alias("page_start"), (F.col("page_start") - 1).alias("page_end"))
    return front.unionByName(ranged.drop("opens"))


def in_ranges(pages: DataFrame, ranges: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages with the range that holds them: an equality on the document, then a range condition."""
    return pages.join(ranges, [doc]).where(F.col("page").between(F.col("page_start"), F.col("page_end")))


def heading_scan(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Chapters of page lines (doc, page, pos, line): a heading that differs from the one before opens a chapter."""
    order = W.partitionBy(doc).orderBy("page", "pos")
    title = T.compact_title(F.col("line"))
    found = lines.withColumn("candidate", F.when(T.is_chapter_title(F.col("line")), title))
    before = F.last("candidate", True).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("heading", F.when(F.col("candidate").isNotNull() & ~F.col("candidate").eqNullSafe(before), F.col("candidate")))
    marked = marked.withColumn("segment", F.sum(F.col("heading").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    body = F.when(F.col("heading").isNull(), F.struct("page", "pos", "line"))
    rolled = marked.groupBy(doc, "segment").agg(F.max("heading").alias("title"), F.min("page").alias("page_start"), F.array_sort(F.collect_list(body)).alias("rows"))
    last = lines.groupBy(doc).agg(F.max("page").alias("last"))
    ahead = F.lead("page_start").over(W.partitionBy(doc).orderBy("segment"))
    out = rolled.withColumn("ahead", ahead).join(last, doc)
    content = T.normalize_whitespace(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return out.select(doc, "segment", F.coalesce("title", F.lit("全文")).alias("title"), F.when(F.col("segment") == 0, F.lit(1)).otherwise(F.col("page_start")).alias("page_start"), F.coalesce(F.greatest(F.col("page_start"), F.col("ahead") - 1), "last").alias("page_end"), content.alias("content")).where("content != ''")


def pick_title(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """A document's likely title: among the largest lines, by page, height, script and length."""
    t = T.compact_title(F.col("line"))
    some = lines.where(T.is_document_title(F.col("line"))).select(doc, t.alias("title"), "font_size", "page", "y")
    large = some.withColumn("most", F.max("font_size").over(W.partitionBy(doc))).where("font_size >= most * 0.9")
    script = F.when(F.col("title").rlike(r"^[\u4E00-\u9FA5]+\z"), 0).when(F.col("title").rlike(r"^[\u4E00-\u9FA5A-Za-z]+\z"), 1).otherwise(2)
    return large.groupBy(doc).agg(F.min_by("title", F.struct("page", "y", script.alias("s"), F.length("title").alias("n"), "title")).alias("title"))


def _group_lines(doc: str, page: int, rows: list[tuple]) -> list[tuple]:
    """Items of one page, in order, as lines: each joins the first line within reach of its height; a gap becomes a blank.

    Lines are looked up by height: they stand more than 2 apart, so few are within reach.
    """
    lines: list[tuple[float, list]] = []
    heights: list[tuple[float, int]] = []
    for said, x, y, width, font_name, font_size in rows:
        if not (said or "").strip():
            continue
        size = font_size or 10.0
        x, y, size, width = (math.nan if v is None else v for v in (x, y, size, width))
        reach = max(2.0, size * 0.35)
        first, k = None, bisect.bisect_left(heights, (y - reach * 1.001 - 1e-9 * abs(y), -1))
        while k < len(heights) and heights[k][0] <= y + reach * 1.001 + 1e-9 * abs(y):
            if abs(heights[k][0] - y) <= reach and (first is None or heights[k][1] < first):
                first = heights[k][1]
            k += 1
        if first is None:
            first = len(lines)
            lines.append((y, []))
            if not math.isnan(y):
                bisect.insort(heights, (y, first))
        lines[first][1].append((x, said, max(0.0, width or 0.0), size, font_name or "", y))
    out = []
    for _, items in lines:
        items = sorted(items, key=lambda i: i[0])
        said, right, weighted, total = "", None, 0.0, 0
        for x, word, width, size, _, _ in items:
            if right is not None and x - right > max(3.0, size * 0.35):
                said += " "
            said += word
            right = x + width
            weighted += size * max(1, len(word))
            total += max(1, len(word))
        bold = any(re.search(BOLD, i[4]) for i in items)
        out.append((doc, page, " ".join(said.split()), items[0][0], items[0][5], weighted / total, max(i[3] for i in items), bold))
    out.sort(key=lambda r: (-r[4], r[3]))
    return out


def group_items(items: DataFrame) -> DataFrame:
    """Lines of positioned text items (doc, page, ord, str, x, y, width, font_name, font_size), page by page.

    Pages are told apart as sorted rows go by, so that a page costs its items and no call of its own.
    """
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.bool_()]

    def told(lines: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for batch in batches:
            for doc, page, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, page) != at:
                    out += _group_lines(*at, held) if held else []
                    at, held = (doc, page), []
                    if len(out) >= 10_000:
                        yield told(out)
                        out = []
                held.append(item)
        out += _group_lines(*at, held) if held else []
        if out:
            yield told(out)

    number = lambda c: F.col(c).cast("double").alias(c)
    rows = items.select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("int").alias("page"), "str", number("x"), number("y"), number("width"), "font_name", number("font_size"), "ord")
    dealt = rows.repartition("doc", "page").sortWithinPartitions("doc", "page", "ord").drop("ord")
    return dealt.mapInArrow(run, LINE_SCHEMA)


def recursive_chunks(text: str, size: int = 700, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about ``size`` characters cut at the coarsest separators that fit, each kept with what follows it.

    The rules are those that splitters of this kind publish: pieces are gathered up to the size; then pieces leave at
    the front until at most ``overlap`` characters remain; a piece that is too long is split by the next separators.
    """
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1 :]
    if sep == "":
        parts = list(text)
    else:
        cut = text.split(sep)
        parts = [p for p in [cut[0], *(sep + c for c in cut[1:])] if p]
    out: list[str] = []
    held: list[str] = []

    def emit(pieces: list[str]) -> None:
        window: list[str] = []
        total = 0
        for p in pieces:
            if total + len(p) > size and window:
                out.append("".join(window))
                while window and (total > overlap or total + len(p) > size):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if window:
            out.append("".join(window))

    for p in parts:
        if len(p) < size:
            held.append(p)
            continue
        emit(held)
        held = []
        if rest:
            out += recursive_chunks(p, size, overlap, rest)
        else:
            out.append(p)
    emit(held)
    return [c for c in (o.strip() for o in out) if c]


CHUNK_SCHEMA = "book string, chapter_id string, chunk_index int, text string, char_start int, char_end int, char_count int"


def chunk(chapters: DataFrame, size: int = 700, overlap: int = 80, book: str = "textbook_id", text: str = "content") -> DataFrame:
    """Chunks of chapters with their places; page, id and reference are added by ``with_refs``."""
    if not 500 <= size <= 800 or not 50 <= overlap <= 100:
        raise ValueError("chunk size must be 500 to 800 and overlap 50 to 100")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for b, chapter, content in batch.itertuples(index=False):
                cursor = 0
                for k, piece in enumerate(recursive_chunks(content, size, overlap) if content else []):
                    start = content.find(piece, max(0, cursor - 200))
                    start = content.find(piece) if start < 0 else start
                    start = min(cursor, max(0, len(content) - len(piece))) if start < 0 else start
                    rows.append((b, chapter, k + 1, piece, start, min(len(content) - 1, start + len(piece) - 1), len(piece)))
                    cursor = max(start + len(piece) - overlap, start + 1)
            yield pd.DataFrame(rows, columns=names)

    source = chapters.select(F.col(book).cast("string"), "chapter_id", T.normalize_text(F.col(text)).alias("content"))
    return source.mapInPandas(run, CHUNK_SCHEMA)


def with_refs(chunks: DataFrame, chapters: DataFrame, book: str = "textbook_id") -> DataFrame:
    """Chunks with id, page and source reference from their chapter (title, chapter_title, page_start, page_end)."""
    c = chapters.select(F.col(book).cast("string").alias("book"), "chapter_id", "title", "chapter_title", "page_start", "page_end", F.length("content").alias("length"))
    page = T.estimate_page(F.col("page_start"), F.col("page_end"), F.col("char_start"), F.col("length"))
    key = F.concat_ws(":", "book", "chapter_id", (F.col("chunk_index") - 1).cast("string"), "text")
    number = F.lpad(F.col("chunk_index").cast("string"), 4, "0")
    joined = chunks.join(c, ["book", "chapter_id"]).withColumn("page", page)
    return joined.withColumn("chunk_id", F.concat_ws("_", F.lit("rag"), "book", "chapter_id", number, T.short_hash(key, 8))).withColumn("source_ref", T.source_ref(F.col("title"), F.col("chapter_title"), F.col("page")))
