"""Readers of textbook files and of the engine's own JSON, and its sinks."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as T
from quire.operators import graph, segment
from quire.sources import xls

MOST_BYTES = 200 << 20
#: Why a file is not read.
EMPTY, TOO_LARGE, UNSUPPORTED = "Uploaded textbook is empty", "Textbook is too large", "Unsupported textbook format"
SHEET_SCHEMA = "path string, sheet string, sheet_idx int, row_idx int, cells array<string>"
BODY_SCHEMA = "path string, markdown boolean, text string"
ALIASES = ("textbookAddress", "address", "path", "filePath", "url", "textbookPath")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def resolve(context: str | dict) -> dict:
    """A source's address and what is known of it, from a string or from any of the usual names."""
    given = {"address": context} if isinstance(context, str) else context
    if not isinstance(given, dict):
        raise TypeError("context must be an object")
    address = next((given[k] for k in ALIASES if given.get(k) is not None), None)
    if not isinstance(address, str) or not address.strip():
        raise TypeError("context must provide a non-empty textbook address")
    return {"address": address.strip(), "textbook_id": given.get("textbook_id", given.get("textbookId")), **{k: given.get(k) for k in ("filename", "title", "format")}}


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder, or of a pattern, that hold no byte."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for top in store.globStatus(place) or []:
        listed = store.listStatus(top.getPath()) if top.isDirectory() else [top]
        found += [f.getPath().toString() for f in listed if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", "."))]
    return found


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files as path, filename, ext, content, problem.

    Empty files, those above ``most_bytes`` and those of an unsupported format are listed with their problem and without
    format or content, so that no reader takes them; ``require_supported`` refuses them.
    """
    f = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    nothing = _empty_files(spark, path)  # Spark's reader passes over them
    if nothing:
        f = f.unionByName(spark.createDataFrame([(p, 0, None) for p in nothing], "path string, length long, content binary"))
    name = T.basename(F.url_decode("path"))
    problem = F.when(F.col("length") == 0, EMPTY).when(F.col("length") > most_bytes, TOO_LARGE).when(T.extension(name).isNull(), UNSUPPORTED)
    sound = lambda c: F.when(F.col("problem").isNull(), c)
    return f.select("path", name.alias("filename"), problem.alias("problem"), "content").select("path", "filename", sound(T.extension(F.col("filename"))).alias("ext"), sound(F.col("content")).alias("content"), "problem")


def require_supported(files: DataFrame) -> DataFrame:
    """The same files; one that is empty, too large or of an unsupported format fails the query."""
    said = F.concat("problem", F.lit(": "), "filename")
    return files.withColumn("ext", F.when(F.col("problem").isNotNull(), F.raise_error(said)).otherwise(F.col("ext")))


def fetched(addresses: DataFrame, get: Callable[[str], bytes], head: Callable[[str], str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Books at web addresses (path) read on the executors: path, filename, ext, content, problem.

    ``get`` returns a book's bytes; ``head`` its content type, which is asked for only where the address tells no format.
    """
    known = addresses.select("path", T.basename(F.col("path")).alias("filename")).withColumn("ext", T.extension(F.col("filename")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext in zip(pdf["path"], pdf["ext"], strict=True):
                try:
                    kind = head(path) if ext is None and head is not None else None
                    rows.append((path, kind, bytes(get(path)), None))
                except OSError as e:
                    rows.append((path, None, None, f"unreadable: {e}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "content", "failure"])

    got = known.select("path", "ext").mapInPandas(run, "path string, kind string, content binary, failure string")
    name = T.basename(F.col("path"))
    ext = T.extension(name, None, F.lower(F.coalesce("kind", F.lit(""))))
    size = F.octet_length("content")
    problem = F.coalesce("failure", F.when(size == 0, EMPTY).when(size > most_bytes, TOO_LARGE).when(ext.isNull(), UNSUPPORTED))
    sound = lambda c: F.when(F.col("problem").isNull(), c)
    return got.select("path", name.alias("filename"), ext.alias("found"), "content", problem.alias("problem")).select("path", "filename", sound(F.col("found")).alias("ext"), sound(F.col("content")).alias("content"), "problem")


def texts(files: DataFrame) -> DataFrame:
    """Text and Markdown files as path, markdown, text."""
    return files.where(F.col("ext").isin(".txt", ".md")).select("path", (F.col("ext") == ".md").alias("markdown"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def docx_text(data: bytes) -> tuple[bool, str]:
    """Whether a word-processor file has headings of the first three levels, and its text with them marked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out, marked = [], False
    for p in root.iter(f"{_WORD}p"):
        said = "".join(t.text or "" for t in p.iter(f"{_WORD}t"))
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        level = re.fullmatch(r"(?i)heading\s*([1-3])", style.get(f"{_WORD}val", "") if style is not None else "")
        marked |= bool(level and said.strip())
        out.append(("#" * int(level[1]) + " " + said) if level and said.strip() else said)
    return marked, "\n\n".join(out)


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    value = c.find(f"{_SHEET}v")
    if c.get("t") == "s" and value is not None:
        return shared[int(value.text or 0)]
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
    return (value.text or "") if value is not None else ""


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of a workbook in their order, as rows of cell texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            part = links[s.get(_LINK)].lstrip("/")
            sheet = ElementTree.fromstring(z.read(part if part in names else f"xl/{part}"))
            out.append((s.get("name", ""), [[_cell(c, shared) for c in row.iter(f"{_SHEET}c")] for row in sheet.iter(f"{_SHEET}row")]))
    return out


def table_rows(data: bytes, ext: str) -> list[tuple[str, list[list[str]]]]:
    if ext in (".csv", ".tsv"):
        return [("Sheet1", list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")), delimiter="\t" if ext == ".tsv" else ",")))]
    return xls.sheets(data) if ext == ".xls" else xlsx_sheets(data)


def _mapped(files: DataFrame, exts: tuple[str, ...], schema: str, rows: Callable[[str, str, bytes], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ext, content in batch.itertuples(index=False):
                yield pd.DataFrame(rows(path, ext, bytes(content)), columns=names)

    return files.where(F.col("ext").isin(*exts)).select("path", "ext", "content").mapInPandas(run, schema)


def documents(files: DataFrame) -> DataFrame:
    """Word-processor files as path, markdown, text."""
    return _mapped(files, (".docx",), BODY_SCHEMA, lambda path, ext, data: [(path, *docx_text(data))])


def sheets(files: DataFrame) -> DataFrame:
    """Rows of workbooks and of separated text."""
    return _mapped(files, (".xlsx", ".xls", ".csv", ".tsv"), SHEET_SCHEMA, lambda path, ext, data: [(path, name, i, j, cells) for i, (name, rows) in enumerate(table_rows(data, ext)) for j, cells in enumerate(rows)])


def sheet_chapters(rows: DataFrame) -> DataFrame:
    """A chapter per sheet: filled cells of a row joined by bars, rows by line breaks; empty rows and sheets go."""
    said = F.array_join(F.filter(F.transform("cells", lambda c: T.strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")
    lines = rows.select("path", "sheet", "sheet_idx", "row_idx", said.alias("line")).where("line != ''")
    body = F.array_sort(F.collect_list(F.struct("row_idx", "line")))
    return lines.groupBy("path", "sheet_idx", "sheet").agg(body.alias("rows")).select(
        "path", F.col("sheet_idx").alias("segment"), F.col("sheet").alias("title"), (F.col("sheet_idx") + 1).alias("page_start"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("content")
    )


def chapters(files: DataFrame) -> DataFrame:
    """Chapters of all supported text, word-processor and table files: path, chapter_id, chapter_idx, title, content, char_count."""
    bodies = texts(files).unionByName(documents(files))
    plain = segment.split_text(bodies.where("not markdown"), "path")
    marked = segment.split_markdown(bodies.where("markdown"), "path")
    tables = sheet_chapters(sheets(files)).select("path", F.col("segment").cast("long").alias("segment"), "title", "content")
    return segment.finalise(plain.unionByName(marked).unionByName(tables), "path")


def page_lines(items: DataFrame) -> DataFrame:
    """Lines (doc, page, pos, line, ...) of positioned text items, without noise and what stands at many pages' edges."""
    lines = segment.group_items(items)
    order = W.partitionBy("doc", "page").orderBy(F.desc("y"), "x")
    lines = lines.where(~T.is_noise_line(F.col("text"), F.col("page"))).withColumn("pos", F.row_number().over(order)).withColumnRenamed("text", "line")
    often = segment.boundary_lines(lines).select(F.col("doc").alias("often_in"), F.col("line").alias("often"))
    return lines.join(often, (F.col("doc") == F.col("often_in")) & (T.compact_title(F.col("line")) == F.col("often")), "left_anti")


def pdf_chapters(items: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Chapters of positioned text items of page files; items come from whichever reader is at hand.

    Files whose outline (doc, title, page, pages) has chapter headings are cut by their pages, the others by the headings
    in their text.
    """
    kept = page_lines(items)
    if outline is None:
        return segment.heading_scan(kept)
    entries = outline.where(T.is_chapter_title(F.col("title"))).withColumn("title", T.compact_title(F.col("title")))
    ranges = segment.outline_ranges(entries, "doc", F.col("pages"))
    body = F.array_sort(F.collect_list(F.struct("page", "pos", "line")))
    cut = segment.in_ranges(kept, ranges).groupBy("doc", "title", "page_start", "page_end").agg(body.alias("rows"))
    content = T.normalize_whitespace(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    number = (F.row_number().over(W.partitionBy("doc").orderBy("page_start")) - 1).cast("long")
    found = cut.select("doc", number.alias("segment"), "title", "page_start", "page_end", content.alias("content")).where("content != ''")
    return found.unionByName(segment.heading_scan(kept.join(entries.select("doc"), "doc", "left_anti")))


def pdf_titles(items: DataFrame, pages: int = 15) -> DataFrame:
    """Each page file's likely title, from the largest lines of its first pages."""
    lines = page_lines(items).where(F.col("page") <= pages)
    return segment.pick_title(lines.withColumn("font_size", F.col("max_font_size")))


def parsed_books(spark: SparkSession, folder: str, prefix: str = "textbook-") -> DataFrame:
    """Parsed textbooks of a folder, the first file of each identity winning; total characters are filled in where missing.

    Files are in the order in which Chinese readers sort names.
    """
    books = spark.read.option("multiLine", True).option("pathGlobFilter", f"{prefix}*.json").json(folder).withColumn("file", T.basename(F.col("_metadata.file_path")))
    books = books.where(~F.col("file").endswith(".summary.json"))
    for name, kind in (("textbook_id", "string"), ("filename", "string"), ("total_chars", "bigint")):
        if name not in books.columns:
            books = books.withColumn(name, F.lit(None).cast(kind))
    identity = T.first_filled(F.col("textbook_id"), F.col("filename"), F.col("file"))
    counted = F.aggregate("chapters", F.lit(0).cast("bigint"), lambda s, c: s + F.coalesce(c["char_count"].cast("bigint"), F.length(c["content"]).cast("bigint"), F.lit(0).cast("bigint")))
    out = books.withColumn("identity", identity).withColumn("total_chars", F.coalesce("total_chars", counted))
    return graph.first_wins(out.withColumn("_order", F.collate("file", "zh")), ["identity"], "_order").drop("_order")


def graph_payloads(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Rows of node or edge files that are arrays or hold an array under one of ``keys``: file, pos, row (a variant)."""
    raw = spark.read.option("wholetext", True).text(folder).select(T.basename(F.col("_metadata.file_path")).alias("file"), F.try_parse_json("value").alias("v"))
    found = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *(F.try_variant_get("v", f"$.{k}", "array<variant>") for k in keys))
    return raw.select("file", F.posexplode(found).alias("pos", "row"))


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """Names and values of an environment file; comments and blank lines go, quotes around a value too.

    Spark passes over files whose names begin with a dot, so the file needs another name.
    """
    line = T.strip(F.col("value"))
    value = T.strip(F.regexp_extract(line, r"^(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=(.*)\z", 1))
    name = F.regexp_extract(line, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    return spark.read.text(path).where(~line.startswith("#")).select(name.alias("name"), F.regexp_replace(value, "^([\"'])(.*)\\1\\z", "$2").alias("value")).where("name != ''")


def chosen_books(spark: SparkSession, given: DataFrame | None = None, file: str | None = None, folder: str | None = None) -> DataFrame:
    """The books to work on: those given, else those of one file, else those of a folder; without any there is an error."""
    if given is not None:
        return given
    if file is not None:
        return spark.read.option("multiLine", True).json(file)
    if folder is not None:
        return parsed_books(spark, folder)
    raise TypeError("books, a file or a folder are required")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def graph_scan(spark: SparkSession, folder: str, scope: str = "latest", own: str = "integrated") -> tuple[DataFrame, DataFrame]:
    """Rows (file, pos, row) of the node and side files of a folder.

    ``source`` takes what books gave, ``integrated`` what integration wrote, ``latest`` the latter where it is there.
    """
    integrated = scope == "integrated" or scope != "source" and _exists(spark, f"{folder}/node/{own}.nodes.json")
    rows = [graph_payloads(spark, f"{folder}/{part}", *keys) for part, keys in (("node", ("nodes",)), ("side", ("relationships", "sides", "edges")))]
    mine = F.col("file").startswith(own)
    return tuple(r.where(mine if integrated else ~mine) for r in rows)


def knowledge_base(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of an index; an index that is missing or has none is an error."""
    if not _exists(spark, f"{folder}/chunks"):
        raise FileNotFoundError(f"there is no index in {folder}; build it first")
    chunks = spark.read.parquet(f"{folder}/chunks")
    if chunks.isEmpty():
        raise ValueError(f"the index in {folder} has no chunks; build it again")
    return chunks


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of an index, a row of counts; no rows where there is none."""
    schema = "textbook_count long, chapter_count long, indexed_chapter_count long, chunk_count long"
    return spark.read.schema(schema).json(f"{folder}/manifest") if _exists(spark, f"{folder}/manifest") else spark.createDataFrame([], schema)


def write_index(chunks: DataFrame, vectors: DataFrame, chapters: DataFrame, folder: str) -> None:
    """Chunks and vectors of an index, replacing what was there, and last the manifest that says so."""
    write_chunks(chunks, folder)
    write_vectors(vectors, folder)
    books = chapters.agg(F.count_distinct("book").alias("textbook_count"), F.count("*").alias("chapter_count"))
    done = chunks.agg(F.count_distinct("book", "chapter_id").alias("indexed_chapter_count"), F.count("*").alias("chunk_count"))
    books.join(done, F.lit(True)).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def add_vectors(vectors: DataFrame, folder: str) -> None:
    """More vectors for an index that is there; a vector of an id that is there already is left out."""
    known = vectors.sparkSession.read.parquet(f"{folder}/vectors").select("id")
    _normed(vectors.join(known, "id", "left_anti")).write.mode("append").parquet(f"{folder}/vectors")


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, stem: str) -> None:
    """A graph under its own name, and again as the latest one."""
    for name in (stem, "latest"):
        write_graph(nodes, edges, f"{folder}/{name}")


def write_integration(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, turns: DataFrame, folder: str) -> None:
    """All that integration leaves: the graph, its latest copy, and additions to the log and to the conversation."""
    write_snapshot(nodes, edges, folder, "integrated")
    append_log(decisions, f"{folder}/decisions")
    append_log(turns, f"{folder}/conversation")


def persist_uploads(files: DataFrame, folder: str) -> DataFrame:
    """Uploaded books (read_files) stored under names with a digest of their content: filename, ext, digest, content.

    Refused files fail the query. Returns what was stored.
    """
    digest = F.left(F.sha1(F.concat(F.col("filename").cast("binary"), F.col("content"))), F.lit(10))
    stored = require_supported(files).select(T.output_stem(F.col("filename")).alias("stem"), "filename", "ext", digest.alias("digest"), "content")
    stored.write.mode("append").parquet(f"{folder}/uploads")
    return files.sparkSession.read.parquet(f"{folder}/uploads").drop("content")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A session map that appears whole: written beside its place, then renamed into it."""
    spark = sessions.sparkSession
    part = f"{path}.{uuid.uuid4().hex}"
    sessions.write.json(part)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(hadoop(path), True)
    if not store.rename(hadoop(part), hadoop(path)):
        raise OSError(f"{path} could not be replaced")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph's nodes and edges as JSON, replacing what was there."""
    nodes.write.mode("overwrite").json(f"{folder}/node")
    edges.write.mode("overwrite").json(f"{folder}/side")


def append_log(rows: DataFrame, path: str) -> None:
    """Decisions or turns added to their log."""
    rows.write.mode("append").json(path)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")


def _normed(vectors: DataFrame) -> DataFrame:
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.withColumn("norm", F.sqrt(square))


def write_vectors(vectors: DataFrame, folder: str) -> None:
    """A vector table with norms worked out once, for exact search."""
    _normed(vectors).write.mode("overwrite").parquet(f"{folder}/vectors")


def report(overview: DataFrame, recent: DataFrame) -> DataFrame:
    """A Markdown report, a line a row: figures of a one-row overview, then the last decisions (seq, decision_id, action, affected_nodes, reason)."""
    figures = F.array(F.lit("# 整合报告"), F.lit(""), *(F.concat(F.lit(f"- {c}："), F.coalesce(F.col(c).cast("string"), F.lit("待整合后生成"))) for c in overview.columns), F.lit(""), F.lit("## 重点整合案例"), F.lit(""))
    said = F.concat(F.lit("- "), "decision_id", F.lit("："), "action", F.lit("，涉及 "), F.array_join("affected_nodes", ", "), F.lit("。理由："), F.coalesce("reason", F.lit("未记录")))
    last = recent.orderBy(F.desc("seq")).limit(5).agg(F.array_sort(F.collect_list(F.struct("seq", said.alias("line")))).alias("rows"))
    cases = F.when(F.size("rows") > 0, F.transform("rows", lambda r: r["line"])).otherwise(F.array(F.lit("- 当前尚未产生整合决策。")))
    return overview.join(last, F.lit(True)).select(F.posexplode(F.concat(figures, cases)).alias("pos", "value"))


def write_report(overview: DataFrame, path: str, recent: DataFrame | None = None) -> None:
    """The report as one text file."""
    spark = overview.sparkSession
    none = spark.createDataFrame([], "seq long, decision_id string, action string, affected_nodes array<string>, reason string")
    report(overview, none if recent is None else recent).coalesce(1).sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)
