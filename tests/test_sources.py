import io
import json
import zipfile

import pytest

from pyspark.sql import functions as F

from quire.functions import adapters
from quire.operators import library
from quire.sources import files


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}Heading1{chr(34)}/></w:pPr>' if h else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for h, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx(sheets):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_all_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("第一章 绪论\n正文一\n第二章 细胞\n正文二")
    (tmp_path / "b.md").write_text("# 书\n## 第一章 绪论\n正文")
    (tmp_path / "c.docx").write_bytes(docx([(True, "第一章 血液"), (False, "正文"), (True, "第二章 循环"), (False, "正文")]))
    (tmp_path / "d.xlsx").write_bytes(xlsx([("表一", [["a", "b"], ["", "c"]]), ("表二", [["x"]])]))
    (tmp_path / "e.csv").write_text("a,b\n,\n1,2\n")
    (tmp_path / "f.png").write_bytes(b"x")
    (tmp_path / "g.txt").write_text("")
    found = files.read_files(spark, str(tmp_path))
    assert {r["filename"]: r["problem"] for r in found.where("problem is not null").collect()} == {"f.png": files.UNSUPPORTED, "g.txt": files.EMPTY} and found.count() == 7
    assert files.read_files(spark, str(tmp_path / "a.txt"), 5).first()["problem"] == files.TOO_LARGE
    got = {}
    for r in files.chapters(found).orderBy("path", "chapter_idx").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["title"], r["content"]))
    assert [t for t, _ in got["a.txt"]] == ["第一章 绪论", "第二章 细胞"]
    assert [t for t, _ in got["c.docx"]] == ["第一章 血液", "第二章 循环"]
    assert got["d.xlsx"] == [("表一", "a | b\nc"), ("表二", "x")]
    assert got["e.csv"] == [("Sheet1", "a | b\n1 | 2")]
    with pytest.raises(Exception, match="Unsupported textbook format|empty"):
        files.require_supported(found).collect()


def test_addresses():
    assert files.resolve(" /x.md ")["address"] == "/x.md"
    assert files.resolve({"filePath": "/y", "textbookId": "t"})["textbook_id"] == "t"
    for bad in ({}, {"url": " "}, 3):
        with pytest.raises(TypeError):
            files.resolve(bad)


def test_parsed_books_and_graphs(spark, tmp_path):
    chapter = {"chapter_id": "ch_01", "content": "abc", "char_count": None}
    for name, book in (("textbook-1.json", {"textbook_id": "t", "chapters": [chapter, chapter | {"char_count": 10}]}), ("textbook-2.json", {"textbook_id": "t", "total_chars": 99, "chapters": [chapter]}), ("textbook-3.summary.json", {"textbook_id": "s", "chapters": []})):
        (tmp_path / name).write_text(json.dumps(book, indent=1))
    got = files.parsed_books(spark, str(tmp_path)).collect()
    assert [(r["identity"], r["total_chars"]) for r in got] == [("t", 13)]
    node = tmp_path / "node"
    node.mkdir()
    (node / "a.json").write_text(json.dumps([{"id": "x"}]))
    (node / "b.json").write_text(json.dumps({"nodes": [{"id": "y"}, {"id": "z"}]}))
    assert files.graph_payloads(spark, str(node), "nodes").count() == 3


def test_env_and_sinks(spark, tmp_path):
    (tmp_path / "env.txt").write_text("# c\nA=1\nexport B='x y'\n\nC=\"z\"\n")
    assert {r["name"]: r["value"] for r in files.read_env(spark, str(tmp_path / "env.txt")).collect()} == {"A": "1", "B": "x y", "C": "z"}
    n = spark.createDataFrame([("a",)], "id string")
    files.write_graph(n, n, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/node")).count() == 1
    files.append_log(n, str(tmp_path / "log"))
    files.append_log(n, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    files.write_vectors(spark.createDataFrame([("a", [3.0, 4.0])], "id string, vector array<double>"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "vectors")).first()["norm"] == 5.0
    files.write_report(spark.sql("select 1 as nodes"), str(tmp_path / "r"))
    assert "- nodes：1" in "".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "r")).collect())


def test_adapters(spark):
    df = spark.createDataFrame([(str(i), "x" * i) for i in range(40)], "id string, text string")
    got = {r["id"]: r["vector"] for r in adapters.embed(df, lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got["7"] == [7.0]
    assert adapters.first_json_object('say ```json\n{"a": "}"}\n``` end') == {"a": "}"}
    assert adapters.first_json_object('x {"a": {"b": 1}} y') == {"a": {"b": 1}}
    assert adapters.first_json_object("none") is None
    sent = []

    def send(request):
        sent.append(request)
        if "max_tokens" in request:
            raise ValueError("unsupported parameter")
        return "ok"

    c = adapters.Client("http://h/", "secret", "m", send)
    assert "secret" not in str(c.described()) and c.complete("hi", temperature=0.5, max_tokens=10) == "ok"
    assert len(sent) == 2 and sent[1]["max_completion_tokens"] == 10
    for bad in ({"temperature": 3}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            c.complete("hi", **bad)
    with pytest.raises(TypeError):
        c.complete(" ")


def test_prompts_and_callbacks(spark, tmp_path):
    chapters = spark.createDataFrame([("b", "c1", "第一章", 3, "正文 " * 9000)], "book string, chapter_id string, title string, page_start int, content string")
    asked = adapters.extraction_prompts(chapters).first()
    assert asked["user"].startswith("Book: b\nChapter: 第一章\nFirst page: 3") and len(asked["user"]) < 9200
    heard = str(tmp_path / "heard")

    def hear(row, payload=None):
        with open(heard, "a") as f:
            f.write(f"{row['chapter_id']}:{payload is not None}\n")

    got = adapters.extract(chapters, lambda r: {"nodes": [{"name": r["title"]}]}, hear, hear).first()
    assert json.loads(got["payload"]) == {"nodes": [{"name": "第一章"}]} and open(heard).read() == "c1:False\nc1:True\n"
    q = spark.createDataFrame([("q", "what?"), ("r", "none")], "query_id string, query string")
    found = spark.createDataFrame([("q", 2, "[b, 2]", "two"), ("q", 1, "[a, 1]", "one")], "query_id string, rank int, source_ref string, text string")
    said = {r["query_id"]: r["user"] for r in adapters.answer_prompts(q, found).collect()}
    assert said == {"q": "Question: what?\n\n[a, 1]\none\n\n[b, 2]\ntwo", "r": "Question: none\n\n"}
    assert adapters.in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]) == [[1.0], [2.0]]
    answered = adapters.answer(spark.createDataFrame([("q", "what?", ["a"])], "query_id string, query string, chunks array<string>"), lambda query, chunks: f"{query} {chunks[0]}").first()
    assert answered["answer"] == "what? a"


def test_web_books(spark):
    pages = {"http://h/a.txt": b"x", "http://h/b": b"%PDF", "http://h/c.txt": b"", "http://h/d": b"y"}
    asked = []

    def get(path):
        if path not in pages:
            raise OSError("404")
        return pages[path]

    df = spark.createDataFrame([(p,) for p in [*pages, "http://h/e.txt"]], "path string").coalesce(1)
    got = {r["path"][-5:]: (r["ext"], r["problem"]) for r in files.fetched(df, get, lambda p: "application/PDF" if p.endswith("b") else "image/png").collect()}
    assert got["a.txt"] == (".txt", None) and got["//h/b"] == (".pdf", None) and got["c.txt"] == (None, files.EMPTY)
    assert got["//h/d"] == (None, files.UNSUPPORTED) and got["e.txt"][1].startswith("unreadable")


def test_scans_by_scope(spark, tmp_path):
    for part, name, rows in (("node", "a.nodes.json", [{"id": "x", "name": "1"}, {"node_id": "y", "label": " Y  y "}, {"title": "z"}]), ("node", "b.nodes.json", {"nodes": [{"id": "x", "name": "2"}]}), ("side", "a.sides.json", {"sides": [{"source": "x", "target": "y", "type": "contains"}, {"source": "x", "target": ""}, {"source": "x", "target": "gone"}]})):
        (tmp_path / part).mkdir(exist_ok=True)
        (tmp_path / part / name).write_text(json.dumps(rows))
    nodes, sides = library.source_graph(*files.graph_scan(spark, str(tmp_path), "source"))
    got = {r["id"]: r for r in nodes.collect()}
    assert set(got) == {"x", "y", "a_nodes_node_003"} and got["x"]["name"] == "1" and got["y"]["name"] == "Y y"
    assert (got["y"]["category"], got["y"]["categories"], got["y"]["chapters"], got["y"]["frequency"], got["y"]["page"]) == ("核心概念", ["核心概念"], [], 1.0, None)
    assert [(r["source"], r["target"], r["relation_type"]) for r in sides.orderBy("pos").collect()] == [("x", "y", "contains"), ("x", "gone", "parallel")]
    shown, edges = library.shown_graph(library.normalised_nodes(files.graph_scan(spark, str(tmp_path), "latest")[0]), sides.withColumn("id", F.lit(None).cast("string")))
    assert shown.where("id = 'x'").first()["name"] == "2"
    assert [(r["target"], len(r["id"])) for r in edges.collect()] == [("y", 12)]
    (tmp_path / "node/integrated.nodes.json").write_text(json.dumps([{"id": "m"}]))
    (tmp_path / "side/integrated.sides.json").write_text("[]")
    assert [r["n"] for r in files.graph_scan(spark, str(tmp_path))[0].selectExpr("count(*) n").collect()] == [1]
    assert files.graph_scan(spark, str(tmp_path), "source")[0].count() == 4


def test_index_and_log(spark, tmp_path):
    folder = str(tmp_path)
    assert library.index_status(files.manifest(spark, folder)).first()["indexed"] is False
    with pytest.raises(FileNotFoundError):
        files.knowledge_base(spark, folder)
    chunks = spark.createDataFrame([("k1", "b", "c1", "text")], "id string, book string, chapter_id string, text string")
    files.write_index(chunks, spark.createDataFrame([("k1", [3.0, 4.0])], "id string, vector array<double>"), chunks.select("book", "chapter_id"), folder)
    files.add_vectors(spark.createDataFrame([("k1", [0.0, 1.0]), ("k2", [6.0, 8.0])], "id string, vector array<double>"), folder)
    assert sorted((r["id"], r["norm"]) for r in spark.read.parquet(folder + "/vectors").collect()) == [("k1", 5.0), ("k2", 10.0)]
    assert files.knowledge_base(spark, folder).count() == 1
    assert tuple(library.index_status(files.manifest(spark, folder)).first()) == (True, 1, 1, 1, 1)
    files.write_chunks(chunks.where("false"), folder)
    with pytest.raises(ValueError):
        files.knowledge_base(spark, folder)
    n = spark.createDataFrame([("a",)], "id string")
    for _ in range(2):
        files.write_integration(n, n, n, n, folder + "/out")
    count = lambda part: spark.read.json(f"{folder}/out/{part}").count()
    assert [count(p) for p in ("integrated/node", "latest/side", "decisions", "conversation")] == [1, 1, 2, 2]
    assert tuple(library.integration_status(n, n, n.where("false")).first()) == (True, 1, 0)
    for k in (1, 2):
        files.write_sessions(spark.createDataFrame([(f"c{k}", k)], "chat_id string, session int"), folder + "/sessions")
    assert [r["chat_id"] for r in spark.read.json(folder + "/sessions").collect()] == ["c2"] and not list(tmp_path.glob("sessions.*"))
    log = spark.createDataFrame([(k, f"keep_{k}", "keep", ["a", "b"], None if k == 7 else f"r{k}") for k in range(1, 8)], "seq int, decision_id string, action string, affected_nodes array<string>, reason string")
    files.write_report(spark.sql("select 1 as nodes, cast(null as int) as chars"), folder + "/report", log)
    lines = [r[0] for r in spark.read.text(folder + "/report").collect()]
    assert lines[2:4] == ["- nodes：1", "- chars：待整合后生成"] and lines[-1] == "- keep_7：keep，涉及 a, b。理由：未记录" and lines[-5].startswith("- keep_3")


def test_uploads_and_choice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/第一 本(1).txt").write_text("x")
    got = files.persist_uploads(files.read_files(spark, str(tmp_path / "in")), str(tmp_path)).first()
    assert (got["stem"], got["ext"], len(got["digest"])) == ("第一_本_1_", ".txt", 10)
    (tmp_path / "in/e.txt").write_text("")
    with pytest.raises(Exception, match="empty"):
        files.persist_uploads(files.read_files(spark, str(tmp_path / "in")), str(tmp_path))
    (tmp_path / "textbook-1.json").write_text(json.dumps({"textbook_id": "t", "chapters": [{"chapter_id": "c", "content": "x", "char_count": 1}]}))
    given = spark.range(1)
    assert files.chosen_books(spark, given, "nowhere") is given
    assert files.chosen_books(spark, None, str(tmp_path / "textbook-1.json"), "nowhere").first()["textbook_id"] == "t"
    assert files.chosen_books(spark, folder=str(tmp_path)).first()["identity"] == "t"
    with pytest.raises(TypeError):
        files.chosen_books(spark)
