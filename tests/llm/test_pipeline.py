import random

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

R = random.Random(12)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    out = [r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(out[k : k + 9]).capitalize() + "." for k in range(0, n, 9))


def junk(seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS).upper() + "!!###" for _ in range(60))


ITEM = prose(40, 1).replace("\n", " ")


def tables(spark, folder, docs, schema="doc_id long, text string, lang string, source string, n_chars int, score double, th string, Tokens int"):
    spark.createDataFrame([(d, t, "en", "s", 1, 0.5, "x", 2) for d, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(9, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d, 0 if "###" in (t or "") else 1, 0) for d, t in docs if d is not None and d < 900]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows():
    out = [(k, prose(R.randint(60, 200), 100 + k)) for k in range(120)] + [(k, junk(k)) for k in range(200, 260)]
    out += [(500 + k, out[5][1]) for k in range(40)]  # copies
    out += [(600 + k, out[7][1] + f" near{k}") for k in range(40)]  # near copies
    out += [(700 + k, prose(90, 900 + k) + "\n" + ITEM + "\n" + prose(50, 950 + k)) for k in range(8)]  # leaks
    out += [(800, prose(80, 5) + "\nWrite to hein.19@mail5.example.com or call 212-555-0142."), (800, prose(80, 6))]
    return [*out, (1000, None), (1001, ""), (None, prose(70, 7)), (None, prose(70, 7)), (3, out[3][1]), (1002, (prose(900, 8) + "\n") * 30)]


def test_stages(spark, tmp_path):
    folder = tables(spark, f"file:{tmp_path}", rows())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, found = docs.columns, {}
    for k, (name, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, folder)
        if k + 1 < len(C.STAGES):
            assert docs.columns == columns, name
            docs.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
            found[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good, unique, clean, private = (found[n] for n, _ in C.STAGES[:4])
    ids = lambda pairs: {d for d, _ in pairs}
    junk_ids = set(range(200, 260))
    assert len(junk_ids & ids(good)) <= 3 and len(set(range(120)) - ids(good)) <= 3
    copies, near = ids(unique) & {5, *range(500, 540)}, ids(unique) & {7, *range(600, 640)}
    assert copies == {5} and near == {7} and sum(d == 3 for d, _ in unique) == 1
    assert set(range(120)) & ids(good) == set(range(120)) & ids(unique)
    assert ids(unique) - ids(clean) == set(range(700, 708)) & ids(unique)
    assert ids(clean) == ids(private) and len(clean) == len(private)
    text = next(t for d, t in private if d == 800 and "Write to" in (t or ""))
    assert "hein.19" not in text and "212-555-0142" not in text and "@mail5.example.com" in text
    packed = docs.collect()
    totals = {}
    for p in packed:
        totals[p["doc_id"]] = totals.get(p["doc_id"], 0) + p["length"]
    assert ids(private) == set(totals)
    again = C.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in again} == totals


@pytest.mark.parametrize("docs", [[], [(None, None)], [(1, "")], [(None, "one line"), (1, None), (1, None)]])
def test_small_tables(spark, tmp_path, docs):
    folder = tables(spark, f"file:{tmp_path}", docs)
    got = C.run(spark, folder).collect()
    assert len(got) <= len(docs) and all(r["length"] >= 1 for r in got)


def test_stage_names_and_sql():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"] and C.ORACLE_SQL is None
