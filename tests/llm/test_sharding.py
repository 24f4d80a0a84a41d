import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import queries as Q
from quire.llm import sharding as S

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_place_prefers_residual_capacity():
    loads = np.array([[10, 1, 1], [10, 1, 1], [1, 10, 1], [1, 10, 1]], float)
    got = S.place(loads, 2)
    assert sorted(np.bincount(got, loads[:, 0])) == [11, 11]
    assert len(S.place(np.zeros((0, 3)), 4)) == 0 and set(S.place(np.zeros((5, 3)), 4)) <= {0, 1, 2, 3}


def test_level_evens_all_measures():
    rng = np.random.default_rng(3)
    loads = rng.lognormal(0, 1, (2000, 3)) * [1000, 200, 1]
    full = np.stack([np.bincount(S.place(loads, 8), loads[:, c], 8) for c in range(3)], axis=1)
    assert (np.abs(full / full.mean(axis=0) - 1) < 0.005).all()


def rows():
    rng = np.random.default_rng(0)
    out = [(i, "w " * int(rng.integers(1, 60)) + str(i), 1) for i in range(1500)]
    out += [(5000 + i, "hot text of many copies", 1) for i in range(900)]
    out += [(7000 + i, "a few copies", 1) for i in range(5)]
    return [*out, (8000, None, 1), (8001, "", 1), (None, "no id", 1), (3, out[3][1], 1), (8002, "long " * 3000, 1)]


def test_shards(spark):
    all_rows = rows()
    got = S.shard(spark.createDataFrame(all_rows, "doc_id long, text string, shard int"), 8).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d or 0, size(t), zlib.crc32((t or "").encode())) for d, t, _ in all_rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 8 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    full = np.bincount([r["shard"] for r in got], [r["size"] for r in got])  # one text is most of a shard, so rows can't be equal too
    assert full.max() < 1.02 * full.mean() and full.min() > 0.98 * full.mean()
    where = {r["doc_id"]: r["shard"] for r in got}
    assert len({where[7000 + i] for i in range(5)}) == 1 and len({where[5000 + i] for i in range(900)}) > 1
    again = S.shard(spark.createDataFrame(all_rows[::-1], "doc_id long, text string, shard int"), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_hot_id_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 50)
    r = random.Random(1)
    all_rows = [(7, "the same text") for _ in range(900)] + [(7, f"text {k} " * r.randint(1, 30)) for k in range(500)] + [(None, f"no id {k}") for k in range(500)] + [(8, "word " * 400_000)]
    got = S.shard(spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3), 4, PATH).collect()
    slots = {}
    for x in got:
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert len(got) == len(all_rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = np.bincount([x["shard"] for x in got if x["text_crc32"] == zlib.crc32(b"the same text")], minlength=4)
    assert copies.max() < 450
    assert next(x["tokens"] for x in got if x["doc_id"] == 8) == 400_000


def test_the_query_by_brute_force(spark):
    """Every figure of every row, and the law of the query, over the whole table."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = Q.op9_sharding(spark, folder).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode()), len(library.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["tokens"]) for r in got) == want
    assert {r["law"] for r in got} == {"bytes"} and {r["shard"] for r in got} == set(range(24))
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    largest = max(r["size"] for r in got)
    for measure in (lambda r: r["size"], lambda r: r["tokens"], lambda r: 1):
        full = np.bincount([r["shard"] for r in got], [measure(r) for r in got], 24)
        assert full.max() - full.min() < 0.02 * full.mean() + largest / 10
    texts = {d["doc_id"]: d["text"] for d in docs}
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    copies = {}
    for d in docs:
        copies[d["text"]] = copies.get(d["text"], 0) + len(d["text"]) + 8
    half = sum(copies.values()) / 48
    assert all(len(s) == 1 for t, s in where.items() if copies[t] < 0.5 * half)
