import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm import queries as Q
from quire.llm import search as S


def brute(vectors, k, own):
    out = []
    for i, v in vectors:
        if i % own:
            continue
        scored = sorted((-int(np.dot(v, w)), j) for j, w in vectors if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.integers(-300, 300, (50, 37)).astype(float), rng.integers(-300, 300, (40, 37)).astype(float)
    exact = x @ y.T
    before = None
    for cuts in (*(S.cuts_of(np.ones(37), s) for s in S.LEVELS), S.finest(37), np.arange(37)):
        bound = S.summary(x, cuts) @ S.summary(y, cuts).T
        assert (bound >= exact - 1e-6).all()
        assert before is None or bound.sum() <= before + 1e-6
        before = bound.sum()
    assert S.cuts_of(np.array([8.0, 4, 2, 1, 1]), 2).tolist() == [0, 1] and S.cuts_of(np.zeros(4), 2).tolist() == [0, 2]


@pytest.mark.parametrize("scale", [1, 1 << 26])
def test_block_against_brute_force(scale, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 64)
    monkeypatch.setattr(S, "TILE", 16)
    monkeypatch.setattr(S, "PAIRS", 100)
    rng = np.random.default_rng(1)
    x = rng.integers(-4, 5, (300, 20)) * scale
    x[100:200] = x[5]  # many ties
    ids = rng.permutation(1000)[:300]
    search = S.Search(S.Block(ids[:70], x[:70], np.full(70, -np.inf)), 5)
    search.add(ids, x)
    got = sorted((int(ids[j]), int(i), int(s)) for j, s, i in zip(*search.settle(), strict=True))
    want = []
    for q in range(70):
        scored = sorted((-int(np.dot(x[q], w)), int(j)) for j, w in zip(ids, x, strict=True) if j != ids[q])
        want += [(int(ids[q]), j, -s) for s, j in scored[:5]]
    assert got == sorted(want)


def test_bounds_drop_most_pairs():
    """Of the pairs of a real table, nearly all are dropped before their product is worked out."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    x = np.floor(256 * np.stack(table["embedding"].to_list()).astype(float)).astype(np.int64)
    ids = table["vec_id"].to_numpy()
    own = ids % 50 == 0
    exact = x[own] @ x.T
    exact[ids[own][:, None] == ids[None, :]] = np.iinfo(np.int64).min
    few = exact[:, ids % S.FLOOR_PART == 1]
    assert 50 * len(few) == len(x)
    search = S.Search(S.Block(ids[own], x[own], np.sort(few, axis=1)[:, -5].astype(float)), 5)
    search.add(ids, x)
    j, score, _ = search.settle()
    assert (np.sort(exact, axis=1)[:, :-6:-1] == score.reshape(-1, 5)).all()
    print("pairs seen, dropped by bounds, exact:", search.seen, search.dropped, search.exact)
    assert search.seen == search.dropped + search.exact and search.dropped > 0.9 * search.seen


def test_query(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BYTES", 8 * 16 * 16)  # three blocks of queries
    rng = np.random.default_rng(2)
    raw = [(i, rng.normal(size=16).astype(float).tolist(), 1) for i in range(400)]
    raw[7] = (7, raw[8][1], 1)
    odd = [(500, None, 1), (501, [1.0, float("nan")] * 8, 1), (502, [float("inf")] * 16, 1), (503, [None] * 16, 1), (504, [], 1), (None, raw[0][1], 1), (510, [1.0, 2.0], 1), (520, [0.5, 0.25], 1)]
    df = spark.createDataFrame(raw + odd, "vec_id long, embedding array<double>, dim int")
    got = S.top_k(df, F.col("vec_id") % 10 == 0)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in raw] + [(510, np.array([256, 512])), (520, np.array([128, 64]))]
    assert sorted(map(tuple, got.collect())) == brute(fine, 5, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in S.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0)]
    assert S.top_k(df.where("false"), F.lit(True)).count() == 0


def test_the_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    fine = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float)).astype(int)) for r in rows if r["embedding"] is not None]
    assert sorted(map(tuple, Q.op5_topk(spark, folder).collect())) == brute(fine, 5, 50)


def test_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    raw = [(i, rng.normal(size=4000).round(2).tolist()) for i in range(60)]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<double>")
    want = brute([(i, np.floor(256 * np.array(v)).astype(int)) for i, v in raw], 5, 20)
    assert sorted(map(tuple, S.top_k(df, F.col("vec_id") % 20 == 0).collect())) == want
