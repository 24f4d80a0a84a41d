import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import quality as Q
from quire.llm import queries

R = random.Random(4)


def good():
    return "\n".join(" ".join("".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(R.randint(5, 20))).capitalize() + "." for _ in range(R.randint(1, 6)))


def bad():
    kind = R.randrange(4)
    words = ["".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    return (" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + R.choice(("###", "%%%", "$$$")) for w in words), " ".join([words[0]] * 30))[kind]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 4])
    unary, turn = rng.normal(size=8), rng.normal(size=(2, 2))
    p, expected, constant = Q.marginals(unary, turn, sizes)
    at, total, want, turns = 0, 0.0, [], np.zeros((2, 2))
    for n in sizes:
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = np.exp(sum(unary[at + k] * v for k, v in enumerate(y)) + sum(turn[a, b] for a, b in itertools.pairwise(y)))
        z = sum(weights.values())
        total += np.log(z)
        want += [sum(w for y, w in weights.items() if y[k]) / z for k in range(n)]
        for y, w in weights.items():
            for a, b in itertools.pairwise(y):
                turns[a, b] += w / z
        at += n
    assert np.allclose(p, want) and np.allclose(expected, turns) and np.isclose(constant, total)


def test_posteriors_are_the_marginals(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 400, 1000, 2, 130])
    unary, turn = 6 * rng.normal(size=sizes.sum()), 2 * rng.normal(size=(2, 2))
    first = np.isin(np.arange(len(unary)), np.cumsum(sizes) - sizes)
    want = Q.marginals(unary, turn, sizes)[0]
    assert np.allclose(Q.posteriors(unary, turn, first), want, atol=1e-12)
    monkeypatch.setattr(Q, "WINDOW_LINES", 3 * Q.BLOCK_LINES)
    assert np.allclose(Q.posteriors(unary, turn, first), want, atol=1e-12)


def test_a_long_text_scores_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(2)
    model = Q.Model(rng.normal(size=Q.FEATURES) / 3, rng.normal(size=(2, 2)), 4.0, -2.0)
    raw = ("\n".join(bad() if R.random() < 0.5 else good() for _ in range(300)) + "\n" + "long line " * 500 + "\n\n").encode()
    data = np.frombuffer(raw, np.uint8)
    want = model.documents(data, np.array([0, len(data)]))
    monkeypatch.setattr(Q, "SLICE", 1000)
    assert b"".join(p.tobytes() for p in Q._parts(data, 1000)) == raw
    assert np.allclose(model.documents(data, np.array([0, len(data)])), want, atol=1e-6)


def test_millions_of_lines(spark):
    docs = spark.createDataFrame([(1, "\n" * 4_000_000), (2, "x" * 3_000_000), (3, good())], "doc_id long, text string").repartition(1)
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels), keep=["doc_id"]).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)


def test_learning_is_bounded_under_repeats(spark):
    docs = spark.createDataFrame([(4, bad() + f" {i}") for i in range(500)] + [(1, "\n".join(good() for _ in range(200)))], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 0), (1, 1)], "doc_id long, quality int")
    seen = []
    fit, Q.fit = Q.fit, lambda chains, *rest: seen.append([len(c) for c in chains]) or fit(chains, *rest)
    try:
        Q.train(docs, labels, lines=20)
    finally:
        Q.fit = fit
    assert len(seen[0]) == 2 and max(seen[0]) == 20
    assert {Q._place(d, 100, 20) for d in range(2000)} == set(range(81)) and Q._place(1, 20, 20) == 0


def test_line_features():
    texts = ["Plain line here.\nSHOUT!! NOW!!\n", "\n", "a a a a\nx | y | z\n"]
    x, weight, doc = Q.line_features(*Q._bytes_of(pa.array(texts)))
    assert doc.tolist() == [0, 0, 1, 2, 2] and weight.tolist() == [17, 14, 1, 8, 10]
    assert x[1, 5] == 1.0 and x[1, 1] == 1.0 and x[3, 13] == 0.75 and x[4, 4] > 0 and x[2, 10] == 1
    assert (x[0, Q._OWN : Q._OWN + 3] == 0).all() and x[1, Q._OWN] == x[0, 1]


def test_held_out_accuracy(spark):
    rows = [(i, (good() + "\n" if R.random() < 0.3 else "") + (bad() if i % 4 == 0 else good()), i % 4 != 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "l", 1.0) for i, t, _ in rows], "doc_id long, text string, lines string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    model = Q.train(docs, labels, sample=150)
    scored = Q.score(docs, model, name="p").withColumn("h", Q.held_out(F.col("doc_id"))).collect()
    right = [(r["p"] >= Q.THRESHOLD) == (r["doc_id"] % 4 != 0) for r in scored if r["h"]]
    assert len(right) > 80 and np.mean(right) > 0.95 and all(0 <= r["p"] <= 1 for r in scored)
    again = Q.score(docs, Q.train(docs, labels, sample=150), name="p").collect()
    assert [r["p"] for r in again] == [r["p"] for r in scored]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a line"), (4, "x\n" * 5000), (4, "x\n" * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.score(docs, Q.train(docs, none))
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 5
    one = Q.train(docs, spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, quality int"))
    assert all(r["score"] < 0.5 for r in Q.score(docs, one, keep=["doc_id"]).collect())
    assert Q.score(docs.where("false"), one).count() == 0


def test_the_query_by_brute_force(spark):
    """Scores of a whole table from each document's chain alone, walked line by line; and the rule for held-out ids."""
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    model = Q.train(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, folder).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        x, weight, _ = Q.line_features(*Q._bytes_of(pa.array([text + "\n"])))
        unary = x.astype(float) @ model.weights
        good, bad = [unary[0]], [0.0]  # logarithms of forward sums
        for u in unary[1:]:
            a, b = bad[-1], good[-1]
            bad.append(np.logaddexp(a + model.turn[0, 0], b + model.turn[1, 0]))
            good.append(u + np.logaddexp(a + model.turn[0, 1], b + model.turn[1, 1]))
        after = [(0.0, 0.0)]
        for u in unary[:0:-1]:
            a, b = after[-1]
            after.append((np.logaddexp(model.turn[0, 0] + a, model.turn[0, 1] + u + b), np.logaddexp(model.turn[1, 0] + a, model.turn[1, 1] + u + b)))
        p = [1 / (1 + np.exp(f0 + b0 - f1 - b1)) for f0, f1, (b0, b1) in zip(bad, good, after[::-1], strict=True)]
        score = 1 / (1 + np.exp(-(model.slope * (p @ weight / weight.sum()) + model.shift)))
        r = got[d]
        assert abs(r["score"] - score) < 1e-5 and (abs(score - Q.THRESHOLD) < 1e-5 or r["predicted"] == (score >= Q.THRESHOLD))
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
