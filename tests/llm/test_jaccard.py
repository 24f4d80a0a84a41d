import random

import numpy as np
import pytest

from quire.llm import jaccard as J
from quire.llm.components import components

R = random.Random(3)


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(r.randint(0, 300)) for _ in range(n)]


def corpus():
    rows, k = [], 0
    for g in range(12):
        base = words(R.randint(30, 150), g)
        for _ in range(R.randint(1, 12)):
            copy = list(base)
            for _ in range(R.randint(0, 4)):
                copy[R.randrange(len(copy))] = "edit" + str(R.randint(0, 9))
            rows.append((k, " ".join(copy)))
            k += 1
    return [*rows, (k, rows[0][1]), (k + 1, rows[0][1].upper() + " ,"), (k + 2, None), (k + 3, ""), (k + 4, "one two"), (k + 5, "One, two"), (None, rows[3][1]), (k + 6, "!!")]


def brute(rows):
    sets = [frozenset(J.shingles(t or "").tolist()) for _, t in rows]
    classes = {s: [i for i, x in enumerate(sets) if x == s] for s in set(sets) if s}
    links = {s: {o for o in classes if o != s and len(s & o) >= 0.8 * len(s | o)} for s in classes}
    group = {}
    for s in classes:
        seen, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        group[s] = seen
    least = lambda many: min((rows[i][0] for s in many for i in classes[s] if rows[i][0] is not None), default=None)
    return [(d, least(group[s]) if s else d, least([s]) if s else d, len(classes[s]) if s else 1, len(links[s]) if s else 0) for (d, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("block", [1024, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BUCKET_BLOCK", block)
    monkeypatch.setattr(J, "GROUP_BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, c int, root string")
    got = J.near_duplicates(df).select("doc_id", "class_id", "copy_id", "n_copies", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in [*rows, rows[1], rows[1]]], "doc_id long, text string, th int, kept_id string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    want = {r[1] for r in brute(rows)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(none).count() == 0 and J.keep_one(none).count() == 0


def test_pruning_bounds():
    needed = J.least_matches(0.8, 1e-5)
    assert needed[0] == 0 and all(a <= b for a, b in zip(needed[J.STEP :], needed[J.STEP + 1 :], strict=False))
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = np.mean(J.signature(a) == J.signature(a[:900]))
    assert 0.75 < same < 1
    rng, lost = np.random.default_rng(1), 0
    for _ in range(200):  # pairs just at the threshold survive
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        s, t = J.signature(x[:810]), J.signature(x[90:])
        lost += len(J.survivors(s[None], t[None], False, needed)[0]) == 0
    assert lost <= 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["a"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[103]} == {100} and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    i, j = np.tril_indices(12, -1)
    many, few = J.overlaps(sets, i, j), [J.overlaps(sets, i[k : k + 1], j[k : k + 1])[0] for k in range(len(i))]
    assert many.tolist() == few


def test_keep_one_names_groups_by_their_texts(spark):
    """Equal ids on unlinked texts don't merge groups; near copies without ids are one group."""
    words = [f"w{k}" for k in range(400)]
    long = lambda a: " ".join(words[a : a + 60])
    rows = [(1, long(0)), (1, long(100)), (2, long(100) + " more"), (None, long(200)), (None, long(200) + " x"), (None, long(200) + " y"), (None, long(300)), (3, None), (4, "")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in kept) == sorted([("1", "w0 w1"), ("1", "w100 "), ("None", "w200 "), ("None", "w300 "), ("3", "None"), ("4", "")])


def test_very_long_texts(spark):
    words = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, words), (2, words + " end"), (3, "x" * 2_000_000), (4, "one two three four five six")]
    got = {r["doc_id"]: r for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["class_id"] for k in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1]["n_links"] == 1
