import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import decontaminate as D
from quire.llm import queries as Q

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if r.random() < 0.1 else "") for _ in range(n))


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_lcs(a, b):
    n, used = D.lcs(a, b)
    assert n == brute(a, b) == sum(used)
    kept = iter(b)
    assert all(x in kept for x, u in zip(a, used, strict=True) if u)


def test_word_ids():
    assert list(D.ids_of("A b_1, É-a a")) == [D.ids_of(w)[0] for w in ("a", "b_1", "é", "a", "a")]
    assert len(D.ids_of("")) == 0 and len(D.ids_of(" .,")) == 0
    assert len(set(D.ids_of(" ".join(VOCABULARY)).tolist())) == len(set(VOCABULARY))


def test_leaks(spark):
    items = [(k, prose(n, 1000 + k)) for k, n in enumerate((16, 20, 30, 45, 59))]
    docs = [(i, prose(R.randint(1, 400), i)) for i in range(300)]
    want = set()
    for k, (item, text) in enumerate(items * 3):
        words = prose(200, 2000 + k).split(" ")
        at = 7 * k
        docs.append((1000 + k, " ".join([*words[:at], text, *words[at:]])))
        want.add((1000 + k, item))
    paraphrase = items[4][1].split(" ")
    for k in range(4, 40, 9):
        paraphrase[k] = "zzz"
    docs += [(2000, prose(50, 9) + " " + " ".join(paraphrase)), (2001, None), (2002, ""), (2003, items[3][1]), (2003, items[3][1]), (None, items[3][1])]
    want |= {(2000, 4), (2003, 3), (None, 3)}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, word int, th string")
    bench = spark.createDataFrame([*items, (90, None), (91, "too short"), (None, items[0][1])], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == 302
    assert not {r["doc_id"] for r in kept.collect()} & {d for d, _ in want}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a text of some words here")], "doc_id long, text string")
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, bench).count() == 0 and D.leaks(none, bench).count() == 0
    assert D.leaks(none, bench.unionByName(spark.createDataFrame([(1, prose(30, 1))], "item_id long, text string"))).count() == 0


def test_leaks_at_the_limit(spark):
    """Paraphrases that keep just enough words, wherever they begin, and short items word for word."""
    r = random.Random(11)
    items, docs, want = [(100, "abc def gea bhi cej")], [(i, prose(r.randint(100, 400), 5000 + i)) for i in range(200)], set()
    for m in range(17, 29):
        own = [f"{r.choice(VOCABULARY)}{k if k % 3 else ''}" for k in range(m)]
        items.append((m, " ".join(own)))
        answer = m - -(-m // 3)
        keep = -(-3 * m // 5) - (m - answer)
        kept = {*r.sample(range(answer), keep), *range(answer, m)}
        for at in (12, 8, 0):
            text = [w if k in kept else "zzz" for k, w in enumerate(own)]
            around = prose(200, 9000 + m).replace(".", "").split(" ")
            docs.append((1000 + 20 * m + at, " ".join([*around[: 48 + at], *text, *around[48 + at :]])))
            want.add((1000 + 20 * m + at, m))
    docs += [(9001, prose(70, 3) + " abc def gea bhi cej " + prose(30, 4)), (9002, prose(70, 3) + " abc def gea bhi zzz cej " + prose(30, 4)), (9003, "abc")]
    want.add((9001, 100))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(f["doc_id"], f["item_id"]) for f in found} == want


def corpus(spark):
    """Documents of a real table, with copies of passages and with common words, and its benchmark."""
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")


def changed(words, kind, r, filler):
    words, m = list(words), len(words)
    if kind == "replaced":
        for k in r.sample(range(m), m * 3 // 10):
            words[k] = r.choice(filler)
    elif kind == "dropped":
        for k in sorted(r.sample(range(m), m // 4), reverse=True):
            del words[k]
    elif kind == "inserted":
        for _ in range(m // 4):
            words.insert(r.randrange(len(words)), r.choice(filler))
    elif kind == "moved":
        n = max(1, m // 6)
        k = r.randrange(m - n)
        part = words[k : k + n]
        del words[k : k + n]
        k = r.randrange(len(words))
        words[k:k] = part
    return words


def test_recall(spark):
    """Copies and paraphrases that the acceptance rule takes anywhere in a document, planted among real documents."""
    docs, bench = corpus(spark)
    r = random.Random(3)
    rows = [(x["doc_id"], x["text"]) for x in docs.collect() if x["text"]]
    filler = [w for _, t in rows[:50] for w in t.split()]
    items = [D.item_of(x["item_id"], x["text"]) for x in bench.collect()]
    plain = {x["item_id"]: x["text"].split() for x in bench.collect()}
    planted, want = [], {}
    for kind in ("copied", "replaced", "dropped", "inserted", "moved"):
        for item in items:
            around = r.choice(rows)[1].split()[: r.randrange(40, 300)]
            at = r.randrange(len(around))
            text = " ".join([*around[:at], *changed(plain[item.item_id], kind, r, filler), *around[at:]])
            words = D.ids_of(text)
            share, answer = D._check(item, words, 0, len(words))
            if share >= D.CLEAR or share >= D.PARAPHRASE and answer >= D.ANSWER:
                want.setdefault(kind, set()).add((10_000_000 + len(planted), item.item_id))
            planted.append((10_000_000 + len(planted), text))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in D.leaks(df, bench).collect()}
    recall = {kind: len(pairs & got) / len(pairs) for kind, pairs in want.items()}
    print("recall", {k: (round(v, 3), len(want[k])) for k, v in recall.items()})
    assert recall["copied"] >= 0.98 and min(recall.values()) >= 0.9


def test_the_cosine_search_selects(spark):
    """Few pairs of passages and items are candidates, and all that is reported comes from them."""
    docs, bench = corpus(spark)
    seen = {}
    searched, D._searched = D._searched, lambda stored, queries, table, *rest: seen.update(q=queries, t=table) or searched(stored, queries, table, *rest)
    try:
        found = D.leaks(docs, bench).collect()
    finally:
        D._searched = searched
    texts = [x["text"] or "" for x in docs.collect()]
    words = [D.ids_of(t) for t in texts]
    ids, counts = np.concatenate(words), np.array([len(w) for w in words])
    units = -(-counts // D.UNIT)
    pairs = sum(len(D._places(units, q.size, q.step)[0]) * len(q.items) for q in seen["q"])
    taken = sum(len(doc) for _, doc, _, _ in D.candidates(ids, counts, seen["q"], seen["t"]))
    assert taken < 0.02 * pairs and found and all(f["cosine"] >= D.COSINE for f in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), min_size=1, max_size=8), st.integers(3, 60))
def test_passages_cover_every_word(counts, m):
    size, step = D._shape(m)
    units = -(-np.array(counts) // D.UNIT)
    doc, low, high = D._places(units, size, step)
    first = np.cumsum(units) - units
    for d, n in enumerate(units.tolist()):
        mine = doc == d
        covered = {u for a, b in zip(low[mine] - first[d], high[mine] - first[d], strict=True) for u in range(a, b)}
        assert covered == set(range(n))
        for begin in range(max(0, counts[d] - m + 1)):  # an item fits into a passage wherever it begins
            assert any(a * D.UNIT <= begin and begin + m <= max(b * D.UNIT, counts[d] if b == n else 0) for a, b in zip(low[mine] - first[d], high[mine] - first[d], strict=True))
    assert (np.diff(doc) >= 0).all() and (high - low <= size).all()


def test_a_very_long_text(spark):
    item = prose(40, 77)
    docs = [(i, prose(120, 7000 + i)) for i in range(100)] + [(500, prose(150_000, 8) + " " + item + " " + prose(150_000, 9)), (501, "x" * 2_000_000)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(500, 1)]


def test_the_query_by_brute_force(spark):
    """Every document of a table against every item by the acceptance rule alone, with no candidate search."""
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], D.ids_of(r["text"] or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [D.item_of(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = set()
    for d, words in docs:
        for item in items:
            share, answer = D._check(item, words, 0, len(words))
            if share >= D.CLEAR or share >= D.PARAPHRASE and answer >= D.ANSWER:
                want.add((d, item.item_id, round(share, 9)))
    got = {(r["doc_id"], r["item_id"], round(r["lcs_share"], 9)) for r in Q.op2_decontaminate(spark, folder).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and want
