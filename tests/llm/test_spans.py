import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import spans as S

R = random.Random(6)


def sentence():
    return " ".join("".join(R.choice("abcdefghij") for _ in range(4)) for _ in range(R.randint(2, 12))).capitalize() + "."


def short(count, words):
    return words < S.LEAST_WORDS or count < S.LEAST_SENTENCES and words < S.LONG


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25))
def test_runs(words):
    want = set()
    for i in range(len(words)):
        for n in range(1, len(words) - i + 1):
            if not short(n, sum(words[i : i + n])):
                want.add((i, n))
                break
        for n in range(1, i + 2):
            if not short(n, sum(words[i + 1 - n : i + 1])):
                want.add((i + 1 - n, n))
                break
    assert set(S.runs(words)) == want
    if words and not short(len(words), sum(words)):
        assert {k for i, n in want for k in range(i, i + n)} == set(range(len(words)))


def brute(rows):
    """Spans by document, keyed by (doc_id, text): all but the first of each run go."""
    runs = {}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        said = [" ".join(s.split()) for s in S.sentences((key[1] or "").lower())]
        for i, n in S.runs([s.count(" ") + 1 for s in said]):
            runs.setdefault("\n".join(said[i : i + n]), []).append((key, i, n))
    gone = {}
    for found in runs.values():
        for key, i, n in found[1:]:
            gone.setdefault(key, set()).update(range(i, i + n))
    return gone


def test_against_brute_force(spark):
    passage = " ".join(sentence() for _ in range(9))
    rows = [(i, "\n".join([*(sentence() for _ in range(R.randint(0, 5))), *([passage] if i % 3 == 0 else []), *(sentence() for _ in range(R.randint(0, 5)))])) for i in range(40)]
    rows += [(90, rows[1][1]), (91, None), (92, ""), (None, rows[2][1]), (93, "Wher. " * 60), (94, rows[3][1]), (94, rows[3][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    gone = brute(rows)
    for r in S.remove_repeats(df).collect():
        text = next(t for d, t in rows if d == r["doc_id"] and (r["n_removed"] == len(gone.get((d, t), ()))))
        want = S.without(text, [(k, 1) for k in gone.get((r["doc_id"], text), ())])[0] if text else text
        assert r["text"] == want
    kept = [r["text"] or "" for r in S.remove_repeats(df).collect()]
    assert sum(passage in t for t in kept) == 1


def test_hot_runs_and_equal_ids(spark, monkeypatch):
    passage = " ".join(sentence() for _ in range(6))
    rows = [(7, f"{sentence()} {passage} {sentence()}") for _ in range(120)] + [(None, f"{sentence()}\n{passage}") for _ in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    said, counts = sum(t.count(".") for _, t in rows), {}
    for heavy in (S.HEAVY, 1):  # by broadcast, by shuffle
        monkeypatch.setattr(S, "HEAVY", heavy)
        got = S.remove_repeats(df).collect()
        counts[heavy] = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in got)
        assert sum(passage in r["text"] for r in got) == 1
        assert said - sum(r["text"].count(".") for r in got) == sum(r["n_removed"] for r in got)
    assert counts[1] == counts[S.HEAVY] or len(set(map(str, counts.values()))) == 1


def test_a_very_long_text(spark):
    passage = " ".join(sentence() for _ in range(8))
    long = " ".join(f"{sentence()} Number {k} it is." for k in range(60_000))
    df = spark.createDataFrame([(1, passage), (2, f"{long} {passage}"), (3, "word " * 500_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    assert passage not in got[2]["text"] and got[1]["n_removed"] == got[3]["n_removed"] == 0


def test_without():
    text = "One a. Two b.\nThree c.\n\nFour d."
    assert S.without(text, [(1, 2)]) == ("One a.\n\nFour d.", 2)
    assert S.without(text, []) == (text, 0)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
