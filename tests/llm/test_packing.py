import struct
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm import queries as Q
from quire.llm.tokens import UnitIds, parts_of, units

PATH = public_tokenizers.path("word_bpe_49k.json")


def cost(length, window):
    return packing.WINDOW_COST + (0 if length == window or length & (length - 1) == 0 and length >= max(1, window // packing.SHORTEST) else window - length)


def brute(ends, penalties, window):
    """Least cost over all ways to cut, by trying every start for every end."""
    at = [0, *ends]
    best = [0.0] + [float("inf")] * len(ends)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= window:
                best[j] = min(best[j], best[i] + cost(at[j] - at[i], window) + penalties[j - 1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 5)), min_size=1, max_size=40), st.booleans())
def test_cuts_are_optimal(parts, more):
    ends, at = [], 0
    for n, _ in parts:
        at += n
        ends.append(at)
    penalties = [p for _, p in parts]
    cuts = packing.cut_windows(ends, penalties, 16, more)
    spent, low = 0, 0
    for c in cuts:
        assert 0 < c - low <= 16 and c in ends
        spent += cost(c - low, 16) + penalties[ends.index(c)]
        low = c
    best = brute(ends, penalties, 16)
    assert spent == best[ends.index(cuts[-1]) + 1]
    if more:
        assert cuts[-1] > ends[-1] - 16 and spent == min(best[k + 1] for k, e in enumerate(ends) if e > ends[-1] - 16)
    else:
        assert cuts[-1] == ends[-1]


def test_padding_rule():
    assert packing.padding_of(1024, 2048) == 0 and packing.padding_of(1000, 2048) == 1048


def ids_by_table(table, texts):
    raw = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return table.of(data, np.cumsum([len(r) for r in raw]) - 1)[0].tolist()


LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.text(st.sampled_from("aAbB éÉßüñ×÷.,!?'s|#$ \n\t\r0129İσΣ中文\u0301\u00a0 <|endoftext>"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.sampled_from([3, 1000]))
def test_ids_are_the_librarys(texts, memory):
    table = UnitIds(PATH, 1, memory)
    want = [i for t in texts for i in [*LIBRARY.encode(t, add_special_tokens=False).ids, 1]]
    for _ in range(2):
        assert ids_by_table(table, texts) == want
    raw = [t.encode() + b"\n" for t in texts]
    counts = table.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]) - 1)
    assert counts.tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_ids_of_long_units():
    table, texts = UnitIds(PATH, 1), ["x" * 5000 + " " + "ab1!" * 900, "don't we'll <|endoftext|>it " * 300, ""]
    assert ids_by_table(table, texts) == [i for t in texts for i in [*LIBRARY.encode(t, add_special_tokens=False).ids, 1]]


def test_units_by_hand():
    raw = b"Ab, c12 it's\n"
    begin, end, _ = units(np.frombuffer(raw, np.uint8), np.array([len(raw) - 1]))
    assert [raw[a:b] for a, b in zip(begin, end, strict=True)] == [b"Ab", b",", b"c", b"1", b"2", b"it's", b"\n"]


def test_parts_of_a_long_text():
    data = np.frombuffer(b"aa bb. cc " * 50 + b"d" * 300 + b" e" * 40, np.uint8)
    parts = list(parts_of(data, 64))
    assert b"".join(p.tobytes() for p in parts) == data.tobytes()
    assert all(p[-1] == 32 for p in parts[:-1]) and max(map(len, parts)) < 400


def check(spark, rows, **options):
    """Every id of every document lies in one piece, and sequences are gapless."""
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, b string")
    got = packing.pack(df, PATH, **options).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted([[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows])
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in got) == sum(map(len, want))
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == pieces[0]["sequence_length"] <= options.get("window", 2048)
    return got, docs


def test_pieces(spark):
    long = "word " * 5000 + "end. " * 300
    rows = [(1, long, 3, "x"), (2, "A short one. Two!", 1, "y"), (3, None, None, None), (4, "", 0, ""), (5, "Same text.", 1, "z"), (5, "Same text.", 1, "z"), (None, "No id here.", 1, "z"), (-7, "Negative.", 1, "z"), (900, "x" * 3000, 1, "z")]
    got, docs = check(spark, rows)
    ids = [*Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids, 1]
    at = 0
    for p in sorted((p for p in got if p["doc_id"] == 1), key=lambda p: p["start"]):
        part = ids[at : at + p["length"]]
        assert p["start"] == at and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        at += p["length"]
    assert at == len(ids)
    assert sum(p["padding"] for p in {p["sequence_id"]: p for p in got}.values()) < 0.05 * sum(p["length"] for p in got)
    assert [p["doc_tokens"] for p in got if p["doc_id"] in (3, 4)] == [1, 1]


def test_empty_and_small_windows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    check(spark, [(i, f"Sentence number {i}. And more, of it. " * 5, 1, "") for i in range(40)], window=16)


def test_any_ids(spark):
    text = "Some words stand here, and some more. " * 12
    sparse = [(k * 10**15 - 2**62, text + str(k), 1, "") for k in range(300)] + [(2**62 + k, text, 1, "") for k in range(100)] + [(-(2**63), "least", 1, ""), (2**63 - 1, "most", 1, "")]
    hot = [(7, text, 1, "") for _ in range(200)] + [(None, text + str(k % 3), 1, "") for k in range(200)]
    for rows in (sparse, hot):
        got, _ = check(spark, rows)
        padded = sum({p["sequence_id"]: p["padding"] for p in got}.values())
        assert padded < 0.03 * sum(p["length"] for p in got) + 2048 * 4


def test_cuts_lie_at_boundaries(spark):
    rows = [(k, "".join(f"Word {j} and the one after it{'!' if j % 3 else '.'}{' ' if j % 5 else chr(10)}" for j in range(k % 60)), 1, "") for k in range(200)]
    got, _ = check(spark, rows, window=256)
    library = Tokenizer.from_file(PATH)
    texts = {r[0]: r[1] for r in rows}
    inner = [p for p in got if p["start"]]
    assert inner
    for p in inner:
        t = texts[p["doc_id"]]
        spots = {len(library.encode(t[: i + 1], add_special_tokens=False).ids) for i, c in enumerate(t) if c == "\n" or t[i : i + 2] in (". ", "! ", "? ")}
        assert p["start"] in spots


def test_a_very_long_text(spark):
    text = "Here are a few words that make one sentence. " * 80_000
    got, docs = check(spark, [(1, text, 1, ""), (2, "x" * 400_000, 1, ""), (3, "after", 1, "")])
    ids = [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]
    at = 0
    for p in sorted((p for p in got if p["doc_id"] == 1), key=lambda p: p["start"]):
        assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
        at += p["length"]
    assert at == len(ids)


def test_the_query_by_the_library(spark):
    """Every id of every document of a whole table, by the tokenizer itself."""
    folder = "/root/testdata/sf0.01"
    pieces = {}
    for p in Q.op1_packing(spark, folder).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    sequences = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array([*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces.pop(r["doc_id"]), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert at == len(ids)
    assert not pieces
    padded = total = 0
    for rows in sequences.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
        total, padded = total + at, padded + packing.padding_of(at, 2048)
    assert padded < 0.02 * total
