"""Benchmark passages found in documents by latent semantic retrieval, also where they are paraphrased."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, tidied, written
from quire.llm.quality import _bytes_of, _slices
from quire.llm.sums import SCHEMA, sliced, summed

#: The latent space is fitted on passages of two neighbouring blocks of so many words.
BLOCK = 16
#: Hashed terms, columns of the sketch, and singular directions kept of it.
TERMS, SKETCH, KEPT = 8192, 112, 96
#: Passages are searched in steps of a quarter of the item, made of units of so many words.
UNIT = 5
#: A passage is looked at when its cosine with the item in the latent space is at least this, whatever the item.
COSINE = 0.33
#: A document leaks an item when their longest common subsequence of words covers CLEAR of the item, or PARAPHRASE of
#: it and ANSWER of the item's answer.
CLEAR, PARAPHRASE, ANSWER = 0.8, 0.6, 0.75
#: The subsequence lies within so many times the item's words.
STRETCH = 1.5
#: Items of fewer words say too little in part: they leak only where all their words stand in a row.
LEAST_WORDS = 8
#: Bytes of the items' vectors that one pass over the corpus searches for, and passages compared with them at a time.
ITEM_BYTES, PASSAGES = 8 << 20, 8192
#: Slices in which sketches are summed up.
SLICES = 64
_SEED = 20240229
_WORDS = np.zeros(256, bool)
_WORDS[list(b"0123456789_abcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, modulo 2^64."""
    if base not in _TABLES or len(_TABLES[base]) < n:
        out = np.full(max(n, 1 << 19), base, np.uint64)
        out[:1] = 1
        _TABLES[base] = np.multiply.accumulate(out)
    return _TABLES[base][:n]


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts in turn, and the number of words of each text.

    Texts are in lower case and end with a line break. A word is a run of ASCII letters, digits, underscores and
    characters beyond ASCII; its hash is that of its bytes, worked out from running sums over the whole buffer.
    """
    inside = _WORDS[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    raw ^= raw >> np.uint64(31)
    ids = (raw * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    return ids, np.diff(np.searchsorted(starts, offsets))


def ids_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode() + b"\n", np.uint8)
    return word_ids(raw, np.array([0, len(raw)]))[0]


def lcs(item: list[int], span: list[int]) -> tuple[int, list[bool]]:
    """Length of the longest common subsequence, and which words of ``item`` one of them has (bit-parallel)."""
    at: dict[int, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    whole = (1 << len(item)) - 1
    v, states = whole, []
    for w in span:
        states.append(v)
        u = v & at.get(w, 0)
        v = (v + u | v - u) & whole
    used, k = [False] * len(item), len(item) - 1
    length = len(item) - v.bit_count()
    row = len(span) - 1
    state = v
    while k >= 0 and row >= 0:  # walk back: a zero bit marks where the length rises
        if state >> k & 1:
            k -= 1
        elif not states[row] >> k & 1:
            state = states[row]
            row -= 1
        else:
            used[k] = True
            state = states[row]
            row -= 1
            k -= 1
    return length, used


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: int  # where the answer's words begin


def item_of(item_id: int, text: str | None) -> Item:
    """An item's words; its answer is its last sentence, or its last third where it has but one sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text or "") if p.strip()]
    words = ids_of(text or "")
    last = len(ids_of(parts[-1])) if len(parts) > 1 else -(-len(words) // 3)
    return Item(item_id, words, len(words) - max(1, last) if len(words) else 0)


def _terms(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of hashed terms (filled up with TERMS), their document numbers, and where each one's words begin in it."""
    blocks = np.maximum(-(-counts // BLOCK), 0)
    doc = np.repeat(np.arange(len(counts)), blocks)
    first = np.cumsum(blocks) - blocks
    out = np.full(int(blocks.sum()) * BLOCK, TERMS, np.uint16)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(ids)) - np.repeat(begin - first * BLOCK, counts)
    out[place] = ids & (TERMS - 1)
    return out.reshape(-1, BLOCK), doc, (np.arange(len(doc)) - first[doc]) * BLOCK


def _pairs(doc: np.ndarray) -> np.ndarray:
    """Blocks that begin a passage: all but a document's last, unless it is the only one."""
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    alone = last & np.insert(last[:-1], 0, True) if len(doc) else last
    return np.flatnonzero(~last | alone)


def _passages(blocks: np.ndarray, doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the passages' words of rows of ``table`` (whose last row is zero), and the blocks they begin at."""
    sums = np.empty((len(blocks), table.shape[1]), np.float32)
    for k in range(0, len(blocks), 512):
        some = blocks[k : k + 512]
        part = table[some[:, 0]]
        for c in range(1, BLOCK):
            part += table[some[:, c]]
        sums[k : k + 512] = part
    at = _pairs(doc)
    follow = np.minimum(at + 1, len(doc) - 1)
    out = sums[at]
    out[doc[follow] == doc[at]] += sums[follow[doc[follow] == doc[at]]] if len(at) else 0
    if len(at):
        single = (follow == at) & (doc[follow] == doc[at])
        out[single] = sums[at[single]]
    return out, at


def _stored(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, ids and word counts of parts of a batch with about ``most`` words each."""
    sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // 4
    marks = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            data, _ = _bytes_of(batch.column(column).slice(a, b - a))
            yield a, np.frombuffer(data.tobytes(), np.uint32), sizes[a:b]


def document_frequencies(stored: DataFrame, tasks: int) -> tuple[np.ndarray, float]:
    """In how many blocks of the corpus each term stands, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * TERMS)
        for batch in batches:
            for _, ids, counts in _stored(batch, 0):
                blocks, _, _ = _terms(ids, counts)
                total[TERMS] += len(blocks)
                blocks = np.sort(blocks, axis=1)
                new = np.ones(blocks.shape, bool)
                new[:, 1:] = blocks[:, 1:] != blocks[:, :-1]
                total[:TERMS] += np.bincount(blocks[new], minlength=TERMS + 1)[:TERMS]
        yield from sliced(total, 2, tasks)

    got = summed(stored.select("ids").mapInArrow(tidied(run), SCHEMA), 2 * TERMS, 2, tasks)
    return got[:TERMS], got[TERMS]


def latent_space(stored: DataFrame, idf: np.ndarray, share: np.ndarray, tasks: int) -> np.ndarray:
    """A table of TERMS + 1 rows: what a word adds to its passage's latent vector.

    With A the TF-IDF matrix of all passages, one pass works out the sketch Y = A'A W of a random W: each task adds up
    its passages' part. From Y the randomised Nystrom decomposition of A'A gives the right singular vectors and the
    singular values of A. Each term keeps its direction among them, and its length is the logarithm of its inverse
    frequency: otherwise the terms of passages with thousands of copies, which fill the first directions, would drown
    the others. A second pass sums up the passages' second moments, by which the space is made round, so that
    cosines of unrelated passages scatter around nought alike in all directions.
    """
    start = np.random.default_rng(_SEED).standard_normal((TERMS, SKETCH))
    weighted = start * idf[:, None]
    weighted = np.vstack([weighted - share @ weighted, np.zeros(SKETCH)]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS + 1, SKETCH))
        for batch in batches:
            for _, ids, counts in _stored(batch, 0):
                blocks, doc, _ = _terms(ids, counts)
                if not len(blocks):
                    continue
                z, at = _passages(blocks, doc, weighted)
                gives = np.zeros((len(blocks), SKETCH), np.float32)
                gives[at] = z
                follow = at + 1
                inner = (follow < len(doc)) & (doc[np.minimum(follow, len(doc) - 1)] == doc[at])
                gives[follow[inner]] += z[inner]
                order = np.argsort(blocks.ravel(), kind="stable")
                terms = blocks.ravel()[order]
                for k in range(0, len(order), 1 << 14):
                    some = terms[k : k + (1 << 14)]
                    cuts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
                    total[some[cuts]] += np.add.reduceat(gives[order[k : k + (1 << 14)] // BLOCK], cuts, axis=0)
        yield from sliced(total[:TERMS] * idf[:, None], SLICES, tasks)

    y = summed(stored.select("ids").mapInArrow(tidied(run), SCHEMA), TERMS * SKETCH, SLICES, tasks).reshape(TERMS, SKETCH)
    nudge = 1e-9 * np.linalg.norm(y)
    y = y + nudge * start
    core = start.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * max(values.max(), 1e-300)
    left, singular, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = min(KEPT, int((singular > 1e-6 * max(singular[0], 1e-300)).sum()) if len(singular) else 0)
    table = left[:, :keep] * idf[:, None] / singular[:keep]
    table = _unit(table) * np.where(idf > 0, np.log1p(idf * idf), 0)[:, None]
    table = np.vstack([table - share @ table, np.zeros(keep)])
    moment = second_moment(stored, table.astype(np.float32), tasks)
    spread, axes = np.linalg.eigh(moment)
    spread = np.maximum(spread, 0) + 1e-3 * max(spread.mean() if len(spread) else 0, 1e-300)
    return (table @ (axes / np.sqrt(spread)) @ axes.T).astype(np.float32)


def second_moment(stored: DataFrame, table: np.ndarray, tasks: int) -> np.ndarray:
    """Sum over passages of two blocks, one after the other, of their latent vectors' outer products."""
    dims = table.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for _, ids, counts in _stored(batch, 0):
                if len(ids):
                    z = _sums(_filled(ids, counts, 2 * BLOCK)[0], table)
                    total += z.T @ z
        yield from sliced(total, 1, tasks)

    return summed(stored.select("ids").mapInArrow(tidied(run), SCHEMA), dims * dims, 1, tasks).reshape(dims, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _size(m: int) -> int:
    """Words of a stretch that is compared with an item of m words."""
    return int(STRETCH * m) + 1


def _least(m: int) -> int:
    """Words that a leak of an item of m words has in common with it, at least."""
    return m if m < LEAST_WORDS else int(np.ceil(PARAPHRASE * m - 1e-9))


def _shape(m: int) -> tuple[int, int]:
    """Units of a passage, and of the step between passages, for an item of m words.

    A step is about a quarter of the item, and a passage has room for the item wherever it begins inside a step.
    """
    step = max(1, -(-m // (4 * UNIT)))
    return -(-m // UNIT) + step, step


def _filled(ids: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms in rows of ``size`` words, each document from a row of its own (filled up with TERMS), and rows a document."""
    rows = -(-counts // size)
    first, begin = np.cumsum(rows) - rows, np.cumsum(counts) - counts
    out = np.full(int(rows.sum()) * size, TERMS, np.int32)
    out[np.arange(len(ids)) - np.repeat(begin - first * size, counts)] = ids & np.uint32(TERMS - 1)
    return out.reshape(-1, size), rows


def _sums(terms: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty((len(terms), table.shape[1]), np.float32)
    for k in range(0, len(terms), 512):
        some = terms[k : k + 512]
        part = table[some[:, 0]]
        for c in range(1, terms.shape[1]):
            part += table[some[:, c]]
        out[k : k + 512] = part
    return out


def _units(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the latent vectors of units (those of a document begin at its first word), and units a document.

    A word counts once a unit, so that a stutter next to an item does not drown it.
    """
    terms, units = _filled(ids, counts, UNIT)
    for c in range(UNIT - 1, 0, -1):
        again = terms[:, c] == terms[:, 0]
        for b in range(1, c):
            again |= terms[:, c] == terms[:, b]
        terms[again, c] = TERMS
    part, n = _sums(terms, table), 16
    rows = -(-len(part) // n)
    sums = np.zeros((rows * n + 1, table.shape[1]), np.float32)
    sums[1 : len(part) + 1] = part
    inner = sums[1:].reshape(rows, n, table.shape[1])  # running sums inside runs of n units, all runs at once, then of the runs
    for k in range(1, n):
        inner[:, k] += inner[:, k - 1]
    inner[1:] += np.cumsum(inner[:-1, -1], axis=0)[:, None]
    return sums[: len(part) + 1], units


def _places(units: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last + 1 unit of every passage: every ``step`` units while they fit, and the last ``size``."""
    first = np.cumsum(units) - units
    steps = np.where(units > 0, np.maximum(-(-(units - size) // step), 0) + 1, 0)
    doc = np.repeat(np.arange(len(units)), steps)
    low = (np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)) * step
    low = first[doc] + np.maximum(np.minimum(low, units[doc] - size), 0)
    return doc, low, np.minimum(low + size, first[doc] + units[doc])


@dataclass
class Queries:
    """Items whose passages have the same shape, as unit vectors (a column each)."""

    size: int
    step: int
    items: list[Item]
    vectors: np.ndarray


def _queries(items: list[Item], table: np.ndarray) -> list[Queries]:
    shapes: dict[tuple[int, int], list[Item]] = {}
    for i in items:
        shapes.setdefault(_shape(len(i.words)), []).append(i)
    whole = lambda i: _units(i.words, np.array([len(i.words)]), table)[0][-1]
    return [Queries(*shape, same, _unit(np.stack([whole(i) for i in same])).T.astype(np.float32)) for shape, same in sorted(shapes.items())]


def candidates(ids: np.ndarray, counts: np.ndarray, queries: list[Queries], table: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[Item, np.ndarray, np.ndarray, np.ndarray]]:
    """Cosine search: for each item the documents, first units in their document, and cosines of the passages found."""
    if not len(ids):
        return
    sums, units = _units(ids, counts, table)
    first = np.cumsum(units) - units
    for q in queries:
        doc, low, high = _places(units, q.size, q.step)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(doc), PASSAGES):
            some = slice(k, k + PASSAGES)
            z = sums[high[some]]
            z -= sums[low[some]]
            length = np.sqrt(np.einsum("ij,ij->i", z, z)) + 1e-12
            score = z @ q.vectors
            at, which = np.nonzero(score >= cosine * length[:, None])
            found.append((at + k, which, score[at, which] / length[at]))
        at, which, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(which, kind="stable")
        at, which, score = at[order], which[order], score[order]
        cuts = np.searchsorted(which, np.arange(len(q.items) + 1))
        for n, item in enumerate(q.items):
            mine = slice(cuts[n], cuts[n + 1])
            if cuts[n + 1] > cuts[n]:
                yield item, doc[at[mine]], low[at[mine]] - first[doc[at[mine]]], score[mine]


def _common(item: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Words that each row of ``spans`` has in common with the item, each as often as both have it."""
    words, times = np.unique(item, return_counts=True)
    out = np.zeros(len(spans), np.int64)
    step = max(1, (1 << 21) // max(1, spans.shape[1] * len(words)))
    for k in range(0, len(spans), step):
        met = (spans[k : k + step, :, None] == words).sum(axis=1)
        out[k : k + step] = np.minimum(met, times).sum(axis=1)
    return out


def _enough(item: Item, doc: np.ndarray, unit: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which passages have, with half an item around them, as many of the item's words as any leak must have.

    A leak has at least that many of them in a stretch of STRETCH times the item, so one that overlaps the passage is
    kept for the subsequence check.
    """
    m = len(item.words)
    margin = m // 2 + UNIT
    begin, width = np.cumsum(counts) - counts, (_shape(m)[0] * UNIT) + 2 * margin
    keep = np.zeros(len(doc), bool)
    member = np.zeros(1 << 16, np.uint8)
    member[item.words & np.uint32(65535)] = 1
    for k in range(0, len(doc), 4096):
        d = doc[k : k + 4096]
        place = unit[k : k + 4096, None] * UNIT - margin + np.arange(width)
        inside = (place >= 0) & (place < counts[d][:, None])
        spans = np.where(inside, ids[np.where(inside, place + begin[d][:, None], 0)], 0)
        # words that look like the item's are at least as many as those that are
        rough = np.flatnonzero(member[spans & np.uint32(65535)].sum(axis=1, dtype=np.int32) >= _least(m))
        keep[k + rough] = _common(item.words, spans[rough]) >= _least(m)
    return keep


def _check(item: Item, words: np.ndarray, low: int, high: int) -> tuple[float, float]:
    """Shares of the item and of its answer in the longest common subsequence with words from low to high or around.

    The best stretch counts, so that words scattered over a long text don't add up.
    """
    m = len(item.words)
    span = words[max(0, low - m) : high + m]
    if m < LEAST_WORDS:
        rows = np.lib.stride_tricks.sliding_window_view(span, m) if len(span) >= m else span[:0, None]
        return (1.0, 1.0) if (rows == item.words).all(axis=1).any() else (0.0, 0.0)
    own = item.words.tolist()
    inside = np.isin(span, item.words)
    if inside.sum() < PARAPHRASE * m or lcs(own, span[inside].tolist())[0] < PARAPHRASE * m:
        return 0.0, 0.0
    best, size = (0.0, 0.0), _size(m)
    for k in range(0, max(1, len(span) - size + max(1, m // 4)), max(1, m // 4)):
        part = span[k : k + size][inside[k : k + size]]
        if len(part) >= PARAPHRASE * m:
            n, used = lcs(own, part.tolist())
            best = max(best, (n / m, sum(used[item.answer :]) / (m - item.answer)))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Documents that hold benchmark items: doc_id, th (hash of the text), item_id, cosine, lcs_share, answer_share, word.

    Term statistics and a randomised SVD of the TF-IDF matrix of overlapping passages cover the whole corpus. Every
    document is then cut into overlapping passages as long as the items (steps of a quarter), and those whose latent
    vector has at least the given ``cosine`` with the item's are its candidates. A candidate is compared with the item by
    the longest common subsequence of words, and by the item's answer. One row per text and item, with the best
    passage's figures (``word`` is where it begins).

    The cosine search finds what it finds with some odds: recall is measured in the tests on copies and on paraphrases
    (words replaced, dropped, moved) and stated in the README. Null and empty texts hold nothing; null ids are reported
    as null. Repeated rows are reported once (equal id and text). Items that are null or empty are left out; those
    shorter than LEAST_WORDS must stand there word for word. Items of equal text are all reported.
    Empty tables give no rows; other columns take no part. Documents shorter than a passage are one short passage.
    """
    text = F.concat(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit("\n"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), text.alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(2), 1 << 18):
                part = batch.slice(a, b - a)
                ids, counts = word_ids(*_bytes_of(part.column(2)))
                ends = np.cumsum(counts) * 4
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column], names=["doc_id", "th", "ids"])

    stored = written(base.mapInArrow(tidied(split), "doc_id long, th long, ids binary"), "words")
    schema = "doc_id long, th long, item_id long, cosine double, lcs_share double, answer_share double, word long"
    tasks = len(stored.inputFiles())
    df, blocks = document_frequencies(stored, tasks)
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema)
    idf = np.sqrt(np.where(df > 0, blocks / np.maximum(df, 1), 0))  # gives every term the same variance, so that rare words tell
    table = latent_space(stored, idf, df / df.sum(), tasks)
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = usable.agg(F.count("*") * F.lit(4 * KEPT + 100) + F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // ITEM_BYTES))
    out = None
    for p in range(parts):  # what goes to the driver and to each task at once is bounded by ITEM_BYTES
        some = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        items = [i for i in (item_of(r["item_id"], r["text"]) for r in some) if len(i.words)]
        found = _searched(stored, _queries(items, table), table, schema, cosine) if items else docs.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine", (-F.col("word")).alias("back"))).alias("b")
    return out.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", "b.cosine", "b.lcs_share", "b.answer_share", (-F.col("b.back")).alias("word"))


def search(ids: np.ndarray, counts: np.ndarray, queries: list[Queries], table: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[int, Item, float, float, float, int]]:
    """(document, item, cosine, share, answer's share, first word) of the leaks among some documents."""
    ends = np.cumsum(counts)
    for item, doc, unit, score in candidates(ids, counts, queries, table, cosine):
        keep = _enough(item, doc, unit, ids, counts)
        near: dict[tuple[int, int], list] = {}
        m = len(item.words)
        far = 4 * _shape(m)[0]  # candidates near each other are checked together
        for d, u, c in zip(doc[keep].tolist(), unit[keep].tolist(), score[keep].tolist(), strict=True):
            had = near.setdefault((d, u // far), [u, u, c, u])
            had[0], had[1] = min(had[0], u), max(had[1], u)
            if c > had[2]:
                had[2], had[3] = c, u
        for (d, _), (low, high, c, at) in near.items():
            share, answer = _check(item, ids[ends[d] - counts[d] : ends[d]], low * UNIT, (high + _shape(m)[0]) * UNIT)
            if share >= CLEAR or share >= PARAPHRASE and answer >= ANSWER:
                yield d, item, c, share, answer, at * UNIT


def _searched(stored: DataFrame, queries: list[Queries], table: np.ndarray, schema: str, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, ids, counts in _stored(batch, 2):
                for d, item, c, share, answer, word in search(ids, counts, queries, table, cosine):
                    rows.append((batch.column(0)[first + d].as_py(), batch.column(1)[first + d].as_py(), item.item_id, c, share, answer, word))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return stored.mapInArrow(tidied(run), schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns are kept."""
    i, t = (free_name(docs.columns, n) for n in ("leak_id", "leak_th"))
    bad = leaks(docs, benchmark).select("doc_id", "th").distinct().toDF(i, t)
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (own == F.col(t)), "left_anti")
