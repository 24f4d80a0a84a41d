"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, tidied

#: At most so many labelled documents of each label are learned from, and so many lines in a row of each.
SAMPLE, SAMPLE_LINES = 1500, 300
#: Documents whose score is at least this are predicted to be good.
THRESHOLD = 0.7
#: Text of about so many bytes is worked on at once.
SLICE = 1 << 20
STEPS, RATE, DECAY = 160, 0.08, 1e-4
#: Lines of a block that is walked in step with others, and lines whose messages are at hand at once.
BLOCK_LINES, WINDOW_LINES = 128, 1 << 16

#: Byte classes that lines are counted by.
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\r",
    b".,;:?'\"-()",
    b"!",
    b"|",
    b"#$%&*@^~=+<>_/\\{}[]`",
)
_OWN = 14  # features of a line itself
_NEAR = (1, 2, 3, 4, 5, 6, 7, 11, 12, 13)  # those also taken from the lines before and after
FEATURES = _OWN + 2 * (len(_NEAR) + 1)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, none of them null, and where each text starts and the last ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Fixed odd numbers, one per byte value, that words are told apart by.
_MARK = ((np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B1) % np.uint64(1 << 31)).astype(np.uint32) | 1


def _stutter(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The part of each line's words that repeat the word before."""
    first = np.flatnonzero((data == 32) | (data == 10))[:-1] + 1
    first = np.concatenate([[0], first])
    said = np.add.reduceat(_MARK[data], first, dtype=np.uint32) - _MARK[data[np.concatenate([first[1:], [len(data)]]) - 1]]
    line = np.searchsorted(starts, first, side="right") - 1
    again = (said[1:] == said[:-1]) & (line[1:] == line[:-1])
    words = np.bincount(line, minlength=len(starts))
    return np.bincount(line[1:][again], minlength=len(starts)) / np.maximum(words, 1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.fromiter((hash(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(ends))


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(data == 10)
    return np.concatenate([[0], ends[:-1] + 1]), ends


def _own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each line shows by itself (``again``: its document has it twice), and the byte lengths."""
    length = (ends - starts).astype(float)
    counts = []
    for members in _CLASSES:
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        counts.append(np.add.reduceat(table[data], starts, dtype=np.int64).astype(float))
    lower, upper, digit, blank, stop, shout, pipe, sign = counts
    words, letters = blank + 1, np.maximum(lower + upper, 1)
    last = data[np.maximum(ends - 1, starts)]
    first = data[starts]
    size = np.maximum(length, 1)
    own = [
        np.ones(len(ends)),
        upper / letters,
        np.minimum(digit / size * 4, 1),
        np.minimum(sign / words, 3) / 3,
        np.minimum(pipe / words, 1),
        np.minimum(shout / words, 2) / 2,
        np.minimum(stop / words, 1),
        np.log1p(words) / 5,
        np.minimum((lower + upper) / words, 20) / 20,
        words <= 2,
        length == 0,
        ~np.isin(last, list(b".!?")),
        again,
        _stutter(data, starts),
        (first >= 97) & (first <= 122),
    ]
    return np.stack([np.asarray(v, np.float32) for v in own], axis=1), length + 1


def _with_neighbours(own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """All features of the lines: their own and those of the lines before and after.

    ``before`` and ``after`` tell whether a line of the same document is there; the first and the last row of ``own``
    are only neighbours.
    """
    n, width = len(own) - 2, len(_NEAR)
    x = np.zeros((n, FEATURES), np.float32)
    x[:, :_OWN] = own[1:-1, :_OWN]
    x[:, 8] += 0.05 * own[1:-1, _OWN]
    for at, rows, there in ((_OWN, own[:-2], before), (_OWN + width + 1, own[2:], after)):
        x[:, at : at + width] = rows[:, _NEAR] * there[:, None]
        x[:, at + width] = ~there
    return x


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, byte lengths and document numbers of all lines; every text ends with a line break."""
    starts, ends = _lines(data)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    key = _hashes(data, starts, ends) ^ (doc * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    own, length = _own_features(data, starts, ends, times[back] > 1)
    same = doc[1:] == doc[:-1]
    edge = np.zeros((1, own.shape[1]), np.float32)
    return _with_neighbours(np.concatenate([edge, own, edge]), np.concatenate([[False], same]), np.concatenate([same, [False]])), length, doc


def _parts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text, whose last byte is a line break, in parts of about ``most`` bytes that end with line breaks."""
    low = 0
    while low < len(data):
        high = min(low + most, len(data))
        breaks = np.flatnonzero(data[low:high] == 10)[-1:] + low
        while not len(breaks):
            breaks = np.flatnonzero(data[high : high + most] == 10)[:1] + high
            high += most
        yield data[low : int(breaks[0]) + 1]
        low = int(breaks[0]) + 1


def marginals(unary: np.ndarray, turn: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for many chains, which lie one after the other in ``unary`` (the score of label 1).

    Returns each place's probability of label 1, the expected counts of the four turns of labels, and the summed log
    of the chains' normalising constants. All chains move in step, longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    n, longest = len(unary), int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # chains with more than t places
    forward, scale = np.zeros((n, 2)), np.zeros(n)
    top = np.maximum(unary, 0)
    e = np.stack([np.exp(-top), np.exp(unary - top)], axis=1)
    m = np.exp(turn - turn.max())
    for t in range(longest):
        at = begin[: active[t]] + t
        a = e[at] if t == 0 else (forward[at - 1] @ m) * e[at]
        z = a.sum(axis=1)
        forward[at], scale[at] = a / z[:, None], z
    backward = np.ones((n, 2))
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = e[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        expected += m * (forward[at].T @ ahead)
        backward[at] = ahead @ m.T
    p = forward * backward
    constant = float(np.log(scale).sum() + top.sum() + (n - len(sizes)) * turn.max())
    return p[:, 1] / p.sum(axis=1), expected, constant


def _steps(unary: np.ndarray, turn: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The matrix by which each line carries forward messages on, in blocks (block, line, 2, 2).

    A document's first line forgets what came before, so that documents one after the other are one chain. Blocks are
    filled up with matrices that change nothing.
    """
    top = np.maximum(unary, 0)
    e = np.stack([np.exp(-top), np.exp(unary - top)], axis=1)
    step = np.exp(turn - turn.max())[None] * e[:, None, :]
    step[first] = e[first][:, None, :]
    blocks = -(-len(unary) // BLOCK_LINES)
    out = np.tile(np.eye(2), (blocks * BLOCK_LINES, 1, 1))
    out[: len(unary)] = step
    return out.reshape(blocks, BLOCK_LINES, 2, 2)


def _whole(steps: np.ndarray) -> np.ndarray:
    """The product of each block's matrices, up to a factor."""
    out = steps[:, 0]
    for t in range(1, steps.shape[1]):
        out = out @ steps[:, t]
        out = out / out.max(axis=(1, 2), keepdims=True)
    return out


def _run(blocks: np.ndarray, start: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """The message that enters each block from the left (or, going back, from the right), and the one that leaves all."""
    out = np.empty((len(blocks), 2))
    order = range(len(blocks) - 1, -1, -1) if back else range(len(blocks))
    for k in order:
        out[k] = start
        start = blocks[k] @ start if back else start @ blocks[k]
        start = start / start.sum()
    return out, start


def _inside(steps: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each line's probability of label 1, given the messages that enter the blocks."""
    n = steps.shape[1]
    forward = np.empty((len(steps), n, 2))
    for t in range(n):
        left = (left[:, None, :] @ steps[:, t])[:, 0]
        left = left / left.sum(axis=1, keepdims=True)
        forward[:, t] = left
    for t in range(n - 1, -1, -1):
        forward[:, t] *= right
        right = (steps[:, t] @ right[:, :, None])[:, :, 0]
        right = right / right.sum(axis=1, keepdims=True)
    p = forward.reshape(-1, 2)
    return p[:, 1] / p.sum(axis=1)


def posteriors(unary: np.ndarray, turn: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over documents one after the other; ``first`` marks their first lines.

    Blocks of lines move in step, so that the time of a long chain is that of its blocks. Windows of lines are taken
    one by one, carrying the messages from one to the next, so that little more than the input is at hand.
    """
    spans = [slice(a, a + WINDOW_LINES) for a in range(0, len(unary), WINDOW_LINES)]
    out = np.empty(len(unary))
    one = np.ones(2) / 2
    if len(spans) == 1:
        steps = _steps(unary, turn, first)
        blocks = _whole(steps)
        return _inside(steps, _run(blocks, one, False)[0], _run(blocks, one, True)[0])[: len(unary)]
    back, message = [], one
    for span in reversed(spans):
        back.append(message)
        _, message = _run(_whole(_steps(unary[span], turn, first[span])), message, True)
    message = one
    for span, behind in zip(spans, reversed(back), strict=True):
        steps = _steps(unary[span], turn, first[span])
        blocks = _whole(steps)
        left, message = _run(blocks, message, False)
        out[span] = _inside(steps, left, _run(blocks, behind, True)[0])[: len(out[span])]
    return out


@dataclass
class Model:
    weights: np.ndarray
    turn: np.ndarray
    slope: float
    shift: float

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text: the mean over lines, weighted by length, of the probability of being good, calibrated."""
        if len(offsets) == 2 and len(data) > 2 * SLICE:
            mean = np.array([self._long(data)])
        else:
            x, weight, doc = line_features(data, offsets)
            p = posteriors(x @ self.weights, self.turn, np.diff(doc, prepend=-1) > 0)
            mean = np.bincount(doc, p * weight, len(offsets) - 1) / np.bincount(doc, weight, len(offsets) - 1)
        return 1 / (1 + np.exp(-(self.slope * mean + self.shift)))

    def _long(self, data: np.ndarray) -> float:
        """The weighted mean for one long text, worked out part by part: a dozen bytes a line are kept."""
        hashes = np.concatenate([_hashes(part, *_lines(part)) for part in _parts(data, SLICE)])
        hashes.sort()
        twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        del hashes
        unary, sizes, held, before = [], [], None, np.zeros((1, _OWN + 1), np.float32)

        def take(own: np.ndarray, after: np.ndarray | None) -> None:
            there = np.ones(len(own), bool)
            has_after = there.copy()
            there[0], has_after[-1] = bool(unary), after is not None
            edge = np.zeros((1, _OWN + 1), np.float32) if after is None else after
            unary.append((_with_neighbours(np.concatenate([before, own, edge]), there, has_after) @ self.weights).astype(np.float32))

        for part in _parts(data, SLICE):
            starts, ends = _lines(part)
            own, size = _own_features(part, starts, ends, np.isin(_hashes(part, starts, ends), twice))
            sizes.append(size.astype(np.float32))
            if held is not None:
                take(held, own[:1])
                before = held[-1:]
            held = own
        take(held, None)
        scores, weight = np.concatenate(unary), np.concatenate(sizes)
        p = posteriors(scores, self.turn, np.arange(len(scores)) == 0)
        return float(p @ weight / weight.sum(dtype=float))


def fit(chains: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> Model:
    """Learns from documents (features and lengths of their lines) with labels 0 and 1.

    Lines first take their document's label. After a first fit, lines of bad documents that look clearly good are
    given label 1, as a bad document often holds good lines, and the fit goes on. Good documents keep all labels.
    """
    if not chains or len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 4.0 if not chains or labels[0] == 1 else -4.0)
    x, sizes = np.concatenate(chains).astype(float), np.array([len(c) for c in chains])
    doc, size = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(weights)
    y = labels[doc].astype(float)
    inner = doc[1:] == doc[:-1]
    w, turn = np.zeros(FEATURES), np.zeros((2, 2))
    state = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for step in range(1, STEPS + 1):
        p, expected, _ = marginals(x @ w, turn, sizes)
        if step == STEPS // 2:
            clear = (labels[doc] == 0) & (p > 0.9)
            some = np.bincount(doc, ~clear, len(sizes)) > 0
            y = np.where(clear & some[doc], 1.0, labels[doc])
        seen = np.array([[((y[:-1] == a) & (y[1:] == b) & inner).sum() for b in (0, 1)] for a in (0, 1)])
        g = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(y) - DECAY * np.concatenate([w, turn.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, turn = w + move[:FEATURES], turn + move[FEATURES:].reshape(2, 2)
    p, _, _ = marginals(x @ w, turn, sizes)
    mean = np.bincount(doc, p * size) / np.bincount(doc, size)
    slope, shift = 4.0, -2.0
    balance = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    for _ in range(60):  # Newton steps of a logistic regression with a small ridge
        q = 1 / (1 + np.exp(-(slope * mean + shift)))
        d = balance * q * (1 - q) + 1e-9
        r = balance * (labels - q)
        g = np.array([(r * mean).sum() - 0.1 * slope, r.sum() - 0.1 * shift])
        h = np.array([[(d * mean * mean).sum() + 0.1, (d * mean).sum()], [(d * mean).sum(), d.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return Model(w, turn, float(slope), float(shift))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    marks = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Model:
    """Fits the field on at most ``sample`` documents of each label, chosen by a hash of their ids.

    Rows of ``labels`` (doc_id, quality) with null or other labels, and held-out ids, are left out; of repeated ids
    the highest label counts. Of a longer document ``lines`` lines in a row are learned from, at a place chosen by a hash
    of its id; what the driver gets is bounded by both numbers. Of rows with one doc_id the first text counts. With no
    labelled document of one of the labels, every document gets the score of the other.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    some = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = some[0].unionByName(some[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "y", F.concat("text", F.lit("\n")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(2)):
                part = batch.slice(a, b - a)
                data, offsets = _bytes_of(part.column(2))
                if b - a == 1 and len(data) > 2 * SLICE:  # as many lines as are needed and their neighbours
                    breaks = np.flatnonzero(data == 10)
                    at = _place(part.column(0)[0].as_py(), len(breaks), lines)
                    low, high = max(0, at - 1), min(len(breaks), at + lines + 1)
                    data = data[0 if not low else breaks[low - 1] + 1 : breaks[high - 1] + 1]
                    x, weight, _ = line_features(data, np.array([0, len(data)]))
                    spans = [slice(at - low, at - low + min(lines, len(breaks)))]
                else:
                    x, weight, doc = line_features(data, offsets)
                    cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    sizes = np.diff(cuts)
                    places = [_place(d, n, lines) for d, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True)]
                    spans = [slice(cuts[k] + at, cuts[k] + at + min(lines, sizes[k])) for k, at in enumerate(places)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x[s].tobytes() for s in spans], pa.binary()), pa.array([weight[s].tobytes() for s in spans], pa.binary())],
                    names=["doc_id", "y", "x", "w"],
                )

    got = sorted(rows.mapInArrow(tidied(run), "doc_id long, y int, x binary, w binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    chains = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    return fit(chains, [np.frombuffer(r["w"], float) for r in got], np.array([r["y"] for r in got], int))


def _place(doc_id: int, n: int, lines: int) -> int:
    """The first of ``lines`` lines in a row of a document with n lines."""
    return 0 if n <= lines else int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little") % (n - lines + 1)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with a column ``name``: quality between 0 and 1.

    Whole texts are scored row by row where they lie, with no shuffle. Only the text is an input. Null text counts as
    empty; an empty text is one empty line. Repeated rows score alike; an empty table gives an empty one. A long text is
    worked on in parts; a line and its neighbours must fit in memory.
    """
    kept = docs.columns if keep is None else keep
    extra = free_name(docs.columns, "lines")
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n")).alias(extra))
    out = source.drop(extra).withColumn(name, F.lit(None).cast("double")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            scores = [model.documents(*_bytes_of(column.slice(a, b - a))) for a, b in _slices(column)]
            arrays = [*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return source.mapInArrow(tidied(run), out)
