"""Order-preserving packing of documents into token windows by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import tidied
from quire.llm.tokens import MEMORY, PART, UnitIds, parts_of, slices, texts_of, unit_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padding long"
#: Numbers of a partition's sequences stay below this.
PARTITION_SPAN = 1 << 36
#: Cost in tokens of ending a window inside a document at a sentence end, and inside a sentence longer than a window;
#: and of a window as such, so that of equal paddings fewer windows win.
SENTENCE_PENALTY, FORCED_PENALTY, WINDOW_COST = 4, 64, 1
#: A window may also be a power of two from window / SHORTEST on: such lengths are not padded.
SHORTEST = 32
#: Windows are settled once so many times their length is at hand.
SETTLED = 32


def padding_of(length: int, window: int) -> int:
    """A window is padded to its full length unless its length is a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def cut_windows(ends: list[int], penalties: list[int], window: int, more: bool = False) -> list[int]:
    """Ends of the windows over a stream whose allowed cuts are ``ends`` (rising, gaps of at most ``window``).

    f(j) = penalty(j) + WINDOW_COST + the least of f(i) + padding(end(j) - end(i)) over the cuts i at most a window
    before j. The padded lengths share the term window - end(j), so their minimum over the sliding range of i is kept in
    a monotone queue, which each cut enters and leaves once; the lengths that are powers of two are looked up. With
    ``more`` to come the windows end at the cheapest cut of the last window. Ties take the longer window.
    """
    if not ends:
        return []
    at = [0, *ends]
    place = {p: k for k, p in enumerate(at)}
    short, size = [], window // 2
    while size >= max(1, window // SHORTEST):
        short.append(size)
        size //= 2
    values, origin = [0], [0]  # f, and the cut before
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f + end, end, cut
    for j in range(1, len(at)):
        end = at[j]
        low = end - window
        while queue[0][1] < low:
            queue.popleft()
        least, begin, i = queue[0]
        value = least + (window - end if begin != low else -low)
        for size in short:
            k = place.get(end - size)
            if k is not None and values[k] < value:
                value, i = values[k], k
        value += WINDOW_COST + penalties[j - 1]
        values.append(value)
        origin.append(i)
        key = value + end
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, end, j))
    i = len(at) - 1
    if more:
        low = at[i] - window
        i = min((k for k in range(1, len(at)) if at[k] > low), key=lambda k: (values[k], -k))
    out = []
    while i > 0:
        out.append(at[i])
        i = origin[i]
    return out[::-1]


def offered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids before each sentence end of a buffer: after a full stop, shout or question mark and a blank, or a line."""
    stop = (data == 46) | (data == 33) | (data == 63)
    at = np.flatnonzero((data[1:] == 10) | (data[1:] == 32) & stop[:-1]) + 1
    total = np.concatenate([[0], np.cumsum(size)])
    return total[np.searchsorted(begin, at)]


class _Stream:
    """The token stream of a partition's documents, in their order; windows leave it as they are settled."""

    def __init__(self, ids: UnitIds, window: int, first: int) -> None:
        self.table, self.window, self.sequence = ids, window, first
        self.ids = np.zeros(0, np.uint32)
        self.cuts = np.zeros(0, np.int64)
        self.penalties = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)  # of the documents at hand, from the stream's present start on
        self.totals = np.zeros(0, np.int64)
        self.names = pa.array([], pa.int64())

    def add(self, names: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        """Texts, each closed by a line break, and the places where they start and the last ends."""
        ends = offsets[1:] - 1
        if len(ends) == 1 and len(data) > 2 * PART:
            got, cuts, at = [], [], 0
            for part in parts_of(data, PART):
                last = np.array([len(part) - 1] if at + len(part) == len(data) else [], np.int64)
                ids, begin, size = self.table.of(part, last)
                cuts.append(offered(part, begin, size) + sum(map(len, got)))
                got.append(ids)
                at += len(part)
            ids, inner = np.concatenate(got), np.concatenate(cuts)
            totals = np.array([len(ids)])
        else:
            ids, begin, size = self.table.of(data, ends)
            inner = offered(data, begin, size)
            closes = np.cumsum(size)[np.searchsorted(begin, ends)]
            totals = np.diff(closes, prepend=0)
        closes = np.cumsum(totals)
        cuts = np.concatenate([closes, inner])
        order = np.argsort(cuts, kind="stable")  # a document's end comes before a sentence's at the same place
        cuts, penalties = cuts[order], (order >= len(closes)) * SENTENCE_PENALTY
        keep = np.diff(cuts, prepend=0) > 0
        cuts, penalties = cuts[keep], penalties[keep]
        gap = np.diff(cuts, prepend=0)
        for k in np.flatnonzero(gap > self.window)[::-1].tolist():
            step = max(1, self.window // 32)
            more = np.arange(cuts[k] - gap[k] + step, cuts[k], step)
            cuts, penalties = np.insert(cuts, k, more), np.insert(penalties, k, np.full(len(more), FORCED_PENALTY))
        base = len(self.ids)
        self.cuts, self.penalties = np.concatenate([self.cuts, base + cuts]), np.concatenate([self.penalties, penalties])
        self.begins, self.totals = np.concatenate([self.begins, base + closes - totals]), np.concatenate([self.totals, totals])
        self.names = pa.concat_arrays([self.names, names])
        self.ids = np.concatenate([self.ids, ids])

    def settle(self, more: bool) -> pa.RecordBatch | None:
        """The pieces of the windows that are settled."""
        if not len(self.cuts) or more and len(self.ids) < SETTLED * self.window:
            return None
        cuts = np.array(cut_windows(self.cuts.tolist(), self.penalties.tolist(), self.window, more))
        done = int(cuts[-1])
        ends = self.begins + self.totals
        starts = np.union1d(np.concatenate([[0], cuts[:-1]]), self.begins[(self.begins >= 0) & (self.begins < done)])
        length = np.diff(starts, append=done)
        doc = np.searchsorted(ends, starts, side="right")
        which = np.searchsorted(cuts, starts, side="right")
        opens = np.concatenate([[0], cuts[:-1]])
        size = cuts - opens
        padding = np.where(size & (size - 1) == 0, 0, self.window - size)
        view = memoryview(self.ids[:done].astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), length.tolist(), strict=True)]
        columns = [self.names.take(pa.array(doc)), starts - self.begins[doc], length, crc, self.totals[doc], self.sequence + which, starts - opens[which], size[which], padding[which]]
        out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])
        self.sequence += len(cuts)
        left = int(np.searchsorted(ends, done, side="right"))
        self.names, self.begins, self.totals = self.names.slice(left), self.begins[left:] - done, self.totals[left:]
        rest = self.cuts > done
        self.cuts, self.penalties, self.ids = self.cuts[rest] - done, self.penalties[rest], self.ids[done:].copy()
        return out


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, memory: int = MEMORY) -> DataFrame:
    """Packs every document's ids (then ``end_id``) into windows of at most ``window`` tokens.

    Rows are dealt into ranges of ``doc_id``, as many to each whatever the ids are, and sorted; each range is one stream
    that is cut at ends of documents and sentences only, except inside sentences longer than a window. Returns one row
    per piece: doc_id, start and length within the document's ids, CRC-32 of the piece's ids, tokens of the document,
    sequence_id, offset in the sequence, sequence_length and the sequence's padding. ``memory`` bounds the units whose
    ids a Python worker keeps; it changes the speed, not the result. A task holds a slice of its stream (PART bytes
    and SETTLED windows), or the ids of one document that is longer.

    Null text counts as empty (one piece that holds ``end_id``). Any long is an id; null ids come first. Rows with equal
    ids are all packed, in order of a hash of their texts, and however many they are they spread over the ranges. An
    empty table gives no rows; other columns of the input, whatever their names, take no part.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(unit_ids(vocabulary, end_id, memory), window, TaskContext.get().partitionId() * PARTITION_SPAN)
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, PART):
                stream.add(batch.column(0).slice(a, b - a), *texts_of(texts.slice(a, b - a)))
                if (out := stream.settle(True)) is not None:
                    yield out
        if (out := stream.settle(False)) is not None:
            yield out

    text = F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n"))
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("t"))
        .select("d", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("m"))
        .repartitionByRange("d", "h", "m")
        .sortWithinPartitions("d", "h")
    )
    return dealt.select("d", "t").mapInArrow(tidied(run), SCHEMA)
