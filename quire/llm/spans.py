"""Removal of repeated passages found as equal runs of consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, tidied, written

#: A run has at least so many sentences and so many words; sentences with LONG words make a run even alone.
LEAST_SENTENCES, LEAST_WORDS, LONG = 2, 20, 30
#: A place packs the first sentence's number and 20 bits of the run's length.
_START = 1 << 20
#: Runs that make up more than one part in HEAVY of all are joined by a broadcast: there are at most so many of them.
HEAVY = 1 << 16


def sentences(text: str) -> list[str]:
    """Sentences in turn; lines end them too."""
    return [s for s in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if s and not s.isspace()]


def runs(words: list[int], least: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, long: int = LONG) -> list[tuple[int, int]]:
    """(first, count) of the shortest runs from each sentence on and up to each sentence that are long enough.

    Of a passage shared by two documents every sentence is covered by a run inside it, as soon as the passage's whole
    sentences make one run: the first ones by runs from them on, the last ones by runs up to them.
    """
    out = set()
    short = lambda count, total: total < least_words or count < least and total < long
    n, j, total = len(words), 0, 0
    for i in range(n):
        if j < i:
            j, total = i, 0
        while j < n and short(j - i, total):
            total += words[j]
            j += 1
        if short(j - i, total):
            break
        out.add((i, j - i))
        total -= words[i]
    i, total = n - 1, 0
    for j in range(n - 1, -1, -1):
        if i > j:
            i, total = j, 0
        while i >= 0 and short(j - i, total):
            total += words[i]
            i -= 1
        if short(j - i, total):
            break
        out.add((i + 1, j - i))
        total -= words[j]
    return sorted(out)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def repeated(docs: DataFrame, least: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, long: int = LONG) -> DataFrame:
    """The runs that are not the first of their kind: doc_id, th (hash of the text), start, count.

    The first is the one with the smallest (doc_id, th, start). Hashes of runs are counted with map-side sums. Of the runs
    that repeat, those so frequent that they would fill a task (at most HEAVY kinds) find their first by a broadcast
    and are not shuffled; the others are joined by their hash.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("th"), _text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                hashes, ids, marks, places = [], [], [], []
                for doc_id, th, t in zip(*(c.to_pylist() for c in batch.slice(k, 1000).columns), strict=True):
                    said = [" ".join(s.split()) for s in sentences(t.lower())]
                    words = [s.count(" ") + 1 for s in said]
                    starts, at = [], 0
                    for s in said:
                        starts.append(at)
                        at += len(s) + 1
                    starts.append(at)
                    whole = "\n".join(said)
                    spans = runs(words, least, least_words, long)
                    hashes += [digest(whole[starts[i] : starts[i + n] - 1]) - (1 << 63) for i, n in spans]
                    places += [i * _START + n for i, n in spans]
                    ids += [doc_id] * len(spans)
                    marks += [th] * len(spans)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hashes, ids, marks, places)], names=["h", "doc_id", "th", "place"])

    spans = written(base.mapInArrow(tidied(run), "h long, doc_id long, th long, place long"), "spans")
    here = F.struct("doc_id", "th", "place")
    firsts = written(spans.groupBy("h").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1"), "firsts")
    most = spans.count() // HEAVY
    heavy = F.broadcast(firsts.where(F.col("n") > most).select("h", "first"))
    usual = spans.join(heavy.select("h"), "h", "left_anti").join(firsts.where(F.col("n") <= most).select("h", "first"), "h")
    later = spans.join(heavy, "h").unionByName(usual).where(here > F.col("first"))
    return later.select("doc_id", "th", F.floor(F.col("place") / _START).cast("int").alias("start"), (F.col("place") % _START).cast("int").alias("count"))


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the sentences that the spans cover, and how many those are. Emptied lines go."""
    gone = {k for i, n in spans for k in range(i, i + n)}
    lines, k = [], 0
    for line in text.split("\n"):
        kept, had = [], 0
        for s in line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
            if not s or s.isspace():
                kept.append(s)
                continue
            had += 1
            if k not in gone:
                kept.append(s)
            k += 1
        if not had or any(s and not s.isspace() for s in kept):
            lines.append(" ".join(kept))
    return "\n".join(lines), len(gone)


def remove_repeats(docs: DataFrame, least: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, long: int = LONG, removed: str = "n_removed") -> DataFrame:
    """``docs`` without the sentences covered by a non-first repeated run; ``removed`` counts them.

    A run is several sentences in a row, at least ``least`` of them with ``least_words`` words together, or one of
    ``long`` words. Longer runs that repeat are covered by the shortest ones that start and end inside them.

    Sentences are compared in lower case with blanks folded. Null text stays null and empty text empty (0 removed).
    Rows with equal id and text are one document and lose the same sentences; null ids come before all others. Texts
    too short for one run are left alone; an empty table gives an empty one; other columns stay as they are.
    """
    spans = repeated(docs, least, least_words, long).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "count")).alias("spans"))
    i, m, s = (free_name([*docs.columns, removed], n) for n in ("span_id", "span_th", "spans"))
    spans = spans.toDF(i, m, s)
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(_text()) == F.col(m)), "left").drop(i, m)
    schema = docs.withColumn(removed, F.lit(0).cast("long")).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            texts, counts = batch.column(at).to_pylist(), [0] * len(found)
            for k, spans_of in enumerate(found):
                if spans_of:
                    texts[k], counts[k] = without(texts[k], [(x["start"], x["count"]) for x in spans_of])
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=schema.names)

    return joined.mapInArrow(tidied(run), schema)
