"""Similarity join on word shingles with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, marked_members, membership, tidied, written
from quire.llm.components import components

#: Words of a shingle and the similarity from which texts are linked.
WORDS, THRESHOLD = 5, 0.8
#: MinHash values, in BANDS bands of ROWS. A pair at the threshold meets in no band with odds of 2e-6.
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
#: A pair is dropped when the odds that it reaches the threshold fall below this, given the values compared so far.
TOLERANCE = 1e-5
#: Values are compared in so many steps.
STEP = 20
#: Texts of a block; larger buckets and components are compared block by block.
BUCKET_BLOCK, GROUP_BLOCK = 1024, 256
_WORD = re.compile(r"\w+")
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _SEED.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words; a shorter text is one run of all its words."""
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in _WORD.findall(text.lower())], np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * _MIX[1]
    return np.unique(out ^ (out >> np.uint64(31)))


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    out = np.empty(HASHES, np.uint64)
    for i in range(HASHES):
        out[i] = ((found ^ _B[i]) * _A[i] >> np.uint64(13)).min()
    return (out * _MIX[2] >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, most: int = HASHES) -> list[int]:
    """For n compared values, the fewest matches with which the odds of reaching the threshold are above tolerance.

    With an even prior the similarity given m matches of n follows Beta(m + 1, n - m + 1); the odds that it reaches t
    are those of at most m successes in n + 1 trials of chance t.
    """
    out = [0]
    for n in range(1, most + 1):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, same: bool, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that no step of the comparison dropped; with ``same``, each pair of ``left`` once."""
    matches = np.zeros((len(left), len(right)), np.uint8)
    for h in range(STEP):
        matches += left[:, h, None] == right[None, :, h]
    keep = matches >= needed[STEP]
    if same:
        keep &= np.tri(len(left), k=-1, dtype=bool)
    i, j = np.nonzero(keep)
    count = matches[i, j].astype(np.int32)
    for h in range(STEP, HASHES, STEP):
        count += (left[i, h : h + STEP] == right[j, h : h + STEP]).sum(axis=1, dtype=np.int32)
        alive = count >= needed[h + STEP]
        i, j, count = i[alive], j[alive], count[alive]
    return i, j


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs, by blocked products of incidence where pairs are many."""
    if len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], int)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[back] > 1
    owner, column = owner[keep], shared[back[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared[-1]) + 1 if len(shared) else 0, 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        seen = np.zeros((len(sets), 8192), np.float32)
        seen[owner[a:b], column[a:b] - low] = 1
        both += seen @ seen.T
    return both[i, j].astype(int)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, group by group; the first ``keys`` columns are the key."""
    at, rows = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns), strict=True):
                if row[:keys] != at:
                    if rows:
                        yield rows
                    at, rows = row[:keys], []
                rows.append(row)
    if rows:
        yield rows


def _blocks(df: DataFrame, key: str, n: Column, block: int) -> DataFrame:
    """Each row goes to the pairs (i, j), i <= j, of blocks of its group that hold its own block; ``n`` is the group's size."""
    own = F.pmod(F.xxhash64("c", F.lit(7)), F.col("parts").cast("long")).cast("int")
    out = df.withColumn("parts", F.ceil(n / block).cast("int")).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("parts", "other")
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "c")


def _split(rows: list[tuple], i: int, j: int, own: int) -> tuple[list[int], list[int], bool]:
    """Indices of the rows of block i and of block j."""
    same = rows[0][i] == rows[0][j]
    left = [k for k, r in enumerate(rows) if r[own] == r[i]]
    return left, left if same else [k for k, r in enumerate(rows) if r[own] != r[i]], same


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), c (number of its set of shingles; null where there is none), sig."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, signatures = [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                classes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "th", "c", "sig"])

    return base.mapInArrow(tidied(run), "doc_id long, th long, c long, sig binary")


def _candidates(classes: DataFrame, needed: list[int]) -> DataFrame:
    """Links (a, b) that join up all pairs of classes which share a band and survive the pruning."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = classes.select("c", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = bands.join(shared, "band").join(classes.select("c", "sig"), "c")
    dealt = _blocks(members, "band", F.col("n"), BUCKET_BLOCK).select("band", "i", "j", "own", "c", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in _groups(batches, 3):
            if len(rows) < 2:
                continue
            left, right, same = _split(rows, 1, 2, 3)
            sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), HASHES)
            i, j = survivors(sig[left], sig[right], same, needed)
            i, j = np.array(left, int)[i], np.array(right, int)[j]
            root = roots_of(len(rows), i, j)
            for k in np.flatnonzero(root != np.arange(len(rows))).tolist():
                a.append(rows[k][4])
                b.append(rows[root[k]][4])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(tidied(run), "a long, b long").distinct()


def _verified(docs: DataFrame, members: DataFrame, words: int, threshold: float, needed: list[int]) -> DataFrame:
    """(a, b, n) for each class and block: n links of class a, one of them leading to b by way of others."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    members = written(members, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = marked_members(texts, F.col("th"), membership(members, "th"), "likely").where("likely").drop("likely")  # else every text is shuffled
    joined = texts.join(members.withColumnRenamed("doc_id", "rep"), (F.col("doc_id").eqNullSafe(F.col("rep"))) & (texts["th"] == members["th"])).select("root", "size", "c", "text").dropDuplicates(["c"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [shingles(t.as_py(), words) for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([f.tobytes() for f in found], pa.binary()), pa.array([signature(f).tobytes() for f in found], pa.binary())], names=["root", "size", "c", "found", "sig"])

    made = joined.mapInArrow(tidied(sets), "root long, size long, c long, found binary, sig binary")
    dealt = _blocks(made, "root", F.col("size"), GROUP_BLOCK).select("root", "i", "j", "own", "c", "sig", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[], [], []]
        for rows in _groups(batches, 3):
            if len(rows) > 1:
                left, right, same = _split(rows, 1, 2, 3)
                sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), HASHES)
                i, j = survivors(sig[left], sig[right], same, needed)
                i, j = np.array(left, int)[i], np.array(right, int)[j]
                found = [np.frombuffer(r[6], np.uint64) for r in rows]
                size = np.array([len(f) for f in found])
                both = overlaps(found, i, j)
                linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[linked], j[linked]
                links = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
                root = roots_of(len(rows), i, j)
                some = np.flatnonzero(links)
                out[0] += [rows[k][4] for k in some.tolist()]
                out[1] += [rows[k][4] for k in root[some].tolist()]
                out[2] += links[some].tolist()
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n"])
                out = [[], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n"])

    return dealt.mapInArrow(tidied(run), "a long, b long, n long")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, th, class_id, copy_id, n_copies, n_links, component.

    Documents with equal sets of shingles are copies of one class of texts, ``copy_id`` its smallest doc_id and
    ``n_copies`` its size. Classes are linked when the Jaccard similarity of their sets reaches ``threshold``:
    ``n_links`` counts the other classes so linked, and ``class_id`` is the smallest doc_id of the component that the
    links form. ``component`` is a number of its own for each component, also where ids are null or stand on several
    texts (null for texts without a word). ``th`` tells rows of equal doc_id apart.

    Classes that share a MinHash band are compared value by value, dropped as soon as the posterior odds of reaching
    the threshold fall below ``tolerance``, and gathered into candidate components; inside a component all pairs are
    compared again, and those left are verified exactly. Buckets and components larger than a block are dealt out as
    pairs of blocks. Links are never emitted pair by pair: a task returns counts and a spanning forest.

    Null and empty texts, and texts with no word, have no shingles: each is its own class and has no link. Texts of
    fewer than ``words`` words are one shingle. Null ids join classes like any other (ids of a class skip nulls).
    Repeated rows are copies. An empty table gives no rows; other columns take no part.
    """
    needed = least_matches(threshold, tolerance)
    signed = written(_signed(docs, words), "signed")
    rep = F.min(F.struct("doc_id", "th"))
    classes = written(signed.where("c is not null").groupBy("c").agg(rep.alias("rep"), F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), "classes")
    together = components(_candidates(classes, needed))
    together = together.join(together.groupBy("root").agg(F.count("*").alias("size")), "root")
    members = together.withColumnRenamed("a", "c").join(classes.select("c", "rep.doc_id", "rep.th"), "c")
    links = written(_verified(docs, members, words, threshold, needed), "links")
    degree = links.groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "c")
    groups = components(links.select("a", "b")).withColumnRenamed("a", "c")
    named = groups.join(classes.select("c", "copy_id"), "c")
    named = named.join(named.groupBy("root").agg(F.min("copy_id").alias("class_id")), "root").select("c", "class_id", "root").join(degree, "c")
    found = classes.select("c", "copy_id", "n_copies").join(named, "c", "left")
    return signed.select("doc_id", "th", "c").join(found, "c", "left").select(
        "doc_id",
        "th",
        F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "c").alias("component"),
    )


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest (doc_id, text hash); null ids go last.

    Of rows with equal id and text one stays. Texts without a word all stay, but for such repeats. Columns are kept.
    """
    found = written(near_duplicates(docs, words, threshold).select("doc_id", "th", "component"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    best = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("k")).select("k.doc_id", "k.th")
    best = best.unionByName(found.where(F.col("component").isNull()).select("doc_id", "th")).toDF("best_id", "best_th")
    spare = found.select("doc_id", "th").distinct().join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("th") == F.col("best_th")), "left_anti")
    again = found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "th")
    i, t, own, touched = (free_name(docs.columns, n) for n in ("spare_id", "spare_th", "own_th", "touched"))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = marked_members(marked, F.col(own), membership(spare.unionByName(again), "th"), touched)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = marked.where(F.col(touched)).join(spare.toDF(i, t), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(t)), "left_anti")
    return marked.where(~F.col(touched)).select(columns).unionByName(rest.dropDuplicates(["doc_id", own]).select(columns))
