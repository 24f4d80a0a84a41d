"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import new_path, tidied, written

#: Numbers of segments, coarse to fine; on the finest level the last quarter of the dimensions stands in segments of two
#: and each of the others, which tell more, by itself.
LEVELS = (1, 4, 16)
#: Bytes of the queries that are searched for in one pass over all vectors.
QUERY_BYTES = 32 << 20
#: Queries and candidates whose bounds are worked out together.
TILE, ROWS = 512, 2048
#: One row in FLOOR_PART gives each query a first floor, by the same search; no result depends on it.
FLOOR_PART = 16
#: A level that dropped less than this share of its pairs is left out, and tried again every AGAIN tiles.
LEAST_DROPPED, AGAIN = 0.05, 64
#: Pairs whose exact products are worked out at a time.
PAIRS = 1 << 16


def cuts_of(energy: np.ndarray, segments: int) -> np.ndarray:
    """Where segments of about equal energy begin, for dimensions of falling energy."""
    total = np.concatenate([[0], np.cumsum(energy)])
    if total[-1] <= 0:
        return np.unique(np.linspace(0, len(energy), segments + 1).astype(int)[:-1])
    at = np.searchsorted(total, total[-1] * np.arange(segments) / segments * (1 - 1e-12))
    return np.unique(np.minimum(at, len(energy) - 1))


def finest(dims: int) -> np.ndarray:
    head = 3 * dims // 4
    return np.concatenate([np.arange(head), np.arange(head, dims, 2)])


def summary(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows whose dot products bound those of ``x``: means and deviations of each segment times root of its length.

    With a segment's n values written as mean plus rest, the dot product is n * m * m' plus the rests' product, which
    is at most n * s * s' (Cauchy-Schwarz). Equally |x-y|^2 >= sum of n * ((m-m')^2 + (s-s')^2).
    """
    size = np.diff(np.append(cuts, x.shape[1]))
    means = np.add.reduceat(x, cuts, axis=1) / size
    square = np.add.reduceat(x * x, cuts, axis=1) / size
    several = size > 1  # a single dimension is its mean
    deviations = np.sqrt(np.maximum(square - means * means, 0))[:, several]
    return np.concatenate([means, deviations], axis=1) * np.sqrt(np.concatenate([size, size[several]]))


@dataclass
class Block:
    """Queries of one dimension, turned so that the first coordinates tell most, and their summaries.

    Fewer queries than dimensions are not worth the turning of every vector: their dimensions are only sorted by energy.
    """

    ids: np.ndarray
    values: np.ndarray
    floor: np.ndarray
    turn: np.ndarray | None = field(init=False, default=None)
    order: np.ndarray | None = field(init=False, default=None)
    levels: list[tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self) -> None:
        q = self.values.astype(float)
        if len(q) < q.shape[1]:
            energy = (q * q).sum(axis=0)
            self.order = np.argsort(-energy, kind="stable")
            energy = energy[self.order]
        else:
            energy, turn = np.linalg.eigh(q.T @ q)
            energy, self.turn = np.maximum(energy[::-1], 0), turn[:, ::-1]
        turned = self.turned(q)
        cuts = [cuts_of(energy, s) for s in LEVELS if s < q.shape[1]] + [finest(q.shape[1])]
        self.levels = [(c, summary(turned, c).astype(np.float32)) for c in cuts]

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.order] if self.turn is None else x @ self.turn


class Search:
    """The best candidates of a block's queries so far, and counts of what each level dropped."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.floor = block.floor.astype(float).copy()
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.seen, self.dropped, self.exact, self.tiles = 0, 0, 0, 0
        self.useful = [True] * len(block.levels)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for low in range(0, len(ids), ROWS):
            self._add(ids[low : low + ROWS], x[low : low + ROWS])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        b = self.block
        peak = float(max(np.abs(x).max(initial=0), np.abs(b.values).max(initial=0)))
        slack = 2e-6 * peak * peak * x.shape[1] + 1e-6
        turned = b.turned(x.astype(float))
        sums: list[np.ndarray | None] = [None] * len(b.levels)
        for low in range(0, len(b.ids), TILE):
            tile = slice(low, low + TILE)
            alive = ids[:, None] != b.ids[None, tile]
            floor = (self.floor[tile] - slack).astype(np.float32)
            floor = np.nextafter(floor, np.float32(-np.inf))
            self.seen += int(alive.sum())
            retry = self.tiles % AGAIN == 0
            self.tiles += 1
            rows = np.arange(len(ids))
            if np.isfinite(floor).any():
                for level, (cuts, own) in enumerate(b.levels):
                    if not (self.useful[level] or retry) or not len(rows):
                        continue
                    if sums[level] is None:
                        sums[level] = summary(turned, cuts).astype(np.float32)
                    before = int(alive.sum())
                    alive[rows] &= sums[level][rows] @ own[tile].T >= floor
                    after = int(alive.sum())
                    self.dropped += before - after
                    self.useful[level] = before - after >= LEAST_DROPPED * before
                    rows = rows[alive[rows].any(axis=1)]
            i, j = np.nonzero(alive)
            self._verify(ids, x, i, j + low, peak)

    def _verify(self, ids: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, peak: float) -> None:
        """Exact products, in doubles where these hold them exactly, else in integers."""
        b = self.block
        self.exact += len(i)
        kind = float if peak * peak * x.shape[1] < 2**52 else np.int64
        if 2 * len(i) > len(x) * min(TILE, len(b.ids)):  # most pairs: all of them at once
            low = int(j.min())
            score = (x.astype(kind) @ b.values[low : int(j.max()) + 1].astype(kind).T)[i, j - low]
            self._keep(ids[i], j, score.astype(np.int64))
            return
        for at in range(0, len(i), PAIRS):
            some = slice(at, at + PAIRS)
            score = np.einsum("ij,ij->i", x[i[some]].astype(kind), b.values[j[some]].astype(kind))
            self._keep(ids[i[some]], j[some], score.astype(np.int64))

    def _keep(self, ids: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.floor[j]
        self.best.append((j[good], score[good], ids[good]))
        self.held += int(good.sum())
        if self.held > 4 * self.k * len(self.block.ids) + PAIRS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, candidate) of each query's k best, ties to smaller ids; raises the floors."""
        j, score, ids = (np.concatenate(c) if self.best else np.zeros(0, np.int64) for c in (zip(*self.best, strict=True) if self.best else ((), (), ())))
        order = np.lexsort((ids, -score, j))
        j, score, ids = j[order], score[order], ids[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        last = rank == self.k - 1
        self.floor[j[last]] = np.maximum(self.floor[j[last]], score[last])
        keep = rank < self.k
        self.best, self.held = [(j[keep], score[keep], ids[keep])], int(keep.sum())
        return self.best[0]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _searched(vectors: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    """Each task's best (query_id, vec_id, score) for the queries of the blocks (by dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {dim: Search(b, k) for dim, b in blocks.items()}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in found:
                    some = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                    found[dim].add(some.column(0).to_numpy(), some.column(2).flatten().to_numpy().reshape(-1, dim))
        for s in found.values():
            j, score, ids = s.settle()
            yield pa.RecordBatch.from_arrays([pa.array(s.block.ids[j]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(tidied(run), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's ``k`` candidates with the highest integer inner product, ties to the smaller vec_id.

    ``is_query`` marks the rows of ``vectors`` (vec_id, embedding) that are queries; every other row is a candidate of
    each of them. Queries go in blocks of QUERY_BYTES through one pass over the vectors each, so vectors are never shuffled
    or copied. A block's queries are turned to their own principal directions, which leaves products as they are;
    segment bounds, coarse to fine, then drop pairs below the query's floor: the k-th best score among one row in
    FLOOR_PART, raised as better ones are met. Whole numbers decide among the pairs left. Returns query_id, rank (from
    1), vec_id, score; each block's part is written to the shared folder.

    Null vectors, vectors with null, NaN or infinite components, empty vectors and null ids take no part. A query
    meets candidates of its own dimension. Repeated vec_ids are all candidates (a query never meets its own id; its
    first row counts). Empty tables give no rows; other columns take no part.
    """
    spark = vectors.sparkSession
    values = quantised(F.col("embedding"), scale)
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), values.alias("v"), is_query.alias("is_query")).where("id is not null and v is not null")
    v = written(v.select("id", F.size("v").alias("dim"), "v", "is_query"), "vectors")
    queries = written(v.where("is_query").groupBy("id").agg(F.min_by("v", "v").alias("v")), "queries")
    total = queries.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()[0]
    parts = max(1, -(-total // QUERY_BYTES))
    rows = v.select("id", "dim", "v")
    out = new_path(spark, "best")
    for part in range(parts):
        some = queries.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)) == part).orderBy("id").collect()
        by_dim: dict[int, list] = {}
        for r in some:
            by_dim.setdefault(len(r["v"]), []).append(r)
        made = lambda floors: {d: Block(np.array([r["id"] for r in rs]), np.array([r["v"] for r in rs]), np.array([floors.get(r["id"], -np.inf) for r in rs])) for d, rs in by_dim.items()}  # noqa: E731, B023
        few = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FLOOR_PART)) == 0)
        floors = {r["query_id"]: float(r["score"]) for r in _best(_searched(few, made({}), k), k).where(F.col("rank") == k).collect()}
        _best(_searched(rows, made(floors), k), k).write.mode("append").parquet(out)
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(out).select("query_id", "rank", "vec_id", "score")
