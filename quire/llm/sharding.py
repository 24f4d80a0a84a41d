"""Shards balanced in bytes, tokens and rows at once by vector bin packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import tidied, written
from quire.llm.tokens import PART, slices, texts_of, unit_ids

#: Small groups are gathered by hash into so many bundles per shard; what goes to the driver is bounded by it.
BUNDLES = 384
#: A group with more than SPLIT of a shard in any measure is split into chunks of about CHUNK of a shard.
SPLIT, CHUNK = 1 / 2, 1 / 16
#: Where one document makes equal bytes, tokens and rows impossible, bytes come first: these are the weights of their gaps.
WEIGHTS = (10.0, 1.0, 1.0)
#: Bytes counted for a row besides its text.
ROW_BYTES = 8
#: Ids that stand on more than one part in HOT_IDS of all rows are dealt by row; rows of a unit numbered by one task.
HOT_IDS, TASK_ROWS = 1 << 14, 200_000


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: largest first, to where the dot product of load and residual capacity is highest.

    ``loads`` has a row per item and a column per measure. Ties go to the smaller shard number. Then items move on or
    change places while that evens all measures out together.
    """
    total = loads.sum(axis=0)
    unit = loads / np.where(total > 0, total, 1)
    order = np.lexsort((np.arange(len(unit)), -unit.max(axis=1, initial=0)))
    left = np.full((shards, loads.shape[1]), 1 / shards)
    out = np.zeros(len(unit), int)
    for i in order:
        s = int(np.argmax(left @ unit[i]))
        out[i] = s
        left[s] -= unit[i]
    return level(unit * np.array(WEIGHTS[: unit.shape[1]]), out, shards)


def level(unit: np.ndarray, out: np.ndarray, shards: int, moves: int = 1500) -> np.ndarray:
    """Evens out all measures jointly: each step lowers the sum of squared distances from the mean load.

    The step is between the two shards that lie furthest apart in some measure (the next measure or pair where nothing
    helps there): an item moves, or two change places, whichever lowers that sum most.
    """
    out = out.copy()
    full = np.stack([np.bincount(out, unit[:, c], shards) for c in range(unit.shape[1])], axis=1)
    nothing = np.zeros((1, unit.shape[1]))
    for _ in range(moves if len(unit) else 0):
        gaps = full.max(axis=0) - full.min(axis=0)
        for c in np.argsort(-gaps, kind="stable"):
            a, b = int(np.argmax(full[:, c])), int(np.argmin(full[:, c]))
            own, other = np.flatnonzero(out == a), np.flatnonzero(out == b)
            if a == b or not len(own):
                continue
            goes = unit[own][:, None, :] - np.concatenate([nothing, unit[other]])[None, :, :]
            gain = goes @ (full[a] - full[b]) - (goes * goes).sum(axis=2)
            i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[i, j] > 1e-15:
                out[own[i]] = b
                if j:
                    out[other[j - 1]] = a
                full[a] -= goes[i, j]
                full[b] += goes[i, j]
                break
        else:
            break
    return out


def _measured(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    """doc_id, size, tokens, text_crc32, g (hash of the text) and m, which tells equal rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        F.monotonically_increasing_id().alias("m"),
        text.alias("t"),
    )
    if vocabulary is None:
        words = F.when(F.length("t") > 0, F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1).otherwise(F.lit(0))
        return base.select("doc_id", "size", "text_crc32", "g", "m", words.cast("long").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unit_ids(vocabulary, 1)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            counts = [np.zeros(0, np.int64)]
            for a, b in slices(sizes, PART):
                data, offsets = texts_of(batch.column(5).slice(a, b - a))
                counts.append(table.counts(data, offsets[1:] - 1) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.concatenate(counts))], names=["doc_id", "size", "text_crc32", "g", "m", "tokens"])

    closed = base.withColumn("t", F.concat("t", F.lit("\n")))
    return closed.mapInArrow(tidied(run), "doc_id long, size long, text_crc32 long, g long, m long, tokens long")


def shard(docs: DataFrame, shards: int = 24, vocabulary: str | None = None) -> DataFrame:
    """Puts every document into one of ``shards`` shards; rows with equal texts form a group that stays together.

    Groups are bundled by hash, so the driver places at most ``shards * BUNDLES`` bundles; a group that holds more
    than SPLIT of a shard's bytes, tokens or rows (of which there are at most 3 * shards / SPLIT) is split into
    chunks by document id (and by row where one id stands on many of its rows) and placed by itself. Bytes, tokens and
    rows come out near equal together; where they can't, bytes do. Returns doc_id, size (UTF-8 bytes plus 8), tokens (by the word vocabulary file
    ``vocabulary``, else blank-separated words), text_crc32, shard and slot (gapless from 0 in each shard, in order of
    unit, part and id). Texts are read once; all else works on a table of numbers in the shared folder.

    Null text has size 8, no tokens and checksum 0 and shares a group with empty text; null ids are ordinary rows.
    Repeated rows each take a slot. Texts may have any length. An empty table gives no rows; other columns take no part.
    """
    spark = docs.sparkSession
    base = written(_measured(docs, vocabulary), "measured")
    groups = written(base.groupBy("g").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("size"), F.sum("tokens"), F.sum("n")).first()
    share = F.greatest(*(F.col(c) / max(1.0, (x or 0) / shards) for c, x in zip(("size", "tokens", "n"), total, strict=True)))
    heavy = F.broadcast(groups.where((share > SPLIT) & (F.col("n") > 1)).select("g", F.least(F.ceil(share / CHUNK), F.col("n")).cast("int").alias("parts")))
    ids = base.join(heavy.select("g"), "g").groupBy("g", "doc_id").agg(F.count("*").alias("k")).where(F.col("k") > max(1, (total[2] or 0) // HOT_IDS))
    ids = F.broadcast(ids.select(F.col("g").alias("hot_g"), F.col("doc_id").alias("hot_id")))
    same = (F.col("g") == F.col("hot_g")) & F.col("doc_id").eqNullSafe(F.col("hot_id"))
    by_hash = F.pmod(F.xxhash64("g", F.lit(1)), F.lit(shards * BUNDLES))
    own = F.when(F.col("hot_g").isNotNull(), F.col("m"))
    chunk = F.pmod(F.xxhash64("doc_id", own, F.lit(2)), F.col("parts").cast("long"))
    unit = F.when(F.col("parts").isNull(), by_hash).otherwise(-1 - F.pmod(F.xxhash64("g", chunk), F.lit(1 << 40)))
    parted = base.join(heavy, "g", "left").join(ids, same, "left").select("doc_id", "size", "tokens", "text_crc32", unit.alias("unit"), own.alias("own"))
    units = parted.groupBy("unit").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("unit").collect()
    loads = np.array([[u["size"], u["tokens"], u["n"]] for u in units], float).reshape(len(units), 3)
    before = [0] * shards
    rows = []
    for u, s in zip(units, place(loads, shards).tolist(), strict=True):
        rows.append((u["unit"], s, before[s], -(-u["n"] // TASK_ROWS)))
        before[s] += u["n"]
    placed = F.broadcast(spark.createDataFrame(rows, "unit long, shard int, before long, pieces long"))
    # a unit of many rows is numbered piece by piece
    dealt = parted.join(placed, "unit").withColumn("piece", F.pmod(F.xxhash64("doc_id", "own", F.lit(3)), F.col("pieces")))
    sums = dealt.groupBy("unit", "piece").agg(F.count("*").alias("rows"))
    ahead = F.sum("rows").over(Window.partitionBy("unit").orderBy("piece")) - F.col("rows")
    order = Window.partitionBy("unit", "piece").orderBy("doc_id", "text_crc32", "size", "own")
    numbered = dealt.withColumn("k", F.row_number().over(order)).join(sums.select("unit", "piece", ahead.alias("ahead")), ["unit", "piece"])
    return numbered.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("ahead") + F.col("k") - 1).cast("long").alias("slot"))
