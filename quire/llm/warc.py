"""Deterministic sharded WARC writer and the reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import tidied, written

MANIFEST = "_manifest"
#: A file is closed once it holds so many compressed bytes.
ROLL_BYTES = 64 << 20
#: Shards hold at least so many bytes, and so many times the root of all bytes: 256 MB of 1 TB, 2.5 GB of 100 TB.
LEAST_SHARD, SHARD_ROOT = 16 << 20, 256
#: Bytes counted for a record besides its payload.
RECORD_BYTES = 700
#: Payloads, and pages of one payload, that make up more than one part in HEAVY of all rows are told by a broadcast.
HEAVY = 1 << 14
#: Records carry this date, so that the same pages give the same bytes.
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
MANIFEST_SCHEMA = "file string, records long, bytes long, sha1 string, first_page_id long, last_page_id long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


class Store:
    """Whole files of a folder, local or in any store that pyarrow opens."""

    def __init__(self, folder: str) -> None:
        self.local = "://" not in folder and not folder.startswith("file:") or folder.startswith("file:")
        if self.local:
            self.root = "/" + folder.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def put(self, name: str, data: bytes) -> None:
        """The file appears whole: it is written under a name of its own and then renamed."""
        part = f"{self.root}/_temporary/{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(os.path.dirname(part), exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{self.root}/{name}")
        else:
            self.fs.create_dir(os.path.dirname(part))
            with self.fs.open_output_stream(part) as f:
                f.write(data)
            self.fs.move(part, f"{self.root}/{name}")

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_stream(f"{self.root}/{name}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: str = "0") -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{copy}')}>"


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, copy: str, date: str) -> tuple[list[tuple[str, str]], bytes]:
    """Head and block of a response with its payload, or (payload None) a revisit of its page's or an earlier page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    plain = url is not None and url != "" and all("!" <= c <= "~" for c in url)
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Target-URI", target),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if not plain:  # so that it is read back as it was
        head.append(("X-Url", "" if url is None else base64.b64encode(b"=" + url.encode()).decode()))
    return head, block


def _revisit(head: list[tuple[str, str]], first: int, digest: str) -> list[tuple[str, str]]:
    return [*head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-Id", str(first))]


def _info(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\nsoftware: quire\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Filename", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], body)


def _later(pairs: DataFrame, total: int) -> DataFrame:
    """(page_id, key, first) of all pages above ``first``, the smallest page that has the payload.

    Payloads of very many pages find it by a broadcast of at most HEAVY rows, the others by a join on their key.
    """
    known = pairs.where("page_id is not null").select("page_id", "key")
    firsts = written(known.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1"), "firsts")
    often = F.col("pages") > total // HEAVY
    heavy = F.broadcast(firsts.where(often).select("key", "first"))
    usual = known.join(heavy.select("key"), "key", "left_anti").join(firsts.where(~often).select("key", "first"), "key")
    return known.join(heavy, "key").unionByName(usual).where("page_id > first").select("page_id", "key", "first")


def _chunks(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Repeated rows of a page, counted, in chunks that are fractions of a shard: place (of the chunk), n."""
    each = F.when(F.col("page_id").isNull(), F.col("size")).otherwise(F.lit(0)) + RECORD_BYTES
    some = F.greatest(F.lit(1), F.floor(F.lit(shard_bytes / 4) / each)).cast("long")
    parts = rows.withColumn("some", some).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("some")))))
    return parts.withColumn("n", F.least(F.col("some"), F.col("n") - F.col("place") * F.col("some"))).drop("some")


def _bounds(units: DataFrame, shard_bytes: int) -> DataFrame:
    """One row with the first (page_id, key, url, place) of every shard, in order.

    The units are sorted and summed up from the first on, so that shards depend on the rows alone: on executors inside
    ranges, of which only the sums come to the driver.
    """
    schema = "page_id long, key string, url string, place long, range long, before long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            weight = batch.column(4).to_numpy()
            before = total + np.cumsum(weight) - weight
            total += int(weight.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(weight), at)), pa.array(before)], names=[c.split()[0] for c in schema.split(", ")])
        yield pa.RecordBatch.from_arrays([pa.array([None], t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64())] + [pa.array([at], pa.int64()), pa.array([total], pa.int64())], names=[c.split()[0] for c in schema.split(", ")])

    order = ("page_id", "key", "url", "place")
    sorted_ = written(units.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "weight").mapInArrow(tidied(run), schema), "order")
    sums = sorted_.where("place is null").orderBy("range").collect()
    ahead = np.cumsum([0] + [r["before"] for r in sums])
    spark = units.sparkSession
    offsets = F.broadcast(spark.createDataFrame([(r["range"], int(x)) for r, x in zip(sums, ahead[:-1], strict=True)], "range long, ahead long"))
    shard = F.floor((F.col("before") + F.col("ahead")) / shard_bytes)
    firsts = sorted_.where("place is not null").join(offsets, "range").groupBy(shard.alias("shard")).agg(F.min(F.struct(*order)).alias("b"))
    return firsts.agg(F.array_sort(F.collect_list("b")).alias("bounds"))


def _shard_of(key: Column, bounds: Column) -> Column:
    """The number of the last bound that is not above ``key``, found by halving."""

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
        fits = F.element_at(bounds, middle + 1) <= key
        return F.struct(F.when(fits, middle).otherwise(acc["low"]).alias("low"), F.when(fits, acc["high"]).otherwise(middle - 1).alias("high"))

    start = F.struct(F.lit(0).alias("low"), (F.size(bounds) - 1).alias("high"))
    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds).cast("double"))).cast("int") + 1)
    return F.aggregate(turns, start, lambda acc, x: F.when(acc["low"] < acc["high"], step(acc, x)).otherwise(acc))["low"]


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE, shard_bytes: int | None = None) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) to gzip WARC files in ``folder``.

    Rows are sorted by page_id and dealt into shards of ``shard_bytes`` bytes (by default LEAST_SHARD or SHARD_ROOT times
    the root of all bytes), whose bounds follow from the rows alone: the same rows give the same files, however they
    lie. Each shard rolls its files by compressed size and names them by its number. Of equal payloads the one with the
    smallest page_id is a response, the others revisit it. Every file appears by renaming, so a repeated task replaces
    its files with the same bytes; the manifest, a Parquet table that Spark commits last, names the files that count.
    Lengths, ids and digests are worked out anew.

    Null html is an empty payload; a null or unprintable url is read back as it was. Rows without page_id are responses
    of their own. Of rows with equal page_id and payload the first (by url, null first) is the response, the others
    revisit it; where they are many they are counted first and their records spread over shards. A page must fit in
    memory. An empty table gives an empty manifest; other columns take no part.
    """
    datetime.fromisoformat(date)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("key", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    total, total_bytes = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)) + F.count("*") * RECORD_BYTES).first()
    shard_bytes = shard_bytes or max(LEAST_SHARD, int(SHARD_ROOT * total_bytes**0.5))
    pairs = written(base.groupBy("page_id", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "pairs")
    later = _later(pairs, total)
    no_url, at_start = F.lit(None).cast("string"), F.lit(0).cast("long")

    # pages with very many rows of one payload: counted by url, in chunks that know what they refer to
    hot = F.broadcast(pairs.where(F.col("n") > max(1, total // HEAVY)).select(F.col("page_id").alias("hot_id"), F.col("key").alias("hot_key")))
    is_hot = F.col("page_id").eqNullSafe(F.col("hot_id")) & (F.col("key") == F.col("hot_key"))
    counted = written(base.join(hot, is_hot, "left_semi").groupBy("page_id", "key", "url").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.first("payload").alias("payload")), "counted")
    leads = counted.groupBy(F.col("page_id").alias("lead_id"), F.col("key").alias("lead_key")).agg(F.min(F.struct("url")).alias("lead"))
    chunks = _chunks(counted, shard_bytes).join(F.broadcast(leads), F.col("page_id").eqNullSafe(F.col("lead_id")) & (F.col("key") == F.col("lead_key")))
    hot_later = F.broadcast(later.join(hot, is_hot, "left_semi").toDF("later_id", "later_key", "later_first"))
    chunks = chunks.join(hot_later, (F.col("page_id") == F.col("later_id")) & (F.col("key") == F.col("later_key")), "left")
    leading = (F.col("place") == 0) & (F.struct("url") == F.col("lead"))
    first = F.coalesce("later_first", F.when(~F.coalesce(leading, F.lit(False)), F.col("page_id")))
    many = chunks.select("page_id", "key", F.lit(1).alias("kind"), "url", F.col("url").alias("at_url"), "place", "n", "size", F.when(first.isNull(), F.col("payload")).alias("payload"), first.alias("first"))

    weight = F.col("bytes") + F.col("n") * RECORD_BYTES
    units = pairs.join(hot, is_hot, "left_anti").select("page_id", "key", no_url.alias("url"), at_start.alias("place"), weight.alias("weight"))
    split = many.select("page_id", "key", "url", "place", (F.when(F.col("page_id").isNull(), F.col("size") * F.col("n")).otherwise(F.coalesce(F.octet_length("payload"), F.lit(0))) + F.col("n") * RECORD_BYTES).cast("long").alias("weight"))
    bounds = written(_bounds(units.unionByName(split), shard_bytes), "bounds").withColumn("one", F.lit(1))

    one = base.join(hot, is_hot, "left_anti").select("page_id", "key", F.lit(1).alias("kind"), "url", no_url.alias("at_url"), at_start.alias("place"), F.lit(1).cast("long").alias("n"), "size", "payload", F.lit(None).cast("long").alias("first"))
    marks = later.select("page_id", "key", F.lit(0).alias("kind"), no_url.alias("url"), no_url.alias("at_url"), at_start.alias("place"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("payload"), "first")
    rows = one.unionByName(many)
    placed = rows.unionByName(marks).withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one")
    own = F.struct("page_id", "key", F.col("at_url").alias("url"), "place")
    placed = placed.withColumn("shard", _shard_of(own, F.col("bounds"))).select("shard", "page_id", "key", "at_url", "place", "kind", "first", "url", "n", "size", "payload")
    shards = max(1, -(-total_bytes // shard_bytes))
    dealt = placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "key", "at_url", "place", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        body, name, n, span, shard, files = io.BytesIO(), "", 0, [None, None], None, 0

        def close() -> pa.RecordBatch:
            data = body.getvalue()
            store.put(name, data)
            row = [name, n, len(data), hashlib.sha1(data, usedforsecurity=False).hexdigest(), *span]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])

        at, mark, seen = None, None, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for number, page_id, key, at_url, place, kind, points, url, copies, size, data in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True):
                    if number != shard:
                        if n:
                            yield close()
                        shard, n, files = number, 0, 0
                    if (page_id, key, at_url, place) != at:
                        at, mark, seen = (page_id, key, at_url, place), points, 0
                    if kind == 0:
                        continue
                    digest = base64.b32encode(bytes.fromhex(key)).decode()
                    for _ in range(copies):
                        if not n:
                            name = f"pages-{shard:06d}-{files:04d}.warc.gz"
                            files += 1
                            body, span = io.BytesIO(), [page_id, page_id]
                            body.write(_info(name, date))
                        refers = None if page_id is None else mark if mark is not None else page_id if seen else None
                        answers = refers is None and page_id is not None
                        head, block = _record(page_id, url, digest, size, data if refers is None else None, "0" if answers else f"{at_url}/{place}/{seen + 1}", date)
                        body.write(_member(head if refers is None else _revisit(head, refers, digest), block))
                        seen, n, span[1] = seen + 1, n + 1, page_id
                        if body.tell() >= roll_bytes:
                            yield close()
                            n = 0
        if n:
            yield close()

    dealt.mapInArrow(tidied(run), MANIFEST_SCHEMA).write.parquet(f"{folder}/{MANIFEST}")


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file in turn."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if parts:
                raise ValueError("the file ends inside a record")
            return
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            rest, parts, z = z.unused_data, [], zlib.decompressobj(31)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _read_record(fields: dict[str, str], block: bytes) -> tuple | None:
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    if fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']} is wrong")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["warc-type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is wrong")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    url = fields["warc-target-uri"]
    if "x-url" in fields:
        url = base64.b64decode(fields["x-url"])[1:].decode() if fields["x-url"] else None
    return number("x-page-id"), url, size, digest, fields["warc-type"], number("x-refers-to-page-id")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record of the files that the manifest names; every digest and length is checked."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, rows = 0, []
                with store.open(name) as f:
                    for member in _members(f):
                        if got := _read_record(*parse(member)):
                            seen += 1
                            rows.append((*got, name))
                            if len(rows) >= 10_000:
                                yield pack(rows)
                                rows = []
                if seen != expected:
                    raise ValueError(f"{name} holds {seen} records; the manifest says {expected}")
                if rows:
                    yield pack(rows)

    return manifest.repartition(max(1, min(2 * files, 8192)), "file").select("file", "records").mapInArrow(tidied(run), RECORD_SCHEMA)
