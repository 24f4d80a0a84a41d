import base64
import gzip
import hashlib
import os

import pytest

from quire.llm import warc

SCHEMA = "page_id long, url string, html string, first long"


def pages():
    out = [(i, f"http://e.example/{i}", f"<p>{'x' * (i % 50)} {i % 37}</p>" if i % 9 else "same", 1) for i in range(300)]
    return [*out, (400, None, None, 1), (401, "http://é.example/ä b", "", 1), (5, "again", "same", 1), (5, "again", "same", 1), (None, "u", "same", 1), (402, "u", "ünï" * 40_000, 1)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    folder = f"file:{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, SCHEMA), folder, roll_bytes=3000)
    got = warc.read(spark, folder).collect()
    data = [(d, (h or "").encode()) for d, _, h, _ in rows]
    first = {}
    for d, b in data:
        if d is not None:
            first[b] = min(d, first.get(b, d))
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(d), len(b), digest(b)) for d, b in data)
    by_digest = {digest(b): f for b, f in first.items()}
    seen = set()
    for r in got:
        own = r["page_id"] is None or by_digest[r["payload_digest"]] == r["page_id"]
        if r["record_type"] == "response":
            assert own and r["refers_to"] is None and (r["page_id"] is None or (r["page_id"], r["payload_digest"]) not in seen)
            seen.add((r["page_id"], r["payload_digest"]))
        else:
            assert r["refers_to"] == by_digest[r["payload_digest"]]
    assert len(seen) == len(first) + 1
    assert sorted(map(str, ((r["page_id"], r["url"]) for r in got))) == sorted(map(str, ((d, u) for d, u, _, _ in rows)))
    names = sorted(n for n in os.listdir(tmp_path / "w") if n.endswith(".warc.gz"))
    assert len(names) > 3 and not os.listdir(tmp_path / "w/_temporary")
    text = gzip.decompress((tmp_path / "w" / names[0]).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.endswith(b"\r\n\r\n")


def files_of(folder):
    return {n: (folder / n).read_bytes() for n in os.listdir(folder) if n.endswith(".gz")}


def test_same_bytes_however_dealt(spark, tmp_path, monkeypatch):
    copies = [(500, f"u{k % 3}", "many copies " * 9, 1) for k in range(400)] + [(501, None, "many copies " * 9, 1)] * 60 + [(None, "n", "no id", 1)] * 100
    df = spark.createDataFrame(pages() + copies, SCHEMA)
    for heavy in (1 << 14, 1):  # copies counted first, and all of them row by row
        monkeypatch.setattr(warc, "HEAVY", heavy)
        found = []
        for k, some in enumerate((df.coalesce(1), df.repartition(7), df.orderBy("html"))):
            spark.conf.set("spark.sql.shuffle.partitions", str(3 + 2 * k))
            warc.write(some, f"file:{tmp_path}/{heavy}-{k}", shard_bytes=20_000)
            found.append(files_of(tmp_path / f"{heavy}-{k}"))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert found[0] == found[1] == found[2] and len(found[0]) > 5
        got = warc.read(spark, f"file:{tmp_path}/{heavy}-0").collect()
        assert len(got) == len(pages()) + len(copies)
        assert [(r["page_id"], r["url"]) for r in got if r["payload_bytes"] == 108 and r["record_type"] == "response"] == [(500, "u0")]
        assert {r["refers_to"] for r in got if r["page_id"] in (500, 501)} == {None, 500}
        assert {r["record_type"] for r in got if r["page_id"] is None} == {"response"}
        ids = [line for data in found[0].values() for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
        assert len(ids) == len(set(ids)) == len(got) + len(found[0])


def test_a_very_long_page(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x" * 20_000_000, 1), (2, "b", "x" * 20_000_000, 1), (3, "c", "", 1)], SCHEMA)
    warc.write(df, f"file:{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read(spark, f"file:{tmp_path}/w").collect()}
    assert (got[2]["refers_to"], got[2]["payload_bytes"], got[1]["record_type"], got[3]["record_type"]) == (1, 20_000_000, "response", "response")


def test_damage_is_noticed(spark, tmp_path):
    folder = f"file:{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", "payload", 1)], SCHEMA), folder)
    name = next(n for n in os.listdir(tmp_path / "w") if n.endswith(".gz"))
    whole = gzip.decompress((tmp_path / "w" / name).read_bytes())
    at = whole.rindex(b"WARC/1.1")
    (tmp_path / "w" / name).write_bytes(gzip.compress(whole[:at]) + gzip.compress(whole[at:].replace(b"payload\r\n", b"pAyload\r\n")))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, folder).collect()


def test_empty(spark, tmp_path):
    folder = f"file:{tmp_path}/w"
    warc.write(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read(spark, folder).count() == 0
