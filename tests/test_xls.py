import struct

import pytest

from quire.sources import files, xls


def record(kind, raw):
    return struct.pack("<HH", kind, len(raw)) + raw


def text(said):
    return struct.pack("<HB", len(said), 1) + said.encode("utf-16-le")


def workbook(small=False):
    """Two sheets with every kind of cell; the shared strings are cut inside a string."""
    cell = lambda kind, r, c, raw: record(kind, struct.pack("<HHH", r, c, 0) + raw)
    one = b"".join([
        record(0x809, bytes(16)), cell(0xFD, 0, 0, struct.pack("<I", 0)), cell(0xFD, 0, 2, struct.pack("<I", 1)), cell(0x203, 1, 0, struct.pack("<d", 2.5)), cell(0x27E, 1, 1, struct.pack("<I", 7 << 2 | 2)),
        cell(0x27E, 1, 2, struct.pack("<i", (-150 << 2) | 3)[:4]), record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 4 << 2 | 2, 0, 5 << 2 | 2, 1)), cell(0x204, 3, 1, text("标签")), cell(0x205, 4, 0, b"\x01\x00"),
        cell(0x06, 5, 0, b"\x00" * 6 + b"\xff\xff" + bytes(8)), record(0x207, text("result")), cell(0x06, 5, 1, struct.pack("<d", 1e3) + bytes(8)), cell(0x06, 5, 2, b"\x02" + bytes(5) + b"\xff\xff" + bytes(8)), record(0x0A, b""),
    ])
    two = record(0x809, bytes(16)) + record(0x0A, b"")
    plain = struct.pack("<HB", 5, 0) + b"plain"
    first, rest = struct.pack("<II", 2, 2) + plain + struct.pack("<HBH", 4, 1 | 8, 1) + "细胞".encode("utf-16-le"), b"\x01" + "膜。".encode("utf-16-le") + bytes(4)
    shared = record(0xFC, first) + record(0x3C, rest)
    sheet = lambda at, name: record(0x85, struct.pack("<IBB", at, 0, 0) + bytes([len(name), 1]) + name.encode("utf-16-le"))
    head = record(0x809, bytes(16)) + sheet(0, "表一") + sheet(0, "two") + shared + record(0x0A, b"")
    at = len(head)
    head = record(0x809, bytes(16)) + sheet(at, "表一") + sheet(at + len(one), "two") + shared + record(0x0A, b"")
    body = head + one + two
    return container(body if small else body + bytes(max(0, 4096 - len(body))), small)


def container(body, small):
    pad = lambda b, n: b + bytes(-len(b) % n)
    entry = lambda name, kind, start, size: pad(name.encode("utf-16-le"), 64) + struct.pack("<HB", 2 * len(name) + 2, kind) + bytes(49) + struct.pack("<II", start, size) + bytes(4)
    data = pad(body, 64) if small else body
    sectors = -(-len(data) // 512)
    folder = entry("Root Entry", 5, 3 if small else 0xFFFFFFFE, len(data) if small else 0) + entry("Workbook", 2, 0 if small else 3, len(body))
    table = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *(3 + k + 1 for k in range(sectors - 1)), 0xFFFFFFFE]
    minis = [*range(1, len(data) // 64), 0xFFFFFFFE] if small else []
    header = xls._MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<8I", 1, 1, 0, 4096, 2 if small else 0xFFFFFFFE, 1, 0xFFFFFFFE, 0)
    header += struct.pack("<I", 0) + b"\xff" * (512 - len(header) - 4)
    words = lambda ns: pad(struct.pack(f"<{len(ns)}I", *ns), 4) + b"\xff" * (512 - 4 * len(ns))
    return header + words(table) + pad(folder, 512) + words(minis) + pad(data, 512)


@pytest.mark.parametrize("small", [False, True])
def test_cells(small):
    (name, rows), (other, none) = xls.sheets(workbook(small))
    assert (name, other, none) == ("表一", "two", [])
    assert rows == [["plain", "", "细胞膜。"], ["2.5", "7", "-1.5"], ["4", "5"], ["", "标签"], ["TRUE"], ["result", "1000", "#ERROR"]]


def test_broken():
    for bad in (b"", b"hello", xls._MAGIC + bytes(600)):
        with pytest.raises((ValueError, struct.error)):
            xls.sheets(bad)


def test_chapters(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(workbook())
    got = files.chapters(files.read_files(spark, str(tmp_path / "a.xls"))).collect()
    assert [(r["title"], r["content"].split("\n")[:2]) for r in got] == [("表一", ["plain | 细胞膜。", "2.5 | 7 | -1.5"])]
