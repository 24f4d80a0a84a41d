"""Sheets out of old binary workbooks: the container of streams, and the records that hold cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_FREE = 0xFFFFFFFA  # marks of sectors that lead nowhere begin here


def stream(data: bytes, *names: str) -> bytes:
    """The first stream of one of the names."""
    if data[:8] != _MAGIC or len(data) < 1024:
        raise ValueError("not an old workbook")
    if data[30:31] not in (b"\x09", b"\x0c"):
        raise ValueError("the workbook is broken")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    first_dir, _, cutoff, first_small, _, more, _ = struct.unpack_from("<7I", data, 48)
    places = numbers(data[76:512])
    while more < _FREE:
        part = numbers(sector(more))
        places += part[:-1]
        more = part[-1]
    table = [n for p in places if p < _FREE for n in numbers(sector(p))]

    def chain(n: int, following: list[int]) -> Iterator[int]:
        for _ in range(len(following) + 1):
            if n >= min(_FREE, len(following)):
                return
            yield n
            n = following[n]

    whole = lambda n: b"".join(sector(k) for k in chain(n, table))
    folder = whole(first_dir)
    entries = {}
    for at in range(0, len(folder) - 127, 128):
        length, kind = struct.unpack_from("<HB", folder, at + 64)
        start, total = struct.unpack_from("<II", folder, at + 116)
        entries.setdefault("" if kind == 5 else folder[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), (start, total))
    start, total = next((entries[n] for n in names if n in entries), (None, 0))
    if start is None:
        raise ValueError("the file holds no workbook")
    if total >= cutoff:
        return whole(start)[:total]
    short, follows = whole(entries[""][0]), numbers(whole(first_small))
    return b"".join(short[k * small : (k + 1) * small] for k in chain(start, follows))[:total]


def _records(book: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + size]
        at += 4 + size


def _strings(parts: list[bytes]) -> list[str]:
    """The shared strings; one that runs over the end of a part goes on in the next after a new width mark."""
    out: list[str] = []
    count = struct.unpack_from("<I", parts[0], 4)[0] if len(parts[0]) >= 8 else 0
    k, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal k, at
        got = b""
        while n > 0 and k < len(parts):
            piece = parts[k][at : at + n]
            got, at, n = got + piece, at + len(piece), n - len(piece)
            if n:
                k, at = k + 1, 0
        return got

    for _ in range(count):
        head = take(3)
        if len(head) < 3:
            break
        length, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        said, wide = "", flags & 1
        while length and k < len(parts):
            if at >= len(parts[k]):
                k, at = k + 1, 0
                if k >= len(parts):
                    break
                wide, at = parts[k][0] & 1, 1
            piece = parts[k][at : at + length * (1 + wide)]
            said += piece.decode("utf-16-le" if wide else "latin-1", "replace")
            at, length = at + len(piece), length - len(piece) // (1 + wide)
        take(4 * runs + extra)
        out.append(said)
    return out


def _number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _packed(raw: int) -> str:
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return _number(value / 100 if raw & 1 else value)


def _text(raw: bytes, wide_length: bool = True) -> str:
    length, at = (struct.unpack_from("<H", raw)[0], 2) if wide_length else (raw[0], 1)
    wide = raw[at] & 1
    return raw[at + 1 : at + 1 + length * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of an old workbook in their order, as rows of cell texts."""
    book = stream(data, "Workbook", "Book")
    listed: list[tuple[str, int]] = []
    parts: list[bytes] = []
    before = 0
    for kind, raw in _records(book):
        if kind == 0x85 and raw[5] == 0:
            listed.append((_text(raw[6:], False), struct.unpack_from("<I", raw)[0]))
        elif kind == 0xFC or kind == 0x3C and before == 0xFC:
            parts.append(raw)
            kind = 0xFC
        elif kind == 0x0A:
            break
        before = kind
    shared = _strings(parts) if parts else []
    out = []
    for name, start in listed:
        cells: dict[int, dict[int, str]] = {}
        waiting = None
        for kind, raw in _records(book, start):
            if kind == 0x0A:
                break
            if kind == 0x207 and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _text(raw)
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x205) or len(raw) < 6:
                continue
            row, column = struct.unpack_from("<HH", raw)
            line = cells.setdefault(row, {})
            if kind == 0xFD:
                at = struct.unpack_from("<I", raw, 6)[0]
                line[column] = shared[at] if at < len(shared) else ""
            elif kind == 0x203:
                line[column] = _number(struct.unpack_from("<d", raw, 6)[0])
            elif kind == 0x27E:
                line[column] = _packed(struct.unpack_from("<I", raw, 6)[0])
            elif kind == 0xBD:
                for k in range((len(raw) - 6) // 6):
                    line[column + k] = _packed(struct.unpack_from("<I", raw, 6 + 6 * k)[0])
            elif kind == 0x204:
                line[column] = _text(raw[6:])
            elif kind == 0x205:
                line[column] = ("TRUE" if raw[6] else "FALSE") if not raw[7] else "#ERROR"
            elif raw[12:14] == b"\xff\xff":  # a formula whose result is no number: text follows, or a truth, an error, nothing
                waiting = (row, column)
                line[column] = {1: "TRUE" if raw[8] else "FALSE", 2: "#ERROR"}.get(raw[6], "")
            else:
                line[column] = _number(struct.unpack_from("<d", raw, 6)[0])
        out.append((name, [[cells[r].get(c, "") for c in range(max(cells[r]) + 1)] for r in sorted(cells) if cells[r]]))
    return out
