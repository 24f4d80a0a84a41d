"""Positioned text items and outlines out of PDF files, without any library: the parts of the format that texts need."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

ITEM_SCHEMA = "doc string, page int, ord int, str string, x double, y double, width double, font_name string, font_size double"
OUTLINE_SCHEMA = "doc string, title string, page int, pages int"
#: Where fonts tell no widths, a character is taken to be so many sizes wide.
USUAL_WIDTH = 0.5
_DELIMITERS = b"()<>[]{}/% \t\r\n\x00\x0c"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class Name(str):
    """A name, which a file writes after a slash."""


class Operator(str):
    """A word of a page's program."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    about: dict
    raw: bytes


class Reader:
    """Reads values one after the other."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def _skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c == 37:  # a comment
                end = re.compile(rb"[\r\n]").search(self.data, self.at)
                self.at = end.start() if end else len(self.data)
            elif c in b" \t\r\n\x00\x0c":
                self.at += 1
            else:
                return

    def value(self):
        """The next value; None at the end. Closing brackets come as operators."""
        self._skip()
        d = self.data
        if self.at >= len(d):
            return None
        two, c = d[self.at : self.at + 2], d[self.at : self.at + 1]
        if two == b"<<":
            return self._dictionary()
        if two == b">>":
            self.at += 2
            return Operator(">>")
        if c == b"[":
            return self._array()
        if c in (b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return Operator(c.decode())
        if c == b"(":
            return self._text()
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1 if end >= 0 else len(d)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            word = self._word(self.at + 1)
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), word))
        if m := _REFERENCE.match(d, self.at):
            self.at = m.end()
            return Ref(int(m[1]))
        if m := _NUMBER.match(d, self.at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        word = self._word(self.at)
        if not word:
            self.at += 1
        return {"true": True, "false": False, "null": None}.get(word, Operator(word))

    def _word(self, start: int) -> str:
        end = start
        while end < len(self.data) and self.data[end] not in _DELIMITERS:
            end += 1
        self.at = end
        return self.data[start:end].decode("latin-1")

    def _dictionary(self) -> dict:
        self.at += 2
        out = {}
        while self.at < len(self.data):
            key = self.value()
            if not isinstance(key, Name):
                break
            out[str(key)] = self.value()
        return out

    def _array(self) -> list:
        self.at += 1
        out = []
        while self.at < len(self.data):
            v = self.value()
            if isinstance(v, Operator):
                break
            out.append(v)
        return out

    def _text(self) -> bytes:
        d, k, depth, out = self.data, self.at + 1, 1, bytearray()
        while k < len(d):
            c = d[k : k + 1]
            if c == b"\\":
                k += 1
                if m := re.compile(rb"[0-7]{1,3}").match(d, k):
                    out.append(int(m[0], 8) & 255)
                    k = m.end()
                    continue
                nxt = d[k : k + 1]
                if nxt in b"\r\n" and nxt:
                    k += 2 if d[k : k + 2] == b"\r\n" else 1
                    continue
                out += _ESCAPES.get(nxt, nxt)
                k += 1
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
            k += 1
        self.at = k + 1
        return bytes(out)


@dataclass
class Font:
    name: str = ""
    wide: bool = False
    letters: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)

    def read(self, raw: bytes) -> tuple[str, float]:
        """The text of a shown string, and its width in sizes."""
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)] if self.wide else list(raw)
        plain = (lambda c: chr(c)) if self.wide else (lambda c: bytes([c]).decode("cp1252", "replace"))
        return "".join(self.letters.get(c) or plain(c) for c in codes), sum(self.widths.get(c, USUAL_WIDTH) for c in codes)


def _letters(program: bytes) -> dict[int, str]:
    """What a font's codes stand for, from its map to Unicode."""
    out: dict[int, str] = {}
    text = lambda raw: raw.decode("utf-16-be", "replace")
    r, held = Reader(program), []
    while (v := r.value()) is not None or r.at < len(program):
        if v == "endbfchar":
            for a, b in zip(held[::2], held[1::2], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[int.from_bytes(a, "big")] = text(b)
        elif v == "endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(low, min(high, low + 65535) + 1):
                    if isinstance(c, list):
                        if k - low < len(c):
                            out[k] = text(c[k - low])
                    else:
                        out[k] = text(c[:-2] + (int.from_bytes(c[-2:], "big") + k - low & 65535).to_bytes(2, "big"))
        if isinstance(v, Operator):
            held = []
        else:
            held.append(v)
    return out


class Pdf:
    """The objects of a file, found by reading it through, whatever its cross references say."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        trailers = []
        for m in _OBJECT.finditer(data):
            r = Reader(data, m.end())
            value = r.value()
            if isinstance(value, dict):
                s = re.compile(rb"\s*stream\r?\n").match(data, r.at)
                if s:
                    value = Stream(value, b"")
                    size = value.about.get("Length")
                    end = s.end() + size if isinstance(size, int) else -1
                    if not data[end : end + 20].lstrip().startswith(b"endstream"):
                        end = data.find(b"endstream", s.end())
                    value.raw = data[s.end() : end if end >= 0 else len(data)]
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"\btrailer\b", data):
            if isinstance(t := Reader(data, m.end()).value(), dict):
                trailers.append(t)
        for s in [o for o in self.objects.values() if isinstance(o, Stream)]:
            if s.about.get("Type") == "ObjStm":
                body = self.decoded(s)
                r = Reader(body)
                heads = [(r.value(), r.value()) for _ in range(int(self.at(s.about.get("N")) or 0))]
                for number, offset in heads:
                    if isinstance(number, int) and isinstance(offset, int):
                        self.objects.setdefault(number, Reader(body, int(self.at(s.about.get("First")) or 0) + offset).value())
            elif s.about.get("Type") == "XRef":
                trailers.append(s.about)
        if any("Encrypt" in t for t in trailers):
            raise ValueError("the PDF file is encrypted")
        roots = [self.at(t["Root"]) for t in trailers if "Root" in t] + [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        self.root: dict = next((r for r in roots if isinstance(r, dict)), {})
        self.info: dict = next((i for t in trailers if isinstance(i := self.at(t.get("Info")), dict)), {})
        self.pages = list(self._pages(self.root.get("Pages"), {}, set()))

    def at(self, value):
        """The value itself, or the object that it refers to."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def decoded(self, stream: Stream) -> bytes:
        """A stream's bytes; empty where it is packed in a way that texts don't use."""
        filters = self.at(stream.about.get("Filter"))
        out = stream.raw
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            f = self.at(f)
            if f == "FlateDecode":
                try:
                    out = zlib.decompressobj().decompress(out)
                except zlib.error:
                    return b""
            elif f == "ASCIIHexDecode":
                out = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", out.split(b">")[0]).decode())
            else:
                return b""
        return out

    def _pages(self, node, given: dict, seen: set) -> Iterator[tuple[int | None, dict]]:
        number = node.number if isinstance(node, Ref) else None
        node = self.at(node)
        if not isinstance(node, dict) or number in seen:
            return
        seen = seen | {number}
        given = {**given, **{k: node[k] for k in ("Resources", "MediaBox") if k in node}}
        kids = self.at(node.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                yield from self._pages(kid, given, seen)
        else:
            yield number, {**given, **node}

    def _font(self, about) -> Font:
        about = self.at(about)
        if not isinstance(about, dict):
            return Font()
        font = Font(str(self.at(about.get("BaseFont")) or ""), about.get("Subtype") == "Type0")
        if isinstance(to := self.at(about.get("ToUnicode")), Stream):
            font.letters = _letters(self.decoded(to))
        widths, first = self.at(about.get("Widths")), self.at(about.get("FirstChar"))
        if isinstance(widths, list) and isinstance(first, int):
            font.widths = {first + k: w / 1000 for k, w in enumerate(map(self.at, widths)) if isinstance(w, int | float)}
        return font

    def items(self, page: dict) -> Iterator[tuple[str, float, float, float, str, float]]:
        """(text, x, y, width, font, size) of each string that a page shows."""
        contents = self.at(page.get("Contents"))
        parts = [self.at(c) for c in contents] if isinstance(contents, list) else [contents]
        program = b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))
        resources = self.at(page.get("Resources")) or {}
        fonts = {k: self._font(v) for k, v in (self.at(resources.get("Font")) or {}).items()}
        whole, kept = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []
        line = text = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        font, size, leading = Font(), 1.0, 0.0
        times = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])
        r, held = Reader(program), []
        while True:
            v = r.value()
            if v is None and r.at >= len(program):
                return
            if not isinstance(v, Operator):
                held.append(v)
                continue
            numbers = [h for h in held if isinstance(h, int | float) and not isinstance(h, bool)]
            if v == "BT":
                line = text = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif v == "q":
                kept.append(whole)
            elif v == "Q" and kept:
                whole = kept.pop()
            elif v == "cm" and len(numbers) == 6:
                whole = times(tuple(numbers), whole)
            elif v == "Tf" and len(held) >= 2 and numbers:
                font, size = fonts.get(str(held[0]), Font()), float(numbers[-1])
            elif v == "TL" and numbers:
                leading = numbers[0]
            elif v in ("Td", "TD") and len(numbers) == 2:
                leading = -numbers[1] if v == "TD" else leading
                line = text = times((1, 0, 0, 1, *numbers), line)
            elif v == "Tm" and len(numbers) == 6:
                line = text = tuple(map(float, numbers))
            elif v in ("T*", "'", '"'):
                line = text = times((1, 0, 0, 1, 0, -leading), line)
            if v in ("Tj", "TJ", "'", '"') and held:
                shown = held[-1] if isinstance(held[-1], list) else [held[-1]]
                said, wide = "", 0.0
                for part in shown:
                    if isinstance(part, bytes):
                        letters, width = font.read(part)
                        said, wide = said + letters, wide + width
                    elif isinstance(part, int | float):
                        wide -= part / 1000
                        if part < -180 and said and not said.endswith(" "):  # a gap as wide as a blank
                            said += " "
                place = times(text, whole)
                scale = (place[2] ** 2 + place[3] ** 2) ** 0.5 or 1.0
                along = (place[0] ** 2 + place[1] ** 2) ** 0.5 or 1.0
                if said.strip():
                    yield said, place[4], place[5], wide * size * along, font.name, size * scale
                text = times((1, 0, 0, 1, wide * size, 0), text)
            held = []

    def _text(self, raw) -> str:
        raw = self.at(raw)
        if not isinstance(raw, bytes):
            return ""
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")

    def title(self) -> str:
        return self._text(self.info.get("Title"))

    def _named(self, name, node=None, depth: int = 0):
        """The destination of a name, in the tree of names or in the old dictionary."""
        if node is None:
            old = self.at(self.root.get("Dests"))
            if isinstance(old, dict) and str(name) in old:
                return self.at(old[str(name)])
            node = self.at((self.at(self.root.get("Names")) or {}).get("Dests"))
        if not isinstance(node, dict) or depth > 30:
            return None
        names = self.at(node.get("Names")) or []
        for key, value in zip(names[::2], names[1::2], strict=False):
            if self.at(key) == name:
                return self.at(value)
        for kid in self.at(node.get("Kids")) or []:
            if (found := self._named(name, self.at(kid) or {}, depth + 1)) is not None:
                return found
        return None

    def _page_of(self, destination) -> int | None:
        destination = self.at(destination)
        if isinstance(destination, bytes | Name):
            destination = self._named(destination if isinstance(destination, bytes) else str(destination))
        if isinstance(destination, dict):
            destination = self.at(destination.get("D"))
        if not isinstance(destination, list) or not destination:
            return None
        first = destination[0]
        if isinstance(first, int):
            return first + 1 if 0 <= first < len(self.pages) else None
        return next((k + 1 for k, (number, _) in enumerate(self.pages) if isinstance(first, Ref) and number == first.number), None)

    def outline(self) -> Iterator[tuple[str, int]]:
        """Title and page of each entry of the outline's first level that leads to a page."""
        entry, seen = (self.at(self.root.get("Outlines")) or {}).get("First"), set()
        while isinstance(entry, Ref) and entry not in seen and isinstance(found := self.at(entry), dict):
            seen.add(entry)
            page = self._page_of(found["Dest"] if "Dest" in found else (self.at(found.get("A")) or {}).get("D"))
            if page:
                yield self._text(found.get("Title")), page
            entry = found.get("Next")


def _read(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                yield pd.DataFrame(list(rows(path, Pdf(bytes(content)))), columns=names)

    return files.where("ext = '.pdf'").select("path", "content").mapInPandas(run, schema)


def text_items(files: DataFrame) -> DataFrame:
    """The positioned text items of PDF files (read_files), page by page; a broken or encrypted file fails the query."""
    return _read(files, ITEM_SCHEMA, lambda path, pdf: ((path, n + 1, k, said, x, y, width, font, size) for n, (_, page) in enumerate(pdf.pages) for k, (said, x, y, width, font, size) in enumerate(pdf.items(page))))


def outlines(files: DataFrame) -> DataFrame:
    """The outline entries of PDF files with the pages they lead to, and the number of pages."""
    return _read(files, OUTLINE_SCHEMA, lambda path, pdf: ((path, title, page, len(pdf.pages)) for title, page in pdf.outline()))


def titles(files: DataFrame) -> DataFrame:
    """What PDF files say of their titles: doc, title, pages."""
    return _read(files, "doc string, title string, pages int", lambda path, pdf: [(path, pdf.title(), len(pdf.pages))])
