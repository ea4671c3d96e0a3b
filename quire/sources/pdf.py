"""Pages of PDF files: cross-reference tables and streams, compressed objects, and the page tree with what pages inherit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a page whose file gives no box; bytes that a stream may come to; and depth of nested values.
LETTER, LARGEST, DEEPEST = (0.0, 0.0, 612.0, 792.0), 1 << 28, 64
_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
#: What can stand at a place, after blanks and comments: 1 a name, 2 a reference, 3 a number or word, 4 and 5 a dictionary's
#: ends, 6 and 7 a list's, 8 a text without brackets in it, 9 the beginning of another one, 10 a text in hexadecimal.
_TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(?:(/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*+)|(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z])"
    rb"|([^\x00\t\n\x0c\r ()<>\[\]{}/%]++)|(<<)|(>>)|(\[)|(\])|\(((?:[^\\()]++|\\.)*+)\)|(\()|<([^>]*+)>)",
    re.S,
)
_BRACKET = re.compile(rb"\\.|[()]", re.S)
_SECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ ]+(\d+)[ ]*[\r\n]+")
_ENTRY = re.compile(rb"[\r\n ]*(\d{10}) (\d{5}) ([nf])[\r\n ]*")
_LOOSE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")


class Damaged(ValueError):
    """A file that does not hold together."""


class Ref(NamedTuple):
    number: int


def value(data: bytes, at: int) -> tuple[Any, int]:
    """(value, end) of what stands at a place: dictionaries by name, lists, numbers, references; names and texts as bytes.

    One match a token; what is open is held as a list, with where it is a dictionary.
    """
    held: list[tuple[int, list]] = []
    kind_of, items, match = 0, [], _TOKEN.match
    while True:
        m = match(data, at)
        if m is None:
            raise Damaged("value")
        kind, at = m.lastindex, m.end()
        if kind == 5 or kind == 7:
            if kind_of != kind or kind == 5 and len(items) % 2:
                raise Damaged("value")
            v = dict(zip(items[::2], items[1::2])) if kind == 5 else items  # noqa: B905  of even number
            kind_of, items = held.pop()
        elif len(held) > DEEPEST:
            raise Damaged("value")
        elif kind == 1:
            v = m[1]
            if b"#" in v:
                v = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), v)
        elif kind == 2:
            v = Ref(int(m[2]))
        elif kind == 3:
            v = m[3]
            try:
                v = float(v) if b"." in v else int(v)
            except ValueError:
                pass
        elif kind == 4 or kind == 6:
            held.append((kind_of, items))
            kind_of, items = kind + 1, []
            continue
        elif kind == 9:
            v, at = _text(data, at - 1)
        else:
            v = m[kind]
        if not held:
            return v, at
        items.append(v)


def _text(data: bytes, at: int) -> tuple[bytes, int]:
    level = 0
    for m in _BRACKET.finditer(data, at):
        if m[0] == b"(":
            level += 1
        elif m[0] == b")":
            level -= 1
            if not level:
                return data[at + 1 : m.start()], m.end()
    raise Damaged("text")


class File:
    """A file's objects, read as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.trailer, self.packed = data, {}, {}, {}, {}
        try:
            self._references()
            if not isinstance(self.get(self.get(self.trailer.get(b"/Root"), {}).get(b"/Pages")), dict):
                raise Damaged("no pages")
        except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error, RecursionError):
            self._scan()

    def _references(self) -> None:
        found = re.findall(rb"startxref[\x00\t\n\x0c\r ]*(\d+)", self.data[-2048:])
        if not found:
            raise Damaged("no startxref")
        todo, seen = [int(found[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or at >= len(self.data):
                continue
            seen.add(at)
            at = _SPACE.match(self.data, at).end()
            trailer = self._table(at + 4) if self.data.startswith(b"xref", at) else self._stream_table(at)
            self.trailer = trailer | self.trailer
            todo += [trailer[k] for k in (b"/XRefStm", b"/Prev") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        while m := _SECTION.match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            for n in range(first, first + count):
                e = _ENTRY.match(self.data, at)
                if not e:
                    raise Damaged("xref")
                at = e.end()
                if e[3] == b"n":
                    self.at.setdefault(n, (1, int(e[1])))
                else:
                    self.at.setdefault(n, (0, 0))
        end = self.data.index(b"trailer", at) + 7
        return value(self.data, end)[0]

    def _stream_table(self, at: int) -> dict:
        d, raw = self._stream(at)
        widths = d[b"/W"]
        index = d.get(b"/Index", [0, d[b"/Size"]])
        i = 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for n in range(first, first + count):
                row = []
                for w, default in zip(widths, (1, 0, 0), strict=False):
                    row.append(int.from_bytes(raw[i : i + w], "big") if w else default)
                    i += w
                self.at.setdefault(n, (row[0], row[1] if row[0] != 2 else (row[1], row[2])))
        return d

    def _stream(self, at: int) -> tuple[dict, bytes]:
        """The dictionary and the decoded bytes of the stream object at a place."""
        m = _OBJECT.match(self.data, _SPACE.match(self.data, at).end())
        if not m:
            raise Damaged("object")
        d, end = value(self.data, m.end())
        begin = re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)").match(self.data, end)
        if not begin or not isinstance(d, dict):
            raise Damaged("stream")
        length = self.get(d.get(b"/Length"))
        stop = begin.end() + length if isinstance(length, int) else -1
        if stop < 0 or not re.compile(rb"[\r\n ]*endstream").match(self.data, stop):
            stop = self.data.index(b"endstream", begin.end())
        raw = self.data[begin.end() : stop]
        filters, parms = d.get(b"/Filter", []), d.get(b"/DecodeParms", {})
        filters, parms = (filters if isinstance(filters, list) else [filters]), (parms if isinstance(parms, list) else [parms])
        for k, f in enumerate(filters):
            if f != b"/FlateDecode":
                raise Damaged("filter")
            raw = zlib.decompressobj().decompress(raw, LARGEST)
            p = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
            if p.get(b"/Predictor", 1) >= 10:
                raw = _unpredicted(raw, p.get(b"/Columns", 1) * max(1, p.get(b"/Colors", 1) * p.get(b"/BitsPerComponent", 8) // 8))
        return d, raw

    def _scan(self) -> None:
        """Take the objects as they stand in the file, later ones first, where the references lead nowhere."""
        self.at, self.held, self.packed = {}, {}, {}
        packs = []
        for m in _OBJECT.finditer(self.data):
            self.at[int(m[1])] = (1, m.start())
            head = self.data[m.end() : m.end() + 256]
            if b"/ObjStm" in head:
                packs.append(int(m[1]))
            elif re.search(rb"/Type\s*/Catalog", head):
                self.trailer = self.trailer | {b"/Root": Ref(int(m[1]))}
        for m in re.finditer(rb"trailer", self.data):
            try:
                d = value(self.data, m.end())[0]
                self.trailer = self.trailer | d if isinstance(d, dict) else self.trailer
            except (ValueError, IndexError):
                continue
        for n in packs:
            try:
                for k, inside in enumerate(self._pack(n)):
                    self.at.setdefault(inside, (2, (n, k)))
                    d = self.get(Ref(inside))
                    if isinstance(d, dict) and d.get(b"/Type") == b"/Catalog":
                        self.trailer.setdefault(b"/Root", Ref(inside))
            except (ValueError, IndexError, KeyError, TypeError, zlib.error):
                continue

    def _pack(self, n: int) -> list[int]:
        """Numbers of the objects that an object stream holds; the stream is kept."""
        if n not in self.packed:
            d, raw = self._stream(self.at[n][1])
            head = [int(x) for x in raw[: d[b"/First"]].split()[: 2 * d[b"/N"]]]
            self.packed[n] = (head[::2], [d[b"/First"] + x for x in head[1::2]], raw)
        return self.packed[n][0]

    def get(self, v: Any, default: Any = None) -> Any:
        """A value, or what it refers to."""
        if type(v) is not Ref:
            return default if v is None else v
        for _ in range(DEEPEST):
            if type(v) is not Ref:
                break
            if v.number not in self.held:
                kind, where = self.at.get(v.number, (0, 0))
                out = None
                if kind == 1:
                    m = _OBJECT.match(self.data, _SPACE.match(self.data, where).end())
                    if not m or int(m[1]) != v.number:
                        raise Damaged("object")
                    out = value(self.data, m.end())[0]
                elif kind == 2:
                    numbers = self._pack(where[0])
                    k = where[1] if where[1] < len(numbers) and numbers[where[1]] == v.number else numbers.index(v.number)
                    out = value(self.packed[where[0]][2], self.packed[where[0]][1][k])[0]
                self.held[v.number] = out
            v = self.held[v.number]
        return default if v is None else v

    def pages(self) -> Iterator[tuple[float, float, int]]:
        """(width, height, rotation) of each page in order; boxes and rotations come from above where a page has none."""
        root = self.get(self.trailer.get(b"/Root"), {})
        todo, seen = [(root.get(b"/Pages"), LETTER, 0)], set()
        while todo:
            ref, box, turn = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref.number in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref.number)
            if b"/MediaBox" in node:
                own = self.get(node[b"/MediaBox"])
                own = [self.get(x) for x in own] if isinstance(own, list) and len(own) == 4 else None
                box = tuple(map(float, own)) if own and all(isinstance(x, (int, float)) for x in own) else box
            turn = self.get(node[b"/Rotate"], turn) if b"/Rotate" in node else turn
            kids = self.get(node[b"/Kids"]) if b"/Kids" in node else None
            if isinstance(kids, list):
                todo += [(k, box, turn) for k in reversed(kids)]
            else:
                yield abs(box[2] - box[0]), abs(box[3] - box[1]), int(turn) % 360


def _unpredicted(raw: bytes, columns: int) -> bytes:
    """PNG rows: each begins with how it was predicted from the bytes to its left and above."""
    out, last = bytearray(), bytearray(columns)
    for i in range(0, len(raw), columns + 1):
        kind, row = raw[i], bytearray(raw[i + 1 : i + 1 + columns])
        if kind == 2:
            row = bytearray([(x + y) & 255 for x, y in zip(row, last, strict=False)])
        for k in range(len(row) if kind in (1, 3, 4) else 0):
            a, b, c = (row[k - 1] if k else 0), last[k], (last[k - 1] if k else 0)
            if kind == 1:
                row[k] = (row[k] + a) & 255
            elif kind == 3:
                row[k] = (row[k] + (a + b) // 2) & 255
            elif kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[k] = (row[k] + near) & 255
        out += row
        last = row
    return bytes(out)


_PAGES = "struct<error:string,pages:array<struct<width:double,height:double,rotation:int>>>"


def _read(data: bytes | None) -> tuple[str | None, list[tuple[float, float, int]]]:
    """(error, pages) of a file; a file without pages is an error."""
    try:
        file = File(bytes(data or b""))
        # a file whose tree is lost has the pages that stand in it, of a size that nothing tells
        pages = list(file.pages()) or [(*LETTER[2:], 0)] * len(_LOOSE.findall(file.data))
        locked = b"/Encrypt" in file.trailer and not pages
        return None if pages else "encrypted" if locked else "no pages", pages
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error, RecursionError) as e:
        return f"no pages: {e}" if str(e) else "no pages", []


def page_boxes(content: Column) -> Column:
    """struct(error, pages: array of (width, height, rotation)) of each row's file; a file without pages is an error."""

    @F.pandas_udf(_PAGES)
    def run(files: pd.Series) -> pd.DataFrame:
        out = [(error, [dict(zip(("width", "height", "rotation"), p, strict=True)) for p in pages]) for error, pages in map(_read, files)]
        return pd.DataFrame(out, columns=["error", "pages"])

    return run(content)


def pages(files: DataFrame, key: str = "path") -> DataFrame:
    """key, page, n_pages, width, height, rotation of each page of ``files`` (key, content), a row a page.

    Pages are found through the file's references, compressed or not, and where those lead nowhere among the objects as
    they stand; where the tree itself is lost, page objects count, as letter pages. Files without pages have no row here (see :func:`quire.sources.tables.opened`).
    """
    kinds = {"page": pa.int32(), "n_pages": pa.int32(), "width": pa.float64(), "height": pa.float64(), "rotation": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows, each = [], b.slice(at, 256)
                for i, data in enumerate(each.column("content")):
                    found = _read(data.as_py())[1]
                    rows += [(i, page, len(found), *p) for page, p in enumerate(found)]
                own, *columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([each.column(key).take(pa.array(own, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))], [key, *kinds])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {dict(files.dtypes)[key]}, page int, n_pages int, width double, height double, rotation int")


def made(n: int, packed: bool, turned: int = 0, width: int = 600, height: int = 800) -> bytes:
    """A file of ``n`` empty pages, five to a node of its tree; ``packed`` keeps its objects and references compressed.

    The first page of a node is narrower than the rest, which take the tree's box; a node's pages are turned alike.
    """
    nodes = -(-n // 5)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /MediaBox [0 0 %d %d] /Kids [%s] >>" % (n, width, height, b" ".join(b"%d 0 R" % (3 + i) for i in range(nodes)))}
    for i in range(nodes):
        own = range(5 * i, min(n, 5 * i + 5))
        objects[3 + i] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Rotate %d /Kids [%s] >>" % (len(own), turned * (i % 2), b" ".join(b"%d 0 R" % (3 + nodes + k) for k in own))
        for k in own:
            box = b" /MediaBox [0 0 %d %d]" % (width - 100, height) if k == 5 * i else b""
            objects[3 + nodes + k] = b"<< /Type /Page /Parent %d 0 R%s /Contents (a \\) /Type /Page) >>" % (3 + i, box)
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    if not packed:
        places = {}
        for k, body in objects.items():
            places[k] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[k] for k in sorted(places))
        return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))
    head, bodies = [], b""
    for k in sorted(objects):
        head.append(b"%d %d" % (k, len(bodies)))
        bodies += objects[k] + b"\n"
    first = b" ".join(head) + b"\n"
    inner = zlib.compress(first + bodies)
    pack, table = len(objects) + 1, len(objects) + 2
    place = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (pack, len(objects), len(first), len(inner)) + inner + b"\nendstream\nendobj\n"
    rows = [b"\0" * 7] + [b"\2" + pack.to_bytes(4, "big") + i.to_bytes(2, "big") for i in range(len(objects))] + [b"\1" + place.to_bytes(4, "big") + b"\0\0", b"\1" + len(out).to_bytes(4, "big") + b"\0\0"]
    up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(r, last, strict=True)) for r, last in zip(rows, [b"\0" * 7, *rows], strict=False))
    raw, at = zlib.compress(up), len(out)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /Root 1 0 R /W [1 4 2] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length %d >>\nstream\n" % (table, len(rows), len(raw)) + raw + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)
