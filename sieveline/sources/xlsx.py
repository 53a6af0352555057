"""Minimal .xlsx reading and writing with the standard library, row by row.

Excel takes 1,048,576 rows a sheet: more rows go on in further sheets ("Sheet1 (continued 2)" and so on), each with the header.
"""

from __future__ import annotations

import contextlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
# Fixed values of the formats: rows of a sheet, bytes of a zip entry without 64-bit sizes (some programs refuse those).
SHEET_ROWS, SHEET_BYTES = 1_048_576, (1 << 31) - 1
PIECE_BYTES = 1 << 20
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _elements(file: IO[bytes], tag: str, parent: str) -> Iterator[ElementTree.Element]:
    """The elements of one name within ``parent``, one in memory at a time."""
    tag, parent, within = f"{{{_NS['m']}}}{tag}", f"{{{_NS['m']}}}{parent}", None
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            within = e if e.tag == parent else within
        elif e.tag == tag:
            yield e
            if within is not None:
                within.clear()


def sheet_parts(z: zipfile.ZipFile) -> list[str]:
    """The part of the first sheet and of the sheets that continue it."""
    first = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
    try:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
    except (KeyError, ElementTree.ParseError):
        return [first]
    parts = {s.get("name"): t[1:] if t.startswith("/") else f"xl/{t}" for s in sheets if (t := targets.get(s.get(f"{{{_REL}}}id")))}
    name, out = next((n for n, part in parts.items() if part == first), None), [first]
    while (part := parts.get(f"{name} (continued {len(out) + 1})")) in z.NameToInfo:
        out.append(part)
    return out


def sheet_rows(z: zipfile.ZipFile, part: str) -> tuple[list[str], Iterator[list[str | None]]]:
    """The names in the first row of a sheet, and its other rows as strings by these names."""
    shared: list[str] = []
    c_, v_, t_ = (f"{{{_NS['m']}}}{x}" for x in "cvt")
    if "xl/sharedStrings.xml" in z.NameToInfo:
        with z.open("xl/sharedStrings.xml") as f:
            shared = ["".join(t.text or "" for t in si.iter(t_)) for si in _elements(f, "si", "sst")]

    def grid() -> Iterator[dict[int, str | None]]:
        with z.open(part) as f:
            for row in _elements(f, "row", "sheetData"):
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.findall(c_)):
                    v, kind, ref = c.find(v_), c.get("t"), c.get("r")
                    if kind == "inlineStr":
                        text = "".join([t.text or "" for t in c.iter(t_)])
                    elif v is None:
                        text = None
                    else:
                        text = shared[int(v.text)] if kind == "s" else v.text
                    cells[_column(ref) if ref else k] = text
                yield cells

    rows = grid()
    names = {n: i for i, n in next(rows, {}).items() if n}
    return list(names), ([row.get(i) for i in names.values()] for row in rows)


def read_xlsx(content: bytes) -> list[dict[str, str | None]]:
    """Rows of the first sheet, and of those that continue it, as strings by the names in the first row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out = []
        for part in sheet_parts(z):
            names, rows = sheet_rows(z, part)
            out += [dict(zip(names, row)) for row in rows]
        return out


Piece = tuple[int, int, int, bytes]


def _piece(text: bytes, rows: int = 0) -> Piece:
    z = zlib.compressobj(wbits=-15)
    return rows, len(text), zlib.crc32(text), z.compress(text) + z.flush(zlib.Z_FULL_FLUSH)


def sheet_pieces(rows: Iterable[Iterable]) -> Iterator[Piece]:
    """Rows as inline strings in deflated pieces (rows, bytes of XML, CRC, deflated bytes); any pieces make a sheet one after another.

    Rows and cells go by their order, as the format allows: a piece is the same at any place.
    """
    def line(values: Iterable) -> bytes:
        cells = ["<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>' for v in values]
        return f"<row>{''.join(cells)}</row>".encode()

    lines: list[bytes] = []
    size = 0
    for row in rows:
        lines.append(line(row))
        size += len(lines[-1])
        if size >= PIECE_BYTES:
            yield _piece(b"".join(lines), len(lines))
            lines, size = [], 0
    if lines:
        yield _piece(b"".join(lines), len(lines))


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, highest bit first."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _crc_joined(first: int, second: int, size: int) -> int:
    """The CRC of two texts one after another, by the CRC of each and the bytes of the second."""
    shift, power = 1 << 31, 1 << 23  # x^0, x^8
    while size:
        shift = _times(shift, power) if size & 1 else shift
        power, size = _times(power, power), size >> 1
    return _times(first, shift) ^ second


class _Zip:
    """A zip file written from front to back, of entries that come in deflated pieces."""

    def __init__(self, out: IO[bytes]) -> None:
        self.out, self.at, self.entries = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.size, self.crc = name.encode(), self.at, 0, 0
        self.write(struct.pack("<4s5H3L2H", b"PK\3\4", 20, 8, 8, 0, 33, 0, 0, 0, len(self.name), 0) + self.name)  # 33: the first day of 1980
        self.data = self.at

    def add(self, piece: Piece) -> None:
        _, size, crc, data = piece
        self.crc = _crc_joined(self.crc, crc, size)
        self.size += size
        self.write(data)

    def end(self) -> None:
        self.write(b"\3\0")  # the last block, empty
        sizes = struct.pack("<3L", self.crc, self.at - self.data, self.size)
        self.write(b"PK\7\x08" + sizes)
        far = struct.pack("<2HQ", 1, 8, self.start) if self.start >= 0xFFFFFFFF else b""
        self.entries.append(struct.pack("<4s6H", b"PK\1\2", 45 if far else 20, 45 if far else 20, 8, 8, 0, 33) + sizes
                            + struct.pack("<5H2L", len(self.name), len(far), 0, 0, 0, 0, min(self.start, 0xFFFFFFFF)) + self.name + far)

    def entry(self, name: str, text: str) -> None:
        self.begin(name)
        self.add(_piece(text.encode()))
        self.end()

    def close(self) -> None:
        at, n = self.at, len(self.entries)
        self.write(b"".join(self.entries))
        size, end = self.at - at, self.at
        if at >= 0xFFFFFFFF:
            self.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
        self.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, size, min(at, 0xFFFFFFFF), 0))


def write_pieces(path: str | IO[bytes], columns: list[str], pieces: Iterable[Piece]) -> None:
    """A workbook of pieces of rows; when a sheet is full the next one continues it."""
    xml, head, tail, n, rows = '<?xml version="1.0" encoding="UTF-8"?>', next(sheet_pieces([columns])), _piece(b"</sheetData></worksheet>"), 0, 0
    with open(path, "wb") if isinstance(path, str) else contextlib.nullcontext(path) as out:
        z = _Zip(out)

        def begin() -> None:
            z.begin(f"xl/worksheets/sheet{n}.xml")
            z.add(_piece(f'{xml}<worksheet xmlns="{_NS["m"]}"><sheetData>'.encode()))
            z.add(head)

        def end() -> None:
            z.add(tail)
            z.end()

        for piece in pieces:
            if not n or rows + piece[0] > SHEET_ROWS or z.size + piece[1] + tail[1] > SHEET_BYTES:
                if n:
                    end()
                n, rows = n + 1, 1
                begin()
            z.add(piece)
            rows += piece[0]
        if not n:
            n = 1
            begin()
        end()
        names = ["Sheet1", *[f"Sheet1 (continued {k})" for k in range(2, n + 1)]]
        z.entry("xl/workbook.xml", f'{xml}<workbook xmlns="{_NS["m"]}" xmlns:r="{_REL}"><sheets>'
                + "".join(f'<sheet name="{s}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(names, 1)) + "</sheets></workbook>")
        z.entry("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                + "".join(f'<Relationship Id="r{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + "</Relationships>")
        z.entry("_rels/.rels", f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                f'<Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.entry("[Content_Types].xml", f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
                + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k in range(1, n + 1)) + "</Types>")
        z.close()


def write_xlsx(path: str | IO[bytes], columns: list[str], rows: Iterable[Iterable]) -> None:
    """A workbook of rows, written as they come."""
    write_pieces(path, columns, sheet_pieces(rows))
