"""Cut the XML parts of Office files into records, as a stream.

A record is one paragraph, shape or row. What comes out of a task is its bare markup (the
tags that carry text, without prefixes and in order) or, of a row, the fields of its
cells as they are stored. Text, values and dates are made of it by Spark expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.util import find_spec
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

from parchmill.formats.opc import Package, local
from parchmill.formats.strings import SharedStrings

_CHUNK = 1 << 16
# Characters of a record after which it goes on in another piece.
PIECE_CHARS = 4_000_000
# Fixed value: the last row a sheet can have.
LAST_ROW = 1_048_576
# Between the cells of a row and the fields of a cell: signs that no XML text can hold.
CELL, FIELD = "\x1e", "\x1f"

Attributes = dict[str, str]
_local = lru_cache(maxsize=4096)(local)


class _Cutter:
    """Calls `begin` and `end` with the path of tags below the record, while in one."""

    def __init__(self, record: tuple[str, ...]):
        self.record, self.path = record, []
        self.inside = False  # a record
        self.out: list[str] = []
        self.done: list[tuple[Attributes, str, bool]] = []
        self.text, self.size = False, 0
        self.attributes: Attributes = {}
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self._start
        self.parser.EndElementHandler = self._end
        self.parser.CharacterDataHandler = self._characters

    def begin(self, below: tuple[str, ...], attributes: Attributes) -> None:
        """A tag below the record begins."""

    def end(self, below: tuple[str, ...]) -> None:
        """A tag below the record ends."""

    def outside(self, path: tuple[str, ...], attributes: Attributes) -> None:
        """A tag outside any record begins."""

    def _start(self, tag: str, attributes: Attributes) -> None:
        path, n = self.path, len(self.record)
        path.append(_local(tag))
        named = {_local(k): v for k, v in attributes.items()} if attributes else {}
        if len(path) == n:
            self.inside = tuple(path) == self.record
        if not self.inside:
            self.outside(tuple(path), named)
        elif len(path) == n:
            self.attributes, self.out, self.size = named, [], 0
            self.record_begins()
        else:
            self.begin(tuple(path[n:]), named)

    def record_begins(self) -> None:
        """The record's own tag begins."""

    def _end(self, _tag: str) -> None:
        if self.inside:
            below = tuple(self.path[len(self.record) :])
            if below:
                self.end(below)
            else:
                self.piece(more=False)
                self.inside = False
        self.path.pop()

    def _characters(self, data: str) -> None:
        if self.text:
            self.out.append(escape(data))
            self.size += len(data)
            if self.size > PIECE_CHARS:
                self.too_long()

    def piece(self, more: bool) -> None:
        """Hand over what there is of the record; `more` says that it goes on."""
        self.done.append((self.attributes, "".join(self.out), more))
        self.out, self.size = [], 0

    def too_long(self) -> None:
        """The record has grown long amid a text."""

    def records(self, part: BinaryIO) -> Iterator[tuple[Attributes, str, bool]]:
        while data := part.read(_CHUNK):
            self.parser.Parse(data, False)
            yield from self.done
            self.done = []
        self.parser.Parse(b"", True)
        yield from self.done


class _Paragraphs(_Cutter):
    """<t>text</t>, <tab/>, <hyphen/> and <br/> of a paragraph's runs and links."""

    _SIGNS = {"tab": "tab", "ptab": "tab", "noBreakHyphen": "hyphen", "cr": "br"}

    def __init__(self):
        super().__init__(("document", "body", "p"))

    def begin(self, below: tuple[str, ...], attributes: Attributes) -> None:
        if below[:-1] not in (("r",), ("hyperlink", "r")):
            return
        tag = below[-1]
        if tag == "t":
            self.out.append("<t>")
            self.text = True
        elif tag in self._SIGNS:
            self.out.append(f"<{self._SIGNS[tag]}/>")
        elif tag == "br" and attributes.get("type", "textWrapping") == "textWrapping":
            self.out.append("<br/>")

    def too_long(self) -> None:
        self.out.append("</t>")
        self.piece(more=True)
        self.out.append("<t>")

    def end(self, below: tuple[str, ...]) -> None:
        if self.text and below[-1] == "t":
            self.out.append("</t>")
            self.text = False


class _Shapes(_Cutter):
    """<p/> between the paragraphs of a shape, and <t>text</t> and <br/> in them."""

    def __init__(self):
        super().__init__(("sld", "cSld", "spTree", "sp"))
        self.first = True

    def record_begins(self) -> None:
        self.first = True

    def begin(self, below: tuple[str, ...], attributes: Attributes) -> None:
        if below == ("txBody", "p"):
            if not self.first:
                self.out.append("<p/>")
            self.first = False
        elif below == ("txBody", "p", "br"):
            self.out.append("<br/>")
        elif below in (("txBody", "p", "r", "t"), ("txBody", "p", "fld", "t")):
            self.out.append("<t>")
            self.text = True

    def too_long(self) -> None:
        self.out.append("</t>")
        self.piece(more=True)
        self.out.append("<t>")

    def end(self, below: tuple[str, ...]) -> None:
        if self.text and below[-1] == "t":
            self.out.append("</t>")
            self.text = False


class _Strings(_Cutter):
    """The text of a shared string or of its runs, without phonetics."""

    def __init__(self):
        super().__init__(("sst", "si"))

    def _characters(self, data: str) -> None:
        if self.text:
            self.out.append(data)

    def begin(self, below: tuple[str, ...], attributes: Attributes) -> None:
        self.text = below in (("t",), ("r", "t"))

    def end(self, below: tuple[str, ...]) -> None:
        self.text = False


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _position(ref: str) -> tuple[int, int]:
    letters = ref.replace("$", "").rstrip("0123456789")
    return int(ref.replace("$", "")[len(letters) :]), column_number(letters)


class _Rows(_Cutter):
    """The cells of a row, in order: column from 0, type, number format, value, formula and
    inline or shared text. The last four are empty, or a sign and what there is: `=` for
    what is a value, `:` for the others.

    `formats` has the number format of each cell style that is not the general one. Of
    several cells of one column the last one counts."""

    def __init__(self, formats: list[str | None], clip: bool, strings: SharedStrings | None):
        super().__init__(("worksheet", "sheetData", "row"))
        self.formats, self.clip, self.strings = formats, clip, strings
        self.columns: dict[str, int] = {}
        self.column, self.last_column, self.last_row = 0, float("inf"), float("inf")
        self.skip, self.kind, self.shown = False, "n", ""
        self.cells: dict[int, str] = {}
        self.fields: dict[str, str] = {}

    def outside(self, path: tuple[str, ...], attributes: Attributes) -> None:
        if path == ("worksheet", "dimension") and self.clip and "ref" in attributes:
            self.last_row, self.last_column = _position(attributes["ref"].rpartition(":")[2])

    def record_begins(self) -> None:
        self.column, self.cells = 0, {}

    def begin(self, below: tuple[str, ...], attributes: Attributes) -> None:
        if below == ("c",):
            letters = attributes.get("r", "").rstrip("0123456789")
            if letters and letters not in self.columns:
                self.columns[letters] = column_number(letters)
            self.column = self.columns.get(letters) or self.column + 1
            self.skip = self.column > self.last_column
            self.kind, style = attributes.get("t", "n"), int(attributes.get("s") or 0)
            shown = self.formats[style] if self.kind == "n" and style < len(self.formats) else None
            self.shown, self.fields = f":{shown}" if shown else "", {}
        elif not self.skip:
            if below in (("c", "v"), ("c", "f"), ("c", "is")):
                self.out, self.text = [], below[1] != "is"
            elif below in (("c", "is", "t"), ("c", "is", "r", "t")):
                self.text = True

    def _characters(self, data: str) -> None:
        if self.text:
            self.out.append(data)
            self.size += len(data)

    def end(self, below: tuple[str, ...]) -> None:
        if self.skip:
            return
        self.text = False
        if below in (("c", "v"), ("c", "f"), ("c", "is")):
            said = "".join(self.out)
            if below[1] == "v" and self.kind == "n" and said and not said.lstrip("-").isdigit():
                said = repr(float(said))  # as Python spells it, which is how it appears in a text
            self.fields[below[1]] = f":{said}" if below[1] == "f" else f"={said}"
        elif below == ("c",):
            field = self.fields
            if self.kind == "s" and len(field.get("v", "")) > 1:
                found = self.strings.get(int(field["v"][1:])) if self.strings else None
                field["is"] = "" if found is None else f"={found}"
                self.size += len(field["is"])
            self.cells[self.column] = FIELD.join(
                (str(self.column - 1), self.kind, self.shown, field.get("v", ""), field.get("f", ""), field.get("is", ""))
            )
            if self.size > PIECE_CHARS:
                self.piece(more=True)

    def piece(self, more: bool) -> None:
        cells = self.cells
        ordered = cells if list(cells) == sorted(cells) else sorted(cells)
        self.done.append((self.attributes, CELL.join(cells[c] for c in ordered), more))
        self.cells, self.out, self.size = {}, [], 0


# part_no, part_name, row_no, what, content, gap. A record in several pieces: of a
# paragraph all but the first are paragraph+, of a shape or row all but the last shape+ or
# row+, and the last of such a row is row-.
Record = tuple[int, str | None, int | None, str, str, int]


def word(source: BinaryIO) -> Iterator[Record]:
    """Paragraphs that stand directly in the body."""
    package = Package(source, "document")
    with package.open(package.main) as part:
        k, before = 0, False
        for _, markup, more in _Paragraphs().records(part):
            yield k, None, None, "paragraph+" if before else "paragraph", markup, 0
            k, before = k + (not more), more


def _children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if local(c.tag) in names]


def slides(source: BinaryIO) -> Iterator[Record]:
    """Shapes of the slides in order; groups, tables and pictures have none."""
    package = Package(source, "presentation")
    ids = [
        e
        for group in _children(package.xml(package.main), "sldIdLst")
        for e in _children(group, "sldId")
    ]
    for slide_no, (_, name) in enumerate(package.by_relation(package.main, ids)):
        with package.open(name) as part:
            k = 0
            for _, markup, more in _Shapes().records(part):
                yield slide_no, None, k, "shape+" if more else "shape", markup, 0
                k += not more


def _formats(package: Package, part: str | None) -> list[str | None]:
    """Number format by cell style: its code, #n for a built-in one, none for general."""
    if part is None:
        return []
    tree = package.xml(part)
    codes = {
        int(e.get("numFmtId")): e.get("formatCode")
        for g in _children(tree, "numFmts")
        for e in g
    }
    used = [int(e.get("numFmtId") or 0) for g in _children(tree, "cellXfs") for e in g]
    return [codes.get(n, f"#{n}") if n else None for n in used]


def _sheet(package: Package, name: str, formats: list[str | None], clip: bool, strings: SharedStrings | None):
    """(row number from 0, cells, sign of a piece of a row) of a sheet."""
    cutter, row_no, before = _Rows(formats, clip, strings), 0, False
    with package.open(name) as part:
        for attributes, cells, more in cutter.records(part):
            number = int(attributes.get("r") or (row_no if before else row_no + 1))
            if number > cutter.last_row:
                return
            if number > LAST_ROW:
                raise ValueError(f"row {number} is beyond the last row of a sheet")
            if number > row_no or before:
                sign = "+" if more else "-" if before else ""
                row_no, before = number, more
                yield number - 1, cells, sign


def workbook(first_sheet_only: bool, strings_folder: str | None = None) -> Callable[[BinaryIO], Iterator[Record]]:
    """The rows of the sheets, each with the number of rows that are missing before it.

    The first sheet alone is read as a table: its first row with a value is part 0 and
    the others are part 1; rows without a value count as missing, and the stated size of
    a sheet does not matter. Dates count from 1904 in some workbooks, which `part_name`
    cannot say, so their rows are `row1904`. Shared strings that take much room are
    looked up in a file below `strings_folder`."""

    def read(source: BinaryIO) -> Iterator[Record]:
        package = Package(source, "workbook")
        main = package.xml(package.main)
        sheets = [e for g in _children(main, "sheets") for e in g]
        listed = [
            (s.get("name"), kind, part)
            for s, (kind, part) in zip(sheets, package.by_relation(package.main, sheets), strict=True)
            if part in package.names
        ]
        props = _children(main, "workbookPr")
        mac = bool(props) and props[0].get("date1904") in ("1", "true")
        parts = dict(package.relations(package.main).values())
        formats = _formats(package, parts.get("styles"))
        strings = None
        if parts.get("sharedStrings") in package.names:
            with package.open(parts["sharedStrings"]) as part:
                # Fixed value: the escape of an escape sign in shared strings.
                texts = (text.replace("x005F_", "") for _, text, _ in _Strings().records(part))
                strings = SharedStrings(texts, strings_folder)
        try:
            for sheet_no, (name, kind, part) in enumerate(listed[:1] if first_sheet_only else listed):
                if kind == "chartsheet":
                    raise ValueError(f"sheet {name!r} is a {kind} and has no rows")
                done, header = 0, None
                for row_no, cells, sign in _sheet(package, part, formats, not first_sheet_only, strings):
                    if first_sheet_only and FIELD + "=" not in cells:
                        continue
                    what = ("row1904" if mac else "row") + sign
                    part_no = sheet_no
                    if first_sheet_only:
                        header = row_no if header is None else header
                        part_no = int(row_no > header)
                    yield part_no, name, row_no, what, cells, max(0, row_no - done)
                    done = row_no + 1
        finally:
            if strings is not None:
                strings.close()

    return read


@lru_cache(maxsize=4)
def _found(name: str, _places: tuple[str, ...]) -> bool:
    """Whether a package is there; looked for once, and again when the search path changes."""
    return name in sys.modules or find_spec(name) is not None


def pdf(source: BinaryIO) -> Iterator[Record]:
    """The text of each page, by the PDF library of the executors."""
    if not _found("pypdf", tuple(sys.path)):
        raise ModuleNotFoundError("No module named 'pypdf'", name="pypdf")
    from pypdf import PdfReader

    for k, page in enumerate(PdfReader(source).pages):
        yield k, None, None, "text", page.extract_text(), 0
