"""Office and page files: workbooks, documents and slide shows as zipped XML, and text pages of PDF files, all with the standard library.

Every reader takes files as (path string, content binary), as the ``binaryFile`` source gives them, and emits rows; one file is read by one
task. Files that can't be read, and null contents, give no rows; column names of the input other than path and content aren't read.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

# Name spaces of the formats.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Reader = Callable[[bytes], Iterator[tuple]]


def _rows(files: DataFrame, reader: Reader, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """One row per tuple that ``reader`` makes of a file, with the file's path in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = list(reader(content)) if content else []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, zlib.error):
                    rows = []
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, (_, t, _) in zip(cols, columns, strict=True))], names=["path", *(n for n, *_ in columns)])

    return files.select("path", "content").mapInArrow(run, ", ".join(["path string", *(f"{n} {ddl}" for n, _, ddl in columns)]))


def _parse(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():  # type: ignore[union-attr]
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes, sheet: int | str = 0) -> Iterator[tuple[int, list[str]]]:
    """(row number in the sheet from 0, cells as text) of one sheet, by index or name; rows without any cell text are left out, and rows
    after them keep their numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in _parse(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [(s.get("name"), s.get(RELATION)) for s in _parse(z, "xl/workbook.xml").iter(f"{SHEET}sheet")]
        targets = {r.get("Id"): r.get("Target") for r in _parse(z, "xl/_rels/workbook.xml.rels")}
        _, relation = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s[0] == sheet)
        target = (targets[relation] or "").lstrip("/")
        for at, row in enumerate(_parse(z, target if target.startswith("xl/") else f"xl/{target}").iter(f"{SHEET}row")):
            cells: list[str] = []
            for c in row.iter(f"{SHEET}c"):
                place = _column_number(c.get("r", "")) if c.get("r") else len(cells)
                value, kind = c.findtext(f"{SHEET}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value or ""
                cells += [""] * (place + 1 - len(cells))
                cells[place] = text
            if any(x.strip() for x in cells):
                yield int(row.get("r", at + 1)) - 1, cells


def write_workbook(rows: list[list[str]], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet with the rows as inline strings."""
    from xml.sax.saxutils import escape

    body = "".join(f'<row r="{i + 1}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for x in r) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET[1:-1]}" xmlns:r="{RELATION[1:].partition("}")[0]}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def document_paragraphs(content: bytes) -> Iterator[tuple[int, str]]:
    """(number, text) of a document's paragraphs that hold text, in order; tabs and line breaks are kept as such."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        n = 0
        for p in _parse(z, "word/document.xml").iter(f"{WORDS}p"):
            text = "".join(t.text or "" if t.tag == f"{WORDS}t" else "\t" if t.tag == f"{WORDS}tab" else "\n" for t in p.iter() if t.tag in (f"{WORDS}t", f"{WORDS}tab", f"{WORDS}br"))
            if text.strip():
                yield n, text
                n += 1


def slide_shapes(content: bytes) -> Iterator[tuple[int, str | None, list[str]]]:
    """(slide from 1, title, texts of the other shapes) of a slide show, in order of the slides' numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        numbers = sorted(int(m[1]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
        for k in numbers:
            title, texts = None, []
            for shape in _parse(z, f"ppt/slides/slide{k}.xml").iter(f"{SLIDES}sp"):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{DRAWING}t")) for p in shape.iter(f"{DRAWING}p")).strip()
                role = next((ph.get("type") for ph in shape.iter(f"{SLIDES}ph")), None)
                if role in ("title", "ctrTitle") and title is None:
                    title = text
                elif text:
                    texts.append(text)
            yield k, title, texts


_OBJECT = re.compile(rb"(?:^|\s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:[^\[\]\\]|\\.)*\]\s*TJ|T\*|\bTd\b|\bTD\b|\bET\b|'", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    plain = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", lambda m: _ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else m[1]), raw)
    return plain.decode("utf-16-be", "replace") if plain.startswith(b"\xfe\xff") else plain.decode("cp1252", "replace")


def pdf_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """(page from 0, text) of a PDF file's pages in the order of their objects: strings shown by text operators, from plain and deflated content
    streams. Fonts with private encodings give unreadable text, which the garbled-text check finds; encrypted files give no rows."""
    if not content.startswith(b"%PDF") or b"/Encrypt" in content:
        return
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    n = 0
    for _, body in sorted(objects.items()):
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        held = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        lines: list[str] = [""]
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", held[1]) if held else []:
            stream = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", objects.get(int(ref), b""), re.S)
            data = stream[1] if stream else b""
            if b"/FlateDecode" in objects.get(int(ref), b""):
                data = zlib.decompress(data)
            for m in _SHOWN.finditer(data):
                token = m.group()
                if token.startswith(b"("):
                    lines[-1] += _literal(token[1:-1])
                elif token.startswith(b"["):
                    lines[-1] += "".join(_literal(x[1:-1]) for x in re.findall(rb"\((?:\\.|[^\\()])*\)", token))
                elif lines[-1]:
                    lines.append("")
        yield n, "\n".join(x for x in lines if x.strip())
        n += 1


def read_workbooks(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """(path, row int, cells array<string>) of one sheet of every workbook."""
    return _rows(files, lambda b: workbook_rows(b, sheet), [("row", pa.int32(), "int"), ("cells", pa.list_(pa.string()), "array<string>")])


def read_documents(files: DataFrame) -> DataFrame:
    """(path, number int, text) of every document's paragraphs."""
    return _rows(files, document_paragraphs, [("number", pa.int32(), "int"), ("text", pa.string(), "string")])


def read_slides(files: DataFrame) -> DataFrame:
    """(path, slide int, title, shapes array<string>) of every slide."""
    return _rows(files, slide_shapes, [("slide", pa.int32(), "int"), ("title", pa.string(), "string"), ("shapes", pa.list_(pa.string()), "array<string>")])


def read_pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page int, text) of every PDF page."""
    return _rows(files, pdf_pages, [("page", pa.int32(), "int"), ("text", pa.string(), "string")])
