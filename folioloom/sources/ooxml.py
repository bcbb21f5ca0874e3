"""Reading and writing Office files with zip and XML alone; pure functions on bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def sheet_names(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]


def xlsx_cells(raw: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of the filled cells, rows and columns from 1; all sheets, or the one named."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_P}Relationship")}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            name = s.get("name")
            if sheet is not None and name != sheet:
                continue
            target = targets[s.get(f"{_R}id")]
            row_no = 0
            for row in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
                row_no = int(row.get("r") or row_no + 1)
                col_no = 0
                for c in row.iter(f"{_S}c"):
                    col_no = _column(c.get("r")) if c.get("r") else col_no + 1
                    kind, v = c.get("t"), c.find(f"{_S}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        text = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}[v.text] if kind == "b" else v.text
                    yield name, row_no, col_no, text


def docx_pages(raw: bytes) -> list[str]:
    """Texts of the pages: headings marked by #, pages cut before a paragraph with a page break, all tables at the end
    of the last page, header and footer before the first; one page at least."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        pages: list[list[str]] = [[]]
        for p in body.findall(f"{_W}p"):
            if any(b.get(f"{_W}type") == "page" for b in p.iter(f"{_W}br")):
                pages.append([])
            text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
            style = p.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?:heading|Heading|标题)\s*([1-9])", style.get(f"{_W}val") or "") if style is not None else None
            if text:
                pages[-1].append(f"{'#' * min(int(level[1]), 4)} {text}" if level else text)
        for table in body.findall(f"{_W}tbl"):
            rows = []
            for tr in table.findall(f"{_W}tr"):
                cells = ["".join(t.text or "" for t in tc.iter(f"{_W}t")).strip() for tc in tr.findall(f"{_W}tc")]
                if line := " | ".join(dict.fromkeys(c for c in cells if c)):
                    rows.append(line)
            pages[-1] += list(dict.fromkeys(rows))
        margins = []
        for name in sorted(n for n in names if re.match(r"word/(header|footer)\d*\.xml$", n)):
            margins += [x for p in ET.fromstring(z.read(name)).iter(f"{_W}p") if (x := "".join(t.text or "" for t in p.iter(f"{_W}t")).strip())]
        pages[0] = margins + pages[0]
        kept = [p for p in pages if p] or [[]]
        return ["\n".join(p) for p in kept]


def pptx_slides(raw: bytes) -> list[str]:
    """Text of each slide under its heading; table rows by bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.match(r"ppt/slides/slide(\d+)\.xml$", n)))
        out = []
        for k, name in found:
            root = ET.fromstring(z.read(name))
            in_tables = {id(p) for tbl in root.iter(f"{_A}tbl") for p in tbl.iter(f"{_A}p")}
            lines = [x for p in root.iter(f"{_A}p") if id(p) not in in_tables and (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]
            for tr in root.iter(f"{_A}tr"):
                cells = ["".join(t.text or "" for t in tc.iter(f"{_A}t")).strip() for tc in tr.iter(f"{_A}tc")]
                if any(cells):
                    lines.append(" | ".join(cells))
            out.append("\n".join([f"--- Slide {k} ---", *lines]))
        return out


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _text(value: object) -> str:
    return escape(_CONTROL.sub("", "" if value is None else str(value)))


def xlsx_bytes(sheets: dict[str, Iterable[Iterable[object]]], widest: int = 50) -> bytes:
    """A workbook of text cells, and numbers as numbers, with fitted column widths."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", _TYPES.format('<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + over))
        z.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(k, "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1))))
        named = "".join(f'<sheet name="{_text(n)[:31]}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{named}</sheets></workbook>')
        for k, rows in enumerate(sheets.values(), 1):
            lines, widths = [], {}
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row, 1):
                    widths[c] = max(widths.get(c, 0), len(str("" if v is None else v)))
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{_letters(c)}{r}"><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            cols = "".join(f'<col min="{c}" max="{c}" width="{min(w + 2, widest)}" customWidth="1"/>' for c, w in sorted(widths.items()))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_S[1:-1]}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>')
    return buffer.getvalue()


def docx_bytes(paragraphs: Iterable[tuple[str, str]], tables: Iterable[Iterable[Iterable[object]]] = ()) -> bytes:
    """A document of (style, text) paragraphs; style '' is body text, 'page' starts a page; then the tables."""
    body = []
    for style, text in paragraphs:
        run = '<w:r><w:br w:type="page"/></w:r>' if style == "page" else ""
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style not in ("", "page") else ""
        body.append(f'<w:p>{props}{run}<w:r><w:t xml:space="preserve">{_text(text)}</w:t></w:r></w:p>')
    for table in tables:
        rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{_text(c)}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table)
        body.append(f"<w:tbl>{rows}</w:tbl>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.format('<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'))
        z.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "word/document.xml")))
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>')
    return buffer.getvalue()


def zip_bytes(entries: Iterable[tuple[str, bytes]]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return buffer.getvalue()
