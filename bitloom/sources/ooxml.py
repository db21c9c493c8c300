"""A small reader and writer of XLSX workbooks on the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """Rich text is the runs' text; phonetic hints don't belong to it."""
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t")) if node.find(f"{MAIN}rPh") is None else "".join(t.text or "" for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t"))


def _number(text: str) -> str:
    """Whole numbers without their point."""
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def sheet_names(file: BinaryIO) -> list[str]:
    with zipfile.ZipFile(file) as z:
        return [x.get("name") for x in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


def read_workbook(data: bytes | BinaryIO, only: set[str] | None = None) -> dict[str, list[list[str | None]] | None]:
    """Sheets by name (all, or those asked for) as rows of cell texts, padded to one width; a sheet that can't be parsed is None."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        names = set(z.namelist())
        shared = [_text(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        out: dict[str, list[list[str | None]] | None] = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            if only is not None and sheet.get("name") not in only:
                continue
            target = targets[sheet.get(f"{REL}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            try:
                out[sheet.get("name")] = _rows(ET.fromstring(z.read(path)), shared)
            except (ET.ParseError, KeyError, IndexError, ValueError, TypeError):
                out[sheet.get("name")] = None
        return out


def _rows(root, shared: list[str]) -> list[list[str | None]]:
    rows: list[dict[int, str]] = []
    for row in root.iter(f"{MAIN}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.findall(f"{MAIN}c")):
            at, kind, v = _column(c.get("r")) if c.get("r") else i, c.get("t"), c.find(f"{MAIN}v")
            if kind == "inlineStr":
                cells[at] = _text(c.find(f"{MAIN}is"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "b", "e") else _number(v.text)
        rows.append(cells)
    width = max((max(r, default=-1) + 1 for r in rows), default=0)
    return [[r.get(i) for i in range(width)] for r in rows]


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of inline strings; None is an empty cell."""

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, k = divmod(i - 1, 26)
            out = chr(65 + k) + out
        return out

    def sheet(rows: list[list]) -> str:
        lines = []
        for y, row in enumerate(rows, 1):
            cells = "".join(f'<c r="{name(x)}{y}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for x, v in enumerate(row) if v is not None)
            lines.append(f'<row r="{y}">{cells}</row>')
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'

    names = list(sheets)
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>",
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": sheet(sheets[n]) for i, n in enumerate(names, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, text)
    return out.getvalue()
