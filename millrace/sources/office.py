"""Attached office files as HTML (S04-S06), from binary columns or the ``binaryFile`` source.

Both formats are archives of XML, so the standard library reads them. PDF needs a library that may be missing; its
rows then come out null.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_html(data: bytes) -> str:
    """Headings by their style's first digit (2 without one), list styles as items, all else as paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = "" if style is None else style.get(f"{_W}val") or ""
        name = (names.get(name) or name).lower()
        if "heading" in name:
            digit = re.search(r"\d", name)
            tag = f"h{digit.group() if digit else 2}"
        else:
            tag = "li" if "list" in name else "p"
        out.append(f"<{tag}>{html.escape(text)}</{tag}>")
    return "<html><body>" + "".join(out) + "</body></html>"


def xlsx_html(data: bytes) -> str:
    """Each sheet as a heading and a table; empty cells stay empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[sheet.get(_R)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    if inline is not None:
                        text = "".join(t.text or "" for t in inline.iter(f"{_S}t"))
                    else:
                        text = "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells.append(f"<td>{html.escape(text)}</td>")
                rows.append(f"<tr>{''.join(cells)}</tr>")
            out.append(f"<h2>{html.escape(sheet.get('name') or '')}</h2><table>{''.join(rows)}</table>")
    return "<html><body>" + "".join(out) + "</body></html>"


def pdf_html(data: bytes) -> str | None:
    """Lines as paragraphs, those 1.3 times larger than the page's mean as headings; null without the library."""
    try:
        import fitz
    except ImportError:
        return None
    out = []
    for page in fitz.open(stream=data, filetype="pdf"):
        lines = [ln for b in page.get_text("dict")["blocks"] for ln in b.get("lines", [])]
        sizes = [s["size"] for ln in lines for s in ln["spans"]] or [12.0]
        for ln in lines:
            text = "".join(s["text"] for s in ln["spans"]).strip()
            if text:
                tag = "h2" if max(s["size"] for s in ln["spans"]) >= 1.3 * sum(sizes) / len(sizes) else "p"
                out.append(f"<{tag}>{html.escape(text)}</{tag}>")
    return "<html><body>" + "".join(out) + "</body></html>"


READERS = {"docx": docx_html, "xlsx": xlsx_html, "pdf": pdf_html}


def _render(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for d, k in zip(data, kind):
        try:
            rows.append((READERS[k](bytes(d)), None) if d is not None and k in READERS else (None, f"unsupported: {k}"))
        except Exception as e:  # noqa: BLE001 - a broken file is a row with an error, not a failed task
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["html", "error"])


def render_documents(files: DataFrame, data: str, kind: Column) -> DataFrame:
    """Adds ``rendered`` (html, error). Broken and unsupported files have an error and no HTML."""
    return files.withColumn("rendered", F.pandas_udf(_render, "html string, error string")(F.col(data), kind))
