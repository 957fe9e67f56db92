"""Word files by the standard library, and extraction by several engines in order."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from sparrowdoc.config import Config

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes of a part of a Word file, unpacked, at most; a larger one is an error of its file.
LARGEST_PART = 256 << 20
ELEMENT = "path string, position int, kind string, text string, confidence double, style string, n_rows int, n_columns int, error string"


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    with archive.open(name) as f:
        raw = f.read(LARGEST_PART + 1)
    if len(raw) > LARGEST_PART:
        raise ValueError(f"{name} is too large")
    if b"<!DOCTYPE" in raw:
        raise ValueError(f"{name} has a document type")
    return ElementTree.fromstring(raw)


def _said(paragraph: ElementTree.Element) -> str:
    marks = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    runs = (x for run in paragraph.iter(f"{_W}r") for x in run if x.tag in marks)
    return "".join(marks[x.tag] or x.text or "" for x in runs)


def _rows(table: ElementTree.Element) -> list[list[str]]:
    """Cells by row; a cell over several columns, or going on from the row above, is repeated."""
    out: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_said(p) for p in tc.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and out and len(row) < len(out[-1]):
                text = out[-1][len(row)]
            row += [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
        out.append(row)
    return out


def _kind(text: str, style: str) -> str:
    style, text = style.lower(), text.strip()
    if "heading" in style or "title" in style:
        return "header"
    if "list" in style or text.startswith(("-", "*", "•")):
        return "list"
    return "header" if len(text) < 100 and text.isupper() else "paragraph"


def word_elements(data: bytes) -> Iterator[tuple[str, str, float, str | None, int | None, int | None]]:
    """(kind, text, confidence, style, n_rows, n_columns) of a Word file: its paragraphs that have text, then its tables, as lines of cells with tabs between."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _part(archive, "word/document.xml").find(f"{_W}body")
        styles = _part(archive, "word/styles.xml") if "word/styles.xml" in archive.namelist() else ElementTree.Element("none")
    named = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val") for s in styles.findall(f"{_W}style") if s.find(f"{_W}name") is not None}
    if body is None:
        return
    for p in body.findall(f"{_W}p"):
        text, ref = _said(p), p.find(f"{_W}pPr/{_W}pStyle")
        if text.strip():
            style = "Normal" if ref is None else named.get(ref.get(f"{_W}val"), "Normal")
            yield _kind(text, style), text, 0.95, style, None, None
    for table in body.findall(f"{_W}tbl"):
        rows = _rows(table)
        yield "table", "\n".join("\t".join(r) for r in rows), 0.9, None, len(rows), max(map(len, rows), default=0)


def word_text(path: str, data: bytes) -> tuple[str, float]:
    """An extraction edge for :func:`tables.read_binary`: the texts of a Word file's elements."""
    return "\n".join(e[1] for e in word_elements(data)), 0.95


def word_layout(files: DataFrame) -> DataFrame:
    """Elements of Word files ``(path, content)``, ``position`` from 0; a file that can't be read is a row with an ``error``, one without elements gives none."""

    def work(frames):
        import pandas as pd

        names = [c.split()[0] for c in ELEMENT.split(", ")]
        for pdf in frames:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, i, *e, None) for i, e in enumerate(word_elements(bytes(data)))]
                except Exception as e:  # noqa: BLE001  a broken file may fail in any way; the row says how
                    rows = [(path, 0, None, None, 0.0, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({"n_rows": "Int32", "n_columns": "Int32"})

    return files.select("path", "content").mapInPandas(work, ELEMENT)


def good_enough(text: str, confidence: float, least: float = Config.ocr_threshold) -> bool:
    """Ten characters or more, enough confidence, half of them letters or digits; see ``functions.text.passes_quality``."""
    return len(text.strip()) >= 10 and confidence >= least and 2 * sum(c.isalnum() for c in text) >= len(text)


def first_good(*engines: Callable[[str, bytes], tuple[str, float]], least: float = Config.ocr_threshold) -> Callable[[str, bytes], tuple[str, float]]:
    """An extraction edge that asks engines in order, until one's text is good enough; if none's is, it raises what each said."""

    def extract(path: str, data: bytes) -> tuple[str, float]:
        said = []
        for engine in engines:
            try:
                text, confidence = engine(path, data)
            except Exception as e:  # noqa: BLE001  an engine may raise anything; the next one is asked
                said.append(f"{type(e).__name__}: {e}")
                continue
            if good_enough(text, confidence, least):
                return text, confidence
            said.append("quality too low")
        raise ValueError("; ".join(said) or "no engine")

    return extract
