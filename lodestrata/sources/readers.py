"""Readers of single files: bytes to markdown. Each raises :class:`Unreadable` with words for whoever owns the file."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

from . import pdf

PDF_DAMAGED = "this is not a PDF file, or a damaged one; check that it opens in a reader, and sync again"
PDF_LOCKED = "this PDF needs a password; save a copy that doesn't, and sync again"
PDF_NO_TEXT = "this PDF holds pictures of pages and no text, so there is nothing to index"
DOCX_DAMAGED = "this is not a Word document, or a damaged one; check that it opens in Word, and sync again"
EMPTY = "there is no text in this file"
NOT_UTF8 = "this file is not UTF-8 text; save it with that encoding, and sync again"
NOT_READ = "this file could not be read: {}"


class Unreadable(Exception):
    @property
    def reason(self) -> str:
        return self.args[0]


@dataclass(frozen=True)
class Extracted:
    text: str
    pages: int | None = None


def read_text(data: bytes) -> Extracted:
    """Strict UTF-8 without a byte order mark, with plain newlines. No other encoding is guessed."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Unreadable(NOT_UTF8) from e
    return Extracted(text.replace("\r\n", "\n").replace("\r", "\n"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_paragraph(p) -> str:
    parts = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            parts.append(e.text or "")
        elif e.tag == f"{_W}tab":
            parts.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
    text = "".join(parts)
    style = p.find(f"{_W}pPr/{_W}pStyle")
    level = re.fullmatch(r"[Hh]eading\s*([1-6])|[Tt]itle", style.get(f"{_W}val", "")) if style is not None else None
    if level and text.strip():
        return "#" * int(level[1] or 1) + " " + " ".join(text.split())
    if p.find(f"{_W}pPr/{_W}numPr") is not None and text.strip():
        return "- " + text
    return text


def read_docx(data: bytes) -> Extracted:
    """Headings, paragraphs, lists and tables of a Word package. What lacks the main part is no Word document."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error) as e:
        raise Unreadable(DOCX_DAMAGED) from e
    if body is None:
        raise Unreadable(DOCX_DAMAGED)
    blocks = []
    for e in body:
        if e.tag == f"{_W}p":
            blocks.append(_docx_paragraph(e))
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(_docx_paragraph, c.iter(f"{_W}p")))) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            lines = ["| " + " | ".join(c.replace("\n", " ") for c in r) + " |" for r in rows]
            if lines:
                lines.insert(1, "|" + " --- |" * len(rows[0]))
            blocks.append("\n".join(lines))
    return Extracted("\n\n".join(b for b in blocks if b.strip()))


def read_pdf(data: bytes) -> Extracted:
    """Text with headings, pages in reading order. Another parser can take its place in the table of readers."""
    if b"%PDF-" not in data[:1024] or b"%%EOF" not in data[-2048:]:
        raise Unreadable(PDF_DAMAGED)
    try:
        file, text, pages = pdf.read(data)
    except (pdf.Damaged, ValueError) as e:
        raise Unreadable(PDF_DAMAGED) from e
    if file.locked():
        raise Unreadable(PDF_LOCKED)
    if not pages and not text:
        raise Unreadable(PDF_DAMAGED)
    return Extracted(text, pages)


#: Extension -> reader. A converter takes another table to use other parsers.
READERS: dict[str, Callable[[bytes], Extracted]] = {"pdf": read_pdf, "docx": read_docx, "txt": read_text, "md": read_text}
