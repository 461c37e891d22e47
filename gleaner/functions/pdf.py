"""PDF bytes: magic, pages, document information, XMP, and the text of plain streams."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.arrow import row_udf

MAX_BYTES = 50 << 20


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary")


def page_count(data: bytes) -> int:
    return len(re.findall(rb"/Type\s*/Page[^s]", data))


def _object(data: bytes, reference: bytes) -> bytes:
    number = reference.split()[0]
    found = re.search(rb"(?:^|[\r\n\s])" + number + rb"\s+\d+\s+obj(.*?)endobj", data, re.S)
    return found[1] if found else b""


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode() + "0" * (len(re.sub(rb"[^0-9A-Fa-f]", b"", raw)) % 2))
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else names.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("utf-8", "ignore") if not data.decode("utf-8", "ignore").encode() != data else data.decode("latin-1")


def info(data: bytes) -> dict:
    """Author, title, creator and creation date of the document information."""
    out = dict.fromkeys(("author", "title", "creator", "creation_date"))
    reference = re.findall(rb"/Info\s+(\d+\s+\d+)\s+R", data)
    body = _object(data, reference[-1]) if reference else b""
    for key, name in ((b"Author", "author"), (b"Title", "title"), (b"Creator", "creator"), (b"CreationDate", "creation_date")):
        found = re.search(rb"/" + key + rb"\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", body, re.S)
        if found:
            out[name] = _string(found[1]) or None
    return out


def _streams(data: bytes):
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        yield m[1], body


def xmp(data: bytes) -> dict:
    """Creator, title and date of an XMP packet."""
    out = dict.fromkeys(("creator", "title", "date"))
    for head, body in _streams(data):
        if b"/Metadata" in head or b"<x:xmpmeta" in body:
            text = body.decode("utf-8", "ignore")
            for name in out:
                found = re.search(rf"<dc:{name}\b[^>]*>(.*?)</dc:{name}>", text, re.S)
                if found:
                    out[name] = re.sub(r"<[^>]+>", "", found[1]).strip() or None
    return out


def text(data: bytes) -> str:
    """Strings shown by content streams with simple encodings; other fonts need a PDF library."""
    parts = []
    for head, body in _streams(data):
        if b"/Metadata" in head:
            continue
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            shown = [_string(s) for s in re.findall(rb"\((?:\\.|[^\\)])*\)", block, re.S)]
            if shown:
                parts.append("".join(shown))
    return "\n".join(parts)


RECORD = "is_pdf boolean, pages int, author string, title string, creator string, creation_date string, text string, has_toc boolean, error string"


def record(data: bytes) -> dict:
    """Metadata (information first, XMP where that is silent) and text; Unsupported over the size cap, Empty without text."""
    if len(data) > MAX_BYTES or not data.startswith(b"%PDF-"):
        return {"is_pdf": data.startswith(b"%PDF-"), "pages": 0, "error": "Unsupported"}
    a, b, shown = info(data), xmp(data), text(data)
    return {
        "is_pdf": True, "pages": page_count(data), "author": a["author"] or b["creator"], "title": a["title"] or b["title"], "creator": a["creator"],
        "creation_date": a["creation_date"] or b["date"], "text": shown, "has_toc": b"/Outlines" in data, "error": None if shown.strip() else "Empty",
    }


def record_udf():
    return row_udf(RECORD, lambda content: record(content or b""))
