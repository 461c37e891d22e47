"""Text, number, date and entity functions: Column in, Column out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space as Unicode's White_Space property has it.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Named entities and their characters.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "middot": "·", "bull": "•", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
    "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "laquo": "«", "raquo": "»",
    "cent": "¢", "pound": "£", "euro": "€", "yen": "¥",
}
# Endings that make a title's last token a domain name.
TITLE_TLDS = "com org net io edu gov co uk us ca de fr jp au info biz me tv xyz dev app ai ru cn in br it es nl se pl ch at be dk fi no pt gr cz hu ro ua tr il kr tw hk sg my th vn ph id nz za mx ar cl pe ve".split()


#: The same characters one by one, for functions that take a set.
_SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACES))


def is_blank(x: Column) -> Column:
    return trim(x) == ""


def collapse(x: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def collapse_lines(x: Column) -> Column:
    """Runs of spaces and tabs become a space, runs of line feeds one; ends trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{2,}", "\n"))


def strip_boilerplate(x: Column) -> Column:
    return collapse_lines(F.regexp_replace(x, r"(?i)press enter or click to view (the )?image in full size", ""))


def strip_leading_title(content: Column, title: Column) -> Column:
    """Cut the title off the start of the content, whatever its case."""
    starts = (F.length(title) > 0) & (F.lower(F.substring(content, F.lit(1), F.length(title))) == F.lower(title))
    return F.when(starts, F.regexp_replace(F.substring(content, F.length(title) + 1, F.length(content)), f"^{SPACE}+", "")).otherwise(content)


def find_ci(text: Column, needle: Column) -> Column:
    """Place of the needle whatever the case, from 0; null if it isn't there."""
    at = F.locate(F.lower(needle), F.lower(text)) if isinstance(needle, str) else F.call_function("locate", F.lower(needle), F.lower(text))
    return F.when(at > 0, at - 1)


def clean_snippet(x: Column) -> Column:
    return F.when(x.rlike(r"Read more$"), trim(F.regexp_replace(x, r"(\.\.\.)?Read more$", ""))).otherwise(x)


def clean_title(x: Column) -> Column:
    """Without what follows an address, and without a domain name glued to the end.

    The cut is at the last capital that follows a small letter or ``)`` and
    starts a suffix ending in a known domain ending.
    """
    out = x
    for prefix in ("https://", "http://"):
        out = F.when(out.contains(prefix), trim(F.substring_index(out, prefix, 1))).otherwise(out)
    tail = r"(?s)^(.*[\p{Ll})])(?=\p{Lu})(?=.*\.(?i:" + "|".join(TITLE_TLDS) + r")$).*$"
    return trim(F.regexp_replace(out, tail, "$1"))


def strip_suffix(x: Column, suffix: str) -> Column:
    return trim(F.when(x.endswith(suffix), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(x))


def slice_text(x: Column, offset: int, most: int) -> Column:
    return F.substring(x, offset + 1, most)


def is_truncated(total_bytes: Column, offset: int, most: int) -> Column:
    """Whether a slice of characters leaves something of a text of so many bytes."""
    return F.lit(most > 0) & (F.lit(offset + most) < total_bytes)


def _entropies(texts: pa.Array) -> pa.Array:
    """Entropy of each text from the histogram of its code points; linear in its length."""
    out = np.zeros(len(texts))
    for i, x in enumerate(texts):
        raw = x.as_buffer() if x.is_valid else None
        if not raw:
            continue
        codes = np.frombuffer(raw, np.uint8)
        if codes.max() > 127:
            codes = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), np.uint32)
            counts = np.unique(codes, return_counts=True)[1]
        else:
            counts = np.bincount(codes)
            counts = counts[counts > 0]
        p = counts / len(codes)
        out[i] = -(p * np.log2(p)).sum() if len(counts) > 1 else 0.0
    return pa.array(out)


_entropy_udf = F.arrow_udf(_entropies, DoubleType())


def entropy(x: Column) -> Column:
    """Shannon entropy of the trimmed text's characters, in bits; 0 for null and blank texts.

    Not sayable in linear time with built-in functions; runs on Arrow batches.
    """
    return _entropy_udf(trim(x))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(f"[^{SPACE[1:]}++"))


def round_score(x: Column) -> Column:
    return F.round(x * 100) / 100


def pdf_date(x: Column) -> Column:
    """RFC 3339 text of ``D:YYYY[MM[DD[HH[mm[ss]]]]][Z|+hh'mm']``; null if it is none."""
    pattern = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(Z|[+-]\d{2}'?(?:\d{2})?'?)?$"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")), F.lit(default))
    zone = F.regexp_extract(x, pattern, 7)
    digits = F.rpad(F.regexp_replace(zone, r"[^0-9]", ""), 4, "0")
    offset = F.when(zone.isin("", "Z"), "+00:00").otherwise(F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)))
    local = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    return F.when(x.rlike(pattern) & F.try_to_timestamp(local, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.concat(local, offset))


def is_date(x: Column) -> Column:
    """Three groups of digits with hyphens between; their lengths aren't looked at."""
    return x.rlike("^[0-9]+-[0-9]+-[0-9]+$")


def traceparent_id(x: Column) -> Column:
    """Trace id of a traceparent header; null unless it is 32 hex digits."""
    return F.nullif(F.regexp_extract(x, r"^[^-]*-([0-9a-fA-F]{32})(?:-|$)", 1), F.lit(""))


def parse_bool(x: Column) -> Column:
    return F.lower(trim(x)).isin("1", "true", "yes", "on")


def or_default(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(trim(x), F.lit("")), F.lit(default))


def normalize_title(x: Column) -> Column:
    return F.lower(collapse(x))


def preview(x: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut back to a character's edge."""
    raw = F.substring(F.encode(x, "UTF-8"), 1, limit)
    partial = F.substring(F.encode(x, "UTF-8"), limit + 1, 1)
    # a continuation byte after the cut means that the last character is incomplete
    inside = F.hex(partial).rlike("^[89AB]")
    whole = F.regexp_replace(F.hex(raw), "(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F]){0,1}|[CD][0-9A-F])$", "")
    return F.when(F.octet_length(x) <= limit, x).otherwise(F.decode(F.when(inside, F.unhex(whole)).otherwise(raw), "UTF-8"))


def decode_entities(x: Column) -> Column:
    """Named and numeric entities; unknown ones stay.  One pass, so what is decoded is not decoded again."""
    table = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])
    parts = F.regexp_extract_all(x, F.lit(r"(?s)&[#A-Za-z0-9]+;|&|[^&]+"), F.lit(0))

    def one(p: Column) -> Column:
        name = F.substring(p, F.lit(2), F.length(p) - 2)
        digits = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, F.lit(2), F.length(name)))
        code = F.try_to_number(digits, F.lit("9999999")).cast("int")
        valid = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~p.rlike("^&[#A-Za-z0-9]+;$"), p).otherwise(F.coalesce(table[name], F.when(valid, point), p))

    return F.when(x.isNotNull(), F.array_join(F.transform(parts, one), ""))


def strip_tags(x: Column) -> Column:
    """Tags go: ``<`` before a letter, ``/``, ``!`` or ``?``, up to ``>`` on the same line within 1024 characters."""
    return F.regexp_replace(x, r"<[A-Za-z/!?][^>\n]{0,1022}>", "")


def clean_rss_text(x: Column) -> Column:
    return collapse(strip_tags(decode_entities(x)))
