"""HTML pages to plain text and headings, with built-in expressions.

A page is cut once into comments, elements nobody reads, tags, shortcodes and
runs of text; each piece becomes what it is for a reader (a line's end, a blank,
nothing, itself), and the pieces are joined to lines.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lx

_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_OPEN, _CLOSE = "\x01", "\x02"  # around a heading


def _letter(point: Column) -> Column:
    """The character of a code point; null where there is none."""
    real = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def _reference(piece: Column) -> Column:
    """What a character reference stands for; an unknown one stays as written."""
    names = F.create_map(*(F.lit(x) for name, point in {**name2codepoint, "apos": 39}.items() for x in (name, chr(point))))
    inner = F.regexp_extract(piece, r"^&#?(.*);$", 1)
    number = F.when(
        inner.rlike("^[xX]"), F.conv(F.substring(inner, 2, 8), 16, 10)
    ).otherwise(inner)
    return F.coalesce(F.when(piece.startswith("&#"), _letter(number.cast("bigint"))).otherwise(F.try_element_at(names, inner)), piece)


def unescape(text: Column) -> Column:
    """Character references decoded, each once."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{_REFERENCE}|[^&]+|&"), 0)
    decoded = F.transform(pieces, lambda p: F.when(p.rlike(f"^{_REFERENCE}$"), _reference(p)).otherwise(p))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def clean_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "(?U)[\\s ​]+", " "))


def readable(page: Column, skip_marker: str = "search:skip", shortcodes: tuple[str, ...] = ()) -> Column:
    """The page as lines of text, headings between two marks of their own; for ``headings`` and ``plain_text``."""
    unseen = rf"<({lx.UNSEEN_TAGS})\b[^>]*>.*?</\1\s*>"
    # Closing shortcodes, those with an attribute or an underscore in the name, and registered ones.
    codes = [r"/[a-zA-Z][\w-]*(?:\s[^\[\]]*)?/?", r"[a-zA-Z][\w-]*\s[^\[\]]*=[^\[\]]*", r"[a-zA-Z][a-zA-Z0-9-]*_[\w-]*(?:\s[^\[\]]*)?/?"]
    if shortcodes:
        codes.append(rf"(?:{'|'.join(shortcodes)})(?:\s[^\[\]]*)?/?")
    pieces = [
        rf"<!--\s*{skip_marker}\s*-->.*?(?:<!--\s*/{skip_marker}\s*-->|\z)", r"<!--.*?-->", unseen, r"<[^>]*>",
        *(rf"\[{code}\]" for code in codes), r"[^<\[]+", r"<", r"\[",
    ]

    def shown(piece: Column) -> Column:
        tag = piece.rlike(r"^<(?s:.*)>$")
        return (
            F.when(~piece.rlike(r"^[<\[]."), piece)
            .when(piece.startswith("[") | piece.startswith("<!--") | piece.rlike(rf"(?is)^{unseen}$"), " ")
            .when(piece.rlike(r"(?i)^<h[1-6]\b"), f"\n{_OPEN}")
            .when(piece.rlike(r"(?i)^</h[1-6]\b"), f"{_CLOSE}\n")
            .when(piece.rlike(rf"(?i)^</?(?:{lx.BLOCK_TAGS}|br)\b"), "\n")
            .when(tag, "")
            .otherwise(piece)
        )

    found = F.regexp_extract_all(F.translate(page, _OPEN + _CLOSE, ""), F.lit("(?is)" + "|".join(pieces)), 0)
    return F.array_join(F.transform(found, shown), "")


def headings(lines: Column) -> Column:
    """The texts of h1 to h6, in order; of ``readable``."""
    found = F.regexp_extract_all(lines, F.lit(rf"{_OPEN}([^{_OPEN}{_CLOSE}]*){_CLOSE}"), 1)
    return F.filter(F.transform(found, lambda h: clean_line(unescape(h))), lambda h: h != "")


def plain_text(lines: Column) -> Column:
    """Lines of text, blank ones dropped; of ``readable``."""
    split = F.split(unescape(F.translate(lines, _OPEN + _CLOSE, "")), r"\R")
    return F.array_join(F.filter(F.transform(split, clean_line), lambda x: x != ""), "\n")
