"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Cyrillic letters of Windows-1251, upper and lower.
CYRILLIC_UPPER, CYRILLIC_LOWER = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_spaces(c: Column) -> Column:
    """Leading and trailing spaces only."""
    return F.btrim(c, F.lit(" "))


def text_length(c: Column) -> Column:
    """Length without trailing spaces."""
    return F.length(F.rtrim(c))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.translate(c, "\t\r\n", "   ")) == "", F.lit(True))


def iequal(a: Column, b) -> Column:
    return to_lower(a) == to_lower(b if isinstance(b, Column) else F.lit(b))


def iprefix(c: Column, prefix: str) -> Column:
    return to_lower(c).startswith(to_lower(F.lit(prefix)))


def to_upper(c: Column) -> Column:
    """ASCII letters only, byte by byte."""
    return F.translate(c, _ASCII_LOWER, _ASCII_UPPER)


def to_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def cyrillic_upper(c: Column, fold_yo: bool = False) -> Column:
    out = F.translate(c, CYRILLIC_LOWER, CYRILLIC_UPPER)
    return F.translate(out, "Ё", "Е") if fold_yo else out


def cyrillic_lower(c: Column, fold_yo: bool = False) -> Column:
    out = F.translate(c, CYRILLIC_UPPER, CYRILLIC_LOWER)
    return F.translate(out, "ё", "е") if fold_yo else out


def split_on(c: Column, token: str) -> Column:
    """Non-empty parts between tokens."""
    return F.filter(F.split(c, "\\Q" + token + "\\E"), lambda x: x != "")


def replace_double(c: Column, token: str) -> Column:
    """Runs of the token become one."""
    return F.regexp_replace(c, "(\\Q" + token + "\\E){2,}", token)


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./\\]*$", "")


def is_listed(c: Column, names: str, token: str = ",") -> Column:
    """Whether c is among names, trimmed and whatever the case of its letters."""
    return to_lower(c).isin(*[n.strip().lower() for n in names.split(token) if n.strip()])


def decode_utf16(c: Column) -> Column:
    return F.decode(c, "UTF-16LE")


def is_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c)


def decode_cp1251(c: Column) -> Column:
    """Windows-1251 bytes to text in the JVM: hex pairs are mapped by a literal map of the upper half of the code page."""
    pairs = []
    for b in range(256):
        pairs += [F.lit(f"{b:02X}"), F.lit(bytes([b]).decode("cp1251", errors="replace"))]
    table = F.create_map(*pairs)
    codes = F.filter(F.split(F.hex(c), "(?<=\\G..)"), lambda x: x != "")
    return F.array_join(F.transform(codes, lambda x: F.element_at(table, x)), "")


def hex_dump(c: Column) -> Column:
    """Bytes as pairs of digits with a space between."""
    return F.trim(F.regexp_replace(F.hex(c), "(..)", "$1 "))


def guid_text(c: Column) -> Column:
    """A 16-byte identifier as text: lower case, padded; its first three parts are little-endian."""
    h = F.lower(F.hex(c))
    part = lambda *at: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in at])
    return F.concat_ws("-", part(3, 2, 1, 0), part(5, 4), part(7, 6), part(8, 9), part(10, 11, 12, 13, 14, 15))


def guid_bytes(c: Column) -> Column:
    h = F.regexp_replace(c, "[-{}]", "")
    part = lambda *at: [F.substring(h, 2 * i + 1, 2) for i in at]
    return F.unhex(F.concat(*part(3, 2, 1, 0, 5, 4, 7, 6, *range(8, 16))))
