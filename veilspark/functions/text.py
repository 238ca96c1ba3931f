"""Scalar functions on names, paths, encodings and words, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import DEVICE_NAMES, EXCLUDED, IMAGE_FORMATS, MACRO_FORMATS, MAX_TEXT, NATIVE_OFFICE, OFFICE_FORMATS, TEXT_FORMATS

#: Python's idea of white space, in Java's dialect.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_name(name: Column) -> Column:
    """A file name that is safe everywhere: last component, no reserved characters or device names, 140 characters. Null if nothing is left."""
    last = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    safe = F.substring(F.trim(F.regexp_replace(last, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" .")), 1, 140)
    stem = F.upper(F.split_part(safe, F.lit("."), F.lit(1)))
    return F.when(safe == "", None).when(stem.isin(DEVICE_NAMES), F.concat(F.lit("_"), safe)).otherwise(safe)


def archive_name_ok(name: Column) -> Column:
    """Whether a member's name stays inside its archive: relative, no "..", no backslash, colon or NUL, parts of at most 180 characters."""
    parts = F.split(name, "/")
    bad = name.isNull() | (name == "") | name.rlike(r"[\\:\x00]") | F.startswith(name, F.lit("/"))
    return F.coalesce(~bad & F.forall(parts, lambda p: (p != "..") & (F.length(p) <= 180)), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regex over a whole name."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}"
    return f"(?s)^(?:{out})$"


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether any part of a relative path, or the whole of it, matches a pattern."""
    if not patterns:
        return F.lit(False)
    any_of = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return F.exists(F.split(path, "/"), lambda p: p.rlike(any_of)) | path.rlike(any_of)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none or the name only begins with a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def route(ext: Column) -> Column:
    """struct<format, text_format, export_mode, supported>: what can be done with a file of an extension."""
    plain = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MACRO_FORMATS.items() for x in kv]), ext), ext)
    office = ext.isin(OFFICE_FORMATS) | ext.isin(list(MACRO_FORMATS))
    mode = (
        F.when(ext == ".zip", "archive")
        .when(ext.isin(NATIVE_OFFICE), "office")
        .when(office | ext.isin(TEXT_FORMATS), "text")
        .when(ext == ".pdf", "pdf")
        .when(ext.isin(IMAGE_FORMATS), "image")
        .otherwise("none")
    )
    return F.struct(ext.alias("format"), plain.alias("text_format"), mode.alias("export_mode"), (mode != "none").alias("supported"))


def byte_size(n: Column) -> Column:
    """A size for people: B, KiB, MiB or GiB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KiB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MiB", n / 1024**2))
        .otherwise(F.format_string("%.2f GiB", n / 1024**3))
    )


def formula_guard(value: Column) -> Column:
    """A cell text that no spreadsheet takes for a formula."""
    return F.when(F.regexp_replace(value, rf"^[{SPACE}]+", "").rlike("^[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def integer(value: Column, low: int, high: int) -> Column:
    """A whole number of a text within bounds, else null."""
    n = F.trim(value).try_cast("long")
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$") & n.between(low, high), n)


# Characters of the Windows-1252 bytes 0x80 to 0x9F; the five bytes without one are left out.
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


def decoded(raw: Column) -> Column:
    """struct<text, method, error>: UTF-16 with a byte order mark, else UTF-8, else Windows-1252; binary content is an error."""
    head = F.hex(F.substring(raw, 1, 3))
    text8 = raw.cast("string")
    latin = F.decode(raw, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, CP1252)), "".join(CP1252.values()))
    valid8 = F.is_valid_utf8(text8)
    wide = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    text = F.when(wide, F.decode(raw, "UTF-16")).when(valid8, F.when(head == "EFBBBF", F.substring(text8, 2, 1 << 30)).otherwise(text8)).otherwise(western)
    method = F.when(wide, "UTF-16").when(valid8, "UTF-8").otherwise("Windows-1252")
    undefined = ~wide & ~valid8 & latin.rlike(r"[\x81\x8d\x8f\x90\x9d]")
    error = F.when(F.contains(text, F.lit("\x00")), "binary").when(undefined, "unknown_encoding")
    return F.struct(F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), method).alias("method"), error.alias("error"))


def truncated(text: Column, limit: int = MAX_TEXT) -> Column:
    """struct<text, truncated>"""
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


def normal_form(v: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", v).casefold() if c.isalnum())


def _normal(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else normal_form(v))


def _plain(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def is_ascii(v: Column) -> Column:
    return v.rlike(r"^[\x00-\x7f]*$")


def normalized(v: Column) -> Column:
    """Compatibility form, case folded, letters and digits only. Python sees non-ASCII values alone."""
    return F.coalesce(F.pandas_udf(_normal, "string")(F.when(~is_ascii(v), v)), F.lower(F.regexp_replace(v, "[^A-Za-z0-9]", "")))


def without_accents(v: Column) -> Column:
    return F.coalesce(F.pandas_udf(_plain, "string")(F.when(~is_ascii(v), v)), v)


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match if the pattern has groups and any took part, else the match, else nothing."""
    import re

    whole = F.regexp_extract(text, pattern, 0)
    if not re.compile(pattern).groups:
        return whole
    n = re.compile(pattern).groups
    took_part = F.concat(*[F.regexp_extract(text, pattern, i) for i in range(1, n + 1)]) != ""
    return F.when(took_part, F.regexp_extract(text, pattern, 1)).otherwise(whole)


def methods_of(methods: Column) -> Column:
    """Different methods of a document's pages, in order, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(methods)), " + ")


def html_escaped(v: Column) -> Column:
    out = v
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlighted(text: Column, query: str, most: int = 20) -> Column:
    """HTML of a text with the first `most` words of a query marked, whatever their case."""
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", query)[:most]
    if not words:
        return html_escaped(text)
    on, off = "﷐", "﷑"
    marked = F.regexp_replace(text, "(?iu)(" + "|".join(words) + ")", f"{on}$1{off}")
    return F.replace(F.replace(html_escaped(marked), F.lit(on), F.lit("<mark>")), F.lit(off), F.lit("</mark>"))


