"""PNG and JPEG files: their structure as rows, and PNG without what is not needed to show it."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import MAX_FILE_BYTES, MAX_PIXELS
from .archives import Refused

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Chunks that are kept, and names of JPEG segments.
KEPT = (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS")
SEGMENTS = {0xE1: "EXIF or XMP metadata", 0xE2: "ICC profile or application metadata", 0xED: "IPTC or Photoshop metadata", 0xFE: "JPEG comment"}


def png_chunks(raw: bytes) -> list[tuple[bytes, int, int]]:
    """(type, start, end) of the chunks up to the end chunk, all of them checked."""
    if not raw.startswith(SIGNATURE):
        raise Refused("not_a_png")
    out, at = [], len(SIGNATURE)
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        end = at + size + 12
        if size > MAX_FILE_BYTES or end > len(raw):
            raise Refused("truncated_chunk")
        kind = raw[at + 4 : at + 8]
        if zlib.crc32(raw[at + 4 : end - 4]) != struct.unpack_from(">I", raw, end - 4)[0]:
            raise Refused("bad_crc")
        if (kind == b"IHDR") != (not out):
            raise Refused("bad_header")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", raw, at + 8)
            if size != 13 or not 0 < width * height <= MAX_PIXELS:
                raise Refused("bad_header")
        elif kind not in KEPT and not kind[0] & 32:
            raise Refused("unknown_critical_chunk")
        out.append((kind, at, end))
        at = end
        if kind == b"IEND":
            break
    kinds = [k for k, _, _ in out]
    if not kinds or kinds[-1] != b"IEND" or b"IDAT" not in kinds:
        raise Refused("incomplete")
    return out


def png_parts(raw: bytes) -> tuple[bytes, list[tuple[str, int]], int, int, bool]:
    """Stripped bytes, (label, bytes) of what was taken out, width, height, whether it was animated."""
    chunks = png_chunks(raw)
    width, height = struct.unpack_from(">II", raw, chunks[0][1] + 8)
    found = [(k.decode("ascii", "replace") + " image chunk", e - s - 12) for k, s, e in chunks if k not in KEPT]
    if chunks[-1][2] < len(raw):
        found.append(("Data after PNG end marker", len(raw) - chunks[-1][2]))
    return SIGNATURE + b"".join(raw[s:e] for k, s, e in chunks if k in KEPT), found, width, height, any(k == b"acTL" for k, _, _ in chunks)


def _png_frame(raws: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in raws:
        if raw is None:
            rows.append((None, None, None, None, None, None))
            continue
        try:
            clean, found, width, height, moving = png_parts(bytes(raw))
            rows.append((clean, [{"label": a, "bytes": n} for a, n in found], width, height, moving, None))
        except Refused as e:
            rows.append((None, None, None, None, None, str(e)))
    out = pd.DataFrame(rows, columns=["clean", "metadata", "width", "height", "animated", "error"], dtype=object)
    return out.astype({"width": "Int32", "height": "Int32", "animated": "boolean"})


def png_udf(raw: Column | str) -> Column:
    """struct of a PNG's stripped bytes, metadata, size and error; null bytes give nulls."""
    schema = "clean binary, metadata array<struct<label:string,bytes:long>>, width int, height int, animated boolean, error string"
    return F.pandas_udf(_png_frame, schema)(raw)


def png_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, ordinal, type, size, start, end, error) of every chunk; a refused file is one row with an error."""

    def read(frames):
        for pdf in frames:
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                try:
                    rows = [(k, n, t.decode("ascii", "replace"), e - s - 12, s, e, None) for n, (t, s, e) in enumerate(png_chunks(bytes(raw or b"")))]
                except Refused as x:
                    rows = [(k, -1, None, 0, 0, 0, str(x))]
                yield pd.DataFrame(rows, columns=[key, "ordinal", "type", "size", "start", "end", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(read, f"{key} {kind}, ordinal int, type string, size long, start long, end long, error string")


def jpeg_segments(raw: bytes) -> list[tuple[int, int]]:
    """(marker, length) of header segments with metadata, up to the scan."""
    if not raw.startswith(b"\xff\xd8"):
        raise Refused("not_a_jpeg")
    at, out = 2, []
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        while at < len(raw) and raw[at] == 0xFF:
            at += 1
        if at >= len(raw) or raw[at] in (0xDA, 0xD9):
            break
        marker, body = raw[at], raw[at + 1 : at + 3]
        size = struct.unpack(">H", body)[0] if len(body) == 2 else 0
        if size < 2 or at + 1 + size > len(raw):
            raise Refused("truncated_segment")
        if 0xE1 <= marker <= 0xEF or marker == 0xFE:
            out.append((marker, size))
        at += 1 + size
    return out


def jpeg_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, ordinal, label, bytes, error) of every metadata segment."""

    def read(frames):
        for pdf in frames:
            rows = []
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                try:
                    rows += [(k, n, SEGMENTS.get(m, "JPEG application metadata"), size, None) for n, (m, size) in enumerate(jpeg_segments(bytes(raw or b"")))]
                except Refused as x:
                    rows.append((k, -1, None, 0, str(x)))
            yield pd.DataFrame(rows, columns=[key, "ordinal", "label", "bytes", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(read, f"{key} {kind}, ordinal int, label string, bytes long, error string")
