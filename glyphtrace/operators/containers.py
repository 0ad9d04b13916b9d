"""Expansion of containers: archives, office files, PDF and HTML to rows of members, level by level."""

from __future__ import annotations

import base64
import binascii
import io
import re
import time
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.limits import ScanLimits
from glyphtrace.operators.formats import PNG, png_parts
from glyphtrace.sources.assets import SCHEMA

MEMBER_BYTES = 10 << 20
_SVG = re.compile(rb"<svg\b.*?</svg\s*>", re.I | re.S)
_DATA_URI = re.compile(rb"data:image/(png|jpeg|svg\+xml);base64,([A-Za-z0-9+/=\r\n]+)", re.I)
Member = tuple[str | None, bytes | None, str | None]


def zip_members(raw: bytes, limits: ScanLimits) -> Iterator[Member]:
    """(name, content, None) or (None, None, error). Every entry counts toward the cap on members."""
    most = min(MEMBER_BYTES, limits.max_decompressed_bytes)
    total = 0
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            for k, entry in enumerate(archive.infolist()):
                if k >= limits.max_archive_members:
                    yield None, None, "member limit reached"
                    return
                if entry.is_dir() or PurePosixPath(entry.filename).suffix.lower() not in dims.MEMBER_SUFFIXES:
                    continue
                if entry.file_size > most:
                    yield None, None, f"oversized member skipped: {entry.filename}"
                    continue
                total += entry.file_size
                if total > limits.max_decompressed_bytes:
                    yield None, None, "decompressed-size limit reached"
                    return
                with archive.open(entry) as f:
                    content = f.read(most + 1)
                yield (None, None, f"oversized member skipped: {entry.filename}") if len(content) > most else (entry.filename, content, None)
    except (OSError, zipfile.BadZipFile, RuntimeError, EOFError, NotImplementedError) as e:
        yield None, None, f"container scan failed: {e}"


def carved_media(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Images inside other bytes: all PNG, then JPEG, then SVG. A PNG without an end stops the search for PNG."""
    at = raw.find(PNG)
    while at >= 0:
        ends = [b for kind, name, _, b in png_parts(raw[at:]) if kind == "chunk" and name == "IEND"]
        if not ends:
            break
        yield "png", raw[at : at + ends[0]]
        at = raw.find(PNG, at + ends[0])
    for m in re.finditer(rb"\xff\xd8.*?\xff\xd9", raw, re.S):
        yield "jpg", m[0]
    for m in _SVG.finditer(raw):
        yield "svg", m[0]


def data_uris(raw: bytes, limits: ScanLimits) -> Iterator[Member]:
    for k, m in enumerate(_DATA_URI.finditer(raw), 1):
        kind = {b"jpeg": "jpg", b"svg+xml": "svg"}.get(m[1].lower(), "png")
        try:
            content = base64.b64decode(re.sub(rb"\s+", b"", m[2]), validate=True)
        except (binascii.Error, ValueError):
            yield None, None, f"invalid base64 in data URI {k}"
            continue
        if len(content) > min(MEMBER_BYTES, limits.max_decompressed_bytes):
            yield None, None, f"oversized data URI skipped: {k}"
        else:
            yield f"data-uri-{k}.{kind}", content, None


def members(suffix: str, raw: bytes, limits: ScanLimits) -> Iterator[Member]:
    if suffix in dims.ZIP_SUFFIXES:
        yield from zip_members(raw, limits)
    elif suffix == ".pdf":
        yield from ((f"embedded-{k}.{kind}", content, None) for k, (kind, content) in enumerate(carved_media(raw), 1))
    elif suffix in (".html", ".htm"):
        yield from data_uris(raw, limits)


def expand(assets: DataFrame, limits: ScanLimits | None = None) -> DataFrame:
    """All members of all containers, down to the depth limit: assets of depth 1 and more, and error rows (content null).

    A container at the depth limit yields an error row of its own, so that its root counts as incomplete.
    """
    limits = ScanLimits.of(limits)
    schema = pa.schema([("asset_id", pa.string()), ("parent_id", pa.string()), ("root_id", pa.string()), ("depth", pa.int32()), ("path", pa.string()), ("name", pa.string()), ("suffix", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("read_error", pa.string())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                until = time.monotonic() + limits.max_scan_seconds
                for k, (name, content, error) in enumerate(members(row["suffix"], row["content"], limits), 1):
                    late = time.monotonic() > until
                    if late:
                        name, content, error = None, None, "max_scan_seconds exceeded"
                    base = {"parent_id": row["asset_id"], "root_id": row["root_id"], "depth": row["depth"] + 1, "asset_id": f"{row['asset_id']}!{k}"}
                    if error is None:
                        base |= {"path": f"{row['path']}!{name}", "name": name, "suffix": PurePosixPath(name).suffix.lower(), "length": len(content), "content": content, "read_error": None}
                    else:
                        base |= {"path": row["path"], "name": None, "suffix": "", "length": None, "content": None, "read_error": error}
                    yield pa.RecordBatch.from_pylist([base], schema=schema)
                    if late:
                        break

    containers = [*dims.ZIP_SUFFIXES, ".pdf", ".html", ".htm"]
    level, out = assets, None
    for depth in range(limits.max_nesting_depth):
        open_ = level.filter(F.col("suffix").isin(*containers) & F.col("content").isNotNull()).select(*assets.columns)
        level = open_.mapInArrow(run, SCHEMA)
        out = level if out is None else out.unionAll(level)
    deep = level.filter(F.col("suffix").isin(*containers) & F.col("content").isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    return out.unionAll(deep.select(F.concat("asset_id", F.lit("!depth")), "asset_id", "root_id", F.col("depth") + 1, "path", none("string"), F.lit(""), none("long"), none("binary"), F.lit("nesting depth limit reached")))
