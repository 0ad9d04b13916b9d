"""Readers of container structure: each turns bytes into rows of parts (kind, name, start, end), bounded by the bytes themselves."""

from __future__ import annotations

import struct
from collections.abc import Iterator

PNG = b"\x89PNG\r\n\x1a\n"
Part = tuple[str, str, int, int]


def png_parts(raw: bytes) -> Iterator[Part]:
    """Chunks from the signature up to IEND; a chunk that runs past the end is told as an overrun and ends the walk."""
    at = len(PNG)
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        name, end = raw[at + 4 : at + 8], at + 12 + size
        if end > len(raw):
            yield "overrun", name.decode("ascii", "replace"), at, len(raw)
            return
        yield "chunk", name.decode("ascii", "replace"), at, end
        at = end
        if name == b"IEND":
            return


def jpeg_parts(raw: bytes) -> Iterator[Part]:
    """Segments up to the start of the scan, whose marker is the last part."""
    at = 0
    while at + 2 <= len(raw) and raw[at] == 0xFF:
        code = raw[at + 1]
        alone = code in (0xD8, 0xD9) or 0xD0 <= code <= 0xD7
        if code == 0xDA or alone:
            yield "segment", f"{code:02X}", at, at + 2
            if code == 0xDA:
                return
            at += 2
            continue
        if at + 4 > len(raw):
            return
        end = at + 2 + struct.unpack_from(">H", raw, at + 2)[0]
        yield "segment", f"{code:02X}", at, min(end, len(raw))
        at = end


def bmff_parts(raw: bytes) -> Iterator[Part]:
    """Boxes; what no box covers is the tail."""
    at = 0
    while at + 8 <= len(raw):
        (size,), head = struct.unpack_from(">I", raw, at), 8
        if size == 1 and at + 16 <= len(raw):
            (size,), head = struct.unpack_from(">Q", raw, at + 8), 16
        elif size == 0:
            size = len(raw) - at
        if size < head or at + size > len(raw):
            break
        yield "box", raw[at + 4 : at + 8].decode("latin-1"), at, at + size
        at += size
    if at < len(raw):
        yield "tail", "", at, len(raw)


def riff_parts(raw: bytes) -> Iterator[Part]:
    """The declared container and what follows it."""
    if len(raw) >= 12 and raw[:4] in (b"RIFF", b"RIFX", b"RF64"):
        (size,) = struct.unpack_from(">I" if raw[:4] == b"RIFX" else "<I", raw, 4)
        if size + 8 < len(raw):
            yield "tail", "", size + 8, len(raw)


def search_ranges(raw: bytes, suffix: str) -> list[tuple[int, int]]:
    """The byte ranges of a file that hold text or metadata, not compressed pixels."""
    whole = [(0, len(raw))]
    if suffix == ".png" or raw.startswith(PNG):
        if not raw.startswith(PNG):
            return whole
        return [(0, 8)] + [(a, b) for kind, name, a, b in png_parts(raw) if kind == "chunk" and name != "IDAT"]
    if suffix in (".jpg", ".jpeg") or raw.startswith(b"\xff\xd8"):
        return [(a, b) for _, _, a, b in jpeg_parts(raw)] if raw.startswith(b"\xff\xd8") else whole
    return whole
