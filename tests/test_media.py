import io
import math
import struct
import sys
import types
import wave
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphtrace.limits import LimitExceeded, ScanLimits
from glyphtrace.operators import pixels, provenance, robust
from glyphtrace.operators.containers import carved_media, data_uris, members, zip_members
from glyphtrace.operators.formats import PNG, bmff_parts, png_parts, riff_parts, search_ranges

L = ScanLimits()


def chunk(name: bytes, data: bytes = b"") -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(a: np.ndarray, kind: int, filters=(0,), extra=b"", palette=None) -> bytes:
    h, w = a.shape[:2]
    step = 1 if a.ndim == 2 else a.shape[2]
    rows, before = b"", np.zeros(w * step, int)
    for y in range(h):
        line, f = a[y].reshape(-1).astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), before[:-step]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0 * line, left, before, (left + before) // 2, paeth][f]
        rows += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + extra
    return PNG + body + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND")


def bmp(a: np.ndarray, top_down=False) -> bytes:
    h, w, n = a.shape
    rows = a if top_down else a[::-1]
    data = b"".join(r[:, [2, 1, 0, *range(3, n)]].tobytes() + b"\0" * (-w * n % 4) for r in rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, 8 * n, 0, len(data), 0, 0, 0, 0) + data


def tiff(a: np.ndarray, strips=1, order="<") -> bytes:
    h, w = a.shape[:2]
    n = 1 if a.ndim == 2 else 3
    parts = [p.tobytes() for p in np.array_split(a, strips)]
    data = b"".join(parts)
    at = [8 + sum(map(len, parts[:k])) for k in range(strips)]
    entries = [(256, w), (257, h), (258, 8), (259, 1), (262, 1 if n == 1 else 2), (277, n)]
    lists, tail = [], 8 + len(data)
    out = b""
    for tag, values in ((273, at), (279, [len(p) for p in parts])):
        if strips == 1:
            lists.append((tag, 1, values[0]))
        else:
            lists.append((tag, strips, tail + len(out)))
            out += struct.pack(f"{order}{strips}I", *values)
    ifd = struct.pack(order + "H", len(entries) + 2)
    for tag, v in entries:
        ifd += struct.pack(order + "HHI", tag, 3, 1) + struct.pack(order + "H", v) + b"\0\0"
    for tag, count, v in lists:
        ifd += struct.pack(order + "HHII", tag, 4, count, v)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, tail + len(out)) + data + out + ifd + b"\0\0\0\0"


def gif(indices: bytes, w: int, h: int, palette: bytes) -> bytes:
    """Codes of nine bits, with a clear code before the width would grow."""
    codes = []
    for k, i in enumerate(indices):
        if k % 200 == 0:
            codes.append(256)
        codes.append(i)
    codes.append(257)
    bits = sum(c << (9 * k) for k, c in enumerate(codes))
    data = bits.to_bytes(-(-9 * len(codes) // 8), "little")
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + palette + b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b";"


rng = np.random.Generator(np.random.PCG64(3))
RGB = rng.integers(0, 256, (20, 24, 3), dtype=np.uint8)


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("kind,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(filters, kind, n):
    a = rng.integers(0, 256, (9, 7, n), dtype=np.uint8)
    image = pixels.read_image(png(a, kind, filters), ".png", L)
    assert (image.width, image.height) == (7, 9)
    assert (np.stack(list(image.planes.values()), 1) == a.reshape(-1, n)).all()


def test_other_readers():
    for a, raw, suffix in ((RGB, bmp(RGB), ".bmp"), (RGB, bmp(RGB, True), ".bmp"), (RGB, bmp(np.dstack([RGB, RGB[:, :, 0]])), ".bmp"), (RGB, tiff(RGB), ".tif"), (RGB, tiff(RGB, 4), ".tiff"), (RGB, tiff(RGB, 1, ">"), ".tif")):
        image = pixels.read_image(raw, suffix, L)
        assert (np.stack([image.planes[c] for c in "RGB"], 1) == a.reshape(-1, 3)).all(), suffix
    grey = pixels.read_image(tiff(RGB[:, :, 0].copy()), ".tif", L)
    assert grey.mode == "L" and (grey.planes["L"] == RGB[:, :, 0].ravel()).all()
    palette = bytes(range(256)) * 3
    image = pixels.read_image(gif(RGB[:, :, 0].tobytes(), 24, 20, palette), ".gif", L)
    assert (image.planes["indices"] == RGB[:, :, 0].ravel()).all() and image.palette == palette
    image = pixels.read_image(png(RGB[:, :, 1], 3, palette=palette), ".png", L)
    assert image.mode == "P" and image.palette == palette


def test_limits():
    with pytest.raises(LimitExceeded, match="max_image_pixels"):
        pixels.read_image(png(RGB, 2), ".png", ScanLimits(max_image_pixels=10))
    with pytest.raises(LimitExceeded, match="max_decompressed_bytes"):
        pixels.read_image(png(RGB, 2), ".png", ScanLimits(max_decompressed_bytes=10))
    for bad in ({"max_findings": 0}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            ScanLimits.of(bad)
    with pytest.raises(TypeError):
        ScanLimits.of(3)


def _pictures():
    y, x = np.mgrid[0:64, 0:64]
    natural = np.clip(128 + 60 * np.cos(x / 9) * np.cos(y / 7) + rng.normal(0, 2, (64, 64)), 0, 255).astype(np.uint8) // 4 * 4
    return natural, (natural & 254) | rng.integers(0, 2, (64, 64), dtype=np.uint8)


def test_chi_square_tells_payloads():
    natural, stego = _pictures()
    assert not pixels.pair_chi_square(natural.ravel())["suspicious"]
    assert pixels.pair_chi_square(stego.ravel())["p_value"] > pixels.pair_chi_square(natural.ravel())["p_value"]
    assert pixels.survival(5, 0) == 1.0 and pixels.survival(-1, 3) == 1.0
    assert abs(pixels.survival(127, 127) - 0.483) < 0.01


def _brute_pairs(plane, width):
    c = dict.fromkeys("wxyz", 0)
    for r in range(len(plane) // width):
        for k in range(width - 1):
            u, v = int(plane[r * width + k]), int(plane[r * width + k + 1])
            if u // 2 == v // 2:
                c["w"] += 1
            elif abs(u - v) == 1:
                c["x"] += 1
            elif u // 2 * 2 == v // 2 * 2 - 2:
                c["y"] += 1
            elif v // 2 * 2 == u // 2 * 2 - 2:
                c["z"] += 1
    n = sum(c.values())
    return {k: v / n for k, v in c.items()}


def test_sample_pairs_and_entropy():
    _, stego = _pictures()
    got = pixels.sample_pairs(stego.ravel(), 64)
    assert {k: pytest.approx(v) for k, v in _brute_pairs(stego.ravel(), 64).items()} == {k: got[k] for k in "wxyz"}
    half = np.tile(np.array([0, 1], np.uint8), 2048)
    assert pixels.bit_entropy(half, 64)["suspicious"]
    assert not pixels.bit_entropy(np.zeros(4096, np.uint8), 64)["suspicious"]
    assert pixels.regular_singular(stego.ravel(), 64)["estimate"] == 0.0
    assert not pixels.palette_bits(bytes(9), half)["suspicious"]
    assert pixels.palette_bits(bytes(k for c in range(16) for k in (c, c, c)), rng.integers(0, 16, 400, dtype=np.uint8))["suspicious"]


def tone(parts, rate=8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.concatenate(parts).astype("<i2").tobytes())
    return out.getvalue()


def test_wav():
    t = np.arange(400)
    parts = [(9000 * np.sin(2 * math.pi * 440 * t / 8000)) if k % 2 == 0 else np.zeros(400) for k in range(12)]
    r = robust.analyze_wav(".wav", tone(parts))
    assert r["status"] == "DETECTED" and "silence_interval" in r["detected_families"]
    assert robust.analyze_wav(".wav", b"junk")["status"] == "NOT_CHECKED"
    assert robust.analyze_wav(".wav", tone([np.zeros(10)]))["status"] == "NOT_CHECKED"


def test_checkerboard():
    board = np.where(np.indices((32, 32)).sum(0) % 2, 152, 104).astype(np.uint8)
    r = robust.analyze_media(".bmp", bmp(np.dstack([board] * 3)))["IMAGE_ROBUST"]
    assert r["status"] == "DETECTED" and r["metrics"]["blocks"] == 16
    assert robust.analyze_media(".bmp", bmp(np.full((32, 32, 3), 9, np.uint8)))["IMAGE_ROBUST"]["status"] == "NOT_DETECTED"


def test_analyzers():
    ok = {"VIDEO_ROBUST": lambda s, b: {"status": "DETECTED", "confidence": 0.5, "families": ["frame"]}}
    assert robust.analyze_media(".mp4", b"", ok)["VIDEO_ROBUST"]["detected_families"] == ["frame"]
    for bad in (lambda s, b: 3, lambda s, b: {"status": "?"}, lambda s, b: {"confidence": 2}, lambda s, b: {"metrics": {"x": object()}}):
        assert robust.analyze_media(".mp4", b"", {"VIDEO_ROBUST": bad})["VIDEO_ROBUST"]["status"] == "ERROR"
    assert robust.analyze_media(".mp4", b"")["VIDEO_ROBUST"]["status"] == "NOT_CHECKED"


def test_parts():
    raw = png(RGB, 2, extra=chunk(b"vpAg") + chunk(b"tEXt", b"abc")) + b"tail"
    assert [n for _, n, _, _ in png_parts(raw)] == ["IHDR", "vpAg", "tEXt", "IDAT", "IEND"]
    assert [k for k, *_ in png_parts(raw[:75])][-1] == "overrun"
    assert all(b"IDAT" not in raw[a:b] for a, b in search_ranges(raw, ".png"))
    assert list(riff_parts(tone([np.zeros(1000)]) + b"xy"))[0][0] == "tail"
    box = struct.pack(">I", 16) + b"ftyp" + b"isom0000" + struct.pack(">I", 8) + b"uuid"
    assert [(k, n) for k, n, _, _ in bmff_parts(box + b"rest")] == [("box", "ftyp"), ("box", "uuid"), ("tail", "")]
    jpeg = b"\xff\xd8\xff\xe1\x00\x06abcd\xff\xda\xe2\x80\x8b"
    assert search_ranges(jpeg, ".jpg") == [(0, 2), (2, 10), (10, 12)]


def packed(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def test_members():
    raw = packed({"a.png": b"1", "b.bin": b"2", "c.svg": b"<svg></svg>"})
    assert [m[0] for m in zip_members(raw, L)] == ["a.png", "c.svg"]
    assert [m[2] for m in zip_members(raw, ScanLimits(max_archive_members=1))] == [None, "member limit reached"]
    assert [m[2] for m in zip_members(packed({"a.png": b"12345"}), ScanLimits(max_decompressed_bytes=3))] == ["oversized member skipped: a.png"]
    assert list(members(".zip", b"no zip", L))[0][2].startswith("container scan failed")
    picture = png(RGB, 2)
    assert [k for k, _ in carved_media(b"%PDF" + picture + b"\xff\xd8..\xff\xd9<svg a='1'>x</svg >")] == ["png", "jpg", "svg"]
    uri = b"<img src='data:image/png;base64,aGVs\r\nbG8='><img src='data:image/jpeg;base64,@@'><img src='data:image/jpeg;base64,abc'>"
    assert [(m[0], m[1], m[2] is None) for m in data_uris(uri, L)] == [("data-uri-1.png", b"hello", True), (None, None, False)]


def test_provenance():
    claim = png(RGB, 2, extra=chunk(b"caBX", b'{"provider": "x"}'))
    assert provenance.examine("a.txt", ".txt", b"c2pa")["status"] == "UNSUPPORTED"
    assert provenance.examine("a.png", ".png", png(RGB, 2))["status"] == "MISSING"
    r = provenance.examine("a.png", ".png", claim)
    assert (r["status"], r["provider"], r["manifest_location"]) == ("NOT_CHECKED", "x", "embedded")
    assert provenance.examine("a.png", ".png", claim, validator=lambda m, b, w: {"status": "VALID"})["status"] == "VALID"
    assert provenance.examine("a.png", ".png", claim, validator=lambda m, b, w: 1 / 0)["status"] == "NOT_CHECKED"
    assert provenance.examine("a.png", ".png", b"", ("a.png.c2pa.json", b"{"))["status"] == "TAMPERED"
    remote = png(RGB, 2, extra=chunk(b"c2pa", b'{"remote_url": "https://x.example/m"}'))
    assert provenance.examine("a.png", ".png", remote)["status"] == "NOT_CHECKED"
    assert [f[6] for f in provenance.findings(provenance.record("TAMPERED"))] == ["high", "high"]
    assert [f[6] for f in provenance.findings(provenance.record("NOT_CHECKED"))] == ["medium", "medium"]
    with pytest.raises(ValueError):
        provenance.record("SOMETHING")


def test_tool_reports():
    read = provenance.ToolValidator.read
    manifest = {"active_manifest": "m", "manifests": {"m": {"signature_info": {"issuer": "I", "time": "t"}, "assertions": [{"label": "c2pa.actions.v2", "data": {"actions": [{"action": "a", "digitalSourceType": "d"}]}}]}}}
    good = read(manifest)
    assert (good["status"], good["provider"], good["digital_source_type"], good["timestamps"], good["certificate_trust"]) == ("VALID", "I", "d", ["t"], "trusted")
    assert read(manifest | {"validation_status": [{"code": "signingCredential.untrusted"}, {"code": "signingCredential.untrusted"}]})["status"] == "UNTRUSTED_SIGNER"
    assert read(manifest | {"validation_status": [{"code": "assertion.dataHash.mismatch"}]})["status"] == "TAMPERED"
    assert read(manifest, 1)["status"] == "TAMPERED" and read({})["status"] == "MISSING" and read([])["status"] == "NOT_CHECKED"
    assert provenance.ToolValidator("no-such-tool-here").validate_content("a.png", b"")["status"] == "NOT_CHECKED"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=1024), st.sampled_from([".png", ".gif", ".bmp", ".zip", ".docx", ".pdf", ".wav", ".mp4", ".jpg", ".tif"]), st.sampled_from([b"", PNG, b"GIF89a", b"BM", b"PK\x03\x04", b"RIFF", b"II*\0", b"\xff\xd8"]))
def test_never_raises(tail, suffix, head):
    raw = head + tail
    try:
        pixels.read_image(raw, suffix, L)
    except LimitExceeded:
        pass
    list(members(suffix, raw, L)), list(png_parts(raw)), list(bmff_parts(raw)), list(riff_parts(raw)), search_ranges(raw, suffix)
    robust.analyze_media(suffix, raw)
    provenance.examine("x" + suffix, suffix, raw)


@pytest.mark.parametrize("step", [1, 3])
def test_line_filters(step):
    """Lines under all filters, mixed, against the definition, a sample at a time."""
    g = np.random.Generator(np.random.PCG64(step))
    rows = np.hstack([g.integers(0, 5, (23, 1)), g.integers(0, 256, (23, 17 * step))]).astype(np.uint8)
    want = np.zeros((24, 17 * step + step), int)
    for y in range(23):
        for x in range(17 * step):
            a, b, c = int(want[y + 1, x]), int(want[y, x + step]), int(want[y, x])
            p = a + b - c
            near = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            want[y + 1, x + step] = (int(rows[y, x + 1]) + [0, a, b, (a + b) // 2, near][rows[y, 0]]) % 256
    assert (pixels._unfiltered(rows, step) == want[1:, step:]).all()


def test_imaging_library(monkeypatch):
    """An installed library goes first; what it can't read, the built-in readers do."""

    class Picture:
        format, mode, size = "FAKE", "LA", (2, 1)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def tobytes(self):
            return b"abcd"

    def open_(f):
        if f.read(3) == b"bad":
            raise OSError
        return Picture()

    library = types.ModuleType("PIL")
    library.Image = types.SimpleNamespace(open=open_)
    monkeypatch.setitem(sys.modules, "PIL", library)
    got = pixels.read_image(b"good", ".png", L)
    assert (got.format, got.mode, bytes(got.planes["L"]), bytes(got.planes["A"])) == ("FAKE", "LA", b"ac", b"bd")
    assert pixels.read_image(b"bad", ".png", L) is None
    with pytest.raises(LimitExceeded):
        pixels.read_image(b"good", ".png", ScanLimits(max_image_pixels=1))
