"""Signal statistics of audio and images that robust watermarks disturb."""

from __future__ import annotations

import io
import json
import math
import wave
from collections.abc import Callable, Mapping

import numpy as np

from glyphtrace import dims
from glyphtrace.limits import LimitExceeded, ScanLimits
from glyphtrace.operators.pixels import read_image

Analyzer = Callable[[str, bytes], Mapping]


def _result(kind: str, status: str, error: str | None = None, confidence: float = 0.0, detected: list[str] | None = None, metrics: dict | None = None) -> dict:
    return {"status": status, "confidence": confidence, "families": list(dims.ROBUST_FAMILIES[kind]), "detected_families": detected or [], "metrics": metrics or {}, "errors": [error] if error else []}


def read_pcm16(raw: bytes) -> tuple[np.ndarray, int] | None:
    """At most ten seconds of 16-bit PCM as one channel with a peak of 1, and the rate."""
    try:
        with wave.open(io.BytesIO(raw)) as w:
            if w.getsampwidth() != 2 or w.getcomptype() != "NONE":
                return None
            rate, channels = w.getframerate(), w.getnchannels()
            data = w.readframes(min(w.getnframes(), rate * 10))
    except (wave.Error, EOFError):
        return None
    x = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").astype(float).reshape(-1, channels).mean(1)
    return x / max(float(np.abs(x).max(initial=0.0)), 1.0), rate


def echo(x: np.ndarray, rate: int) -> float:
    """The largest normalised autocorrelation over a grid of lags."""
    stride = max(1, math.ceil(len(x) / 50_000))
    x, rate = x[::stride], max(1, rate // stride)
    step, best = max(1, rate // 1000), 0.0
    for lag in range(max(8, rate // 1000), min(rate // 10, len(x) // 4), step):
        a, b = x[:-lag], x[lag:]
        power = math.sqrt(float(a @ a) * float(b @ b))
        best = max(best, abs(float(a @ b)) / power if power else 0.0)
    return best


def flatness(x: np.ndarray, rate: int) -> float:
    """Geometric over arithmetic mean of the power at multiples of 125 Hz."""
    if len(x) < 64:
        return 0.0
    x = x[:4096]
    at = np.arange(125, min(rate // 2, 4000), 125)
    if not len(at):
        return 0.0
    angle = 2 * np.pi / rate * at[:, None] * np.arange(len(x))
    power = (np.cos(angle) @ x) ** 2 + (np.sin(angle) @ x) ** 2 + 1e-15
    return float(np.exp(np.log(power).mean()) / power.mean())


def silences(x: np.ndarray, rate: int) -> tuple[int, float]:
    """Runs of silent 50 ms windows: how many and how alike in length."""
    size = max(1, rate // 20)
    quiet = np.sqrt((x[: len(x) // size * size].reshape(-1, size) ** 2).mean(1)) < 0.01 if len(x) >= size else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(int), [0]])))
    runs = edge[1::2] - edge[::2]
    alike = 1 / (1 + float(runs.std()) / max(float(runs.mean()), 1e-9)) if len(runs) >= 2 else 0.0
    return len(runs), alike


def analyze_wav(suffix: str, raw: bytes) -> dict:
    got = read_pcm16(raw)
    if got is None:
        return _result("AUDIO_ROBUST", "NOT_CHECKED", "only uncompressed 16-bit PCM is analysed")
    x, rate = got
    if len(x) < max(64, rate // 10):
        return _result("AUDIO_ROBUST", "NOT_CHECKED", "the audio is too short for statistics")
    phase, e, f, (count, alike) = float((np.abs(np.diff(x)) > 1.25).mean()), echo(x, rate), flatness(x, rate), silences(x, rate)
    regular = alike if count >= 3 else 0.0
    detected = ["phase"] * (phase > 0.02) + ["echo"] * (e > 0.92) + ["spread_spectrum", "spectral"] * (f > 0.75) + ["silence_interval"] * (regular > 0.8)
    metrics = {"discontinuity_ratio": phase, "max_autocorrelation": e, "spectral_flatness": f, "silence_count": count, "silence_regularity": alike}
    return _result("AUDIO_ROBUST", "DETECTED" if detected else "NOT_DETECTED", None, min(0.95, max(phase * 8, e - 0.5, f, regular)), sorted(detected), metrics)


def analyze_image(suffix: str, raw: bytes, limits: ScanLimits = ScanLimits()) -> dict:
    """Projection of 8 x 8 blocks of the first plane onto a checkerboard."""
    image = read_image(raw, suffix, limits)
    if image is None:
        return _result("IMAGE_ROBUST", "NOT_CHECKED", "the pixels cannot be decoded")
    plane = next(iter(image.planes.values()))
    if min(image.width, image.height) < 16 or len(plane) < image.width * image.height:
        return _result("IMAGE_ROBUST", "NOT_CHECKED", "the image is too small for block statistics")
    down, across = image.height // 8, image.width // 8
    blocks = plane[: image.width * image.height].reshape(image.height, image.width)[: down * 8, : across * 8].reshape(down, 8, across, 8).transpose(0, 2, 1, 3).reshape(-1, 64).astype(float)
    blocks -= blocks.mean(1, keepdims=True)
    scale = np.abs(blocks).sum(1)
    board = np.where(np.indices((8, 8)).sum(0).ravel() % 2, 1.0, -1.0)
    c = np.where(scale > 1e-9, blocks @ board / np.maximum(scale, 1e-9), 0.0)
    strong = c[np.abs(c) > 0.02]
    energy = float(np.abs(c).mean())
    agree = max(float((strong > 0).mean()), float((strong < 0).mean())) if len(strong) else 0.0
    found = len(strong) >= 4 and energy > 0.25 and agree > 0.9
    metrics = {"checkerboard_energy": energy, "blocks": len(c), "block_sign_agreement": agree, "correlated_blocks": len(strong), "format": image.format, "mode": image.mode}
    return _result("IMAGE_ROBUST", "DETECTED" if found else "NOT_DETECTED", None, min(0.95, energy * agree) if found else min(0.5, energy), ["transform_domain", "correlation"] if found else [], metrics)


def checked(kind: str, given) -> dict:
    """What an analyzer returned, in the usual shape; ValueError or TypeError if it can't be."""
    if not isinstance(given, Mapping):
        raise TypeError("a media analyzer returns a mapping")
    status, confidence = str(given.get("status", "NOT_CHECKED")), float(given.get("confidence", 0.0))
    if status not in dims.MEDIA_STATUSES:
        raise ValueError(f"unknown media status: {status}")
    if not 0 <= confidence <= 1:
        raise ValueError("a confidence lies between 0 and 1")
    detected = given.get("detected_families") or given.get("families") or []
    out = {"status": status, "confidence": confidence, "families": list(given.get("families") or dims.ROBUST_FAMILIES[kind]), "detected_families": list(detected) if status == "DETECTED" else [], "metrics": dict(given.get("metrics", {})), "errors": list(given.get("errors", []))}
    json.dumps(out)
    return out


def analyze_media(suffix: str, raw: bytes, analyzers: Mapping[str, Analyzer] | None = None, limits: ScanLimits = ScanLimits()) -> dict[str, dict]:
    """Results by kind for a suffix: a given analyzer, a built-in one, or not checked."""
    out = {}
    for kind, suffixes in dims.ROBUST_SUFFIXES.items():
        if suffix not in suffixes:
            continue
        own = (analyzers or {}).get(kind)
        if own is None and kind == "IMAGE_ROBUST" and suffix in dims.LSB_SUFFIXES:
            own = lambda s, b: analyze_image(s, b, limits)
        if own is None and suffix == ".wav":
            own = analyze_wav
        if own is None:
            out[kind] = _result(kind, "NOT_CHECKED", f"no {kind} analyzer is configured for {suffix}")
            continue
        try:
            out[kind] = checked(kind, own(suffix, raw))
        except Exception as e:  # a plug-in's failure is a result
            out[kind] = _result(kind, "ERROR", str(e))
    return out


__all__ = ["LimitExceeded", "analyze_image", "analyze_media", "analyze_wav", "checked"]
