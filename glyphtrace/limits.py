"""Resource limits of a scan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ScanLimits:
    """Budgets of one scan; each must be above zero."""

    max_file_bytes: int = 100 << 20
    max_decompressed_bytes: int = 50 << 20
    max_image_pixels: int = 40_000_000
    max_archive_members: int = 500
    max_nesting_depth: int = 3
    max_scan_seconds: float = 30.0
    max_findings: int = 10_000

    def __post_init__(self):
        low = [f.name for f in fields(self) if getattr(self, f.name) <= 0]
        if low:
            raise ValueError(f"{', '.join(low)} must be greater than zero")

    @classmethod
    def of(cls, given: ScanLimits | Mapping | None) -> ScanLimits:
        """Limits from nothing, from limits, or from a mapping of some of them."""
        if given is None:
            return cls()
        if isinstance(given, cls):
            return given
        if not isinstance(given, Mapping):
            raise TypeError("limits are ScanLimits, a mapping, or None")
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown scan limits: {', '.join(unknown)}")
        return cls(**given)


class LimitExceeded(ValueError):
    """A budget of ScanLimits ran out."""
