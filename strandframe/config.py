"""Settings of the three queries; what the query takes as a table isn't a setting."""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class ReadFilter:
    """Which reads count. Secondary and supplementary alignments are left out only if primary_only."""

    min_map_quality: int = 10
    required_flags: int = 0
    filter_flags: int = 0
    excl_flags: int = 0
    primary_only: bool = False


@dataclass(frozen=True)
class MismatchConfig:
    reads: ReadFilter = ReadFilter()
    min_base_quality: int = 20
    position_mode: str = "insert"
    overlap_mode: str = "cut"
    methylation: bool = False
    softclip_identity: float = 0.66
    region_size: int = 1_000_000
    bed_mode: str = "mask"
    length_sample: int = 10_000
    min_fragment_length: int = 0
    max_fragment_length: int = 1500

    def __post_init__(self) -> None:
        _one_of(self.position_mode, "position_mode", "read", "insert")
        _one_of(self.overlap_mode, "overlap_mode", "cut", "stretch")
        if (self.min_fragment_length, self.max_fragment_length) != (0, 1500):
            warnings.warn("fragment lengths are accepted but select nothing", stacklevel=2)


@dataclass(frozen=True)
class DiagnosticsConfig:
    reads: ReadFilter = ReadFilter(primary_only=True)
    min_base_quality: int = 20
    insert_mode: bool = False
    mode_length: int = 0
    methylation: bool = False
    min_count: int = 7
    min_depth: int = 10
    region_size: int = 10_000_000
    bed_mode: str = "mask"
    softclip_threshold: float = 0.66


@dataclass(frozen=True)
class RescaleConfig:
    max_quality: int = 40
    #: a soft clip at the start of a read doesn't move the offset at which qualities and bases are looked up
    clip_keeps_offset: bool = True


def _one_of(value: str, name: str, *allowed: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is {value!r}, not one of {', '.join(allowed)}")


def check_bed_mode(mode: str) -> str:
    """Only looked at if there is a BED table."""
    _one_of(mode, "bed_mode", "mask", "filter")
    return mode
