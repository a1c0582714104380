"""Scan parameters: what a caller asks for, compiled to one Column predicate."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The flag bits of the SAM format by their usual names.
FLAG_BITS = {
    "isPaired": 0x1, "isProperPair": 0x2, "isUnmappedQuery": 0x4, "hasUnmappedMate": 0x8, "isMinusStrand": 0x10, "isMateMinusStrand": 0x20,
    "isFirstMateRead": 0x40, "isSecondMateRead": 0x80, "isSecondaryAlignment": 0x100, "isNotPrimaryRead": 0x100, "isNotPassingQualityControls": 0x200,
    "isDuplicate": 0x400, "isDuplicateRead": 0x400, "isSupplementaryAlignment": 0x800,
}
FIELDS = ("qname", "flag", "rname", "strand", "pos", "qwidth", "mapq", "cigar", "mrnm", "mpos", "isize", "seq", "qual")
DEFAULT_FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar")
CHAIN = 200
"""Intervals up to which membership is a chain of conditions; beyond, a join."""


def flag_masks(spec: Mapping[str, bool | None]) -> tuple[int, int]:
    """(bits that must be set, bits that must not be) of names that are True, False or None for either."""
    if unknown := set(spec) - set(FLAG_BITS):
        raise ValueError(f"unknown flag names: {sorted(unknown)}")
    chosen = {True: 0, False: 0}
    for name, wanted in spec.items():
        if wanted is not None:
            chosen[bool(wanted)] |= FLAG_BITS[name]
    return chosen[True], chosen[False]


@dataclass(frozen=True)
class Interval:
    """A region in 1-based closed coordinates; label defaults to the coordinates as given."""

    seqname: str
    start: int
    end: int
    label: str | None = None


def intervals(given: DataFrame | Mapping[str, Iterable[tuple[int, int]]] | Iterable) -> list[Interval]:
    """Regions from a mapping of contigs to ranges, tuples (seqname, start, end[, label]), or a small table of such columns."""
    if isinstance(given, DataFrame):
        names = [c for c in ("seqname", "start", "end", "label") if c in given.columns]
        given = [tuple(r) for r in given.select(*names).collect()]
    elif isinstance(given, Mapping):
        given = [(name, s, e) for name, ranges in given.items() for s, e in ranges]
    rows = [(r.seqname, r.start, r.end, r.label) if isinstance(r, Interval) else tuple(r) for r in given]
    return [Interval(r[0], r[1], r[2], r[3] if len(r) > 3 and r[3] is not None else f"{r[0]}:{r[1]}-{r[2]}") for r in rows]


def usable(regions: Iterable[Interval]) -> list[Interval]:
    """Regions with start at least 1 and end at least start; rows that lack a part are left out."""
    return [Interval(r.seqname, max(1, r.start), max(1, r.start, r.end), r.label) for r in regions if None not in (r.seqname, r.start, r.end)]


@dataclass(frozen=True)
class ScanParam:
    """Filters and projection of a scan. A plain number given as `flag` is an error, as it could only be ignored."""

    flag: Mapping[str, bool | None] | None = None
    flag_set: int = 0
    flag_unset: int = 0
    min_mapq: float | None = None
    mapq_filter: float | None = None
    which: tuple[Interval, ...] = ()
    what: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    include_unmapped: bool = True
    _masks: tuple[int, int] = field(init=False, default=(0, 0))

    def __post_init__(self) -> None:
        if self.flag is not None and not isinstance(self.flag, Mapping):
            raise TypeError("flag must map flag names to True, False or None; use flag_set and flag_unset for bit masks")
        if unknown := [w for w in self.what if w not in FIELDS]:
            raise ValueError(f"unknown fields: {unknown}")
        object.__setattr__(self, "which", tuple(intervals(self.which)))
        object.__setattr__(self, "_masks", flag_masks(self.flag) if self.flag is not None else (self.flag_set, self.flag_unset))

    @property
    def masks(self) -> tuple[int, int]:
        return self._masks

    @property
    def mapq(self) -> int:
        t = self.min_mapq if self.min_mapq is not None else self.mapq_filter
        return 0 if t is None or math.isnan(t) or t < 0 else int(t)

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(self.what)) or list(DEFAULT_FIELDS)

    @property
    def tags(self) -> list[str]:
        return [t for t in dict.fromkeys(self.tag) if t]

    def flag_predicate(self, flag: str = "flag", mapq: str = "mapq") -> Column:
        """Bits and quality only, as histograms and coverage use them."""
        wanted, unwanted = self.masks
        p = F.lit(True)
        if wanted:
            p = p & (F.col(flag).bitwiseAND(wanted) == wanted)
        if unwanted:
            p = p & (F.col(flag).bitwiseAND(unwanted) == 0)
        return p & (F.col(mapq) >= self.mapq) if self.mapq else p


def is_unmapped(flag: str = "flag", ref_id: str = "ref_id") -> Column:
    return (F.col(ref_id) < 0) | (F.col(flag).bitwiseAND(4) != 0)
