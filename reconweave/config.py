"""All tunables of the engine as frozen dataclasses; load() overlays a YAML file.

The defaults are fixed values that results depend on: tolerances in rupees and per
cent, windows in days, baselines and penalties in points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Tolerance:
    absolute: float = 10.0
    percent: float = 1.0
    rounding: float = 2.0
    days: int = 5


@dataclass(frozen=True)
class Gst:
    tolerance: Tolerance = Tolerance()
    fuzzy: int = 85
    fuzzy_without_gstin: int = 80
    ambiguity_margin: float = 5.0
    exact: float = 98.0
    variant: float = 90.0
    amount_date: float = 80.0
    fuzzy_baseline: float = 65.0
    cross_period: float = 75.0
    ambiguity_penalty: float = -8.0
    invalid_gstin_penalty: float = -5.0
    cross_period_penalty: float = -12.0
    high: float = 92.0
    medium: float = 65.0
    rate_gap: float = 0.5
    share_gap: float = 0.02
    blank_gstin_matches: bool = True
    # Financial-year tokens that carry no identity in a document number.
    fy_patterns: tuple[str, ...] = (
        "(?<![0-9])[0-9]{2}-[0-9]{2}(?![0-9])",
        "(?<![0-9])[0-9]{4}-[0-9]{2}(?![0-9])",
        "(?<![0-9])[0-9]{2}/[0-9]{2}(?![0-9])",
        "(?<![0-9])[0-9]{4}/[0-9]{2}(?![0-9])",
        "(?<![0-9])FY[0-9]{2,4}(?![0-9])",
        "(?<![0-9])[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])",
    )


# Patterns that notes are read by.
NOTE_CITATIONS = (r"(?i)\bcredit\s*note\b", r"(?i)\bc\.?\s?n\.?\s*(?:no|number|#|:)")
NOTE_REFERENCE = r"(?i)(?:no\.?|number|#|:)?\s*[.:\-]?\s*((?=[\w./\-]*\d)[A-Za-z0-9][\w./\-]*)"
NOTE_TRAILING = r"[-./\s]+$"
NOTE_PERIODS = (r"(?<=\w)[-/\s]?[0-9]{2}-[0-9]{2}$", r"(?<=\w)[-/\s]?[0-9]{4}-[0-9]{2}$")
NOTE_SEPARATORS = r"[-/.\s]"
CREDIT_NUMBER, DEBIT_NUMBER = r"(?i)^CN\s*[-/]", r"(?i)^DN\s*[-/]"


@dataclass(frozen=True)
class Notes:
    exact: float = 98.0
    variant: float = 90.0
    value: float = 80.0
    cross_period_penalty: float = -12.0
    ambiguity_penalty: float = -8.0
    invalid_gstin_penalty: float = -5.0
    missing_gstin_penalty: float = -8.0
    days: int = 5
    guard_days: int = 180
    require_kind: bool = True


@dataclass(frozen=True)
class Tds:
    tolerance: Tolerance = Tolerance(days=7)
    fuzzy: int = 80
    challan: float = 92.0
    deductee: float = 78.0
    aggregated: float = 68.0
    fuzzy_baseline: float = 55.0
    cross_quarter_penalty: float = -10.0
    group_penalty: float = -2.0
    section_check: float = 80.0
    no_pan_rate: float = 20.0
    quarter_boundary: bool = True
    high: float = 85.0
    medium: float = 55.0


@dataclass(frozen=True)
class Other:
    tolerance: Tolerance = Tolerance(days=7)
    fuzzy: int = 80
    reference: float = 98.0
    containment: float = 90.0
    amount_date: float = 80.0
    fuzzy_baseline: float = 65.0
    blank_references_match: bool = False
    high: float = 85.0
    medium: float = 55.0


@dataclass(frozen=True)
class Guards:
    control_total: float = 1.0
    arithmetic: float = 1.0
    mirror: float = 0.01
    implied_rate: float = 1.0
    escalation: float = 0.20


@dataclass(frozen=True)
class Config:
    gst: Gst = Gst()
    notes: Notes = Notes()
    tds: Tds = Tds()
    other: Other = Other()
    guards: Guards = Guards()
    materiality: dict[str, float] = field(default_factory=lambda: {"GST": 10_000.0, "TDS": 5_000.0, "OTHER": 5_000.0})
    coverage_floor: float = 0.80


def overlay(base: Any, values: dict[str, Any], where: str = "config") -> Any:
    """base with the given values; a name it lacks or a bad pattern raises."""
    known = {f.name for f in fields(base)}
    for name, value in values.items():
        if name not in known:
            raise KeyError(f"{where}.{name} is not a setting")
        old = getattr(base, name)
        if is_dataclass(old):
            value = overlay(old, value, f"{where}.{name}")
        elif name.endswith("_patterns"):
            for p in value:
                re.compile(p)
            value = tuple(value)
        base = replace(base, **{name: value})
    return base


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return overlay(Config(), yaml.safe_load(f) or {})
