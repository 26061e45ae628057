"""Threshold ladders and clock-time classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values: (least value, label), largest first.
SCALES = {
    "correlation": ((0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak"), (0.0, "very_weak")),
    "trend": ((0.7, "strong"), (0.5, "moderate"), (0.3, "weak"), (0.0, "very_weak")),
    "effect": ((0.8, "large"), (0.5, "medium"), (0.2, "small"), (0.0, "negligible")),
    "severity": ((4.0, "critical"), (3.0, "high"), (2.5, "medium"), (2.0, "low"), (0.0, "normal")),
    "confidence": ((0.8, "high"), (0.6, "medium"), (0.0, "low")),
}


def label(value: Column, scale: str) -> Column:
    """The label of an absolute value on a scale; null for null."""
    out = None
    for least, name in SCALES[scale]:
        test = F.abs(value) >= least
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def label_sql(value: str, scale: str) -> str:
    """The same ladder as SQL."""
    return "CASE " + " ".join(f"WHEN abs({value}) >= {least} THEN '{name}'" for least, name in SCALES[scale]) + " END"


def hour_between(ts: Column, start: int, end: int) -> Column:
    """Whether the hour lies in start..end, both included; start above end wraps midnight."""
    h = F.hour(ts)
    return h.between(start, end) if start <= end else (h >= start) | (h <= end)


def phase(ts: Column) -> Column:
    """Six phases of the day."""
    h = F.hour(ts)
    return F.when(h < 5, "night").when(h < 8, "early_morning").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 21, "evening").otherwise("late_evening")


def meal(ts: Column) -> Column:
    """The meal that a time suggests."""
    h = F.hour(ts)
    return F.when(h.between(5, 10), "breakfast").when(h.between(11, 15), "lunch").when(h.between(16, 21), "dinner").otherwise("snack")
