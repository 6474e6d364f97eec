"""What of a shape document may be published, and what of it comes from values."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from ..model import Column, Shape, ShapeError

# Levels, the fields that each withholds, the size and the frequency a published set needs.
LEVELS = ("strict", "standard", "permissive")
WITHHELD = {"strict": ("range", "histogram", "values", "frequencies"), "standard": ("values", "frequencies"), "permissive": ()}
SET_SIZE, K = 50, 20
_VALUE_FIELDS = ("range", "histogram", "values", "frequencies", "length", "shape")
#: Mixed into source hashes; fixed, so that digests stay the same.
SALT = "gaugework source"


def values_allowed(column: Column, rows: int, k: int = K) -> bool:
    """Whether a set of values is small and each of its values stands for k rows at least."""
    if not column.values or column.distinct is None or column.distinct.value > SET_SIZE or len(column.frequencies or []) != len(column.values):
        return False
    return all(f * rows >= k for f in column.frequencies)


def apply_privacy(shape: Shape, level: str = "standard", k: int = K) -> Shape:
    """Withhold in place what the level and each column's redact list forbid; the lists come first and always win."""
    if level not in LEVELS:
        raise ShapeError(f"privacy is one of {', '.join(LEVELS)}")
    for table in shape.tables.values():
        for column in table.columns.values():
            asked = set(column.redact)
            gone = set(_VALUE_FIELDS) if "all" in asked else asked & set(_VALUE_FIELDS) | ({"frequencies"} if "values" in asked else set())
            gone |= set(WITHHELD[level])
            if level == "permissive" and not values_allowed(column, table.rows.value or 0, k or K):
                gone |= {"values", "frequencies"}
            if "all" in asked:
                column.format = "opaque"
            for name in gone:
                setattr(column, name, None)
            if level == "strict":
                column.generated_expression = column.generated_expression and "opaque"
                column.default = column.default and "opaque"
        if level == "strict":
            for constraint in table.constraints:
                if constraint.kind == "check" and constraint.expression:
                    constraint.expression = "opaque"
    if level == "strict":
        for kind in shape.types.values():
            if kind.kind == "enum":
                kind.label_count, kind.labels = kind.label_count or len(kind.labels), []
            elif kind.check:
                kind.check = "opaque"
    shape.meta["privacy"] = level
    return shape


@dataclass(frozen=True, order=True)
class Leak:
    location: str
    field: str
    level: str
    detail: str


def leaks(shape: Shape) -> list[Leak]:
    """Everything in the document that comes from values of rows, by location and field."""
    out = []
    for t, table in shape.tables.items():
        for c, column in table.columns.items():
            at = f"{t}.{c}"
            if column.range and any(column.range.get(k) is not None for k in ("min", "max")):
                out.append(Leak(at, "range", "standard", "the extremes are values of the column"))
            if column.histogram and column.histogram.get("bounds"):
                out.append(Leak(at, "histogram", "standard", "the bounds are values of the column"))
            if column.values:
                out.append(Leak(at, "values", "permissive", "the values are published as they are"))
            if column.frequencies:
                out.append(Leak(at, "frequencies", "permissive", "how often each value occurs is published"))
            if column.format == "free_text" and column.length and column.length.get("max") is not None:
                out.append(Leak(at, "length.max", "strict", "the longest text may be known in a small table"))
        for constraint in table.constraints:
            if constraint.kind == "check" and constraint.expression and constraint.expression != "opaque":
                out.append(Leak(f"{t} (constraint {constraint.name})", "check_expression", "standard", "the expression may hold values of the business"))
    return sorted(out)


def normal_host(host: str) -> str:
    return host.strip().lower().rstrip(".").strip("[]")


def source_hash(host: str) -> str:
    return hashlib.sha256(f"{SALT}\0{normal_host(host)}".encode()).hexdigest()


def same_place(target: str, source: str) -> bool:
    """Whether a target names the source under one of its aliases; every loopback address is one host."""

    def alias(host: str) -> str:
        host = normal_host(host)
        return "localhost" if host in ("", "localhost", "::1", "0.0.0.0") or host.startswith("127.") else host

    return alias(target) == alias(source)


def refuse_source(target: str, source: str) -> None:
    """Nothing is ever written where the source is."""
    if target.rstrip("/") == source.rstrip("/") or target.startswith(source.rstrip("/") + "/"):
        raise ShapeError(f"{target} is the source, and is never written to")
