"""Formats of text columns and the skeleton of JSON values."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# The patterns of the format classes, in the order in which they are tried.
STRONG = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?",
}
WEAK = {
    "hostname": r"^([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$",
    "numeric_string": r"^-?\d+(\.\d+)?$",
    "ipv6": r"^[0-9a-fA-F:]+:[0-9a-fA-F:]+$",
    "phone": r"^\+?[0-9][0-9\s().-]{6,}$",
    "slug": r"^[a-z0-9]+(?:-[a-z0-9]+)*$",
    "hex": r"^(0x)?[0-9a-fA-F]+$",
    "base64": r"^[A-Za-z0-9+/]+={0,2}$",
}
# The shares of values that must match, and the most distinct values of a set.
MAJORITY, PROSE, ENUM_LIKE = 0.95, 0.5, 32


def format_aggregates(value: Column, prefix: str, weight: Column | None = None) -> list[Column]:
    """Shares of non-empty values that match each class, for one aggregate over the column; null if there are none.

    With a weight, a row stands for so many values.
    """
    full = F.when(value != "", value)
    share = lambda test: F.avg(test.cast("int")) if weight is None else F.sum(test.cast("int") * weight) / F.sum(F.when(full.isNotNull(), weight))
    # A dollar sign would also match before a last line end here.
    whole = lambda p: p[:-1] + r"\z" if p.endswith("$") else p
    out = [share(full.rlike(whole(p))).alias(f"{prefix}{name}") for name, p in {**STRONG, **WEAK}.items()]
    return [*out, share(full.contains(" ") & full.rlike(r"\p{L}")).alias(f"{prefix}prose")]


def classify(shares: dict[str, float | None], distinct: int | None) -> str:
    """The format of a column from its shares: clear patterns, then small sets, then loose patterns, then prose."""
    if shares.get("prose") is None:
        return "opaque"
    reached = lambda names: next((n for n in names if (shares.get(n) or 0) >= MAJORITY), None)
    found = reached(STRONG)
    if found:
        return found
    if distinct is not None and 0 < distinct <= ENUM_LIKE:
        return "enum_like"
    return reached(WEAK) or ("free_text" if shares["prose"] >= PROSE else "opaque")


def skeleton(value: Any) -> Any:
    """The shape of one JSON value: leaves become type names, an array the merged shape of its elements."""
    if isinstance(value, dict):
        return {k: skeleton(v) for k, v in value.items()}
    if isinstance(value, list):
        out: Any = None
        for k, v in enumerate(value):
            out = skeleton(v) if k == 0 else merge(out, skeleton(v))
        return [out] if value else []
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def merge(a: Any, b: Any) -> Any:
    """Two shapes as one; the order doesn't matter. Leaves unite, keys unite, other conflicts are mixed."""
    if a == b:
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in sorted({*a, *b})}
    if isinstance(a, list) and isinstance(b, list):
        return [merge(a[0], b[0])] if a and b else a or b
    if isinstance(a, str) and isinstance(b, str):
        return "mixed" if "mixed" in (a, b) else "|".join(sorted({*a.split("|"), *b.split("|")}))
    return "mixed"


def json_skeleton(df: DataFrame, column: str) -> Any:
    """The merged shape of a column of JSON texts.

    Each partition merges its own rows, and a hash of the results a second time, so the driver merges
    a bounded number of shapes. Values that aren't JSON are left out.
    """

    ship(df.sparkSession)

    def merged(make):
        def run(batches):
            found, any_ = None, False
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    try:
                        s = make(json.loads(text))
                    except (TypeError, ValueError):
                        continue
                    found, any_ = (merge(found, s), True) if any_ else (s, True)
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found, sort_keys=True)])], ["shape"])

        return run

    parts = df.select(F.col(column).cast("string").alias("j")).where("j is not null").mapInArrow(merged(skeleton), "shape string").distinct()
    parts = parts.mapInArrow(merged(lambda s: s), "shape string").distinct().collect()
    out = None
    for k, r in enumerate(sorted(p[0] for p in parts)):
        s = json.loads(r)
        out = s if k == 0 else merge(out, s)
    return out
