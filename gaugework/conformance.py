"""What documents, generated rows and verdicts must keep to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.types import base_type, category
from .model import RANKS, Shape, digest, emit, parse
from .plans.verdict import BUCKETS, Result, ceiling

# How far a null fraction may be off, and types that come with an extension.
NULL_TOLERANCE = 0.005
EXTENSION_TYPES = {"citext": "citext", "hstore": "hstore", "ltree": "ltree", "geometry": "postgis", "geography": "postgis", "vector": "vector"}


def check_emitter(shape: Shape) -> list[str]:
    """The rules that a document breaks."""
    out = []
    if not str(shape.meta.get("version", "1")).startswith("1"):
        out.append("version: unknown major")
    extensions = {e["name"] if isinstance(e, dict) else e for e in shape.extensions}
    for t, table in shape.tables.items():
        for c, column in table.columns.items():
            at = f"{t}.{c}"
            if category(column.type) == "text" and column.range:
                out.append(f"{at}: text has no range")
            if column.unique is not None and column.unique.confidence != "exact":
                out.append(f"{at}: uniqueness is exact or absent")
            for name in ("null_fraction", "distinct", "unique"):
                fact = getattr(column, name)
                if fact is not None and fact.confidence not in RANKS:
                    out.append(f"{at}.{name}: unknown confidence")
            need = EXTENSION_TYPES.get(base_type(column.type))
            if need and need not in extensions:
                out.append(f"{at}: the extension {need} isn't declared")
        for index in table.indexes:
            if not index.keys:
                out.append(f"{t}.{index.name}: an index has keys")
            if set(index.include) & set(index.keys):
                out.append(f"{t}.{index.name}: an included column is a key")
    for name, kind in shape.types.items():
        if kind.kind == "enum" and not kind.effective_labels():
            out.append(f"{name}: an enum has labels or their number")
        if kind.kind == "domain" and not kind.base:
            out.append(f"{name}: a domain has a base type")
        if kind.kind not in ("enum", "domain"):
            out.append(f"{name}: unknown kind of type")
    if shape.meta.get("engine") and digest(parse(emit(shape))) != digest(shape):
        out.append("digest: it changes on the way through YAML")
    return out


def check_hydrator(shape: Shape, name: str, one: DataFrame, two: DataFrame) -> list[str]:
    """The rules that generated rows break; one and two were made with the same seed."""
    out, table = [], shape.tables[name]
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    if mark(one) != mark(two):
        out.append(f"{name}: the same seed gave other rows")
    columns = list(table.columns)
    got = one.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(columns))).first()
    for k, c in enumerate(columns):
        fact = table.columns[c].null_fraction
        if fact is not None and got["rows"] and abs(got[f"n{k}"] / got["rows"] - fact.value) > NULL_TOLERANCE + 1 / got["rows"]:
            out.append(f"{name}.{c}: its nulls are {got[f'n{k}'] / got['rows']:.4f}, not {fact.value}")
        if table.columns[c].unique is not None and table.columns[c].unique.value and not one.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`")).count().where("count > 1").isEmpty():
            out.append(f"{name}.{c}: it has duplicates")
    return out


def check_validator(result: Result) -> list[str]:
    """The rules that a result breaks: nothing certified on weak facts, and only known buckets."""
    out = []
    for f in result.findings:
        if result.verdict == "PASS" and ceiling(f.confidence or "exact") != "PASS":
            out.append(f"{f.code}: a pass rests on {f.confidence} facts")
        if f.estimate and f.estimate.bucket not in {b for b, _ in BUCKETS}:
            out.append(f"{f.code}: unknown bucket {f.estimate.bucket}")
    return out
