"""The shape document: facts that carry how well they are known, its YAML form, identity and look-ups."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

# The confidence order, from a missing fact to an exact one.
RANKS = {"absent": -1, "declared": 0, "estimated": 1, "measured": 2, "exact": 3}
NAMES = {v: k for k, v in RANKS.items()}
#: Version of the document format that this engine writes, and the major version that it reads.
FORMAT_VERSION, MAJOR = "1.0", 1
#: Bytes that a document may have for each 200 tables.
SIZE_BUDGET = 320 * 1024


class ShapeError(ValueError):
    """A document or request that can't be used as it is."""


def weakest(*confidences: str) -> str:
    """The least of several confidences; without any there is nothing to doubt."""
    return NAMES[min((RANKS[c] for c in confidences), default=3)]


def at_least(confidence: str, floor: str) -> bool:
    return RANKS[confidence] >= RANKS[floor]


@dataclass
class Fact:
    value: Any
    confidence: str = "estimated"
    via: str | None = None
    error: float | None = None

    def dump(self) -> Any:
        """A bare value says estimated; anything more is written out."""
        if self.confidence == "estimated" and self.via is None and self.error is None:
            return self.value
        return {k: v for k, v in dataclasses.asdict(self).items() if v is not None}

    @staticmethod
    def load(raw: Any) -> Fact | None:
        if raw is None:
            return None
        if not isinstance(raw, dict):
            return Fact(raw)
        if raw.get("confidence", "estimated") not in RANKS:
            raise ShapeError(f"unknown confidence {raw['confidence']!r}")
        return Fact(raw.get("value"), raw.get("confidence", "estimated"), raw.get("via"), raw.get("error"))


#: The parts of the document whose members are facts.
FACTS = {"rows", "null_fraction", "distinct", "unique", "orphan_fraction"}


@dataclass
class Column:
    type: str
    nullable: bool = True
    null_fraction: Fact | None = None
    distinct: Fact | None = None
    unique: Fact | None = None
    generated: str | None = None
    generated_expression: str | None = None
    identity: str | None = None
    default: str | None = None
    format: str | None = None
    length: dict | None = None
    values: list | None = None
    frequencies: list | None = None
    range: dict | None = None
    histogram: dict | None = None
    shape: Any = None
    redact: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


@dataclass
class Constraint:
    kind: str
    name: str = ""
    columns: list = field(default_factory=list)
    expression: str | None = None
    validated: bool = True
    nulls_distinct: bool | None = None


@dataclass
class Index:
    name: str
    keys: list = field(default_factory=list)
    method: str = "btree"
    unique: bool = False
    include: list = field(default_factory=list)
    predicate: str | None = None
    bytes: int | None = None
    bloat_estimate: float | None = None


@dataclass
class Reference:
    column: str
    to: str
    name: str = ""
    on_delete: str = "no_action"
    on_update: str = "no_action"
    validated: bool = True
    fanout: dict | None = None
    orphan_fraction: Fact | None = None


@dataclass
class Table:
    rows: Fact = field(default_factory=lambda: Fact(0))
    bytes: int | None = None
    columns: dict[str, Column] = field(default_factory=dict)
    constraints: list[Constraint] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    partitions: dict | None = None
    extra: dict = field(default_factory=dict)


@dataclass
class UserType:
    kind: str
    labels: list = field(default_factory=list)
    label_count: int = 0
    base: str | None = None
    not_null: bool = False
    check: str | None = None

    def effective_labels(self) -> list[str]:
        """The labels, or as many placeholders where a privacy level withheld them."""
        return list(self.labels) or [f"label_{k + 1}" for k in range(self.label_count)]


@dataclass
class Shape:
    meta: dict = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    types: dict[str, UserType] = field(default_factory=dict)
    extensions: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def resolve(self, name: str) -> str | None:
        """The key of a table by exact name, or by its last part if just one table has it; a schema is never guessed."""
        name = name.replace('"', "")
        if name in self.tables:
            return name
        if "." in name:
            return None
        found = [t for t in self.tables if t.rsplit(".", 1)[-1] == name]
        return found[0] if len(found) == 1 else None

    def resolve_type(self, name: str) -> str:
        """A domain's base type, through at most 16 domains."""
        for _ in range(16):
            found = self.types.get(name)
            if found is None or found.kind != "domain" or not found.base:
                return name
            name = found.base
        return name

    def labels_of(self, type_name: str) -> list[str] | None:
        found = self.types.get(type_name)
        return found.effective_labels() if found is not None and found.kind == "enum" else None


def _plain(value: Any) -> Any:
    """Nested dicts and lists without empty members; unknown x_ keys come back to where they were."""
    if isinstance(value, Fact):
        return value.dump()
    if dataclasses.is_dataclass(value):
        out = {}
        for f in dataclasses.fields(value):
            v = getattr(value, f.name)
            if f.name == "extra":
                out |= v
            elif v is not None and v != [] and v != {} and not (f.name in ("bytes", "label_count") and not v):
                out[f.name] = _plain(v)
        return out
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _made(kind: type, raw: dict) -> Any:
    """A dataclass from a mapping; x_ keys are kept where the class has room for them, other unknown keys are ignored."""
    names = {f.name for f in dataclasses.fields(kind)}
    values = {k: Fact.load(v) if k in FACTS else v for k, v in raw.items() if k in names and k != "extra"}
    out = kind(**values)
    if "extra" in names:
        out.extra = {k: v for k, v in raw.items() if k.startswith("x_")}
    return out


def parse(text: str, verify: bool = True) -> Shape:
    """Read a document: an unknown major version is refused, and so is a digest that doesn't match; a missing digest is accepted."""
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ShapeError("a shape document is a mapping")
    version = str((raw.get("meta") or {}).get("version", FORMAT_VERSION))
    if version.split(".")[0] != str(MAJOR):
        raise ShapeError(f"format version {version} isn't supported")
    shape = Shape(meta=dict(raw.get("meta") or {}), extensions=list(raw.get("extensions") or []), extra={k: v for k, v in raw.items() if k.startswith("x_")})
    for name, t in (raw.get("tables") or {}).items():
        table = _made(Table, {k: v for k, v in t.items() if k not in ("columns", "constraints", "indexes", "references")})
        table.columns = {c: _made(Column, {"type": "text", **v}) for c, v in (t.get("columns") or {}).items()}
        table.constraints = [_made(Constraint, c) for c in t.get("constraints") or []]
        table.indexes = [_made(Index, c) for c in t.get("indexes") or []]
        table.references = [_made(Reference, c) for c in t.get("references") or []]
        shape.tables[name] = table
    shape.types = {n: _made(UserType, t) for n, t in (raw.get("types") or {}).items()}
    stored = shape.meta.get("digest")
    if verify and stored and stored != digest(shape):
        raise ShapeError("the document's digest doesn't match its content")
    return shape


def format_float(value: float) -> str:
    """Six significant digits."""
    return format(value, ".6g")


def _rounded(value: Any) -> Any:
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return float(format_float(value))
    if isinstance(value, dict):
        return {k: _rounded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_rounded(v) for v in value]
    return str(value)


def as_dict(shape: Shape) -> dict:
    return _plain(shape)


def canonical(shape: Shape) -> bytes:
    """The bytes a document is identified by: sorted keys, floats of six digits, no digest and no time of making."""
    raw = _rounded(as_dict(shape))
    raw["meta"] = {"version": FORMAT_VERSION} | {k: v for k, v in raw.get("meta", {}).items() if k not in ("digest", "generated_at")}
    return yaml.safe_dump(raw, sort_keys=True, indent=2, allow_unicode=True, width=10**6).encode()


def digest(shape: Shape) -> str:
    return "sha256:" + hashlib.sha256(canonical(shape)).hexdigest()


def emit(shape: Shape) -> str:
    """The YAML of a document, its digest filled in. Engine name and version are required: nothing can be extrapolated without them."""
    engine = shape.meta.get("engine") or {}
    if not engine.get("name") or not engine.get("version"):
        raise ShapeError("meta.engine needs a name and a version")
    shape.meta.setdefault("version", FORMAT_VERSION)
    shape.meta["digest"] = digest(shape)
    return yaml.safe_dump(as_dict(shape), sort_keys=True, default_flow_style=None, allow_unicode=True, width=160)


def over_budget(text: str, tables: int) -> bool:
    return len(text.encode()) > SIZE_BUDGET * max(1.0, tables / 200)


FACT_SCHEMA = "table string, column string, fact string, value_double double, value_string string, confidence string, rank int, via string, error double, path string"


def fact_rows(shape: Shape) -> list[tuple]:
    """The document flattened to one row for each fact; path is what findings depend on."""
    out = []

    def add(table, column, name, fact, path):
        v = fact.value
        number = float(v) if isinstance(v, (int, float)) else None
        out.append((table, column, name, number, None if v is None else str(v).lower() if isinstance(v, bool) else str(v), fact.confidence, RANKS[fact.confidence], fact.via, fact.error, path))

    for t, table in shape.tables.items():
        add(t, None, "rows", table.rows, f"{t}.rows")
        for c, column in table.columns.items():
            for name in ("null_fraction", "distinct", "unique"):
                if getattr(column, name) is not None:
                    add(t, c, name, getattr(column, name), f"{t}.{c}.{name}")
            if column.range is not None:
                confidence = column.range.get("confidence", "absent")
                for name in ("min", "max", "mean"):
                    if column.range.get(name) is not None:
                        add(t, c, f"range.{name}", Fact(column.range[name], confidence), f"{t}.{c}.range")
        for r in table.references:
            if r.orphan_fraction is not None:
                add(t, r.column, "orphan_fraction", r.orphan_fraction, f"{t}.{r.column}.orphan_fraction")
    return out


def facts_frame(spark: SparkSession, shape: Shape) -> DataFrame:
    return spark.createDataFrame(fact_rows(shape), FACT_SCHEMA)


def to_json(value: Any) -> str:
    return json.dumps(_plain(value), ensure_ascii=False, sort_keys=False, default=str)
