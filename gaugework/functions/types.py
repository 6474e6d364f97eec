"""What a declared type or a Spark type means for profiling, analysis and synthesis."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Base names by category.
_NUMERIC = frozenset("smallint integer int int2 int4 int8 bigint tinyint long short byte real float float4 float8 double numeric decimal money serial smallserial bigserial".split())
_TEXT = frozenset("text char character varchar bpchar citext name string nvarchar".split())
_UNSUPPORTED = frozenset("tsvector tsquery line lseg box path polygon circle".split())
_INTEGER_RANK = {"smallint": 1, "int2": 1, "short": 1, "integer": 2, "int": 2, "int4": 2, "bigint": 3, "int8": 3, "long": 3}


def base_type(declared: str) -> str:
    """The name without modifiers, in small letters; `double precision` and `character varying` stay whole."""
    return re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", "", declared)).strip().lower()


def type_length(declared: str) -> int | None:
    """The first modifier, if there is one."""
    found = re.search(r"\(\s*(\d+)", declared)
    return int(found[1]) if found else None


def char_max_length(declared: str) -> int | None:
    """How many characters a string type holds; an unadorned char holds one, text and a bare varchar any number."""
    base = base_type(declared)
    if base in ("char", "character", "bpchar"):
        return type_length(declared) or 1
    if base in ("varchar", "character varying"):
        return type_length(declared)
    return None


def category(declared: str) -> str:
    """numeric, temporal, text, bytea, json, uuid, bool or other."""
    base = base_type(declared)
    first = base.split(" ")[0]
    if base.endswith("[]") or base.startswith("array"):
        return "other"
    if first in _NUMERIC or first.startswith(("numeric", "decimal", "money")):
        return "numeric"
    if first.startswith(("timestamp", "time")) or first in ("date", "datetime"):
        return "temporal"
    if first in _TEXT or "char" in base or "varying" in base:
        return "text"
    return {"bytea": "bytea", "binary": "bytea", "json": "json", "jsonb": "json", "variant": "json", "uuid": "uuid", "boolean": "bool", "bool": "bool"}.get(first, "other")


def synthesis_category(declared: str) -> str:
    """As category, with the further kinds that can be rendered; `unsupported` for those that can't."""
    base = base_type(declared)
    if base.endswith("[]"):
        return "array"
    if base in _UNSUPPORTED or base.endswith("range"):
        return "unsupported"
    first = base.split(" ")[0]
    return {"inet": "inet", "cidr": "inet", "macaddr": "macaddr", "macaddr8": "macaddr8", "interval": "interval", "xml": "xml", "bit": "bit", "point": "point"}.get(first) or category(declared)


def is_integer(declared: str) -> bool:
    first = base_type(declared).split(" ")[0]
    return first in _INTEGER_RANK or first.endswith("serial")


def is_widening(old: str, new: str) -> bool:
    """A change within varchar and text that drops or raises the limit: no value can be lost and nothing is rewritten."""
    family = ("text", "varchar", "character varying", "string")
    if base_type(old) not in family or base_type(new) not in family:
        return False
    limit, before = type_length(new), type_length(old)
    return limit is None or (before is not None and limit >= before)


def is_narrowing(old: str, new: str) -> bool:
    """A change that may lose values: a smaller integer, a new or lower limit, or a fraction made an integer."""
    a, b = base_type(old).split(" ")[0], base_type(new).split(" ")[0]
    if a in _INTEGER_RANK and b in _INTEGER_RANK:
        return _INTEGER_RANK[b] < _INTEGER_RANK[a]
    if category(old) == category(new) == "text":
        limit, before = char_max_length(new), char_max_length(old)
        return limit is not None and (before is None or limit < before)
    return category(old) == "numeric" and a not in _INTEGER_RANK and b in _INTEGER_RANK


def declared_of(kind: T.DataType) -> str:
    """The name under which a Spark type stands in a document."""
    return {
        T.LongType: "bigint", T.IntegerType: "integer", T.ShortType: "smallint", T.ByteType: "smallint", T.DoubleType: "double precision", T.FloatType: "real",
        T.StringType: "text", T.BooleanType: "boolean", T.BinaryType: "bytea", T.DateType: "date", T.TimestampType: "timestamp with time zone", T.TimestampNTZType: "timestamp without time zone",
    }.get(type(kind)) or (f"numeric({kind.precision},{kind.scale})" if isinstance(kind, T.DecimalType) else kind.simpleString())


def spark_type(declared: str) -> str:
    """The Spark type that holds values of a declared type."""
    base, kind = base_type(declared), category(declared)
    if synthesis_category(declared) == "array":
        return f"array<{spark_type(declared.strip()[:-2])}>"
    if synthesis_category(declared) == "interval":
        return "interval day to second"
    if kind == "numeric":
        first = base.split(" ")[0]
        if first in ("smallint", "int2", "smallserial", "short", "tinyint", "byte"):
            return "smallint"
        if first in ("integer", "int", "int4", "serial"):
            return "int"
        if first in ("bigint", "int8", "bigserial", "long"):
            return "bigint"
        if first in ("real", "float4"):
            return "float"
        if first in ("numeric", "decimal", "money"):
            found = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+))?", declared)
            return f"decimal({found[1]},{found[2] or 0})" if found else "decimal(38,6)" if first != "money" else "decimal(19,2)"
        return "double"
    if kind == "temporal":
        return "date" if base == "date" else "string" if base.startswith("time") and not base.startswith("timestamp") else "timestamp_ntz" if "without" in base or base == "timestamp" else "timestamp"
    return {"bool": "boolean", "bytea": "binary"}.get(kind, "string")
