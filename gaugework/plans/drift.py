"""A document against live tables: drift of the structure, and what a change would meet in it."""

from __future__ import annotations

import re
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import base_type, type_length
from ..model import Column, Fact, Shape, Table
from ..sources.tables import Source
from .statements import Statement, changes

# Names of one type.
ALIASES = {
    "int": "integer", "int4": "integer", "int8": "bigint", "int2": "smallint", "bool": "boolean", "float8": "double precision", "double": "double precision", "float4": "real",
    "varchar": "character varying", "bpchar": "character", "char": "character", "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "string": "text", "decimal": "numeric",
}

SCHEMA = "table string, column string, type string, nullable boolean"


def normal_type(declared: str) -> str:
    base = base_type(declared)
    size = re.search(r"\(([^)]*)\)", declared)
    name = ALIASES.get(base, base)
    if name == "character" and type_length(declared) is None:
        return "character(1)"
    return name + (f"({re.sub(r'[ ]', '', size[1])})" if size else "")


def live_shape(sources: list[Source]) -> Shape:
    """The structure of live tables, without any rows read."""
    shape = Shape(meta={"mode": "structure"})
    for s in sources:
        shape.tables[s.name] = Table(Fact(0, "absent"), columns={c: Column(s.type_of(c), s.df.schema[c].nullable) for c in s.df.columns})
    return shape


def mark_exact(shape: Shape) -> Shape:
    """Facts taken from the very data that will be changed can't be wrong about them."""
    for table in shape.tables.values():
        table.rows.confidence = "exact"
        for c in table.columns.values():
            for fact in (c.null_fraction, c.distinct, c.unique):
                if fact is not None:
                    fact.confidence = "exact"
            for part in (c.range, c.histogram):
                if part:
                    part["confidence"] = "exact"
        for r in table.references:
            if r.orphan_fraction:
                r.orphan_fraction.confidence = "exact"
            if r.fanout:
                r.fanout["confidence"] = "exact"
    return shape


def structure_frame(spark: SparkSession, shape: Shape) -> DataFrame:
    return spark.createDataFrame([(t, c, normal_type(shape.resolve_type(col.type)), col.nullable) for t, table in shape.tables.items() for c, col in table.columns.items()], SCHEMA)


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """table, column, drift: tables that are gone, and of the others columns that are gone, new or of another type or nullability.

    Both frames have SCHEMA. Further live tables aren't drift.
    """
    e, a = expected.alias("e"), actual.alias("a")
    both = e.join(a, (F.col("e.table") == F.col("a.table")) & (F.col("e.column") == F.col("a.column")), "full_outer")
    both = both.select(F.coalesce("e.table", "a.table").alias("table"), F.coalesce("e.column", "a.column").alias("column"), F.col("e.type").alias("et"), F.col("a.type").alias("at"), F.col("e.nullable").alias("en"), F.col("a.nullable").alias("an"))
    tables = expected.select(F.col("table")).distinct().withColumn("wanted", F.lit(True)).join(actual.select("table").distinct().withColumn("there", F.lit(True)), "table", "left")
    drift = (
        F.when(F.col("there").isNull(), "missing table")
        .when(F.col("at").isNull(), "missing column")
        .when(F.col("et").isNull(), "unexpected column")
        .when(F.col("et") != F.col("at"), F.concat(F.lit("type "), "et", F.lit(" became "), "at"))
        .when(F.col("en") != F.col("an"), F.when(F.col("an"), "became nullable").otherwise("became not null"))
    )
    out = both.join(tables, "table").withColumn("drift", drift).where("drift is not null")
    return out.select("table", F.when(F.col("there").isNotNull(), F.col("column")).alias("column"), "drift").distinct()


def missing_constraints(expected: Shape, actual: Shape) -> list[str]:
    """Constraints of the document that the live tables lack, by kind and columns or expression."""
    mark = lambda c: (c.kind, tuple(c.columns), re.sub(r"[\s()]", "", c.expression or ""))
    return [f"{t}: {c.kind} {c.name}" for t, table in expected.tables.items() if t in actual.tables for c in table.constraints if mark(c) not in {mark(x) for x in actual.tables[t].constraints}]


def plan_items(statements: list[Statement], live: Shape) -> list[dict]:
    """For each action: ok, conflict (it is there already) or missing-target (what it changes isn't)."""
    out = []
    for s in statements:
        for change in changes(s.sql):
            if change.kind == "tx":
                continue
            table = live.resolve(change.table) if change.table else None
            columns = live.tables[table].columns if table else {}
            status, why = "ok", ""
            if change.kind == "create_table":
                status, why = ("conflict", f"{change.table} exists") if table else ("ok", "")
            elif change.table and table is None:
                status, why = "missing-target", f"{change.table} doesn't exist"
            elif change.kind == "add_column" and change.column in columns:
                status, why = "conflict", f"{change.column} exists"
            else:
                needed = [change.column] if change.kind in ("drop_column", "set_not_null", "set_type") else change.columns if not change.expressions else []
                gone = [x for x in needed if x and x not in columns]
                if gone and change.table:
                    status, why = "missing-target", f"{', '.join(gone)} of {change.table} doesn't exist"
            out.append({"sql": s.sql, "file": s.file, "line": s.line, "kind": change.kind, "table": table or change.table, "status": status, "detail": why})
    return out


def redact_url(url: str) -> str:
    """A URL without user and password."""
    parts = urlsplit(url)
    if "@" not in parts.netloc:
        return url
    return urlunsplit(parts._replace(netloc="redacted@" + parts.netloc.rsplit("@", 1)[1]))
