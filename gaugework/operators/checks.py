"""Checks on data: what a change would run into, found by looking at the rows.

There is no lock manager to watch, so applying a change means running, for each of its actions, the
query that decides whether the rows allow it, with the error code a database would give. Durations
are those of these queries, and are what estimates for the declared engine start from.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import base_type, char_max_length, spark_type
from ..plans.rules import Applied, Capture
from ..plans.statements import Change, Statement, changes, spark_text
from .profile import c

# The codes for what stops a change.
CODES = {"null": "23502", "foreign": "23503", "unique": "23505", "check": "23514", "cut": "22001", "range": "22003", "table": "42P01", "column": "42703", "twice": "42701", "exists": "42P07", "cancelled": "57014"}
#: Seconds that a statement may take.
STATEMENT_SECONDS = 60.0


def has_nulls(df: DataFrame, column: str) -> bool:
    return not df.where(c(column).isNull()).limit(1).isEmpty()


def has_duplicates(df: DataFrame, columns: list[str], predicate: str | None = None) -> bool:
    """Whether two rows agree in all columns, none of them null, among the rows that the predicate selects."""
    return agreeing(df.where(F.expr(predicate)) if predicate else df, [c(x) for x in columns])


def agreeing(df: DataFrame, keys: list[Column]) -> bool:
    """Whether two rows agree in all keys, none of them null."""
    rows = df.select(*(k.alias(f"k{n}") for n, k in enumerate(keys))).dropna()
    return not rows.groupBy(*rows.columns).count().where("count > 1").limit(1).isEmpty()


def orphaned(child: DataFrame, columns: list[str], parent: DataFrame, to: list[str]) -> bool:
    """Whether a row whose key columns are all non-null has no parent. Each key meets the parents once, however many rows have it."""
    names = [f"k{n}" for n in range(len(columns))]
    keys = child.select(*(c(x).alias(n) for x, n in zip(columns, names))).dropna().distinct()
    known = parent.select(*(c(x).alias(n) for x, n in zip(to, names)))
    return not keys.join(known, names, "left_anti").limit(1).isEmpty()


def duplicate_count(df: DataFrame, columns: list[str]) -> int:
    """Rows beyond the first of each key."""
    rows = df.where(reduce(lambda a, b: a & b, (c(x).isNotNull() for x in columns)))
    r = rows.groupBy(*(c(x) for x in columns)).count().agg(F.sum(F.col("count") - 1)).first()
    return int(r[0] or 0)


def violations(df: DataFrame, expression: str) -> int:
    """Rows that a check refuses; one that gives null lets the row pass."""
    return int(df.agg(F.count_if(~F.coalesce(F.expr(expression), F.lit(True)))).first()[0])


def violates(df: DataFrame, expression: str) -> bool:
    return not df.where(~F.coalesce(F.expr(expression), F.lit(True))).limit(1).isEmpty()


def converted(df: DataFrame, column: str, new_type: str) -> Column:
    """A column's values in the new type, null where it can't hold them. Whole numbers are made by rounding, as engines do, not by cutting."""
    value, kind = c(column), spark_type(new_type)
    if kind in ("smallint", "int", "bigint") and isinstance(df.select(value).schema[0].dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
        value = F.round(value)
    return value.try_cast(kind)


def cast_loss(df: DataFrame, column: str, new_type: str) -> Column:
    """Whether the new type can't hold a column's value; a fraction that is rounded off isn't a loss."""
    limit, value = char_max_length(new_type), c(column)
    if limit is not None:
        return value.isNotNull() & (F.char_length(value.cast("string")) > limit)
    if base_type(new_type) == "text":
        return F.lit(False)
    return value.isNotNull() & converted(df, column, new_type).isNull()


def loses(df: DataFrame, column: str, new_type: str) -> bool:
    return not df.where(cast_loss(df, column, new_type)).limit(1).isEmpty()


def _resolve(tables: dict[str, DataFrame], name: str) -> str | None:
    if name in tables:
        return name
    found = [t for t in tables if t.rsplit(".", 1)[-1] == name.rsplit(".", 1)[-1] and ("." not in name or "." not in t)]
    return found[0] if len(found) == 1 else None


@dataclass
class Rows:
    """The tables as the statements so far have left them. Nothing is written: a change of rows is a new frame."""

    tables: dict[str, DataFrame]
    primary: dict[str, list[str]] = field(default_factory=dict)
    constraints: dict[str, tuple[Change, str]] = field(default_factory=dict)
    #: Tables whose rows differ from the first ones, and (table, column or "*") whose values aren't known.
    changed: set[str] = field(default_factory=set)
    unknown: set[tuple[str, str]] = field(default_factory=set)

    def hidden(self, name: str, columns: list[str]) -> bool:
        return any(t == name and (x == "*" or not columns or x in columns) for t, x in self.unknown)


class Undecided(Exception):
    """The rows can't tell whether the change applies."""


def _expression(df: DataFrame, text: str) -> Column:
    """An expression over a frame that Spark understands; Undecided otherwise, but for names that the frame lacks."""
    column = F.expr(spark_text(text))
    try:
        df.select(column)
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        raise Undecided(text) from e
    return column


def _key_broken(change: Change, name: str, rows: Rows) -> bool:
    df, predicate = rows.tables[name], change.predicate
    keys = change.keys if change.kind == "create_index" else []
    if change.partial and not predicate:
        raise Undecided(change.name)
    part = df.where(_expression(df, predicate)) if predicate else df
    return agreeing(part, [_expression(df, k) for k in keys] if keys and change.expressions else [c(x) for x in change.columns])


def _needs_rows(change: Change) -> list[str] | None:
    """The columns whose values decide the change; None if rows have no say."""
    if change.kind == "set_not_null":
        return [change.column]
    if change.kind in ("add_unique", "add_primary_key"):
        return change.columns
    if change.kind == "create_index" and change.unique:
        return [] if change.partial or change.expressions else change.columns
    if change.kind == "set_type":
        return [change.column]
    if change.kind == "add_foreign_key" and not change.not_valid:
        return change.columns
    return [] if change.kind in ("validate", "add_check") and not change.not_valid else None


def _refusal(change: Change, name: str, rows: Rows) -> tuple[str, str]:
    """(code, message) if rows or names refuse a change of an existing table; empty if they don't."""
    df = rows.tables[name]
    needed = [x for x in ([change.column] if change.kind in ("set_not_null", "set_type", "drop_column", "rename_column") else [x for x, _ in change.sets] if change.kind == "update" else change.columns) if x]
    lost = next((x for x in needed if x not in df.columns), None)
    if lost and not (change.kind == "create_index" and change.expressions):
        return ("", "") if change.kind == "drop_column" and change.guarded else (CODES["column"], f'column "{lost}" of relation "{name}" does not exist')
    decisive = _needs_rows(change)
    decided = rows.constraints[change.name.lower()][0] if change.kind == "validate" and change.name.lower() in rows.constraints else change
    if decisive is not None and rows.hidden(name, decided.columns if change.kind == "validate" else decisive):
        raise Undecided(f'the rows of "{name}" aren\'t known any more')
    if change.kind == "set_not_null" and has_nulls(df, change.column):
        return CODES["null"], f'column "{change.column}" of relation "{name}" contains null values'
    if change.kind == "add_primary_key" and any(has_nulls(df, x) for x in change.columns):
        return CODES["null"], f'a key column of relation "{name}" contains null values'
    if (change.kind in ("add_unique", "add_primary_key") or change.kind == "create_index" and change.unique) and (change.columns or change.keys) and _key_broken(change, name, rows):
        return CODES["unique"], f"key ({', '.join(change.keys or change.columns)}) is duplicated"
    if change.kind == "set_type" and loses(df, change.column, change.type):
        return CODES["cut" if char_max_length(change.type) is not None else "range"], f'a value of "{change.column}" does not fit {change.type}'
    if change.kind == "add_column":
        if change.column in df.columns:
            return ("", "") if change.guarded else (CODES["twice"], f'column "{change.column}" of relation "{name}" already exists')
        empty = change.default is None or change.default.strip().upper().split("::")[0] == "NULL"
        if change.not_null and empty and not change.opaque and not df.limit(1).isEmpty():
            return CODES["null"], f'column "{change.column}" of relation "{name}" contains null values'
    if change.kind == "validate" or not change.not_valid:
        if decided.kind == "add_check" and not df.where(~F.coalesce(_expression(df, decided.expression), F.lit(True))).limit(1).isEmpty():
            return CODES["check"], f'check constraint "{decided.name}" is violated by some row'
        if decided.kind == "add_foreign_key":
            parent = _resolve(rows.tables, decided.to)
            if parent is None:
                return CODES["table"], f'relation "{decided.to}" does not exist'
            to = decided.to_columns or rows.primary.get(parent, [])
            lost = next((x for x in to if x not in rows.tables[parent].columns), None)
            if lost:
                return CODES["column"], f'column "{lost}" referenced in foreign key constraint does not exist'
            if len(to) != len(decided.columns) or rows.hidden(parent, to):
                raise Undecided(f'the key of "{parent}" isn\'t known')
            if orphaned(df, decided.columns, rows.tables[parent], to):
                return CODES["foreign"], f'key ({", ".join(decided.columns)}) is not present in table "{parent}"'
    return "", ""


def _carry_out(spark: SparkSession, change: Change, name: str, rows: Rows) -> None:
    """The tables after a change that applies. A change whose rows can't be told leaves them unknown."""
    tables, df = rows.tables, rows.tables[name]
    if change.kind in ("update", "delete", "insert", "truncate"):
        rows.changed.add(name)
    if change.opaque and change.kind in ("update", "delete", "insert"):
        rows.unknown.add((name, "*"))
        raise Undecided(f"{change.kind} of {name}")
    try:
        if change.kind in ("update", "delete"):
            seen = df.alias(change.alias or name.rsplit(".", 1)[-1])
            hit = F.coalesce(_expression(seen, change.predicate), F.lit(False)) if change.predicate else F.lit(True)
            if change.kind == "delete":
                tables[name] = seen.where(~hit)
            else:
                made = {x: F.when(hit, _expression(seen, e).cast(df.schema[x].dataType)).otherwise(c(x)) for x, e in change.sets if e.strip().upper() != "DEFAULT"}
                if len(made) < len(change.sets):
                    raise Undecided("DEFAULT")
                tables[name] = seen.select(*(made.get(x, c(x)).alias(x) for x in df.columns))
        elif change.kind == "insert":
            columns = change.columns or df.columns[: len(change.rows[0])]
            one = spark.range(1)
            for values in change.rows:
                if len(values) != len(columns) or any(v.strip().upper() == "DEFAULT" for v in values):
                    raise Undecided("VALUES")
                given = dict(zip(columns, values))
                new = one.select(*((_expression(one, given[x]) if x in given else F.lit(None)).cast(df.schema[x].dataType).alias(x) for x in df.columns))
                tables[name] = tables[name].union(new)
    except Undecided:
        rows.unknown.add((name, "*") if change.kind != "update" else (name, change.sets[0][0]))
        if change.kind == "update":
            rows.unknown |= {(name, x) for x, _ in change.sets}
        raise
    if change.kind == "truncate":
        tables[name] = df.limit(0)
    elif change.kind == "drop_table":
        del tables[name]
    elif change.kind == "rename_table":
        new = change.to if "." not in name else name.rsplit(".", 1)[0] + "." + change.to
        tables[new] = tables.pop(name)
        rows.unknown = {(new if t == name else t, x) for t, x in rows.unknown}
        rows.changed = {new if t == name else t for t in rows.changed}
        rows.primary = {new if t == name else t: k for t, k in rows.primary.items()}
    elif change.kind == "drop_column":
        tables[name] = df.drop(c(change.column))
    elif change.kind == "rename_column":
        tables[name] = df.withColumnRenamed(change.column, change.to)
        rows.unknown = {(t, change.to if (t, x) == (name, change.column) else x) for t, x in rows.unknown}
        rows.primary = {t: [change.to if t == name and x == change.column else x for x in k] for t, k in rows.primary.items()}
        rows.changed.add(name)
    elif change.kind == "set_type":
        tables[name] = df.withColumn(change.column, converted(df, change.column, change.type))
    elif change.kind == "add_primary_key":
        rows.primary[name] = list(change.columns)
    elif change.kind == "add_column" and change.column not in df.columns:
        rows.changed.add(name)
        kind = spark_type(change.type)
        value = F.lit(None)
        if change.default is not None or change.opaque:
            try:
                value = _expression(spark.range(1), change.default or "")
            except (Undecided, PySparkException):
                # What the default is can't be told here, so nothing is decided by this column.
                rows.unknown.add((name, change.column))
        tables[name] = df.withColumn(change.column, value.cast(kind))


def _one(spark: SparkSession, change: Change, rows: Rows) -> tuple[str, str]:
    """(code, message) of what stops a change; empty if nothing does."""
    if change.kind in ("tx", "other", "reindex", "drop_index") or change.using_index:
        return "", ""
    if change.kind == "create_table":
        if change.table in rows.tables:
            return ("", "") if change.guarded else (CODES["exists"], f'relation "{change.table}" already exists')
        rows.tables[change.table] = spark.createDataFrame([], ", ".join(f"`{x}` {spark_type(t)}" for x, t in change.sets)) if change.sets else spark.range(0)
        rows.changed.add(change.table)
        if change.opaque:
            rows.unknown.add((change.table, "*"))
            raise Undecided(f"the rows of {change.table}")
        return "", ""
    known = rows.constraints.get(change.name.lower()) if change.kind == "validate" else None
    name = _resolve(rows.tables, known[1] if known else change.table)
    if name is None:
        return ("", "") if change.guarded and change.kind == "drop_table" else (CODES["table"], f'relation "{change.table}" does not exist')
    if change.kind in ("add_check", "add_foreign_key") and change.name:
        rows.constraints[change.name.lower()] = (change, name)
    code, message = _refusal(change, name, rows)
    if not code:
        _carry_out(spark, change, name, rows)
    return code, message


def apply(spark: SparkSession, statements: list[Statement], tables: dict[str, DataFrame], seconds: float = STATEMENT_SECONDS, primary: dict[str, list[str]] | None = None) -> Capture:
    """Check statements one after the other, up to the first that fails or runs out of time. The tables themselves aren't changed.

    Changes of rows are carried out as frames, so what comes later is decided on the rows that it
    would find. What neither rows nor names can decide, such as an update from a function that Spark
    lacks, is noted as undecided and never fails. primary: the key columns of tables that have any.
    """
    rows, out = Rows(dict(tables), dict(primary or {})), []
    capture = Capture(out)
    capture.table_rows = {}
    for k, s in enumerate(statements):
        at = Applied(s.sql, s.file, s.line, changes=changes(s.sql))
        out.append(at)
        tag, began = f"check-{id(capture)}-{k}", time.monotonic()
        spark.addTag(tag)
        timer = threading.Timer(seconds, lambda tag=tag: spark.interruptTag(tag))
        timer.start()
        try:
            for change in at.changes:
                try:
                    at.error_code, at.error = _one(spark, change, rows)
                except Undecided as e:
                    capture.undecided.append(f"{s.file}:{s.line}: not decided: {e}".lstrip(":"))
                    at.settled = True
                if at.error_code:
                    break
                at.settled |= change.partial or change.expressions or _resolve(rows.tables, change.table) in rows.changed
        except PySparkException as e:
            if time.monotonic() - began >= seconds:
                at.timed_out, at.error = True, "cancelled by the statement limit"
            else:
                at.error_code, at.error = CODES["column"], str(e).splitlines()[0]
        finally:
            timer.cancel()
            spark.removeTag(tag)
        at.duration_ms = int((time.monotonic() - began) * 1000)
        capture.duration_ms += at.duration_ms
        if at.error_code or at.timed_out:
            capture.success, capture.timed_out = not at.error_code, at.timed_out
            break
    for s in statements[len(out) :]:
        out.append(Applied(s.sql, s.file, s.line, changes=[]))
    return capture
