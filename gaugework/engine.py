"""The engine's commands as functions: pull, hydrate, validate, plan, verify, inspect and explain."""

from __future__ import annotations

import copy
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .model import Shape, ShapeError, emit, facts_frame, over_budget, parse
from .operators import checks, hydrate
from .operators.privacy import apply_privacy, leaks, refuse_source, source_hash
from .operators.profile import pull as profile_all
from .plans import drift, rules
from .plans.statements import Statement, is_transaction_control, split
from .plans.verdict import Result, ToolError, build
from .sources.tables import Source


def read_migrations(path: str) -> list[Statement]:
    """The statements of an .sql file, or of all .sql files of a folder in order of their names."""
    if os.path.isdir(path):
        files = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".sql")]
    elif os.path.isfile(path):
        files = [path]
    else:
        raise ToolError("not_found", f"{path} doesn't exist")
    out = []
    for f in files:
        with open(f, encoding="utf-8") as text:
            out += split(text.read(), f)
    return out


# The files by which migration tools are known, in order of their check.
RUNNERS = (("alembic", ("alembic.ini",)), ("prisma", ("schema.prisma", "prisma/schema.prisma")), ("drizzle", ("drizzle.config.ts", "drizzle.config.js", "drizzle.config.json")))
RAW_FOLDERS = ("migrations", "db/migrations", "sql")


def detect_runner(folder: str) -> str | None:
    """The migration tool of a project; only raw SQL can be read as it is."""
    for name, files in RUNNERS:
        if any(os.path.exists(os.path.join(folder, f)) for f in files):
            return name
    for sub in (*RAW_FOLDERS, "."):
        at = os.path.join(folder, sub)
        if os.path.isdir(at) and any(f.endswith(".sql") for f in os.listdir(at)):
            return "raw_sql"
    return None


def load_shape(path: str) -> Shape:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except FileNotFoundError as e:
        raise ToolError("not_found", f"{path} doesn't exist") from e
    except ShapeError as e:
        raise ToolError("invalid_shape", str(e)) from e


def pull(spark: SparkSession, sources: list[Source], engine: dict, privacy: str = "standard", exact: bool = False, host: str | None = None, **options) -> tuple[str, list[str]]:
    """(YAML of the profiled shape, warnings)."""
    report = profile_all(spark, sources, engine, exact=exact, **options)
    apply_privacy(report.shape, privacy)
    if host:
        report.shape.meta["source_hash"] = source_hash(host)
    text = emit(report.shape)
    if over_budget(text, len(report.shape.tables)):
        report.warnings.append("the document is larger than its budget")
    return text, report.warnings


def load(spark: SparkSession, shape: Shape, folder: str, source: str | None = None, **options) -> dict:
    """Generate all tables into a folder, then check keys and constraints on the rows: {rows, skipped}.

    A constraint that the rows break is reported and doesn't stop the others.
    """
    if source:
        refuse_source(folder, source)
    hydrate.write_parquet(hydrate.generate(spark, shape, **options), folder)
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in shape.tables}
    return {"rows": {t: df.count() for t, df in tables.items()}, "skipped": constraint_report(shape, tables)}


def constraint_report(shape: Shape, tables: dict[str, DataFrame]) -> list[str]:
    out = []

    def guarded(what, test):
        try:
            if test():
                out.append(f"{what}: rows break it")
        except Exception as e:  # noqa: BLE001  one constraint that can't be checked is reported like one that fails
            out.append(f"{what}: {str(e).splitlines()[0]}")

    for t in sorted(shape.tables):
        table, df = shape.tables[t], tables[t]
        for c in table.constraints:
            if c.kind in ("primary_key", "unique"):
                guarded(f"{t}: {c.kind} {c.name}", lambda df=df, c=c: checks.has_duplicates(df, c.columns))
            elif c.kind == "check" and c.expression not in (None, "", "opaque"):
                guarded(f"{t}: check {c.name}", lambda df=df, c=c: checks.violates(df, c.expression))
        for i in table.indexes:
            if i.unique and i.predicate != "opaque":
                guarded(f"{t}: index {i.name}", lambda df=df, i=i: checks.has_duplicates(df, i.keys, i.predicate))
        for r in table.references:
            parent, _, key = r.to.rpartition(".")
            parent = shape.resolve(parent)
            if r.validated and parent in tables:
                guarded(f"{t}: foreign key {r.name or r.column}", lambda df=df, r=r, parent=parent, key=key: checks.orphaned(df, [r.column], tables[parent], [key]))
    return out


def validate(spark: SparkSession | None, shape: Shape, statements: list[Statement], tables: dict[str, DataFrame] | None = None, ephemeral: bool = False, second_scale: float | None = None, seed: int = 42, scale: float = 1.0, most: int | None = None, seconds: float = checks.STATEMENT_SECONDS, names: bool = False) -> Result:
    """The verdict on a change.

    Without tables or ephemeral rows only the statements are read; with `names`, the document has all
    tables and a statement on another one is refused. With `ephemeral`, rows of the
    document's shape are generated and the change is checked on them; with a second scale the
    durations of two sizes are fitted. With tables, the rows themselves are the truth and nothing is capped.
    """
    if tables is not None:
        capture = checks.apply(spark, statements, tables, seconds, primary_keys(shape))
        result = build(shape, rules.analyse(shape, capture), capture, ground_truth=True).check()
        result.warnings += capture.undecided
        return result
    if not ephemeral:
        capture = rules.Capture.of(statements)
        if names:
            rules.name_errors(shape, capture)
        return build(shape, rules.analyse(shape, capture), capture).check()
    made = hydrate.generate(spark, shape, seed, scale, most)
    capture = checks.apply(spark, statements, made, seconds, primary_keys(shape))
    capture.undecided = []
    capture.table_rows = hydrate.plan_rows(shape, scale, most)
    if second_scale:
        again = checks.apply(spark, statements, hydrate.generate(spark, shape, seed, scale * second_scale, most), seconds, primary_keys(shape))
        capture.second, capture.second_rows = [s.duration_ms for s in again.statements], hydrate.plan_rows(shape, scale * second_scale, most)
    # Rows that were made up can show that a statement doesn't parse or name its tables, not that real rows break it.
    for s in capture.statements:
        if s.error_code and s.error_code not in (checks.CODES["table"], checks.CODES["column"]):
            s.error_code, s.error, capture.success = "", "", True
    if any(not s.changes and not is_transaction_control(s.sql) for s in capture.statements):
        for s in capture.statements:
            s.changes = s.changes or rules.changes(s.sql)
    return build(shape, rules.analyse(shape, capture), capture).check()


def primary_keys(shape: Shape) -> dict[str, list[str]]:
    return {t: list(c.columns) for t, table in shape.tables.items() for c in table.constraints if c.kind == "primary_key"}


def ground_truth(spark: SparkSession, sources: list[Source], engine: dict, statements: list[Statement]) -> Result:
    """The verdict on a change over live tables: they are profiled whole, and every fact is exact."""
    report = profile_all(spark, sources, engine, exact=True)
    shape = drift.mark_exact(report.shape)
    result = validate(spark, shape, statements, {s.name: s.df for s in sources})
    result.warnings = report.warnings + result.warnings
    return result


def verify(spark: SparkSession, shape: Shape, sources: list[Source]) -> list[dict]:
    live = drift.live_shape(sources)
    rows = drift.compare(drift.structure_frame(spark, shape), drift.structure_frame(spark, live)).orderBy("table", "column").collect()
    return [r.asDict() for r in rows]


def plan(statements: list[Statement], sources: list[Source]) -> list[dict]:
    return drift.plan_items(statements, drift.live_shape(sources))


def inspect(shape: Shape) -> dict:
    size = len(emit(copy.deepcopy(shape)).encode()) if shape.meta.get("engine") else 0
    return {"tables": len(shape.tables), "columns": sum(len(t.columns) for t in shape.tables.values()), "bytes": size, "leaks": [asdict(x) for x in leaks(shape)]}


def explain(code: str) -> dict:
    found = rules.explain(code)
    if found is None:
        raise ToolError("usage", f"{code} isn't a code; known are {', '.join(sorted(rules.CATALOG))}")
    return found


# The four tools for agents: small answers from a document alone.


def describe_shape(shape: Shape, table: str | None = None) -> dict:
    if table is None:
        return {t: {"rows": x.rows.dump(), "columns": len(x.columns)} for t, x in shape.tables.items()}
    name = shape.resolve(table)
    if name is None:
        raise ToolError("not_found", f"{table} isn't in the document")
    return {c: {"type": col.type, "nullable": col.nullable, "format": col.format, "null_fraction": col.null_fraction and col.null_fraction.dump(), "unique": col.unique and col.unique.dump()} for c, col in shape.tables[name].columns.items()}


def validate_migration(shape: Shape, sql: str) -> dict:
    return validate(None, shape, split(sql)).dump()


def explain_finding(code: str) -> dict:
    return explain(code)


def plan_against(sql: str, shape: Shape) -> list[dict]:
    return drift.plan_items(split(sql), shape)


def facts(spark: SparkSession, shape: Shape) -> DataFrame:
    return facts_frame(spark, shape)
