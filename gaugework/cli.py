"""Command line: python -m gaugework.cli COMMAND. Exit codes: 0 pass, 1 fail, 2 warnings only, 3 the tool failed."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import engine
from .model import ShapeError
from .operators.hydrate import generate, insert_rows
from .operators.privacy import refuse_source
from .plans import verdict
from .sources.tables import parquet_sources


def _spark() -> SparkSession:
    return SparkSession.builder.appName("gaugework").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugework", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="write a first configuration")
    c.add_argument("--out", default="gaugework.json")
    c = sub.add_parser("pull", help="profile a folder of Parquet tables")
    c.add_argument("source")
    c.add_argument("--out", default="shape.yaml")
    c.add_argument("--table", action="append")
    c.add_argument("--privacy", choices=("strict", "standard", "permissive"), default="standard")
    c.add_argument("--exact", action="store_true")
    c.add_argument("--max-escalation-rows", type=int, default=50_000_000)
    c.add_argument("--table-timeout", type=float, default=300.0)
    c.add_argument("--engine", default="postgresql")
    c.add_argument("--engine-version", default="16")
    c = sub.add_parser("hydrate", help="make tables of a shape")
    c.add_argument("shape")
    c.add_argument("--out", required=True)
    c.add_argument("--format", choices=("parquet", "sql"), default="parquet")
    for name, kind, default in (("--seed", int, 42), ("--scale", float, 1.0), ("--max-rows", int, None)):
        c.add_argument(name, type=kind, default=default)
    c.add_argument("--source", help="never written to")
    c = sub.add_parser("validate", help="the verdict on a change")
    c.add_argument("shape")
    c.add_argument("migrations")
    c.add_argument("--target", help="folder of the live Parquet tables")
    c.add_argument("--ephemeral", action="store_true")
    c.add_argument("--calibrate", action="store_true")
    c.add_argument("--json", action="store_true")
    c.add_argument("--warn-fail", action="store_true")
    c.add_argument("--statement-timeout", type=float, default=60.0)
    for name, kind, default in (("--seed", int, 42), ("--scale", float, 1.0), ("--max-rows", int, None)):
        c.add_argument(name, type=kind, default=default)
    c = sub.add_parser("explain", help="what a code means")
    c.add_argument("code")
    for name, text in (("plan", "what a change meets in live tables"), ("verify", "drift of live tables from a shape")):
        c = sub.add_parser(name, help=text)
        c.add_argument("shape" if name == "verify" else "migrations")
        c.add_argument("--against", required=True)
    c = sub.add_parser("inspect", help="size and leaks of a shape")
    c.add_argument("shape")
    c.add_argument("--fail-on-leak", action="store_true")
    c = sub.add_parser("annotate", help="CI annotations of a JSON verdict")
    c.add_argument("result")
    c.add_argument("--summary", action="store_true")
    return p


def run(args: argparse.Namespace) -> int:
    if args.command == "init":
        with open(args.out, "x", encoding="utf-8") as f:
            json.dump({"source": "data/", "shape": "shape.yaml", "migrations": "migrations/", "privacy": "standard"}, f, indent=2)
    elif args.command == "pull":
        spark = _spark()
        text, warnings = engine.pull(spark, parquet_sources(spark, args.source, args.table), {"name": args.engine, "version": args.engine_version}, args.privacy, args.exact, host=args.source, ceiling=args.max_escalation_rows, timeout=args.table_timeout)
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
        print("".join(f"warning: {w}\n" for w in warnings), end="", file=sys.stderr)
    elif args.command == "hydrate":
        spark, shape = _spark(), engine.load_shape(args.shape)
        options = {"seed": args.seed, "scale": args.scale, "most": args.max_rows}
        if args.format == "sql":
            if args.source:
                refuse_source(args.out, args.source)
            for name, df in generate(spark, shape, **options).items():
                insert_rows(df, name).write.text(f"{args.out}/{name}.sql")
        else:
            print(json.dumps(engine.load(spark, shape, args.out, args.source, **options)))
    elif args.command == "validate":
        shape, statements = engine.load_shape(args.shape), engine.read_migrations(args.migrations)
        spark = _spark() if args.target or args.ephemeral or args.calibrate else None
        tables = {s.name: s.df for s in parquet_sources(spark, args.target)} if args.target else None
        result = engine.validate(spark, shape, statements, tables, args.ephemeral or args.calibrate, 0.5 if args.calibrate else None, args.seed, args.scale, args.max_rows, args.statement_timeout)
        print(result.json() if args.json else verdict.human(result))
        return result.exit_code(args.warn_fail)
    elif args.command == "explain":
        print(json.dumps(engine.explain(args.code), indent=2))
    elif args.command == "plan":
        spark = _spark()
        items = engine.plan(engine.read_migrations(args.migrations), parquet_sources(spark, args.against))
        print(json.dumps(items, indent=2))
        return verdict.EXIT_FAIL if any(i["status"] != "ok" for i in items) else verdict.EXIT_PASS
    elif args.command == "verify":
        spark = _spark()
        found = engine.verify(spark, engine.load_shape(args.shape), parquet_sources(spark, args.against))
        print(json.dumps(found, indent=2))
        return verdict.EXIT_FAIL if found else verdict.EXIT_PASS
    elif args.command == "inspect":
        found = engine.inspect(engine.load_shape(args.shape))
        print(json.dumps(found, indent=2))
        return verdict.EXIT_FAIL if args.fail_on_leak and found["leaks"] else verdict.EXIT_PASS
    elif args.command == "annotate":
        with open(args.result, encoding="utf-8") as f:
            raw = json.load(f)
        findings = [verdict.Finding(x["code"], x["severity"], x["title"], location=x.get("location")) for x in raw["findings"]]
        result = verdict.Result(raw["verdict"], findings)
        print(verdict.summary(result) if args.summary else verdict.annotations(result), end="")
    return verdict.EXIT_PASS


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except verdict.ToolError as e:
        print(e.json(), file=sys.stderr)
    except ShapeError as e:
        print(verdict.ToolError("invalid_shape", str(e)).json(), file=sys.stderr)
    except OSError as e:
        print(verdict.ToolError("not_found", str(e)).json(), file=sys.stderr)
    return verdict.EXIT_TOOL


if __name__ == "__main__":
    sys.exit(main())
