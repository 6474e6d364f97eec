"""A shape document as DDL, in an order in which it applies, and what can't be rebuilt from it."""

from __future__ import annotations

from ..functions.types import spark_type
from ..model import Column, Index, Shape, Table


def quoted(name: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _default(column: Column) -> str:
    return f" DEFAULT {column.default}" if column.default and column.default != "opaque" and not column.generated else ""


def _generated(column: Column) -> str:
    if column.identity:
        return f" GENERATED {'ALWAYS' if column.identity == 'always' else 'BY DEFAULT'} AS IDENTITY"
    if column.generated == "stored" and column.generated_expression and column.generated_expression != "opaque":
        return f" GENERATED ALWAYS AS ({column.generated_expression}) STORED"
    return ""


def sequences(shape: Shape) -> list[str]:
    """Sequences that defaults ask for."""
    import re

    found = {m[1] for t in shape.tables.values() for c in t.columns.values() for m in re.finditer(r"nextval\('([^']+)'", c.default or "")}
    return [f"CREATE SEQUENCE IF NOT EXISTS {s};" for s in sorted(found)]


def types(shape: Shape) -> list[str]:
    out = []
    for name in sorted(shape.types, key=lambda n: (shape.types[n].kind != "enum", n)):
        t = shape.types[name]
        if t.kind == "enum":
            out.append(f"CREATE TYPE {quoted(name)} AS ENUM ({', '.join(map(text, t.effective_labels()))});")
        else:
            check = f" CHECK ({t.check})" if t.check and t.check != "opaque" else ""
            out.append(f"CREATE DOMAIN {quoted(name)} AS {t.base}{' NOT NULL' * t.not_null}{check};")
    return out


def create_table(name: str, table: Table) -> str:
    key = (table.partitions or {}).get("key", "").split(",") if table.partitions else []
    lines = [f"  {quoted(c)} {col.type}{_generated(col) or _default(col)}{'' if col.nullable else ' NOT NULL'}" for c, col in table.columns.items()]
    for c in table.constraints:
        # A partitioned table takes only keys that hold its partition key.
        if c.kind in ("primary_key", "unique") and set(key) <= set(c.columns) | {""}:
            nulls = " NULLS NOT DISTINCT" if c.nulls_distinct is False else ""
            lines.append(f"  CONSTRAINT {quoted(c.name)} {'PRIMARY KEY' if c.kind == 'primary_key' else 'UNIQUE' + nulls} ({', '.join(map(quoted, c.columns))})")
    part = f" PARTITION BY {table.partitions['strategy'].upper()} ({', '.join(map(quoted, key))})" if key and key != [""] else ""
    return f"CREATE TABLE {quoted(name)} (\n" + ",\n".join(lines) + f"\n){part};"


def partitions(name: str, table: Table) -> list[str]:
    """Hash partitions by modulus; of range and list partitions, whose bounds are values, one default."""
    if not table.partitions:
        return []
    if table.partitions.get("strategy") == "hash":
        n = int(table.partitions.get("count") or 1)
        return [f"CREATE TABLE {quoted(f'{name}_p{k}')} PARTITION OF {quoted(name)} FOR VALUES WITH (MODULUS {n}, REMAINDER {k});" for k in range(n)]
    return [f"CREATE TABLE {quoted(name + '_default')} PARTITION OF {quoted(name)} DEFAULT;"]


def create_index(table: str, index: Index) -> str:
    include = f" INCLUDE ({', '.join(map(quoted, index.include))})" if index.include else ""
    where = f" WHERE {index.predicate}" if index.predicate else ""
    keys = ", ".join(k if "(" in k or " " in k else quoted(k) for k in index.keys)
    return f"CREATE {'UNIQUE ' * index.unique}INDEX {quoted(index.name)} ON {quoted(table)} USING {index.method} ({keys}){include}{where};"


def secondary_indexes(shape: Shape) -> list[str]:
    """Indexes that no constraint brings; those with a withheld predicate can't be rebuilt."""
    return [create_index(t, i) for t in sorted(shape.tables) for i in shape.tables[t].indexes if i.name not in {c.name for c in shape.tables[t].constraints} and i.predicate != "opaque"]


def deferred(shape: Shape) -> list[str]:
    """Checks and foreign keys, added after the rows; the entries of a composite key share a name and become one."""
    out = []
    for t in sorted(shape.tables):
        table = shape.tables[t]
        for c in table.constraints:
            if c.kind == "check" and c.expression and c.expression != "opaque":
                out.append(f"ALTER TABLE {quoted(t)} ADD CONSTRAINT {quoted(c.name)} CHECK ({c.expression}){'' if c.validated else ' NOT VALID'};")
        groups: dict[str, list] = {}
        for k, r in enumerate(table.references):
            groups.setdefault(r.name or f"{t.rsplit('.', 1)[-1]}_{r.column}_fkey{k or ''}", []).append(r)
        for name, refs in groups.items():
            parent = refs[0].to.rsplit(".", 1)[0]
            actions = "".join(f" ON {w} {a.replace('_', ' ').upper()}" for w, a in (("DELETE", refs[0].on_delete), ("UPDATE", refs[0].on_update)) if a and a != "no_action")
            out.append(f"ALTER TABLE {quoted(t)} ADD CONSTRAINT {quoted(name)} FOREIGN KEY ({', '.join(quoted(r.column) for r in refs)}) REFERENCES {quoted(parent)} ({', '.join(quoted(r.to.rsplit('.', 1)[-1]) for r in refs)}){actions}{'' if refs[0].validated else ' NOT VALID'};")
    return out


def identity_resets(shape: Shape) -> list[str]:
    return [f"SELECT setval(pg_get_serial_sequence({text(t)}, {text(c)}), coalesce(max({quoted(c)}), 1)) FROM {quoted(t)};" for t in sorted(shape.tables) for c, col in shape.tables[t].columns.items() if col.identity]


def ddl(shape: Shape) -> list[str]:
    """Schemas, extensions, sequences, types, tables and partitions, in this order."""
    schemas = sorted({t.rsplit(".", 1)[0] for t in [*shape.tables, *shape.types] if "." in t} - {"public"})
    extensions = [e if isinstance(e, dict) else {"name": e} for e in shape.extensions]
    out = [f"CREATE SCHEMA IF NOT EXISTS {quoted(s)};" for s in schemas]
    out += [f"CREATE EXTENSION IF NOT EXISTS {quoted(e['name'])}{' SCHEMA ' + quoted(e['schema']) if e.get('schema') else ''};" for e in extensions]
    out += sequences(shape) + types(shape)
    for t in sorted(shape.tables):
        out += [create_table(t, shape.tables[t]), *partitions(t, shape.tables[t])]
    return out


def spark_ddl(shape: Shape, name: str) -> str:
    """The columns of a table as Spark DDL."""
    return ", ".join(f"`{c}` {spark_type(shape.resolve_type(col.type))}{'' if col.nullable else ' NOT NULL'}" for c, col in shape.tables[name].columns.items())


def unreproducible(shape: Shape) -> list[str]:
    """What a rebuilt database lacks: withheld defaults and expressions, and partition bounds."""
    out = []
    for t in sorted(shape.tables):
        table = shape.tables[t]
        for c, col in table.columns.items():
            if col.default == "opaque":
                out.append(f"{t}.{c}: its default is withheld")
            if col.generated and (not col.generated_expression or col.generated_expression == "opaque" or col.generated != "stored"):
                out.append(f"{t}.{c}: its generating expression isn't known")
        out += [f"{t}.{i.name}: its predicate is withheld" for i in table.indexes if i.predicate == "opaque"]
        if table.partitions and table.partitions.get("strategy") != "hash":
            out.append(f"{t}: its {table.partitions.get('count')} {table.partitions.get('strategy')} partitions become one")
    return out
