"""Source tables: Parquet folders, catalog tables, JDBC relations or frames, with what is known of them without reading rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import declared_of
from ..model import Fact, Index, ShapeError, UserType

# Rows of a sample, the least share it may have in percent, and its seed.
SAMPLE_ROWS, SAMPLE_FLOOR, SAMPLE_SEED = 20_000, 0.01, 42


@dataclass
class Source:
    """A table to profile. Hints are what its owner says of it; nothing proves them, so they count as declared."""

    name: str
    df: DataFrame
    rows_hint: int | None = None
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    references: list[tuple[str, str, str]] = field(default_factory=list)  # column, parent table, parent column
    checks: list[tuple[str, str]] = field(default_factory=list)  # name, expression
    partition_columns: list[str] = field(default_factory=list)
    declared_types: dict[str, str] = field(default_factory=dict)
    redact: dict[str, list[str]] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)
    types: dict[str, UserType] = field(default_factory=dict)  # enums and domains that declared types may name
    extensions: list[str] = field(default_factory=list)

    def type_of(self, column: str) -> str:
        return self.declared_types.get(column) or declared_of(self.df.schema[column].dataType)


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns; maps and arrays stay and are profiled as other."""
    columns, queue = [], [(F.col(f"`{f.name}`"), f.name, f.dataType) for f in df.schema.fields]
    while queue:
        column, name, kind = queue.pop(0)
        if isinstance(kind, T.StructType):
            queue[:0] = [(column.getField(f.name), f"{name}.{f.name}", f.dataType) for f in kind.fields]
        else:
            columns.append(column.alias(name))
    return df.select(*columns) if any(isinstance(f.dataType, T.StructType) for f in df.schema.fields) else df


def parquet_source(spark: SparkSession, path: str, name: str | None = None, **hints) -> Source:
    name = name or path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    return Source(name, flattened(spark.read.parquet(path)), **hints)


def parquet_sources(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[Source]:
    """The tables of a folder of `name.parquet` files or folders, in order of their names."""
    if names is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        listing = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
        names = sorted(s.getPath().getName().removesuffix(".parquet") for s in listing if s.getPath().getName().endswith(".parquet"))
    return [parquet_source(spark, f"{folder}/{n}.parquet", n) for n in names]


def catalog_sources(spark: SparkSession, database: str | None = None) -> list[Source]:
    """The tables of a database of the session's catalog, without temporary views, in order of their names."""
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return [Source(t.name, flattened(spark.table(f"{database}.{t.name}" if database else t.name))) for t in sorted(tables, key=lambda t: t.name) if not t.isTemporary]


def jdbc_source(spark: SparkSession, url: str, table: str, **options) -> Source:
    """A relation of a database. Only reading is offered, so the source can't be changed through it."""
    return Source(table, flattened(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()))


def frame_source(df: DataFrame, name: str, **hints) -> Source:
    return Source(name, flattened(df), **hints)


def row_hash(df: DataFrame, seed: int = SAMPLE_SEED) -> Column:
    """A hash of a row's content, the same however the rows are laid out. Maps can't be hashed and are left out."""
    usable = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    if not usable:
        raise ShapeError("no column of the table can be hashed")
    return F.xxhash64(F.lit(seed), *usable)


def sample_share(rows: int) -> float:
    """The share of rows that a sample takes: all of a small table, else SAMPLE_ROWS of them, but never under the floor."""
    return 1.0 if rows <= SAMPLE_ROWS else max(SAMPLE_FLOOR / 100, SAMPLE_ROWS / rows)


def hash_sample(df: DataFrame, share: float, key: Column | None = None) -> DataFrame:
    """A sample that depends on the rows alone: on their content, or on a key whose rows then stay together."""
    if share >= 1:
        return df
    spread = 1 << 30
    return df.where(F.pmod(key if key is not None else row_hash(df), F.lit(spread)) < int(share * spread))


def footer_rows(spark: SparkSession, df: DataFrame) -> int:
    """The exact number of rows; on Parquet the count comes from the footers, no column is read."""
    return df.count()


def decode_distinct(n_distinct: float, rows: int) -> int | None:
    """A planner's figure: positive is a count, negative a share of the rows, zero unknown."""
    return None if n_distinct == 0 else round(n_distinct) if n_distinct > 0 else round(-n_distinct * rows)


def planner_stats(spark: SparkSession, table: str) -> tuple[Fact | None, dict[str, dict[str, Fact]]]:
    """(rows, {column: {null_fraction, distinct}}) as ANALYZE TABLE left them in the catalog, read without touching rows.

    They may be out of date, so they count as estimated; what was never analysed is left out.
    """
    found = next((r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r[0] == "Statistics"), "")
    rows = next((int(part.split()[0]) for part in found.split(",") if part.strip().endswith("rows")), None)
    out: dict[str, dict[str, Fact]] = {}
    for name in spark.table(table).columns:
        stats = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table} `{name}`").collect()}
        facts = {}
        if rows and (stats.get("num_nulls") or "NULL") != "NULL":
            facts["null_fraction"] = Fact(round(int(stats["num_nulls"]) / rows, 6))
        if (stats.get("distinct_count") or "NULL") != "NULL":
            facts["distinct"] = Fact(decode_distinct(float(stats["distinct_count"]), rows or 0))
        if facts:
            out[name] = facts
    return (Fact(rows) if rows is not None else None), out
