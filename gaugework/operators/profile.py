"""Profiling: tables into facts.

All cheap facts of all columns of a table come from one aggregate over one scan. Only what needs a
grouping of its own (uniqueness, fan-out, orphans, partitions) runs as a further job, and tables run
side by side. A fact is never stronger than where it comes from: whole columns give exact or, by
sketches, measured facts; samples give estimated ones.
"""

from __future__ import annotations

import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import STRONG, WEAK, classify, format_aggregates, json_skeleton
from ..functions.types import category
from ..model import Column, Constraint, Fact, Reference, Shape, Table
from ..sources.tables import SAMPLE_SEED, Source, hash_sample, row_hash, sample_share
from .quantiles import exact_quantiles

# Fixed values of profiling: sampled text values, the share of distinct values that asks for a proof and
# the rows up to which it is sought, buckets and skew of histograms, sketch size and its relative error.
VALUE_ROWS, SUSPECT, CEILING = 500, 0.95, 50_000_000
BUCKETS, SKEW, SET_SIZE = 16, 4.0, 50
SKETCH, SKETCH_ERROR = 14, 0.008125
#: One in so many values, by its hash, is looked at for a duplicate where uniqueness isn't in question.
SPREAD = 64


@dataclass
class Report:
    shape: Shape
    warnings: list[str] = field(default_factory=list)


def six(value: float | None) -> float | None:
    return None if value is None else round(value + (1e-12 if value >= 0 else -1e-12), 6)


def c(name: str) -> Expression:
    return F.col(f"`{name}`")


def distinct_estimate(x: Expression) -> Expression:
    """Distinct values by 2 ** SKETCH registers that keep maxima, so that neither order nor partitions of the rows matter."""
    return F.approx_count_distinct(x, 1.1 / 2 ** (SKETCH / 2))


def cheap_aggregates(df: DataFrame, kinds: dict[str, str]) -> list[Expression]:
    """For one aggregate over a table: nulls, extremes, mean, lengths and a distinct sketch of every column."""
    out = [F.count(F.lit(1)).alias("rows")]
    for k, (name, kind) in enumerate(kinds.items()):
        x, p = c(name), f"c{k}_"
        out.append(F.count(x).alias(p + "full"))
        data_type = df.schema[name].dataType
        if kind == "numeric":
            number = x.cast("double")
            out += [F.min(number).alias(p + "min"), F.max(number).alias(p + "max"), F.avg(number).alias(p + "mean")]
        elif kind == "temporal":
            out += [F.date_format(f(x), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(p + n) if not isinstance(data_type, T.StringType) else f(x).alias(p + n) for n, f in (("min", F.min), ("max", F.max))]
        elif kind in ("text", "json"):
            size = F.char_length(x)
            out += [F.min(size).alias(p + "lmin"), F.max(size).alias(p + "lmax"), F.avg(size).alias(p + "lmean"), F.percentile_approx(size, 0.95, 10_000).alias(p + "lp95")]
        elif kind == "bytea":
            size = F.octet_length(x)
            out += [F.min(size).alias(p + "lmin"), F.max(size).alias(p + "lmax"), F.avg(size).alias(p + "lmean")]
        if isinstance(data_type, (T.StringType, T.IntegerType, T.LongType, T.BinaryType)):
            out.append(distinct_estimate(x).alias(p + "distinct"))
        elif not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            out.append(distinct_estimate(x.cast("string")).alias(p + "distinct"))
    return out


def value_counts(df: DataFrame, few: list[str], many: list[str], rows: int) -> DataFrame:
    """column, value, n of text columns: all values of columns that have few, VALUE_ROWS values of the others.

    The first are counted in one scan, with no more rows than there are values leaving each task. The
    others are sampled by a hash of their own value's row, in another scan.
    """
    out = None

    def unpivoted(d, names, *extra):
        cells = F.array(*(F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in names))
        return d.select(*extra, F.explode(cells).alias("v")).select(*extra, "v.column", "v.value").where("value is not null")

    if few:
        out = unpivoted(df, few).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if many:
        part = df.select(*(c(x).cast("string").alias(x) for x in many))
        part = hash_sample(part, min(1.0, 8 * VALUE_ROWS / max(1, rows)))
        each = unpivoted(part.withColumn("__order", row_hash(part)), many, "__order")
        place = F.row_number().over(Window.partitionBy("column").orderBy("__order", "value"))
        each = each.withColumn("place", place).where(F.col("place") <= VALUE_ROWS).select("column", "value", F.lit(1).cast("long").alias("n"))
        out = each if out is None else out.unionByName(each)
    return out


def is_unique(df: DataFrame, columns: list[str]) -> bool:
    """Whether no two rows agree in columns that are all non-null.

    Duplicates within a small hash-chosen part already disprove it; only without any is the whole table grouped.
    """
    full = df.select(*(c(x) for x in columns))
    for x in columns:
        full = full.where(c(x).isNotNull())
    spread = F.pmod(F.xxhash64(*(c(x) for x in columns)), F.lit(64))
    for part in (full.where(spread == 0), full):
        if not part.groupBy(*(c(x) for x in columns)).count().where("count > 1").limit(1).isEmpty():
            return False
    return True


def repeated(df: DataFrame, columns: list[str], spread: int = SPREAD) -> set[str]:
    """Columns in which a value of the part that a hash picks stands twice, which proves that they aren't unique.

    All columns are looked at in one scan, whole and in any order of the rows; in a column that isn't
    found here the other values may repeat all the same, but for a spread of one.
    """
    plain = [x for x in columns if not isinstance(df.schema[x].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    if not plain:
        return set()
    text = lambda x: F.hex(c(x)) if isinstance(df.schema[x].dataType, T.BinaryType) else c(x).cast("string")
    cells = F.array(*(F.struct(F.lit(k).alias("column"), F.when(F.pmod(F.xxhash64(text(x)), F.lit(spread)) == 0, text(x)).alias("value")) for k, x in enumerate(plain)))
    counts = df.select(F.explode(cells).alias("v")).select("v.*").where("value is not null").groupBy("column", "value").count().where("count > 1")
    return {plain[r["column"]] for r in counts.select("column").distinct().collect()}


def surely_repeated(full: int, kind: T.DataType, low, high) -> bool:
    """Whether whole numbers between these bounds are fewer than the values."""
    return isinstance(kind, T.IntegralType) and low is not None and full > int(high) - int(low) + 1


def fanout(child: DataFrame, key: str, share: float = 1.0) -> dict | None:
    """Children per parent that has any: mean, p50, p95 (continuous) and max. A sample keeps or leaves out whole parents, so it needs no scaling."""
    rows = child.where(c(key).isNotNull())
    rows = hash_sample(rows, share, F.xxhash64(F.lit(SAMPLE_SEED), c(key)))
    counts = rows.groupBy(c(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # Few different counts stand for many parents.
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("parents"))
    whole = F.sum("parents")
    r = sizes.agg((F.sum(F.col("n") * F.col("parents")) / whole).alias("mean"), F.percentile("n", F.array(F.lit(0.5), F.lit(0.95)), F.col("parents")).alias("q"), F.max("n").alias("max")).first()
    if r["max"] is None:
        return None
    return {"mean": six(r["mean"]), "p50": six(r["q"][0]), "p95": six(r["q"][1]), "max": int(r["max"]), "confidence": "measured" if share >= 1 else "estimated"}


def orphan_fraction(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> float:
    """Share of non-null keys without a parent; 0 without any. Keys are counted before the join, so a frequent key is one row in it."""
    keys = child.where(c(key).isNotNull()).groupBy(c(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(c(parent_key).alias("k")).where("k is not null").distinct().withColumn("found", F.lit(True))
    r = keys.join(known, "k", "left").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("found").isNull(), F.col("n")).otherwise(0)).alias("lost")).first()
    return six(r["lost"] / r["all"]) if r["all"] else 0.0


def partition_skew(df: DataFrame, columns: list[str]) -> dict:
    """Number of partitions and the largest one's share of the rows."""
    r = df.groupBy(*(c(x) for x in columns)).count().agg(F.count(F.lit(1)).alias("count"), F.max("count").alias("max"), F.sum("count").alias("all")).first()
    return {"count": int(r["count"]), "strategy": "list", "key": ",".join(columns), "skew": six(r["max"] / r["all"]) if r["all"] else 0.0}


def equi_depth(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Seventeen exact quantiles of each numeric column."""
    return exact_quantiles(df, columns, [k / BUCKETS for k in range(BUCKETS + 1)])


def is_skewed(bounds: list[float]) -> bool:
    """Whether there are four different bounds and the widest bucket is SKEW times the median one."""
    bounds = sorted(set(bounds))
    if len(bounds) < 4:
        return False
    widths = [b - a for a, b in zip(bounds, bounds[1:])]
    middle = statistics.median(widths)
    return middle > 0 and max(widths) / middle >= SKEW


def must_escalate(distinct: Fact | None, rows: int, proven: bool) -> bool:
    return not proven and distinct is not None and rows > 0 and distinct.confidence in ("estimated", "measured") and distinct.value / rows > SUSPECT


def profile_table(source: Source, exact: bool = True, ceiling: int = CEILING, sources: dict[str, Source] | None = None) -> tuple[Table, list[str], bool]:
    """(table, warnings, whether a column was escalated)."""
    df, warnings = source.df, []
    names = df.columns
    declared = {x: source.type_of(x) for x in names}
    kinds = {x: category(declared[x]) for x in names}
    rows = df.count()
    share = 1.0 if exact else sample_share(rows)
    whole = share >= 1
    read = df if whole else hash_sample(df, share)
    got = read.agg(*cheap_aggregates(read, kinds)).first()
    seen = got["rows"]
    table = Table(rows=Fact(rows, "exact", "footer"))
    texts = [x for x in names if kinds[x] in ("text", "json")]
    shares: dict[str, dict] = {}
    sets: dict[str, list[tuple[str, int]]] = {}
    if texts:
        few = [x for k, x in enumerate(names) if x in texts and (got[f"c{k}_distinct"] or 0) <= 2 * SET_SIZE]
        values = value_counts(read, few, [x for x in texts if x not in few], seen)
        shares = {r["column"]: r.asDict() for r in values.groupBy("column").agg(*format_aggregates(F.col("value"), "", F.col("n"))).collect()}
        if few:
            for r in sorted(values.where(F.col("column").isin(few)).collect(), key=lambda r: (r["column"], r["value"])):
                sets.setdefault(r["column"], []).append((r["value"], r["n"]))
            sets = {x: s for x, s in sets.items() if len(s) <= SET_SIZE}
    bounds = equi_depth(read, [x for x in names if kinds[x] == "numeric"])
    distincts = {x: min(int(got[f"c{k}_distinct"]), got[f"c{k}_full"]) for k, x in enumerate(names) if f"c{k}_distinct" in got.asDict()}
    # What a sample repeats the table repeats, so either can prove it.
    open_ = [x for x in names if x not in sets and distincts.get(x, 0) <= SUSPECT * rows]
    twice = {x for x, s in sets.items() if any(n > 1 for _, n in s)} | repeated(read, open_)
    twice |= {x for k, x in enumerate(names) if kinds[x] == "numeric" and surely_repeated(got[f"c{k}_full"], df.schema[x].dataType, got[f"c{k}_min"], got[f"c{k}_max"])}
    if whole:
        # Few columns are still open here; they are decided on all values.
        twice |= repeated(read, [x for x in open_ if x not in twice and x in distincts], 1)
    escalated = False
    for k, x in enumerate(names):
        p, kind = f"c{k}_", kinds[x]
        full = got[p + "full"]
        column = Column(type=declared[x], nullable=df.schema[x].nullable, redact=source.redact.get(x, []))
        if column.nullable:
            column.null_fraction = Fact(six((seen - full) / seen) if seen else 0.0, "exact" if whole else "estimated", None if not whole else "scan")
        if p + "distinct" in got.asDict():
            distinct = min(int(got[p + "distinct"]), full)
            if whole:
                column.distinct = Fact(distinct, "measured", "hll", SKETCH_ERROR)
            else:
                column.distinct = Fact(round(distinct * rows / seen) if seen and distinct / max(1, full) > 0.5 else distinct)
        if must_escalate(column.distinct, rows, False) and kind not in ("other",):
            if rows > ceiling and not exact:
                warnings.append(f"{source.name}.{x}: {rows} rows are over the ceiling of {ceiling}; uniqueness isn't measured")
            else:
                escalated |= not exact
                if not whole:
                    n = df.agg(distinct_estimate(c(x).cast("string")), F.count(c(x))).first()
                    column.distinct = Fact(min(int(n[0] or 0), n[1]), "measured", "hll", SKETCH_ERROR)
                column.unique = Fact(is_unique(df, [x]), "exact", "probe")
        elif x in twice:
            column.unique = Fact(False, "exact", "probe")
        strength = "exact" if whole else "estimated"
        if kind == "numeric" and got[p + "min"] is not None:
            integral = isinstance(df.schema[x].dataType, (T.IntegralType,))
            as_is = (lambda v: int(v)) if integral else (lambda v: v)
            column.range = {"min": as_is(got[p + "min"]), "max": as_is(got[p + "max"]), "mean": six(got[p + "mean"]), "confidence": strength}
            if x in bounds and is_skewed(bounds[x]):
                column.histogram = {"kind": "equi_depth", "bounds": sorted(set(bounds[x])), "confidence": strength}
        elif kind == "temporal" and got[p + "min"] is not None:
            column.range = {"min": got[p + "min"], "max": got[p + "max"], "confidence": strength}
        elif kind in ("text", "json", "bytea") and got[p + "lmin"] is not None:
            column.length = {"min": got[p + "lmin"], "max": got[p + "lmax"], "mean": six(got[p + "lmean"])}
            if kind != "bytea":
                column.length["p95"] = got[p + "lp95"]
        if kind == "text":
            r = shares.get(x)
            column.format = classify({n: r[n] for n in (*STRONG, *WEAK, "prose")}, column.distinct.value if column.distinct else None) if r else "opaque"
            if x in sets:
                total = sum(n for _, n in sets[x])
                column.values, column.frequencies = [v for v, _ in sets[x]], [six(n / total) for _, n in sets[x]]
        elif kind == "json":
            column.format, column.shape = "json", json_skeleton(read, x)
        elif kind in ("uuid", "bytea"):
            column.format = "uuid" if kind == "uuid" else "opaque"
        table.columns[x] = column
    if source.primary_key:
        table.constraints.append(Constraint("primary_key", f"{source.name}_pkey", list(source.primary_key)))
    table.constraints += [Constraint("unique", f"{source.name}_{'_'.join(u)}_key", list(u)) for u in source.unique]
    table.constraints += [Constraint("check", n, [], e) for n, e in source.checks]
    table.indexes = list(source.indexes)
    for column, parent, parent_key in source.references:
        reference = Reference(column, f"{parent}.{parent_key}", f"{source.name}_{column}_fkey")
        reference.fanout = fanout(df, column, share)
        if sources and parent in sources:
            reference.orphan_fraction = Fact(orphan_fraction(df, column, sources[parent].df, parent_key), "exact", "scan")
        table.references.append(reference)
    if source.partition_columns:
        table.partitions = partition_skew(df, source.partition_columns)
    return table, warnings, escalated


def pull(spark: SparkSession, sources: list[Source], engine: dict, exact: bool = True, ceiling: int = CEILING, timeout: float | None = None, workers: int = 4) -> Report:
    """Profile all tables, several at a time. A table whose jobs run out of time keeps its name and columns, with a warning and no facts."""
    known = {s.name: s for s in sources}
    report = Report(Shape(meta={"engine": engine, "mode": "exact" if exact else "fast"}))

    def one(source: Source):
        tag = f"profile-{source.name}"
        spark.addTag(tag)
        try:
            return profile_table(source, exact, ceiling, known)
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(workers) as pool:
        jobs = [(s, pool.submit(one, s)) for s in sorted(sources, key=lambda s: s.name)]
        for source, job in jobs:
            try:
                table, warnings, escalated = job.result(timeout)
            except TimeoutError:
                spark.interruptTag(f"profile-{source.name}")
                table, warnings, escalated = Table(rows=Fact(0, "absent")), [f"{source.name}: the profile ran out of time, its facts are left out"], False
                table.columns = {x: Column(source.type_of(x), source.df.schema[x].nullable) for x in source.df.columns}
            report.shape.tables[source.name] = table
            # Only what columns name, directly or through a domain.
            named = {c.type for c in table.columns.values()}
            named |= {t.base for n, t in source.types.items() if n in named and t.base}
            report.shape.types |= {n: t for n, t in source.types.items() if n in named}
            report.shape.extensions += [e for e in source.extensions if e not in report.shape.extensions]
            report.warnings += warnings
            if escalated and not exact:
                report.shape.meta["mode"] = "targeted"
    return report

