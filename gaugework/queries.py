"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import CASES, STATEMENTS, case_rows
from .functions.formats import STRONG, WEAK, format_aggregates, json_skeleton
from .model import RANKS, Column, Constraint, Fact, Reference, Shape, Table, UserType, fact_rows
from .operators import checks, hydrate, privacy, profile
from .plans import drift, verdict
from .plans.statements import split
from .sources.tables import frame_source, hash_sample, parquet_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
CHILDREN = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"),
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def unpivot(row: DataFrame, parts: dict[str, dict[str, str]], name: str = "column_name") -> DataFrame:
    """One row of aggregates as a row for each key of parts; parts: key -> {output: aggregate}."""
    structs = [F.struct(F.lit(k).alias(name), *(F.col(v).alias(o) for o, v in p.items())) for k, p in parts.items()]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def values(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# Aggregates over one scan


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in TABLES))
def rows_exact(spark, sf_dir):
    return union([read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in TABLES])


@query("SELECT 'quality' AS column_name, round(count(*) FILTER (WHERE quality IS NULL) / count(*)::DOUBLE, 6) AS null_fraction FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', round(count(*) FILTER (WHERE toxic IS NULL) / count(*)::DOUBLE, 6) FROM documents LEFT JOIN labels USING (doc_id)")
def null_fraction(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    share = lambda c: F.round(F.count_if(F.col(c).isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6)
    return unpivot(both.agg(share("quality").alias("quality"), share("toxic").alias("toxic")), {c: {"null_fraction": c} for c in ("quality", "toxic")})


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 6) AS mean_value FROM lineitem" for c in NUMERIC))
def range_numeric(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*NUMERIC)
    row = df.agg(*profile.cheap_aggregates(df, {c: "numeric" for c in NUMERIC}))
    row = row.select(*(F.round(F.col(f"c{k}_mean"), 6).alias(f"m{k}") for k in range(len(NUMERIC))), *(F.col(f"c{k}_{x}") for k in range(len(NUMERIC)) for x in ("min", "max")))
    return unpivot(row, {c: {"min_value": f"c{k}_min", "max_value": f"c{k}_max", "mean_value": f"m{k}"} for k, c in enumerate(NUMERIC)})


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, strftime(min({c}), '%Y-%m-%dT%H:%M:%SZ') AS min_value, strftime(max({c}), '%Y-%m-%dT%H:%M:%SZ') AS max_value FROM {t}" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))))
def range_temporal(spark, sf_dir):
    out = []
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        df = read(spark, sf_dir, t).select(c)
        out.append(df.agg(*profile.cheap_aggregates(df, {c: "temporal"})).select(F.lit(f"{t}.{c}").alias("column_name"), F.col("c0_min").alias("min_value"), F.col("c0_max").alias("max_value")))
    return union(out)


TEXTS = (("documents", "text"), ("customer", "c_name"), ("part", "p_name"), ("pages", "url"), ("benchmark", "text"))


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, min(length({c}))::BIGINT AS min_length, max(length({c}))::BIGINT AS max_length, round(avg(length({c})), 6) AS mean_length FROM {t}" for t, c in TEXTS))
def length_text(spark, sf_dir):
    size = lambda c: F.char_length(F.col(c)).cast("long")
    return union([read(spark, sf_dir, t).agg(F.min(size(c)).alias("min_length"), F.max(size(c)).alias("max_length"), F.round(F.avg(size(c)), 6).alias("mean_length")).withColumn("column_name", F.lit(f"{t}.{c}")) for t, c in TEXTS])


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, quantile_disc(length({c}), 0.95)::BIGINT AS p95_length FROM {t}" for t, c in TEXTS))
def length_p95(spark, sf_dir):
    return union([read(spark, sf_dir, t).select(F.char_length(F.col(c)).alias("n")).agg(F.expr("cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY n) AS bigint)").alias("p95_length")).withColumn("column_name", F.lit(f"{t}.{c}")) for t, c in TEXTS])


@query("SELECT min(octet_length(encode(text)))::BIGINT AS min_octets, max(octet_length(encode(text)))::BIGINT AS max_octets, round(avg(octet_length(encode(text))), 6) AS mean_octets FROM documents")
def length_octets(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return read(spark, sf_dir, "documents").agg(F.min(size).alias("min_octets"), F.max(size).alias("max_octets"), F.round(F.avg(size), 6).alias("mean_octets"))


DISTINCT = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS distinct_values FROM lineitem" for c in DISTINCT))
def distinct_exact(spark, sf_dir):
    # One grouping for each column, so that the rows aren't expanded once per column.
    df = read(spark, sf_dir, "lineitem")
    return union([df.select(F.col(c).alias("x")).where("x is not null").distinct().agg(F.count(F.lit(1)).alias("distinct_values")).withColumn("column_name", F.lit(c)) for c in DISTINCT])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in DISTINCT) + ") t(column_name, within_error)")
def distinct_hll(spark, sf_dir):
    """Whether the sketch is within five standard errors of the exact count."""
    df = read(spark, sf_dir, "lineitem")
    row = df.agg(*(profile.distinct_estimate(F.col(c)).alias(c) for c in DISTINCT))
    sketch = unpivot(row, {c: {"estimate": c} for c in DISTINCT})
    exact = distinct_exact(spark, sf_dir)
    return sketch.join(exact, "column_name").select("column_name", (F.abs(F.col("estimate") - F.col("distinct_values")) <= 1 + 5 * profile.SKETCH_ERROR * F.col("distinct_values")).alias("within_error"))


@query("SELECT column_name, coalesce(duplicates, 0) = 0 AS is_unique, coalesce(duplicates, 0)::BIGINT AS surplus FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS column_name, (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) g) AS duplicates" for n, t, c in (("documents.text", "documents", "text"), ("customer.c_name", "customer", "c_name"), ("orders.o_orderkey", "orders", "o_orderkey"), ("part.p_name", "part", "p_name"))) + ") x")
def unique_probe(spark, sf_dir):
    out = []
    for n, t, c in (("documents.text", "documents", "text"), ("customer.c_name", "customer", "c_name"), ("orders.o_orderkey", "orders", "o_orderkey"), ("part.p_name", "part", "p_name")):
        surplus = read(spark, sf_dir, t).where(F.col(c).isNotNull()).groupBy(c).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))
        out.append(surplus.select(F.lit(n).alias("column_name"), (F.col("surplus") == 0).alias("is_unique"), "surplus"))
    return union(out)


@query("SELECT 'lineitem(l_orderkey,l_linenumber)' AS key_name, (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)::BIGINT AS surplus UNION ALL SELECT 'conversations(conv_id,turn)', (SELECT count(*) - count(DISTINCT (conv_id, turn)) FROM conversations)::BIGINT")
def unique_composite(spark, sf_dir):
    out = []
    for n, t, cs in (("lineitem(l_orderkey,l_linenumber)", "lineitem", ["l_orderkey", "l_linenumber"]), ("conversations(conv_id,turn)", "conversations", ["conv_id", "turn"])):
        g = read(spark, sf_dir, t).groupBy(*cs).count()
        out.append(g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus")).withColumn("key_name", F.lit(n)))
    return union(out)


@query("SELECT EXISTS (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) AS documents_text, EXISTS (SELECT c_name FROM customer GROUP BY c_name HAVING count(*) > 1) AS customer_name")
def unique_existence(spark, sf_dir):
    found = [not profile.is_unique(read(spark, sf_dir, t), [c]) for t, c in (("documents", "text"), ("customer", "c_name"))]
    return spark.createDataFrame([tuple(found)], "documents_text boolean, customer_name boolean")


# References


def _fanout_sql(t: str, k: str) -> str:
    return f"SELECT '{t}.{k}' AS reference, round(avg(n), 6) AS mean_children, round(quantile_cont(n, 0.5), 6) AS p50_children, round(quantile_cont(n, 0.95), 6) AS p95_children, max(n)::BIGINT AS max_children FROM (SELECT count(*) AS n FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}) c"


def _fanout(spark, sf_dir, *children):
    found = [(f"{t}.{k}", profile.fanout(read(spark, sf_dir, t), k)) for t, k in children]
    return spark.createDataFrame([(n, f["mean"], f["p50"], f["p95"], f["max"]) for n, f in found], "reference string, mean_children double, p50_children double, p95_children double, max_children long")


@query(_fanout_sql("orders", "o_custkey"))
def fanout_orders_by_customer(spark, sf_dir):
    return _fanout(spark, sf_dir, ("orders", "o_custkey"))


@query(_fanout_sql("lineitem", "l_orderkey"))
def fanout_lineitem_by_order(spark, sf_dir):
    return _fanout(spark, sf_dir, ("lineitem", "l_orderkey"))


@query(" UNION ALL ".join(_fanout_sql(t, k) for t, k, _, _ in CHILDREN))
def fanout_all_children(spark, sf_dir):
    return _fanout(spark, sf_dir, *((t, k) for t, k, _, _ in CHILDREN))


@query(" UNION ALL ".join(f"SELECT '{t}.{k}' AS reference, round(coalesce(count(*) FILTER (WHERE p.{pk} IS NULL) / nullif(count(*), 0)::DOUBLE, 0), 6) AS orphan_fraction FROM {t} c LEFT JOIN (SELECT DISTINCT {pk} FROM {p}) p ON c.{k} = p.{pk} WHERE c.{k} IS NOT NULL" for t, k, p, pk in (*CHILDREN, ("documents", "doc_id", "labels", "doc_id"))))
def orphan_fraction_all(spark, sf_dir):
    references = (*CHILDREN, ("documents", "doc_id", "labels", "doc_id"))
    return spark.createDataFrame([(f"{t}.{k}", float(profile.orphan_fraction(read(spark, sf_dir, t), k, read(spark, sf_dir, p), pk))) for t, k, p, pk in references], "reference string, orphan_fraction double")


_POINTS_SQL = "[" + ", ".join(str(k / 16) for k in range(17)) + "]"


@query(f"SELECT i::INTEGER AS i, round(q[i + 1], 4) AS bound FROM (SELECT quantile_cont(l_extendedprice, {_POINTS_SQL}) AS q FROM lineitem) x, range(17) r(i)")
def histogram_extendedprice(spark, sf_dir):
    bounds = profile.equi_depth(read(spark, sf_dir, "lineitem"), ["l_extendedprice"])["l_extendedprice"]
    return spark.createDataFrame(list(enumerate(bounds)), "i int, bound double").select("i", F.round("bound", 4).alias("bound"))


@query(f"""WITH a AS (SELECT c, quantile_cont(v, {_POINTS_SQL}) AS qs FROM (SELECT 'l_extendedprice' AS c, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'squared', l_extendedprice * l_extendedprice * l_extendedprice FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::DOUBLE FROM lineitem) t GROUP BY c),
q AS (SELECT c, unnest(qs) AS b FROM a),
w AS (SELECT c, b - lag(b) OVER (PARTITION BY c ORDER BY b) AS width FROM (SELECT DISTINCT c, b FROM q) d)
SELECT c AS column_name, count(*) FILTER (WHERE width IS NOT NULL) >= 3 AND coalesce(max(width) / median(width) >= 4, false) AS skewed FROM w GROUP BY c""")
def histogram_skew(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice", F.pow("l_extendedprice", F.lit(3)).alias("squared"), F.col("l_linenumber").cast("double"))
    bounds = profile.equi_depth(df, df.columns)
    return spark.createDataFrame([(c, profile.is_skewed(b)) for c, b in sorted(bounds.items())], "column_name string, skewed boolean")


@query("SELECT event_type AS value, count(*)::BIGINT AS occurrences, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS frequency FROM events GROUP BY event_type")
def value_set(spark, sf_dir):
    counts = profile.value_counts(read(spark, sf_dir, "events").select("event_type"), ["event_type"], [], 0)
    # A set has no more than twice SET_SIZE values, so it fits into a row.
    whole = counts.agg(F.sum("n").alias("total"), F.collect_list(F.struct("value", "n")).alias("values"))
    return whole.select("total", F.explode("values").alias("v")).select("v.value", F.col("v.n").alias("occurrences"), F.round(F.col("v.n") / F.col("total"), 6).alias("frequency"))


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, count(*) <= 50 AND bool_and(n >= 20) AS allowed FROM (SELECT count(*) AS n FROM {t} GROUP BY {c}) g" for t, c in (("events", "event_type"), ("customer", "c_mktsegment"), ("part", "p_name"), ("documents", "source"))))
def k_gate(spark, sf_dir):
    pairs = (("events", "event_type"), ("customer", "c_mktsegment"), ("part", "p_name"), ("documents", "source"))
    return union([read(spark, sf_dir, t).groupBy(c).count().agg(((F.count(F.lit(1)) <= privacy.SET_SIZE) & F.bool_and(F.col("count") >= privacy.K)).alias("allowed")).withColumn("column_name", F.lit(f"{t}.{c}")) for t, c in pairs])


@query("SELECT count(*)::BIGINT AS partitions, round(max(n) / sum(n)::DOUBLE, 6) AS skew FROM (SELECT count(*) AS n FROM events GROUP BY event_type) g")
def partition_skew(spark, sf_dir):
    found = profile.partition_skew(read(spark, sf_dir, "events"), ["event_type"])
    return spark.createDataFrame([(found["count"], found["skew"])], "partitions long, skew double")


@query("""WITH RECURSIVE tree(id, parent, bytes) AS (VALUES (1, NULL, 0), (2, 1, 100), (3, 1, 250), (4, 3, 70), (5, 3, 30), (6, NULL, 9)),
walk(root, id) AS (SELECT id, id FROM tree WHERE parent IS NULL UNION ALL SELECT w.root, t.id FROM walk w JOIN tree t ON t.parent = w.id)
SELECT root, sum(bytes)::BIGINT AS total_bytes FROM walk JOIN tree USING (id) GROUP BY root""")
def partition_tree_bytes(spark, sf_dir):
    return spark.sql("""WITH RECURSIVE tree(id, parent, bytes) AS (VALUES (1, cast(NULL AS int), 0), (2, 1, 100), (3, 1, 250), (4, 3, 70), (5, 3, 30), (6, NULL, 9)),
        walk(root, id) AS (SELECT id, id FROM tree WHERE parent IS NULL UNION ALL SELECT w.root, t.id FROM walk w JOIN tree t ON t.parent = w.id)
        SELECT root, sum(bytes) AS total_bytes FROM walk JOIN tree USING (id) GROUP BY root""")


# Formats


def _format_sql(t: str, c: str) -> str:
    shares = ", ".join(f"""round(avg(regexp_matches({c}, '{p.replace("'", "''")}')::INTEGER), 6) AS {n}""" for n, p in {**STRONG, **WEAK}.items())
    return f"SELECT '{t}.{c}' AS column_name, {shares} FROM {t} WHERE {c} <> ''"


FORMATS = (("pages", "url"), ("customer", "c_name"), ("part", "p_name"), ("orders", "o_orderpriority"), ("documents", "source"))


@query(" UNION ALL ".join(_format_sql(t, c) for t, c in FORMATS))
def format_fraction(spark, sf_dir):
    names = [*STRONG, *WEAK]
    return union([read(spark, sf_dir, t).agg(*format_aggregates(F.col(c), "")).select(F.lit(f"{t}.{c}").alias("column_name"), *(F.round(n, 6).alias(n) for n in names)) for t, c in FORMATS])


@query("SELECT * FROM (VALUES ('pages.url', 'url'), ('orders.o_orderpriority', 'enum_like'), ('documents.text', 'free_text')) t(column_name, format)")
def format_class(spark, sf_dir):
    out = []
    for t, c in (("pages", "url"), ("orders", "o_orderpriority"), ("documents", "text")):
        table, _, _ = profile.profile_table(frame_source(read(spark, sf_dir, t).select(c), t))
        out.append((f"{t}.{c}", table.columns[c].format))
    return spark.createDataFrame(out, "column_name string, format string")


@query("SELECT k AS key_name, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE string_agg(DISTINCT kind, '|' ORDER BY kind) END AS kind FROM (SELECT unnest(json_keys(props)) AS k, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(props, '$.k') = 'VARCHAR' THEN 'string' ELSE lower(json_type(props, '$.k')) END AS kind FROM events) j GROUP BY k")
def json_keys(spark, sf_dir):
    shape = json_skeleton(read(spark, sf_dir, "events"), "props") or {}
    return spark.createDataFrame([(k, v if isinstance(v, str) else "object") for k, v in shape.items()], "key_name string, kind string")


# Whole profiles


@query("SELECT column_name, fact, round(v, 4) AS value FROM (" + " UNION ALL ".join([f"SELECT '{c}' AS column_name, 'range.{n}' AS fact, {f}({c})::DOUBLE AS v FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))] + [f"SELECT '{c}' AS column_name, 'null_fraction' AS fact, count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE AS v FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")] + ["SELECT NULL AS column_name, 'rows' AS fact, count(*)::DOUBLE AS v FROM orders"]) + ") f")
def profile_orders(spark, sf_dir):
    table, _, _ = profile.profile_table(parquet_source(spark, f"{sf_dir}/orders.parquet", "orders"))
    rows = [(r[1], r[2], round(r[3], 4)) for r in fact_rows(Shape(tables={"orders": table})) if r[3] is not None and (r[2] in ("rows", "null_fraction") or r[2].startswith("range."))]
    return spark.createDataFrame(rows, "column_name string, fact string, value double")


@query("SELECT 'part' AS table_name, true AS share_close, true AS same_when_dealt_anew UNION ALL SELECT 'lineitem', true, true")
def hash_sample_rows(spark, sf_dir):
    """Whether a sample of a tenth has about a tenth of the rows, and the same rows under another partitioning."""
    out = []
    for t in ("part", "lineitem"):
        df = read(spark, sf_dir, t)
        mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first())
        rows, one, two = df.count(), mark(hash_sample(df, 0.1)), mark(hash_sample(df.repartition(7), 0.1))
        out.append((t, abs(one[0] - rows * 0.1) <= 5 * (rows * 0.09) ** 0.5, one == two))
    return spark.createDataFrame(out, "table_name string, share_close boolean, same_when_dealt_anew boolean")


# Privacy


def _private_shape() -> Shape:
    column = lambda **k: Column("text", format="free_text", length={"min": 1, "max": 90}, **k)
    status = Column("text", distinct=Fact(2, "measured"), values=["a", "b"], frequencies=[0.9, 0.1], format="enum_like")
    amount = Column("bigint", range={"min": 1, "max": 9}, histogram={"bounds": [1, 2, 9]})
    secret = Column("bigint", range={"min": 1, "max": 9}, redact=["range"])
    return Shape(tables={"t": Table(Fact(1000, "exact"), columns={"note": column(), "status": status, "amount": amount, "secret": secret}, constraints=[Constraint("check", "amount_ok", [], "amount > 0")])})


_LEAKS = {
    "strict": [("t.note", "length.max")],
    "standard": [("t (constraint amount_ok)", "check_expression"), ("t.amount", "histogram"), ("t.amount", "range"), ("t.note", "length.max")],
    "permissive": [("t (constraint amount_ok)", "check_expression"), ("t.amount", "histogram"), ("t.amount", "range"), ("t.note", "length.max"), ("t.status", "frequencies"), ("t.status", "values")],
}


@query("SELECT * FROM (VALUES " + values([(level, *x) for level, xs in _LEAKS.items() for x in xs]) + ") t(level, location, field)")
def privacy_leaks(spark, sf_dir):
    """What each privacy level leaves to be found in a document."""
    rows = [(level, x.location, x.field) for level in privacy.LEVELS for x in privacy.leaks(privacy.apply_privacy(_private_shape(), level))]
    return spark.createDataFrame(rows, "level string, location string, field string")


@query("SELECT host, sha256('gaugework source' || chr(0) || normal) AS source_hash FROM (VALUES ('DB.Example.com.', 'db.example.com'), ('[::1]', '::1'), ('localhost', 'localhost')) t(host, normal)")
def source_hash(spark, sf_dir):
    return spark.createDataFrame([(h, privacy.source_hash(h)) for h in ("DB.Example.com.", "[::1]", "localhost")], "host string, source_hash string")


# Verdicts

_FINDINGS = [(1, "info", ["t.rows"]), (2, "info", ["t.rows", "t.a.unique"]), (3, "info", []), (4, "warn", ["t.a.unique"]), (5, "error", ["t.b.range"]), (6, "info", ["t.gone"]), (7, "odd", ["t.rows"]), (8, "info", ["t.c.distinct"])]
_FACTS = [("t.rows", 3), ("t.a.unique", 1), ("t.a.unique", 3), ("t.b.range", 1), ("t.c.distinct", 2)]
_DEPENDS = values([(i, s, p) for i, s, ps in _FINDINGS for p in (ps or [None])])
_CAP_SQL = f"""WITH f(id, severity, path) AS (VALUES {_DEPENDS}), x(path, rank) AS (VALUES {values(_FACTS)}),
m AS (SELECT path, min(rank) AS rank FROM x GROUP BY path),
r AS (SELECT id, severity, coalesce(min(CASE WHEN f.path IS NOT NULL THEN coalesce(m.rank, -1) END), 3) AS rank FROM f LEFT JOIN m ON f.path = m.path GROUP BY id, severity)
SELECT id, severity, CASE rank WHEN 3 THEN 'exact' WHEN 2 THEN 'measured' WHEN 1 THEN 'estimated' WHEN 0 THEN 'declared' ELSE 'absent' END AS confidence,
CASE severity WHEN 'error' THEN 'FAIL' WHEN 'info' THEN CASE WHEN rank >= 2 THEN 'PASS' ELSE 'WARN' END ELSE 'WARN' END AS verdict FROM r"""


def _capped(spark):
    findings = spark.createDataFrame(_FINDINGS, "id int, severity string, depends_on array<string>")
    return verdict.cap_frame(findings, spark.createDataFrame(_FACTS, "path string, rank int")).drop("depends_on")


@query(_CAP_SQL)
def cap_findings(spark, sf_dir):
    return _capped(spark)


@query(f"SELECT CASE max(CASE verdict WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM ({_CAP_SQL}) c")
def verdict_combine(spark, sf_dir):
    return verdict.combine_frame(_capped(spark))


@query("SELECT a, b, CASE least(ra, rb) WHEN 3 THEN 'exact' WHEN 2 THEN 'measured' WHEN 1 THEN 'estimated' WHEN 0 THEN 'declared' ELSE 'absent' END AS weakest, CASE WHEN least(ra, rb) >= 2 THEN 'PASS' ELSE 'WARN' END AS ceiling FROM (VALUES " + values(list(RANKS.items())) + ") x(a, ra), (VALUES " + values(list(RANKS.items())) + ") y(b, rb)")
def confidence_matrix(spark, sf_dir):
    from .model import weakest

    rows = [(a, b, weakest(a, b), verdict.ceiling(weakest(a, b))) for a in RANKS for b in RANKS]
    return spark.createDataFrame(rows, "a string, b string, weakest string, ceiling string")


_BASES = [(m, b, ms, n) for m in ("constant", "linear", "n_log_n") for b, ms in ((0, 5), (1, 5), (1000, 40), (12000, 90)) for n in (0, 1, 1000, 1_200_000, 50_000_000)]
_BUCKET_SQL = "CASE WHEN ms < 100 THEN 'instant' WHEN ms < 1000 THEN 'fast' WHEN ms < 10000 THEN 'noticeable' WHEN ms < 60000 THEN 'slow' ELSE 'outage' END"


@query(f"""SELECT model, basis_rows, basis_ms, declared_rows, round(ms, 3) AS predicted_ms, {_BUCKET_SQL} AS bucket FROM (SELECT *, CASE WHEN basis_ms <= 0 THEN 0 WHEN declared_rows <= 0 OR model = 'constant' THEN basis_ms
WHEN model = 'n_log_n' THEN CASE WHEN basis_rows <= 1 THEN basis_ms * declared_rows ELSE basis_ms * (declared_rows * log2(greatest(declared_rows, 2))) / (basis_rows * log2(basis_rows)) END
ELSE CASE WHEN basis_rows <= 0 THEN basis_ms * declared_rows ELSE basis_ms * (declared_rows / basis_rows::DOUBLE) END END::DOUBLE AS ms
FROM (SELECT model, basis_rows::BIGINT AS basis_rows, basis_ms::BIGINT AS basis_ms, declared_rows::BIGINT AS declared_rows FROM (VALUES {values(_BASES)}) t(model, basis_rows, basis_ms, declared_rows)) v) e""")
def estimate_models(spark, sf_dir):
    rows = spark.createDataFrame(_BASES, "model string, basis_rows long, basis_ms long, declared_rows long")
    ms = verdict.predict_expression(F.col("model"), F.col("basis_rows"), F.col("basis_ms"), F.col("declared_rows"))
    return rows.withColumn("ms", ms).select("model", "basis_rows", "basis_ms", "declared_rows", F.round("ms", 3).alias("predicted_ms"), verdict.bucket_expression(F.col("ms")).alias("bucket"))


_POINTS = [("table_rewrite", 1000, 50, 2000, 90, 1_000_000), ("btree_build", 1000, 50, 4000, 260, 1_000_000), ("table_rewrite", 1000, 90, 2000, 50, 1_000_000), ("catalog_only", 10, 3, 20, 4, 99)]


@query(f"""SELECT operation, {_BUCKET_SQL} AS bucket FROM (SELECT operation, CASE WHEN operation = 'catalog_only' THEN greatest(m1, m2) ELSE greatest(0, (m2 - m1) / (w2 - w1) * wn + m1 - (m2 - m1) / (w2 - w1) * w1) END AS ms, n1 FROM (SELECT operation, n1, m1::DOUBLE AS m1, m2::DOUBLE AS m2,
CASE WHEN operation = 'btree_build' THEN n1 * log2(n1) ELSE n1 END AS w1, CASE WHEN operation = 'btree_build' THEN n2 * log2(n2) ELSE n2 END AS w2, CASE WHEN operation = 'btree_build' THEN n * log2(n) ELSE n END AS wn FROM (VALUES {values(_POINTS)}) t(operation, n1, m1, n2, m2, n)) p) e""")
def calibrate(spark, sf_dir):
    rows = [(o, verdict.calibrate(o, (a, b), (c, d), n, "exact").bucket) for o, a, b, c, d, n in _POINTS]
    return spark.createDataFrame(rows, "operation string, bucket string")


_SIZES = [0, 1_000_000, 20_000_000, 400_000_000, 4_200_000_000, 90_000_000_000]


@query(f"SELECT size::BIGINT AS size, {_BUCKET_SQL} AS bucket FROM (SELECT size, size / 52428.0 AS ms FROM (VALUES {values([(s,) for s in _SIZES])}) t(size)) b")
def reindex_bucket(spark, sf_dir):
    return spark.createDataFrame([(s, verdict.bucket_of_bytes(s)) for s in _SIZES], "size long, bucket string")


# Changes


@query("SELECT * FROM (VALUES " + values([(n, v, ",".join(sorted(f"{c}:{s}" for c, s in found))) for n, (_, _, v, found) in CASES.items()]) + ") t(case_name, verdict, findings)")
def corpus_verdicts(spark, sf_dir):
    """The verdict and the findings of every case of the corpus of changes."""
    return spark.createDataFrame(case_rows(), "case_name string, verdict string, findings string")


def _code_query(code: str) -> None:
    expected = [(n, c, s) for n, (_, _, _, found) in CASES.items() for c, s in found if c == code]

    def run(spark, sf_dir):
        return spark.createDataFrame([(n, *f.split(":")) for n, _, fs in case_rows() for f in fs.split(",") if f.startswith(code)], "case_name string, code string, severity string")

    run.__name__ = f"findings_{code.lower().replace('-', '_')}"
    query("SELECT * FROM (VALUES " + values(expected) + ") t(case_name, code, severity)")(run)


for _code in sorted({c for *_, found in CASES.values() for c, _ in found}):
    _code_query(_code)


@query("SELECT k::INTEGER AS k, line::INTEGER AS line, kind FROM (VALUES " + values([(k, line, kind) for k, (line, kind) in enumerate(STATEMENTS[1])]) + ") t(k, line, kind)")
def statements(spark, sf_dir):
    from .plans.statements import changes

    return spark.createDataFrame([(k, s.line, changes(s.sql)[0].kind) for k, s in enumerate(split(STATEMENTS[0]))], "k int, line int, kind string")


@query("SELECT CASE WHEN count(*) > count(DISTINCT text) THEN 'FAIL' ELSE 'WARN' END AS verdict, CASE WHEN count(*) > count(DISTINCT text) THEN 'RS-DATA-014' END AS code FROM documents WHERE text IS NOT NULL")
def validate_unique_text(spark, sf_dir):
    """Is documents.text safe for ADD UNIQUE? Decided on the rows."""
    from .engine import ground_truth

    source = parquet_source(spark, f"{sf_dir}/documents.parquet", "documents")
    result = ground_truth(spark, [source], {"name": "postgresql", "version": "16"}, split("ALTER TABLE documents ADD CONSTRAINT documents_text_key UNIQUE (text);"))
    found = next((f.code for f in result.findings if f.severity == "error"), None)
    return spark.createDataFrame([(result.verdict, found)], "verdict string, code string")


#: Scripts, and whether the rows stop them: a code, and the SQL that tells when. `t` has a null in `a` for every seventh order.
_SCRIPTS = (
    ("not_null", "ALTER TABLE t ALTER a SET NOT NULL", "23502", "SELECT count(*) > 0 FROM t WHERE a IS NULL"),
    ("backfill", "UPDATE t SET a = 0 WHERE a IS NULL; ALTER TABLE t ALTER a SET NOT NULL", "23502", "SELECT count(*) > 0 FROM (SELECT coalesce(a, 0) AS a FROM t) WHERE a IS NULL"),
    ("deletion", "DELETE FROM t WHERE a IS NULL; ALTER TABLE t ALTER a SET NOT NULL", "23502", "SELECT count(*) > 0 FROM (SELECT * FROM t WHERE a IS NOT NULL) WHERE a IS NULL"),
    ("partly", "DELETE FROM t WHERE a IS NULL AND o_orderkey > 100; ALTER TABLE t ALTER a SET NOT NULL", "23502", "SELECT count(*) > 0 FROM t WHERE a IS NULL AND NOT o_orderkey > 100"),
    ("insertion", "DELETE FROM t WHERE a IS NULL; INSERT INTO t (o_orderkey) VALUES (-1); ALTER TABLE t ALTER a SET NOT NULL", "23502", "SELECT true"),
    ("default", "ALTER TABLE t ADD COLUMN z int DEFAULT 0; ALTER TABLE t ALTER z SET NOT NULL", "23502", "SELECT count(*) > 0 FROM (SELECT 0 AS z FROM t) WHERE z IS NULL"),
    ("no_default", "ALTER TABLE t ADD COLUMN z int NOT NULL", "23502", "SELECT count(*) > 0 FROM t"),
    ("new_table", "CREATE TABLE n (id bigint); ALTER TABLE n ADD COLUMN b text NOT NULL", "42P01", "SELECT false"),
    ("renamed", "ALTER TABLE t RENAME COLUMN a TO b; ALTER TABLE t DROP COLUMN b; ALTER TABLE t DROP COLUMN a", "42703", "SELECT true"),
    ("foreign_key", "ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES c(key)", "23503", "SELECT count(*) > 0 FROM t WHERE a IS NOT NULL AND a NOT IN (SELECT c_custkey FROM customer)"),
    ("orphans", "DELETE FROM c WHERE key <= 50; ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES c(key) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT f", "23503", "SELECT count(*) > 0 FROM t WHERE a IS NOT NULL AND a NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 50)"),
    ("composite_key", "ALTER TABLE l ADD FOREIGN KEY (k, b) REFERENCES t(o_orderkey, o_custkey)", "23503", "SELECT count(*) > 0 FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_linenumber = 3 AND o_custkey % 11 = 5"),
    ("partial_unique", "CREATE UNIQUE INDEX u ON t (o_custkey) WHERE o_orderstatus = 'P'", "23505", "SELECT count(*) > count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P'"),
    ("expression_unique", "CREATE UNIQUE INDEX u ON t ((o_orderkey % 1000))", "23505", "SELECT count(*) > count(DISTINCT o_orderkey % 1000) FROM orders"),
    ("unique_after_deletion", "DELETE FROM t WHERE o_orderkey % 1000 <> 7; ALTER TABLE t ADD UNIQUE (o_orderkey)", "23505", "SELECT count(*) > count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey % 1000 = 7"),
    ("no_table", "ALTER TABLE nowhere ADD COLUMN x int", "42P01", "SELECT true"),
)
_SCRIPT_ROWS = "WITH t AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS a FROM orders) "


@query(_SCRIPT_ROWS + " UNION ALL ".join(f"SELECT '{n}' AS script, CASE WHEN ({test}) THEN '{code}' ELSE '' END AS error_code" for n, _, code, test in _SCRIPTS))
def apply_changes(spark, sf_dir):
    """The code that stops each script on the rows, earlier statements carried out."""
    from .operators.checks import apply

    orders = read(spark, sf_dir, "orders")
    tables = {
        "t": orders.withColumn("a", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END")),
        "c": read(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").alias("key")),
        "l": read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("k"), F.expr("o_custkey + CASE WHEN l_linenumber = 3 AND o_custkey % 11 = 5 THEN 1 ELSE 0 END").alias("b")),
    }
    out = []
    for name, script, *_ in _SCRIPTS:
        capture = apply(spark, split(script), tables)
        out.append((name, next((s.error_code for s in capture.statements if s.error_code), "")))
    return spark.createDataFrame(out, "script string, error_code string")


_CHECKS = (("lineitem", "l_discount < 0.05"), ("customer", "c_acctbal >= 0"), ("orders", "o_totalprice > 0"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{e}' AS expression, count(*) FILTER (WHERE NOT coalesce({e}, true))::BIGINT AS violations FROM {t}" for t, e in _CHECKS))
def check_violations(spark, sf_dir):
    from .operators.checks import violations

    return spark.createDataFrame([(t, e, violations(read(spark, sf_dir, t), e)) for t, e in _CHECKS], "table_name string, expression string, violations long")


_CASTS = (("documents", "text", "varchar(200)", "length(text) > 200"), ("lineitem", "l_extendedprice", "smallint", "round(l_extendedprice) NOT BETWEEN -32768 AND 32767"), ("events", "event_type", "varchar(5)", "length(event_type) > 5"))


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, '{k}' AS new_type, count(*) FILTER (WHERE {w})::BIGINT AS lost FROM {t}" for t, c, k, w in _CASTS))
def cast_losses(spark, sf_dir):
    found = []
    for t, c, k, _ in _CASTS:
        df = read(spark, sf_dir, t)
        found.append(df.agg(F.count_if(checks.cast_loss(df, c, k)).alias("lost")).select(F.lit(f"{t}.{c}").alias("column_name"), F.lit(k).alias("new_type"), "lost"))
    return union(found)


_EXPECTED = [("orders", "o_orderkey", "bigint", True), ("orders", "o_custkey", "integer", True), ("orders", "o_note", "text", True), ("gone", "id", "bigint", True)]


@query("""WITH e(t, c, k) AS (VALUES ('orders', 'o_orderkey', 'bigint'), ('orders', 'o_custkey', 'integer'), ('orders', 'o_note', 'text'), ('gone', 'id', 'bigint')),
a AS (SELECT 'orders' AS t, column_name AS c, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double precision' WHEN 'VARCHAR' THEN 'text' ELSE 'timestamp without time zone' END AS k FROM information_schema.columns WHERE table_name = 'orders')
SELECT coalesce(e.t, a.t) AS "table", CASE WHEN coalesce(e.t, a.t) = 'orders' THEN coalesce(e.c, a.c) END AS "column",
CASE WHEN e.t = 'gone' THEN 'missing table' WHEN a.c IS NULL THEN 'missing column' WHEN e.c IS NULL THEN 'unexpected column' ELSE 'type ' || e.k || ' became ' || a.k END AS drift
FROM e FULL JOIN a ON e.t = a.t AND e.c = a.c WHERE a.c IS NULL OR e.c IS NULL OR e.k <> a.k""")
def drift_columns(spark, sf_dir):
    live = drift.live_shape([parquet_source(spark, f"{sf_dir}/orders.parquet", "orders")])
    return drift.compare(spark.createDataFrame(_EXPECTED, drift.SCHEMA), drift.structure_frame(spark, live))


# Synthesis


def draw_sql(table: str, column: str, turn: int = 0, ordinal: str = "i") -> str:
    return f"(('0x' || substr(sha256('7|{len(table)}:{table}|{len(column)}:{column}|{turn}|' || {ordinal}), 1, 15))::BIGINT)"


def synthetic() -> Shape:
    """A parent and its children, with a column for each way of making values."""
    users = Table(Fact(1000, "exact"), columns={
        "id": Column("bigint", False, unique=Fact(True, "exact", "constraint"), range={"min": 1, "max": 1000}),
        "age": Column("integer", True, null_fraction=Fact(0.032, "exact"), distinct=Fact(80, "measured"), range={"min": 18, "max": 97}),
        "email": Column("text", False, unique=Fact(True, "exact", "probe"), format="email"),
        "plan": Column("plan_kind", False), "code": Column("varchar(4)", False, distinct=Fact(500, "measured"), format="slug"),
        "score": Column("double precision", False, distinct=Fact(101, "measured"), range={"min": -1.0, "max": 1.0}),
        "joined": Column("timestamp without time zone", False, distinct=Fact(11, "measured"), range={"min": "2024-01-01T00:00:00Z", "max": "2024-01-11T00:00:00Z"}),
        "state": Column("text", False, format="enum_like", values=["new", "old"], frequencies=[0.75, 0.25]),
        "level": Column("integer", False, distinct=Fact(50, "measured"), range={"min": 0, "max": 49}), "tags": Column("text[]", False, distinct=Fact(9, "measured")),
    }, constraints=[Constraint("primary_key", "users_pkey", ["id"]), Constraint("check", "level_ok", [], "level >= 5 AND level < 40")])
    orders = Table(Fact(5000, "exact"), columns={"id": Column("bigint", False, unique=Fact(True, "exact")), "user_id": Column("bigint", False)}, references=[Reference("user_id", "users.id", "orders_user_fkey", fanout={"mean": 20, "p50": 5, "p95": 100, "max": 800})])
    events = Table(Fact(2000, "exact"), columns={"user_id": Column("bigint", False)}, references=[Reference("user_id", "users.id")])
    return Shape(meta={"engine": {"name": "postgresql", "version": "16"}}, tables={"users": users, "orders": orders, "events": events}, types={"plan_kind": UserType("enum", ["free", "paid", "team"])})


def _users(spark, *columns: str) -> DataFrame:
    return hydrate.generate_table(spark, synthetic(), "users", hydrate.plan_rows(synthetic()), 7).select(F.col("id"), *columns)


_OVER = "(SELECT i, i + 1 AS id FROM range(1000) r(i)) t"


@query(f"SELECT id, CASE WHEN floor((i + 1) * 0.032::DOUBLE) > floor(i * 0.032::DOUBLE) THEN NULL ELSE (18 + ({draw_sql('users', 'age')} % 80) % 80)::INTEGER END AS age FROM {_OVER}")
def hydrate_nulls(spark, sf_dir):
    return _users(spark, "age")


@query(f"SELECT id, 'user_' || CASE WHEN i < 100000 THEN lpad(i::VARCHAR, 5, '0') ELSE i::VARCHAR END || '@example.invalid' AS email FROM {_OVER}")
def hydrate_unique(spark, sf_dir):
    return _users(spark, "email")


@query(f"SELECT id, (['free', 'paid', 'team'])[(({draw_sql('users', 'plan')} % 1048576) % 3)::INTEGER + 1] AS plan, (['new', 'old'])[CASE WHEN {draw_sql('users', 'state', 2)} / 1152921504606846976.0::DOUBLE >= 0.75 THEN 2 ELSE 1 END] AS state FROM {_OVER}")
def hydrate_enum(spark, sf_dir):
    return _users(spark, "plan", "state")


@query(f"SELECT id, greatest(5, least(39, ({draw_sql('users', 'level')} % 50) % 50))::INTEGER AS level, round(-1.0::DOUBLE + ({draw_sql('users', 'score')} % 101) / 100.0::DOUBLE * 2.0::DOUBLE, 6) AS score FROM {_OVER}")
def hydrate_numbers(spark, sf_dir):
    return _users(spark, "level", F.round("score", 6).alias("score"))


@query(f"SELECT id, strftime(to_timestamp(1704067200 + ({draw_sql('users', 'joined')} % 11) * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS joined FROM {_OVER}")
def hydrate_temporal(spark, sf_dir):
    return _users(spark, F.date_format("joined", "yyyy-MM-dd HH:mm:ss").alias("joined"))


@query(f"SELECT id, CASE WHEN length(s) <= 4 THEN s ELSE left(s, greatest(0, 4 - length(tail))) || tail END AS code FROM (SELECT id, 'slug-' || n AS s, right(CASE WHEN n >= 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', (n // 36)::INTEGER + 1, 1) ELSE '' END || substr('0123456789abcdefghijklmnopqrstuvwxyz', (n % 36)::INTEGER + 1, 1), 4) AS tail FROM (SELECT id, {draw_sql('users', 'code')} % 500 AS n FROM {_OVER}) a) b")
def hydrate_width(spark, sf_dir):
    return _users(spark, "code")


@query("SELECT i % 1000 + 1 AS user_id, count(*)::BIGINT AS children FROM range(2000) r(i) GROUP BY 1")
def hydrate_fk(spark, sf_dir):
    df = hydrate.generate_table(spark, synthetic(), "events", hydrate.plan_rows(synthetic()), 7)
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("children"))


@query("SELECT 5000::BIGINT AS children, 250::BIGINT AS parents, true AS resolved, true AS tail, 800::BIGINT AS whale")
def hydrate_fanout(spark, sf_dir):
    """A long tail: the number of parents from the mean, and one parent with the most children."""
    df = hydrate.generate_table(spark, synthetic(), "orders", hydrate.plan_rows(synthetic()), 7)
    counts = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("children"), F.count(F.lit(1)).alias("parents"), (F.min("user_id") >= 1).alias("resolved"), (F.max("n") >= 5 * F.avg("n")).alias("tail"), F.max("n").alias("whale"))
