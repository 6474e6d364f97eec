import json
import os

import pytest
from pyspark.sql import functions as F

from gaugework import conformance, engine, model
from gaugework.model import Column, Constraint, Fact, Index, Reference, Shape, ShapeError, Table
from gaugework.operators import checks, hydrate, profile
from gaugework.plans import drift
from gaugework.plans.statements import split
from gaugework.queries import synthetic
from gaugework.sources import tables
from gaugework.streaming import sketches

ENGINE = {"name": "postgresql", "version": "16"}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(k, f"user{k}@example.org" if k % 10 else None, "new" if k % 4 else "old", float(k * k), b"ab" * (k % 3), '{"a": %d}' % k if k % 2 else '{"a": "x", "b": [1]}') for k in range(1000)]
    return spark.createDataFrame(rows, "id long, mail string, state string, amount double, raw binary, body string")


def test_exact_profile(spark, people):
    source = tables.frame_source(people, "people", primary_key=["id"], declared_types={"body": "jsonb"})
    t, warnings, _ = profile.profile_table(source)
    c = t.columns
    assert t.rows == Fact(1000, "exact", "footer") and not warnings
    assert c["mail"].null_fraction == Fact(0.1, "exact", "scan") and c["mail"].format == "email"
    assert abs(c["mail"].distinct.value - 900) < 30 and c["mail"].distinct.confidence == "measured"
    assert c["id"].unique == Fact(True, "exact", "probe") and c["state"].unique == Fact(False, "exact", "probe")
    assert c["state"].format == "enum_like" and c["state"].values == ["new", "old"] and abs(sum(c["state"].frequencies) - 1) < 1e-6
    assert c["amount"].range == {"min": 0.0, "max": 998001.0, "mean": 332833.5, "confidence": "exact"} and c["mail"].range is None
    assert c["raw"].length["max"] == 4 and c["body"].shape == {"a": "number|string", "b": ["number"]} and c["id"].histogram is None
    assert t.constraints[0].kind == "primary_key"


def test_no_fact_is_stronger_than_its_source(spark):
    df = spark.range(100_000).select(F.col("id"), (F.col("id") % 7).alias("week"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("maybe"))
    t, warnings, escalated = profile.profile_table(tables.frame_source(df, "t"), exact=False)
    assert escalated and t.columns["id"].unique == Fact(True, "exact", "probe") and t.columns["id"].distinct.confidence == "measured"
    assert t.columns["week"].distinct.confidence == "estimated" and t.columns["week"].range["confidence"] == "estimated" and t.columns["week"].distinct.value == 7
    assert t.columns["maybe"].null_fraction.confidence == "estimated" and abs(t.columns["maybe"].null_fraction.value - 0.2) < 0.02
    t, warnings, _ = profile.profile_table(tables.frame_source(df, "t"), exact=False, ceiling=1000)
    assert warnings and t.columns["id"].unique is None


def test_samples_follow_the_rows(spark):
    df = spark.range(30_000).withColumn("x", F.col("id") % 11)
    marks = {tables.hash_sample(df.repartition(n), 0.1).agg(F.sum("id")).first()[0] for n in (1, 3, 7)}
    assert len(marks) == 1 and tables.sample_share(100) == 1 and tables.sample_share(40_000) == 0.5 and tables.sample_share(10**12) == 0.0001


def test_references(spark):
    child = spark.createDataFrame([(1,)] * 6 + [(2,)] * 2 + [(9,)] * 2 + [(None,)], "p long")
    parent = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    assert profile.fanout(child, "p") == {"mean": 3.333333, "p50": 2.0, "p95": 5.6, "max": 6, "confidence": "measured"}
    assert profile.orphan_fraction(child, "p", parent, "id") == 0.2 and profile.orphan_fraction(child.limit(0), "p", parent, "id") == 0
    assert profile.fanout(child.limit(0), "p") is None
    assert profile.partition_skew(child.na.fill(0), ["p"])["skew"] == round(6 / 11, 6)


def test_escalation_and_decoding():
    assert profile.must_escalate(Fact(96), 100, False) and not profile.must_escalate(Fact(95), 100, False) and not profile.must_escalate(Fact(96), 100, True)
    assert [tables.decode_distinct(x, 1000) for x in (50, -0.5, 0)] == [50, 500, None]
    assert profile.is_skewed([0, 1, 2, 3, 100]) and not profile.is_skewed([0, 1, 2, 3, 4]) and not profile.is_skewed([0, 1, 100])


def test_nested_columns_and_clashing_names(spark):
    df = spark.sql("SELECT named_struct('x', id, 'y.z', 'a') AS s, array(id) AS l, map('k', id) AS m, id AS `a.b`, id AS rows, id AS n FROM range(20)")
    t, _, _ = profile.profile_table(tables.frame_source(df, "t"))
    assert {"s.x", "s.y.z", "a.b", "rows", "l", "m"} <= set(t.columns) and t.columns["a.b"].unique.value is True and t.columns["l"].distinct is None


def test_empty_table(spark):
    t, _, _ = profile.profile_table(tables.frame_source(spark.createDataFrame([], "a long, b string, c double, d timestamp"), "t"))
    assert t.rows.value == 0 and t.columns["a"].range is None and t.columns["b"].format == "opaque" and t.columns["b"].null_fraction.value == 0


def test_pull_and_validate_on_rows(spark, tmp_path):
    text, warnings = engine.pull(spark, tables.parquet_sources(spark, "/root/testdata/sf0.001", ["nation", "region"]), ENGINE, exact=True, host="DB.example")
    shape = model.parse(text)
    assert shape.tables["nation"].rows.value == 25 and shape.meta["mode"] == "exact" and shape.meta["source_hash"] and not warnings
    assert conformance.check_emitter(shape) == []
    docs = tables.parquet_source(spark, "/root/testdata/sf0.001/documents.parquet", "documents")
    r = engine.ground_truth(spark, [docs], ENGINE, split("ALTER TABLE documents ADD UNIQUE (text)"))
    assert r.verdict == "FAIL" and [f.code for f in r.findings if f.severity == "error"] == ["RS-DATA-014"]
    r = engine.ground_truth(spark, [docs], ENGINE, split("ALTER TABLE documents ALTER COLUMN doc_id SET NOT NULL"))
    assert r.verdict == "PASS"


def test_rows_decide_changes(spark):
    t = spark.createDataFrame([(1, "a", 5.5), (2, "a", None), (3, "bbbb", 40000.0)], "id long, s string, x double")
    p = spark.createDataFrame([(1,), (2,)], "id long")

    def code(sql):
        c = checks.apply(spark, split(sql), {"app.t": t, "p": p})
        return next((s.error_code for s in c.statements if s.error_code), "")

    cases = {
        "ALTER TABLE t ALTER x SET NOT NULL": "23502", "ALTER TABLE t ALTER id SET NOT NULL": "", "ALTER TABLE app.t ADD UNIQUE (s)": "23505", "ALTER TABLE t ADD UNIQUE (s, x)": "",
        "ALTER TABLE t ADD PRIMARY KEY (x)": "23502", "ALTER TABLE t ADD CHECK (x < 100)": "23514", "ALTER TABLE t ADD CHECK (x < 100) NOT VALID": "", "ALTER TABLE t ADD CHECK (x > 0)": "",
        "ALTER TABLE t ADD CONSTRAINT c CHECK (x < 100) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT c": "23514", "ALTER TABLE t ADD CONSTRAINT k FOREIGN KEY (id) REFERENCES p(id)": "23503",
        "ALTER TABLE t ALTER x TYPE smallint": "22003", "ALTER TABLE t ALTER s TYPE varchar(3)": "22001", "ALTER TABLE t ALTER s TYPE varchar(4)": "", "ALTER TABLE gone ADD COLUMN a int": "42P01",
        "ALTER TABLE t DROP COLUMN q": "42703", "ALTER TABLE t DROP COLUMN s; ALTER TABLE t ADD UNIQUE (s)": "42703", "DROP TABLE p; TRUNCATE p": "42P01", "CREATE UNIQUE INDEX i ON t (s)": "23505",
        "ALTER TABLE t ADD COLUMN c int; ALTER TABLE t ALTER c SET NOT NULL": "23502", "BEGIN; COMMIT": "", "ALTER TABLE t ADD CHECK (nope > 1)": "42703",
    }
    assert {sql: code(sql) for sql in cases} == cases
    assert checks.duplicate_count(t, ["s"]) == 1 and checks.has_duplicates(t, ["s"], "id < 2") is False and checks.violations(t, "x < 100") == 1


def test_generated_rows(spark):
    shape = synthetic()
    made, again = hydrate.generate(spark, shape, 7), {k: v.repartition(5) for k, v in hydrate.generate(spark, shape, 7).items()}
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    for t in shape.tables:
        assert mark(made[t]) == mark(again[t]) and conformance.check_hydrator(shape, t, made[t], again[t]) == []
    assert mark(hydrate.generate(spark, shape, 8)["users"]) != mark(made["users"])
    users, orders = made["users"], made["orders"]
    assert orders.join(users, orders.user_id == users.id, "left_anti").count() == 0
    part = hydrate.generate_table(spark, shape, "users", {**hydrate.plan_rows(shape), "users": 100}, 7)
    assert part.exceptAll(users).count() == 0
    r = users.agg(F.min("level"), F.max("level"), F.max(F.char_length("code")), F.count_distinct("plan"), F.min("age"), F.max("age")).first()
    assert tuple(r) == (5, 39, 4, 3, 18, 97)
    counts = [x.n for x in orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == 5000 and max(counts) == 800 and abs(len(counts) - 250) < 1
    assert abs(users.where("state = 'new'").count() - 750) < 60
    assert engine.constraint_report(shape, made) == []


def test_orphans_and_planning(spark):
    shape = synthetic()
    shape.tables["orders"].references[0].orphan_fraction = Fact(0.1, "exact")
    df = hydrate.generate_table(spark, shape, "orders", hydrate.plan_rows(shape), 7)
    users = hydrate.generate_table(spark, shape, "users", hydrate.plan_rows(shape), 7)
    lost = df.join(users, df.user_id == users.id, "left_anti").count()
    assert 500 <= lost <= 520
    assert engine.constraint_report(shape, {**hydrate.generate(spark, shape, 7)}) == ["orders: foreign key orders_user_fkey: rows break it"]
    shape.tables["none"] = Table(Fact(0, "exact"))
    assert hydrate.plan_rows(shape, 0.0001) == {"users": 1, "orders": 1, "events": 1, "none": 0} and hydrate.plan_rows(shape, 0, 7)["orders"] == 7
    with pytest.raises(ShapeError):
        hydrate.generate_table(spark, Shape(tables={"t": Table(Fact(3), columns={"a": Column("tsvector")})}), "t", {"t": 3})


def test_every_type_is_rendered(spark):
    kinds = ["bigint", "smallint", "numeric(8,2)", "real", "money", "text", "varchar(3)", "char(2)", "boolean", "bytea", "date", "timestamp", "timestamptz", "time", "uuid", "jsonb", "inet", "macaddr", "macaddr8", "interval", "xml", "bit(5)", "point", "text[]", "integer[]", "citext"]
    formats = ["email", "uuid", "url", "hostname", "slug", "ipv4", "ipv6", "phone", "numeric_string", "hex", "base64", "iso_date", "free_text", "opaque"]
    columns = {f"k{k}": Column(t, False) for k, t in enumerate(kinds)} | {f"f{k}": Column("text", False, format=f) for k, f in enumerate(formats)} | {f"u{k}": Column("varchar(6)", False, format=f, unique=Fact(True, "exact")) for k, f in enumerate(formats)}
    shape = Shape(tables={"t": Table(Fact(200), columns=columns)})
    df = hydrate.generate_table(spark, shape, "t", {"t": 200})
    row = df.agg(*(F.count(c).alias(c) for c in df.columns), *(F.count_distinct(c).alias("d" + c) for c in columns if c.startswith("u"))).first().asDict()
    assert set(row.values()) == {200}
    for f, pattern in {**profile.STRONG, **profile.WEAK}.items():
        assert df.where(~F.col(f"f{formats.index(f)}").rlike(pattern)).count() == 0, f
    lines = [r[0] for r in hydrate.insert_rows(df, "t").limit(2).collect()]
    assert lines[0].startswith('INSERT INTO t ("f0"') and lines[0].endswith(");")


def test_checks_as_domains():
    t = Table(constraints=[Constraint("check", "a", [], e) for e in ("(a >= 1) AND (a < 9)", "s = ANY (ARRAY['x'::text, 'it''s'::character varying])", "s IN ('x', 'z')", "b > 1 OR b < 0", "lower(c) = 'x'", "(d)::numeric > -3.5")] + [Constraint("check", "n", [], "e > 1", validated=False), Constraint("check", "o", [], "opaque")])
    d = hydrate.check_domains(t)
    assert (d["a"].low, d["a"].high) == (1, 8) and d["s"].values == ["x"] and d["d"].low == -2.5 and set(d) == {"a", "s", "d"}


def test_nulls_are_even(spark):
    for p in (0.0, 0.032, 0.5, 1.0):
        for n in (1, 10, 1000):
            got = spark.range(n).where(hydrate.is_null_at(F.col("id"), p)).count()
            assert abs(got - n * p) <= 1


def test_load_and_ephemeral_validation(spark, tmp_path):
    shape = synthetic()
    report = engine.load(spark, shape, f"file://{tmp_path}/out", scale=0.1)
    assert report == {"rows": {"users": 100, "orders": 500, "events": 200}, "skipped": []}
    with pytest.raises(ShapeError):
        engine.load(spark, shape, f"{tmp_path}/out", source=f"{tmp_path}/out")
    r = engine.validate(spark, shape, split("ALTER TABLE users ADD COLUMN t uuid DEFAULT gen_random_uuid(); CREATE INDEX i ON users (age)"), ephemeral=True, second_scale=0.5)
    assert r.verdict == "WARN" and {f.code for f in r.findings} == {"RS-LOCK-001", "RS-INDEX-001"} and all(f.estimate for f in r.findings)
    r = engine.validate(spark, shape, split("ALTER TABLE nobody ADD COLUMN t int"), ephemeral=True)
    assert r.verdict == "FAIL" and r.findings[0].code == "RS-APPLY-001"


def test_round_trip_keeps_the_shape(spark):
    shape = synthetic()
    shape.tables["orders"].rows.value = 20_000
    made = hydrate.generate(spark, shape, 7)
    source = tables.frame_source(made["orders"], "orders", references=[("user_id", "users", "id")])
    t, _, _ = profile.profile_table(source, sources={"users": tables.frame_source(made["users"], "users")})
    f, wanted = t.references[0].fanout, shape.tables["orders"].references[0].fanout
    assert 0.4 * wanted["p50"] <= f["p50"] <= 1.5 * wanted["p50"] + 1 and 0.4 * wanted["p95"] <= f["p95"] <= 1.5 * wanted["p95"] and f["max"] >= 5 * f["mean"]
    assert t.references[0].orphan_fraction == Fact(0.0, "exact", "scan")


def test_drift(spark):
    live = [tables.frame_source(spark.createDataFrame([], "id long, a string, c int"), "t"), tables.frame_source(spark.range(1), "more")]
    expected = Shape(tables={"t": Table(columns={"id": Column("int8"), "a": Column("integer"), "b": Column("text")}, constraints=[Constraint("check", "k", [], "a > 0")]), "gone": Table(columns={"x": Column("text")})})
    got = {(r["table"], r["column"], r["drift"]) for r in engine.verify(spark, expected, live)}
    assert got == {("t", "a", "type integer became text"), ("t", "b", "missing column"), ("t", "c", "unexpected column"), ("gone", None, "missing table")}
    assert drift.missing_constraints(expected, drift.live_shape(live)) == ["t: check k"]


def test_mark_exact():
    s = drift.mark_exact(Shape(tables={"t": Table(Fact(3), columns={"a": Column("int", null_fraction=Fact(0.0), range={"min": 1, "confidence": "estimated"})}, references=[Reference("a", "p.id", fanout={"mean": 1}, orphan_fraction=Fact(0.0))], indexes=[Index("i", ["a"])])}))
    t = s.tables["t"]
    assert {t.rows.confidence, t.columns["a"].null_fraction.confidence, t.columns["a"].range["confidence"], t.references[0].orphan_fraction.confidence, t.references[0].fanout["confidence"]} == {"exact"}


def test_stream_profile(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 4 > 0, F.col("id") % 10).alias("x"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sketches.profile_stream(stream, ["id", "x"], f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got = {r["column"]: r for r in sketches.merged(spark.read.parquet(f"{tmp_path}/state")).collect()}
    assert got["x"]["rows"] == 1000 and got["x"]["nulls"] == 250 and got["x"]["distinct"] == 10 and abs(got["id"]["distinct"] - 1000) < 40


def test_catalog_source(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS gauge_test LOCATION 'file://{tmp_path}/db'")
    try:
        spark.range(5).write.saveAsTable("gauge_test.five")
        assert [s.name for s in tables.catalog_sources(spark, "gauge_test")] == ["five"]
    finally:
        spark.sql("DROP DATABASE gauge_test CASCADE")


def test_command_line(spark, tmp_path, capsys):
    from gaugework import cli

    shape, change = tmp_path / "shape.yaml", tmp_path / "m.sql"
    shape.write_text(model.emit(synthetic()))
    change.write_text("ALTER TABLE users ADD UNIQUE (plan);")
    assert cli.main(["validate", str(shape), str(change), "--json"]) == 2
    result = tmp_path / "r.json"
    result.write_text(capsys.readouterr().out)
    assert json.loads(result.read_text())["verdict"] == "WARN"
    assert cli.main(["annotate", str(result)]) == 0 and "::warning" in capsys.readouterr().out
    assert cli.main(["annotate", str(result), "--summary"]) == 0
    assert cli.main(["validate", str(shape), str(change), "--warn-fail"]) == 1
    assert cli.main(["inspect", str(shape), "--fail-on-leak"]) == 1 and cli.main(["explain", "RS-PERF-001"]) == 0
    assert cli.main(["explain", "RS-NO"]) == 3 and cli.main(["inspect", "none.yaml"]) == 3
    assert "tool_error" in capsys.readouterr().err
    assert cli.main(["hydrate", str(shape), "--out", f"{tmp_path}/sql", "--format", "sql", "--scale", "0.01"]) == 0
    assert any(f.endswith(".txt") for f in os.listdir(tmp_path / "sql" / "users.sql"))
    assert cli.main(["pull", "/root/testdata/sf0.001", "--table", "region", "--out", str(tmp_path / "p.yaml"), "--exact"]) == 0
    assert cli.main(["verify", str(tmp_path / "p.yaml"), "--against", "/root/testdata/sf0.001"]) == 0
    change.write_text("ALTER TABLE region DROP COLUMN nope;")
    assert cli.main(["plan", str(change), "--against", "/root/testdata/sf0.001"]) == 1
    assert cli.main(["init", "--out", str(tmp_path / "c.json")]) == 0


def test_disposable_database(spark):
    from gaugework.operators.targets import Ephemeral

    shape = synthetic()
    with Ephemeral(spark) as target:
        assert target.load(shape, seed=7, scale=0.01) == {"events": 20, "orders": 50, "users": 10}
        assert engine.constraint_report(shape, target.tables(shape)) == []
        name = target.name
    assert not spark.catalog.databaseExists(name)


def test_splitter_in_sql(spark):
    from gaugework.plans import sql_functions

    sql_functions.register(spark)
    rows = spark.sql("SELECT k, line, kind, `table` FROM split_statements('DROP TABLE a;\nALTER TABLE b DROP COLUMN c, ADD COLUMN d int') ORDER BY k, kind").collect()
    assert [tuple(r) for r in rows] == [(0, 1, "drop_table", "a"), (1, 2, "add_column", "b"), (1, 2, "drop_column", "b")]


def test_planner_statistics(spark, tmp_path):
    from gaugework.operators.targets import Ephemeral

    with Ephemeral(spark) as target:
        spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("x")).write.saveAsTable(f"{target.name}.t")
        assert tables.planner_stats(spark, f"{target.name}.t")[1] == {}
        spark.sql(f"ANALYZE TABLE {target.name}.t COMPUTE STATISTICS FOR ALL COLUMNS")
        rows, facts = tables.planner_stats(spark, f"{target.name}.t")
        assert rows == Fact(100) and facts["x"]["null_fraction"] == Fact(0.25) and facts["x"]["distinct"] == Fact(5)


def test_hints_are_carried(spark):
    from gaugework.model import UserType

    source = tables.frame_source(spark.range(10).select("id", F.lit("a").alias("m")), "t", declared_types={"m": "mood"}, types={"mood": UserType("enum", ["a", "b"]), "other": UserType("enum", ["c"])}, indexes=[Index("i", ["m"])], extensions=["citext"], checks=[("ok", "id >= 0")], unique=[["id"]])
    shape = profile.pull(spark, [source], ENGINE).shape
    assert set(shape.types) == {"mood"} and shape.tables["t"].indexes[0].name == "i" and shape.extensions == ["citext"]
    assert {c.kind for c in shape.tables["t"].constraints} == {"unique", "check"} and shape.tables["t"].columns["id"].unique == Fact(True, "exact", "probe")


def test_quantiles_are_exact_at_any_size(spark, monkeypatch):
    import numpy as np

    from gaugework.operators import quantiles

    random_ = np.random.default_rng(4)
    points = [k / 16 for k in range(17)] + [0.001, 0.95]
    columns = {"normal": random_.standard_normal(5000), "few": random_.integers(0, 3, 5000).astype(float), "one": np.full(5000, 7.0), "tail": np.where(random_.random(5000) < 0.99, 1.0, random_.random(5000) * 1e6), "big": random_.integers(-(10**12), 10**12, 5000).astype(float)}
    rows = [tuple(float(columns[c][k]) if k % 10 or c == "one" else None for c in columns) for k in range(5000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns]) ).withColumn("nothing", F.lit(None).cast("int"))
    want = {c: [float(np.quantile([r[k] for r in rows if r[k] is not None], p)) for p in points] for k, c in enumerate(columns)}
    for few, parts in ((4096, 128), (20, 8), (2, 3)):
        monkeypatch.setattr(quantiles, "FEW", few)
        monkeypatch.setattr(quantiles, "PARTS", parts)
        got = quantiles.exact_quantiles(df, [*columns, "nothing"], points)
        assert set(got) == set(columns)
        for c in columns:
            assert np.allclose(got[c], want[c], rtol=1e-12, atol=1e-12), (few, c)
    assert quantiles.exact_quantiles(df.limit(0), [*columns], points) == {}


def test_a_document_is_the_same_for_any_order_of_the_rows(spark):
    rows = [(k, k // 2 if k < 2000 else k, f"name {k % 1700}", float(k % 13), f"u{k}@x.org\n" if k % 2 else f"u{k}@x.org") for k in range(4000)]
    schema = "id long, half long, name string, n double, mail string"
    up, down = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    docs = [engine.pull(spark, [tables.frame_source(d, "t")], {"name": "postgresql", "version": "16"}, exact=True)[0] for d in (up, down, up.repartition(7))]
    assert docs[0] == docs[1] == docs[2]
    table, _, _ = profile.profile_table(tables.frame_source(up, "t"))
    assert table.columns["id"].unique.value is True and table.columns["n"].unique is None or table.columns["n"].unique.value is False
    assert table.columns["name"].unique.value is False and table.columns["mail"].format != "email"
