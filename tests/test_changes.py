import json
import random

import pytest

from gaugework import engine
from gaugework.corpus import CASES, STATEMENTS
from gaugework.model import Column, Constraint, Fact, Index, Reference, Shape, ShapeError, Table, UserType
from gaugework.operators import checks
from gaugework.plans import ddl, drift, rules, statements, verdict
from gaugework.sources.tables import Source


@pytest.mark.parametrize("name", CASES)
def test_corpus(name):
    shape, sql, expected, found = CASES[name]
    result = engine.validate(None, shape, statements.split(sql, "m.sql"), names=True)
    assert result.verdict == expected
    assert sorted((f.code, f.severity) for f in result.findings) == sorted(found)
    for f in result.findings:
        assert f.remediation and f.location["file"] == "m.sql"


def test_capped_findings_name_the_resolving_command():
    shape, sql, *_ = CASES["not_null_estimated"]
    finding = engine.validate(None, shape, statements.split(sql)).findings[0]
    assert "pull --exact --table member" in finding.detail and finding.confidence == "estimated"


def test_splitter():
    got = statements.split(STATEMENTS[0])
    assert [(s.line, statements.changes(s.sql)[0].kind) for s in got] == STATEMENTS[1]
    assert statements.split(" ; ;; -- only\n /* c */ ") == []
    assert statements.without_comments("SELECT  '--x' /* a */ , 1 -- b") == "SELECT '--x' , 1"


def test_splitter_on_random_scripts():
    random.seed(3)
    bits = ["SELECT 1", "'a;b'", "$$;$$", "$t$ ; $t$", "-- c;\n", "/* ; */", '"q;"', "E'\\';'", ";", " ", "\n", "'", "$", "(", ")"]
    for _ in range(400):
        sql = "".join(random.choices(bits, k=random.randint(0, 12)))
        got = statements.split(sql)
        assert all(s.sql.strip() and 1 <= s.line <= sql.count("\n") + 1 for s in got)
        assert [s.sql for s in statements.split(";\n".join(s.sql for s in got) + ";")] == [s.sql for s in got] or "'" in sql or "--" in sql or "$" in sql or "/*" in sql
        statements.changes(sql)


def test_splitter_is_linear():
    import time

    began = time.perf_counter()
    assert len(statements.split("INSERT INTO t VALUES (1, 'x;y');\n" * 1000)) == 1000
    assert time.perf_counter() - began < 0.5


def test_comparisons():
    assert statements.comparison("(a >= -5)") == statements.Comparison("a", ">=", -5.0)
    assert statements.comparison("0 < a") == statements.Comparison("a", ">", 0.0)
    assert statements.comparison("a > 1 AND b < 2") is None and statements.comparison("f(a) > 1") is None


def test_estimates():
    assert [verdict.bucket(x) for x in (99, 100, 999, 9_999, 59_999, 60_000)] == ["instant", "fast", "fast", "noticeable", "slow", "outage"]
    e = verdict.extrapolate("table_rewrite", 12_000, 90, 1_200_000, "exact")
    assert (e.bucket, e.model, e.confidence) == ("noticeable", "linear", "estimated")
    assert verdict.predict_ms("n_log_n", 1, 5, 100) == 500 and verdict.predict_ms("constant", 9, 5, 10**9) == 5 and verdict.predict_ms("linear", 10, 0, 9) == 0
    assert verdict.extrapolate("index_concurrently", 1000, 60, 1000, "measured").bucket == "fast"
    c = verdict.calibrate("table_rewrite", (1000, 50), (2000, 90), 10_000, "exact")
    assert c.bucket == "fast" and c.confidence == "measured" and c.basis_rows == 2000
    assert verdict.calibrate("table_rewrite", (1000, 90), (2000, 50), 10**6, "estimated").bucket == "instant"
    with pytest.raises(ShapeError):
        verdict.calibrate("table_rewrite", (10, 1), (10, 2), 5, "exact")


def test_no_estimate_without_engine_or_table():
    shape = Shape(tables={"t": Table(Fact(10**7, "exact"))})
    sql = statements.split("CREATE INDEX i ON t (a); CREATE INDEX j ON gone (a)")
    findings = engine.validate(None, shape, sql).findings
    assert [f.estimate for f in findings] == [None, None] and findings[1].confidence == "absent"


def test_result_contract():
    r = verdict.Result("WARN", [verdict.Finding("RS-X", "warn", "a|b", location={"file": "d,x.sql", "line": 3})])
    assert (r.exit_code(), r.exit_code(True), verdict.Result("FAIL", []).exit_code(), verdict.Result("PASS", []).exit_code()) == (2, 1, 1, 0)
    assert json.loads(verdict.Result("PASS", []).json())["findings"] == []
    assert verdict.annotations(r) == "::warning file=d%2Cx.sql,line=3,title=RS-X::a|b\n" and "a\\|b" in verdict.summary(r) and "d,x.sql:3" in verdict.human(r)
    for bad in (verdict.Result("MAYBE", []), verdict.Result("FAIL", [verdict.Finding("RS-X", "error", "t")]), verdict.Result("WARN", [verdict.Finding("", "warn", "t")]), verdict.Result("WARN", [verdict.Finding("RS-X", "bad", "t")])):
        with pytest.raises(ShapeError):
            bad.check()
    s = verdict.attestation(r, {"m.sql": b"x"})
    assert s["subject"][1]["digest"]["sha256"].startswith("2d711642") and s["predicate"]["verdict"] == "WARN"
    assert json.loads(verdict.ToolError("timeout", "t").json())["exit"] == 3


def test_failed_and_unfinished_changes():
    shape = Shape(tables={"t": Table(Fact(1, "exact"))})
    failed = rules.Capture([rules.Applied("SELECT x", "m.sql", 4, error_code="42703", error="no x")], success=False)
    r = verdict.build(shape, rules.analyse(shape, failed), failed)
    assert r.verdict == "FAIL" and r.findings[0].code == "RS-APPLY-001" and r.findings[0].location["line"] == 4
    late = rules.Capture([rules.Applied("SELECT x", timed_out=True)], timed_out=True)
    assert verdict.build(shape, [], late).verdict == "WARN"
    error = verdict.Finding("RS-DATA-014", "error", "t", remediation="r")
    assert [f.code for f in verdict.build(shape, [error, *rules.analyse(shape, failed)], failed).findings] == ["RS-DATA-014"]


def test_rules_can_be_registered():
    def rule(shape, capture):
        return [verdict.Finding("RS-OWN-001", "warn", "own")]

    rules.register(rule)
    try:
        assert engine.validate(None, Shape(), []).findings[0].code == "RS-OWN-001"
    finally:
        rules.RULES.remove(rule)


def test_catalogue():
    assert len(rules.CATALOG) == 16 and engine.explain("rs-lock-001")["remediation"]
    with pytest.raises(verdict.ToolError):
        engine.explain("RS-NONE-1")


def test_ddl():
    t = Table(Fact(5), columns={"id": Column("bigint", False, identity="always"), "kind": Column("mood"), "n": Column("integer", default="nextval('s.q'::regclass)"), "g": Column("integer", generated="stored", generated_expression="n + 1"), "o": Column("text", default="opaque")},
              constraints=[Constraint("primary_key", "t_pkey", ["id"]), Constraint("check", "ok", [], "n > 0", validated=False)], indexes=[Index("i", ["n"], include=["g"], predicate="n > 3"), Index("t_pkey", ["id"], unique=True)],
              references=[Reference("id", "s.p.a", "fk"), Reference("n", "s.p.b", "fk")])
    p = Table(Fact(1), columns={"a": Column("bigint", False), "b": Column("integer", False)}, partitions={"count": 2, "strategy": "hash", "key": "a"})
    shape = Shape(tables={"s.t": t, "s.p": p}, types={"mood": UserType("enum", label_count=1), "d": UserType("domain", base="integer", check="VALUE > 0")}, extensions=["citext"])
    text = "\n".join(ddl.ddl(shape))
    order = [text.index(x) for x in ("CREATE SCHEMA", "CREATE EXTENSION", "CREATE SEQUENCE", "CREATE TYPE", "CREATE DOMAIN", "CREATE TABLE")]
    assert order == sorted(order) and "GENERATED ALWAYS AS (n + 1) STORED" in text and "PARTITION BY HASH" in text and "REMAINDER 1" in text
    assert ddl.secondary_indexes(shape) == ['CREATE INDEX "i" ON "s"."t" USING btree ("n") INCLUDE ("g") WHERE n > 3;']
    assert ddl.deferred(shape) == ['ALTER TABLE "s"."t" ADD CONSTRAINT "ok" CHECK (n > 0) NOT VALID;', 'ALTER TABLE "s"."t" ADD CONSTRAINT "fk" FOREIGN KEY ("id", "n") REFERENCES "s"."p" ("a", "b");']
    assert ddl.unreproducible(shape) == ["s.t.o: its default is withheld"] and ddl.identity_resets(shape)
    assert ddl.spark_ddl(shape, "s.p") == "`a` bigint NOT NULL, `b` int NOT NULL"


def test_plan_and_redaction():
    live = Shape(tables={"a.t": Table(columns={"x": Column("bigint")})})
    items = drift.plan_items(statements.split("ALTER TABLE t ADD COLUMN x int; ALTER TABLE t DROP COLUMN y; ALTER TABLE u ADD COLUMN z int; CREATE TABLE a.t (i int); CREATE INDEX i ON t (x); BEGIN"), live)
    assert [i["status"] for i in items] == ["conflict", "missing-target", "missing-target", "conflict", "ok"]
    assert drift.redact_url("postgres://me:pw@host:5/db") == "postgres://redacted@host:5/db" and drift.redact_url("/x") == "/x"
    assert drift.normal_type("varchar( 20 )") == "character varying(20)" and drift.normal_type("int8") == "bigint" and drift.normal_type("char") == "character(1)"


def test_agent_tools():
    shape, sql, expected, _ = CASES["unique_broken"]
    assert engine.validate_migration(shape, sql)["verdict"] == expected
    assert engine.describe_shape(shape)["member"]["columns"] == 2 and engine.describe_shape(shape, "member")["mail"]["type"] == "text"
    assert engine.plan_against("ALTER TABLE member DROP COLUMN nope", shape)[0]["status"] == "missing-target"
    assert engine.explain_finding("RS-DATA-014")["code"] == "RS-DATA-014"


def test_runner_detection(tmp_path):
    assert engine.detect_runner(tmp_path) is None
    (tmp_path / "migrations").mkdir()
    (tmp_path / "migrations" / "1.sql").write_text("SELECT 1;")
    assert engine.detect_runner(tmp_path) == "raw_sql" and len(engine.read_migrations(tmp_path / "migrations")) == 1
    (tmp_path / "alembic.ini").write_text("")
    assert engine.detect_runner(tmp_path) == "alembic"
    with pytest.raises(verdict.ToolError):
        engine.read_migrations(tmp_path / "none.sql")


@pytest.fixture(scope="module")
def small(spark):
    return {
        "t": spark.createDataFrame([(1, None, "x", True), (2, 5, "x", False), (3, 6, None, True)], "id long, a int, s string, live boolean"),
        "c": spark.createDataFrame([("n", 5, 1), ("m", 6, 2), ("o", 7, 3)], "name string, id long, a int"),
    }


@pytest.mark.parametrize(
    "sql, code",
    [
        ("ALTER TABLE t ALTER a SET NOT NULL", "23502"),
        ("UPDATE t SET a=0 WHERE a IS NULL; ALTER TABLE t ALTER a SET NOT NULL", ""),
        ("UPDATE t AS x SET a = x.id, s = 'a''b' WHERE x.a IS NULL; ALTER TABLE t ALTER a SET NOT NULL", ""),
        ("UPDATE t SET a=0 WHERE id = 9; ALTER TABLE t ALTER a SET NOT NULL", "23502"),
        ("DELETE FROM t WHERE a IS NULL; ALTER TABLE t ALTER a SET NOT NULL", ""),
        ("DELETE FROM t; ALTER TABLE t ALTER a SET NOT NULL", ""),
        ("ALTER TABLE t ADD COLUMN z int DEFAULT 0; ALTER TABLE t ALTER z SET NOT NULL", ""),
        ("ALTER TABLE t ADD COLUMN z int; ALTER TABLE t ALTER z SET NOT NULL", "23502"),
        ("ALTER TABLE t ADD COLUMN z int NOT NULL", "23502"),
        ("ALTER TABLE t ADD COLUMN z int NOT NULL DEFAULT 4", ""),
        ("ALTER TABLE t ADD COLUMN a int", "42701"),
        ("ALTER TABLE t ADD COLUMN IF NOT EXISTS a int", ""),
        ("CREATE TABLE n (id bigint, b text, PRIMARY KEY (id)); ALTER TABLE n ADD COLUMN c int NOT NULL; ALTER TABLE n ALTER b SET NOT NULL", ""),
        ("CREATE TABLE t (id bigint)", "42P07"),
        ("ALTER TABLE t RENAME COLUMN a TO b; ALTER TABLE t DROP COLUMN b", ""),
        ("ALTER TABLE t RENAME COLUMN a TO b; ALTER TABLE t DROP COLUMN a", "42703"),
        ("ALTER TABLE t RENAME TO u; ALTER TABLE u DROP COLUMN a", ""),
        ("ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES c(id)", ""),
        ("ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES c(a)", "23503"),
        ("ALTER TABLE t ADD FOREIGN KEY (a, id) REFERENCES c(id, a)", "23503"),
        ("ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES c(nope)", "42703"),
        ("CREATE UNIQUE INDEX u ON t (s) WHERE live", ""),
        ("CREATE UNIQUE INDEX u ON t (s) WHERE id < 3", "23505"),
        ("CREATE UNIQUE INDEX u ON t (lower(s))", "23505"),
        ("INSERT INTO t VALUES (4, 5, 'y', true); ALTER TABLE t ADD UNIQUE (a)", "23505"),
        ("INSERT INTO t (id, s) VALUES (4, 'y'), (5, 'z'); ALTER TABLE t ADD UNIQUE (a)", ""),
        ("TRUNCATE t; ALTER TABLE t ALTER a SET NOT NULL", ""),
        ('UPDATE t SET "a" = 1 WHERE "a" IS NULL; ALTER TABLE t ALTER a SET NOT NULL', ""),
    ],
)
def test_apply_carries_changes_of_rows_out(spark, small, sql, code):
    capture = checks.apply(spark, statements.split(sql), small)
    assert next((s.error_code for s in capture.statements if s.error_code), "") == code and not capture.undecided


@pytest.mark.parametrize(
    "sql",
    [
        "UPDATE t SET a = unheard_of(a); ALTER TABLE t ALTER a SET NOT NULL",
        "UPDATE t SET a = c.a FROM c WHERE c.id = t.id; ALTER TABLE t ALTER a SET NOT NULL",
        "INSERT INTO t SELECT * FROM c; ALTER TABLE t ALTER a SET NOT NULL",
        "CREATE TABLE n AS SELECT * FROM t; ALTER TABLE n ALTER a SET NOT NULL",
    ],
)
def test_what_rows_cannot_decide_never_fails(spark, small, sql):
    capture = checks.apply(spark, statements.split(sql), small)
    assert capture.undecided and (capture.success or "n ALTER" in sql)


def test_ground_truth_after_a_backfill(spark, small):
    source = Source("t", small["t"])
    engine_ = {"name": "postgresql", "version": "16"}
    assert engine.ground_truth(spark, [source], engine_, statements.split("ALTER TABLE t ALTER a SET NOT NULL")).verdict == "FAIL"
    assert engine.ground_truth(spark, [source], engine_, statements.split("UPDATE t SET a=0 WHERE a IS NULL; ALTER TABLE t ALTER a SET NOT NULL")).verdict == "PASS"


@pytest.mark.parametrize("kind", ["double", "float", "decimal(12,2)"])
def test_a_change_to_whole_numbers_rounds(spark, kind):
    made = spark.createDataFrame([(1, 32767.75), (2, 0.75), (3, 1.25)], "id long, x double")
    made = made.selectExpr("id", f"cast(x as {kind}) as x", "cast(x as string) as s")
    code = lambda sql, rows: next((s.error_code for s in checks.apply(spark, statements.split(sql), {"t": rows}).statements if s.error_code), "")
    assert code("ALTER TABLE t ALTER x TYPE smallint", made) != ""
    assert code("ALTER TABLE t ALTER x TYPE integer", made) == ""
    # 0.75 and 1.25 become the same number.
    assert code("ALTER TABLE t ALTER x TYPE integer; ALTER TABLE t ADD UNIQUE (x)", made) == "23505"
    # A text with a fraction is no whole number.
    assert code("ALTER TABLE t ALTER s TYPE integer", made) != ""
