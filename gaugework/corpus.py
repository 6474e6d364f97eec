"""A corpus of changes with the verdict that each must get: the engine's contract, case by case."""

from __future__ import annotations

from .engine import validate
from .model import Column, Fact, Index, Reference, Shape, Table
from .plans.statements import split


def _shape(tables: dict[str, Table], version: str = "16") -> Shape:
    return Shape(meta={"engine": {"name": "postgresql", "version": version}}, tables=tables)


def _table(rows: int, columns: dict[str, Column] | None = None, confidence: str = "exact", **more) -> Table:
    return Table(Fact(rows, confidence), columns={"id": Column("bigint", False), **(columns or {})}, **more)


def _mail(**facts) -> dict[str, Column]:
    return {"mail": Column("text", True, **facts)}


_TAIL = {"mean": 9.1, "p50": 4, "p95": 50, "max": 15000, "confidence": "measured"}
_KEY = "ALTER TABLE visit ADD CONSTRAINT visit_member FOREIGN KEY (member_id) REFERENCES member(id) NOT VALID;"
_VALIDATE = "ALTER TABLE visit VALIDATE CONSTRAINT visit_member;"


def _visits(orphans: float, confidence: str = "exact", **more) -> dict[str, Table]:
    reference = Reference("member_id", "member.id", "visit_member", orphan_fraction=Fact(orphans, confidence), **more)
    return {"member": _table(90_000), "visit": _table(700_000, {"member_id": Column("bigint")}, references=[reference])}


#: name: (shape, change, verdict, {(code, severity)})
CASES: dict[str, tuple[Shape, str, str, list[tuple[str, str]]]] = {
    "not_null_estimated": (_shape({"member": _table(300_000, _mail(null_fraction=Fact(0.0)))}), "ALTER TABLE member ALTER COLUMN mail SET NOT NULL", "WARN", [("RS-DATA-001", "warn")]),
    "not_null_exact": (_shape({"member": _table(300_000, _mail(null_fraction=Fact(0.0, "exact")))}), "ALTER TABLE member ALTER COLUMN mail SET NOT NULL", "PASS", []),
    "not_null_has_nulls": (_shape({"member": _table(300_000, _mail(null_fraction=Fact(0.04, "exact")))}), "ALTER TABLE member ALTER mail SET NOT NULL", "FAIL", [("RS-DATA-001", "error")]),
    "not_null_maybe_nulls": (_shape({"member": _table(300_000, _mail(null_fraction=Fact(0.04)))}), "ALTER TABLE member ALTER mail SET NOT NULL", "WARN", [("RS-DATA-001", "warn")]),
    "not_null_unknown": (_shape({"member": _table(300_000)}), "ALTER TABLE member ALTER mail SET NOT NULL", "WARN", [("RS-DATA-001", "warn")]),
    "unique_unproven": (_shape({"member": _table(300_000, _mail(distinct=Fact(299_000)))}), "ALTER TABLE member ADD CONSTRAINT u UNIQUE (mail)", "WARN", [("RS-DATA-014", "warn"), ("RS-INDEX-002", "warn")]),
    "unique_proven": (_shape({"member": _table(300_000, _mail(unique=Fact(True, "exact", "probe")))}), "ALTER TABLE member ADD CONSTRAINT u UNIQUE (mail)", "WARN", [("RS-INDEX-002", "warn")]),
    "unique_broken": (_shape({"member": _table(300_000, _mail(unique=Fact(False, "exact", "probe")))}), "ALTER TABLE member ADD CONSTRAINT u UNIQUE (mail)", "FAIL", [("RS-DATA-014", "error"), ("RS-INDEX-002", "warn")]),
    "unique_not_exact": (_shape({"member": _table(300_000, _mail(unique=Fact(False, "measured")))}), "ALTER TABLE member ADD UNIQUE (mail)", "WARN", [("RS-DATA-014", "warn"), ("RS-INDEX-002", "warn")]),
    "unique_composite": (_shape({"member": _table(300_000, _mail(unique=Fact(True, "exact")))}), "ALTER TABLE member ADD UNIQUE (id, mail)", "WARN", [("RS-DATA-014", "warn"), ("RS-INDEX-002", "warn")]),
    "unique_using_index": (_shape({"member": _table(300_000)}), "ALTER TABLE member ADD CONSTRAINT u UNIQUE USING INDEX u_idx", "PASS", []),
    "unique_index_broken": (_shape({"member": _table(300_000, _mail(unique=Fact(False, "exact")))}), "CREATE UNIQUE INDEX CONCURRENTLY u ON member (mail)", "FAIL", [("RS-INDEX-010", "error")]),
    "unique_index_unproven": (_shape({"member": _table(300_000, _mail())}), "CREATE UNIQUE INDEX u ON member (mail)", "WARN", [("RS-INDEX-001", "warn"), ("RS-INDEX-010", "warn")]),
    "unique_index_partial": (_shape({"member": _table(300_000, _mail(unique=Fact(False, "exact")))}), "CREATE UNIQUE INDEX u ON member (mail) WHERE gone_at IS NULL", "WARN", [("RS-INDEX-001", "warn"), ("RS-INDEX-010", "warn")]),
    "unique_index_expression": (_shape({"member": _table(300_000, _mail(unique=Fact(True, "exact")))}), "CREATE UNIQUE INDEX CONCURRENTLY u ON member (lower(mail))", "WARN", [("RS-INDEX-010", "warn")]),
    "orphans": (_shape(_visits(0.006)), _KEY + _VALIDATE, "FAIL", [("RS-CONSTRAINT-001", "warn"), ("RS-DATA-020", "error")]),
    "orphans_estimated": (_shape(_visits(0.006, "estimated")), _KEY + "COMMIT;" + _VALIDATE, "WARN", [("RS-DATA-020", "warn")]),
    "no_orphans_two_transactions": (_shape(_visits(0.0)), "BEGIN;" + _KEY + "COMMIT; BEGIN;" + _VALIDATE + "COMMIT;", "PASS", []),
    "no_orphans_one_transaction": (_shape(_visits(0.0)), "BEGIN;" + _KEY + _VALIDATE + "COMMIT;", "WARN", [("RS-CONSTRAINT-001", "warn")]),
    "key_validated_at_once": (_shape(_visits(0.2)), "ALTER TABLE visit ADD CONSTRAINT visit_member FOREIGN KEY (member_id) REFERENCES member(id)", "FAIL", [("RS-DATA-020", "error")]),
    "cascade_delete": (_shape(_visits(0.0, on_delete="cascade", fanout=_TAIL)), "DELETE FROM member WHERE id < 5", "WARN", [("RS-PERF-001", "warn")]),
    "cascade_truncate": (_shape(_visits(0.0, on_delete="cascade", fanout=_TAIL)), "TRUNCATE TABLE member CASCADE", "WARN", [("RS-PERF-001", "warn")]),
    "no_cascade": (_shape(_visits(0.0, fanout=_TAIL)), "DELETE FROM member WHERE id < 5", "PASS", []),
    "update_all": (_shape({"bank.account": _table(5_000_000)}), "UPDATE bank.account SET state = 'where are you'", "WARN", [("RS-PERF-002", "warn")]),
    "update_all_short_name": (_shape({"bank.account": _table(5_000_000)}), "UPDATE account SET state = 'x'", "WARN", [("RS-PERF-002", "warn")]),
    "update_small": (_shape({"bank.account": _table(900)}), "UPDATE account SET state = 'x'", "PASS", []),
    "delete_some": (_shape({"bank.account": _table(5_000_000)}), "DELETE FROM account WHERE id = 1", "PASS", []),
    "check_broken": (_shape({"account": _table(9_000, {"cents": Column("bigint", range={"min": -300, "max": 9000, "confidence": "exact"})})}), "ALTER TABLE account ADD CONSTRAINT c CHECK (cents >= 0)", "FAIL", [("RS-CONSTRAINT-010", "error")]),
    "check_sampled": (_shape({"account": _table(9_000, {"cents": Column("bigint", range={"min": 3, "max": 9000, "confidence": "estimated"})})}), "ALTER TABLE account ADD CONSTRAINT c CHECK (0 < cents)", "WARN", [("RS-CONSTRAINT-010", "warn")]),
    "check_kept": (_shape({"account": _table(9_000, {"cents": Column("bigint", range={"min": 3, "max": 9000, "confidence": "exact"})})}), "ALTER TABLE account ADD CONSTRAINT c CHECK (cents > 0)", "PASS", []),
    "volatile_default": (_shape({"visit": _table(4_000_000)}), "ALTER TABLE visit ADD COLUMN tag uuid DEFAULT gen_random_uuid()", "WARN", [("RS-LOCK-001", "warn")]),
    "stable_default": (_shape({"visit": _table(4_000_000)}), "ALTER TABLE visit ADD COLUMN seen timestamptz DEFAULT now()", "PASS", []),
    "stable_default_old_engine": (_shape({"visit": _table(4_000_000)}, "10"), "ALTER TABLE visit ADD COLUMN seen int DEFAULT 0", "WARN", [("RS-LOCK-001", "warn")]),
    "type_rewrite": (_shape({"visit": _table(4_000_000, {"n": Column("integer")})}), "ALTER TABLE visit ALTER COLUMN n TYPE bigint", "WARN", [("RS-LOCK-001", "warn")]),
    "type_widened": (_shape({"visit": _table(4_000_000, {"n": Column("varchar(20)")})}), "ALTER TABLE visit ALTER COLUMN n TYPE varchar(40)", "PASS", []),
    "type_narrowed": (_shape({"visit": _table(4_000_000, {"n": Column("bigint")})}), "ALTER TABLE visit ALTER COLUMN n TYPE integer", "WARN", [("RS-LOCK-001", "warn"), ("RS-REVERSE-003", "warn")]),
    "index_blocking": (_shape({"visit": _table(6_000_000)}), "CREATE INDEX i ON visit (id)", "WARN", [("RS-INDEX-001", "warn")]),
    "index_concurrent": (_shape({"visit": _table(6_000_000)}), "CREATE INDEX CONCURRENTLY i ON visit (id)", "PASS", []),
    "primary_key": (_shape({"visit": _table(6_000_000)}), "ALTER TABLE visit ADD PRIMARY KEY (id)", "WARN", [("RS-INDEX-002", "warn")]),
    "reindex": (_shape({"visit": _table(6_000_000, indexes=[Index("visit_i", ["id"], bytes=4_000_000_000, bloat_estimate=0.4)])}), "REINDEX INDEX visit_i", "WARN", [("RS-INDEX-020", "warn")]),
    "reindex_concurrent": (_shape({"visit": _table(6_000_000, indexes=[Index("visit_i", ["id"], bytes=4_000_000_000)])}), "REINDEX INDEX CONCURRENTLY visit_i", "PASS", []),
    "drop_column": (_shape({"visit": _table(6_000_000)}), "ALTER TABLE visit DROP COLUMN note", "WARN", [("RS-REVERSE-001", "warn")]),
    "drop_table": (_shape({"visit": _table(6_000_000)}), "DROP TABLE IF EXISTS visit", "WARN", [("RS-REVERSE-002", "warn")]),
    "statement_rejected": (_shape({"visit": _table(6_000_000)}), "ALTER TABLE vist ADD COLUMN note text", "FAIL", [("RS-APPLY-001", "error")]),
    "statement_on_new_table": (_shape({"visit": _table(6_000_000)}), "CREATE TABLE note (id bigint); ALTER TABLE note ADD COLUMN body text", "PASS", []),
    "words_in_comment": (_shape({"visit": _table(6_000_000)}), "-- DROP TABLE visit;\nSELECT 1", "PASS", []),
}

#: A script, and (line, kind of change) of each of its statements.
STATEMENTS = (
    "-- first\nBEGIN;\nCREATE INDEX i ON t (a); /* a ; in a comment */ UPDATE t SET a = 'x;y';\nCOMMIT;\n\nDO $body$ begin; end $body$;\nALTER TABLE t\n  ADD COLUMN b text DEFAULT E'a\\';b';\nDROP TABLE \"odd;name\"",
    [(2, "tx"), (3, "create_index"), (3, "update"), (4, "tx"), (6, "other"), (7, "add_column"), (9, "drop_table")],
)


def case_rows() -> list[tuple[str, str, str]]:
    """(case, verdict, findings) as the engine gives them."""
    out = []
    for name, (shape, sql, _, _) in CASES.items():
        result = validate(None, shape, split(sql, f"{name}.sql"), names=True)
        out.append((name, result.verdict, ",".join(sorted(f"{f.code}:{f.severity}" for f in result.findings))))
    return out
