"""Verdicts: cost estimates, capping by the weakest fact, combining, and the forms a result is shown in."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NAMES, RANKS, Shape, ShapeError, facts_frame, weakest

CONTRACT = "1"
VERDICTS = {"PASS": 0, "WARN": 1, "FAIL": 2}
SEVERITIES = ("error", "warn", "info")
# Exit codes, duration buckets (upper ends in ms), index rebuild speed.
EXIT_PASS, EXIT_FAIL, EXIT_WARN, EXIT_TOOL = 0, 1, 2, 3
BUCKETS = (("instant", 100), ("fast", 1_000), ("noticeable", 10_000), ("slow", 60_000), ("outage", math.inf))
REINDEX_BYTES_PER_MS = 50 * 1024 * 1024 // 1000
# How the work of each kind of operation grows, and how often it passes over the data.
MODELS = {"catalog_only": "constant", "table_rewrite": "linear", "constraint_validation": "linear", "btree_build": "n_log_n", "index_concurrently": "n_log_n"}
PASSES = {"index_concurrently": 2}


@dataclass
class Estimate:
    bucket: str
    model: str
    basis_rows: int = 0
    basis_ms: int = 0
    declared_rows: int = 0
    confidence: str = "estimated"


@dataclass
class Finding:
    code: str
    severity: str
    title: str
    detail: str = ""
    location: dict | None = None
    evidence: dict = field(default_factory=dict)
    estimate: Estimate | None = None
    depends_on: list[str] = field(default_factory=list)
    confidence: str = ""
    remediation: str = ""
    explain: str = ""

    def dump(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, "", [], {})}


@dataclass
class Result:
    verdict: str
    findings: list[Finding]
    id: str = ""
    digest: str = ""
    duration_ms: int = 0
    warnings: list[str] = field(default_factory=list)

    def dump(self) -> dict:
        return {"contract": CONTRACT, "verdict": self.verdict, "shape": {"id": self.id, "digest": self.digest}, "duration_ms": self.duration_ms, "findings": [f.dump() for f in self.findings], "warnings": self.warnings}

    def json(self) -> str:
        return json.dumps(self.dump(), ensure_ascii=False, default=str)

    def exit_code(self, warn_fails: bool = False) -> int:
        return {"FAIL": EXIT_FAIL, "WARN": EXIT_FAIL if warn_fails else EXIT_WARN}.get(self.verdict, EXIT_PASS)

    def check(self) -> Result:
        """What every result must keep to before it is shown."""
        if self.verdict not in VERDICTS:
            raise ShapeError(f"unknown verdict {self.verdict}")
        for f in self.findings:
            if not f.code:
                raise ShapeError("a finding has no code")
            if f.severity not in SEVERITIES:
                raise ShapeError(f"{f.code} has the unknown severity {f.severity}")
            if f.severity == "error" and not f.remediation:
                raise ShapeError(f"{f.code} is an error without remediation")
        return self


# Estimates


def bucket(ms: float) -> str:
    return next(name for name, end in BUCKETS if ms < end)


def bucket_of_bytes(size: int) -> str:
    return bucket(max(0, size) / REINDEX_BYTES_PER_MS)


def work(model: str, rows: float) -> float:
    return 1.0 if model == "constant" else float(rows) if model == "linear" or rows <= 1 else rows * math.log2(rows)


def predict_ms(model: str, basis_rows: int, basis_ms: int, rows: int) -> float:
    """Time at `rows` from one measured point; without a usable width of the basis, time for each row."""
    if basis_ms <= 0:
        return 0.0
    if rows <= 0 or model == "constant":
        return float(basis_ms)
    if basis_rows <= (1 if model == "n_log_n" else 0):
        return float(basis_ms) * rows
    return basis_ms * (work(model, max(2, rows) if model == "n_log_n" else rows) if rows > 1 or model == "linear" else rows * 1.0) / work(model, basis_rows)


def extrapolate(operation: str, basis_rows: int, basis_ms: int, rows: int, confidence: str) -> Estimate:
    model = MODELS[operation]
    ms = predict_ms(model, basis_rows, basis_ms, rows) * PASSES.get(operation, 1)
    return Estimate(bucket(ms), model, basis_rows, basis_ms, rows, weakest("estimated", confidence))


def calibrate(operation: str, one: tuple[int, int], two: tuple[int, int], rows: int, confidence: str) -> Estimate:
    """A line through two measured (rows, ms) points in the model's work, never under zero."""
    model = MODELS[operation]
    large = max(one, two)
    if model == "constant":
        ms = float(max(one[1], two[1]))
    else:
        a, b = work(model, one[0]), work(model, two[0])
        if a == b:
            raise ShapeError("both points have the same work, no line goes through them")
        slope = (two[1] - one[1]) / (b - a)
        ms = max(0.0, slope * work(model, rows) + one[1] - slope * a)
    return Estimate(bucket(ms), model, large[0], large[1], rows, weakest("measured", confidence))


def major_version(version: str | None) -> int | None:
    digits = (version or "").strip().split(".")[0].split(" ")[0]
    return int(digits) if digits.isdigit() else None


def bucket_expression(ms: Column) -> Column:
    out = None
    for name, end in BUCKETS[:-1]:
        out = F.when(ms < end, name) if out is None else out.when(ms < end, name)
    return out.otherwise(BUCKETS[-1][0])


def predict_expression(model: Column, basis_rows: Column, basis_ms: Column, rows: Column) -> Column:
    """predict_ms over columns."""
    many = F.greatest(rows, F.lit(2)).cast("double")
    nlogn = F.when(basis_rows <= 1, basis_ms * rows).otherwise(basis_ms * (rows * F.log2(many)) / (basis_rows * F.log2(basis_rows.cast("double"))))
    linear = F.when(basis_rows <= 0, basis_ms * rows).otherwise(basis_ms * (rows / basis_rows))
    grown = F.when(model == "n_log_n", nlogn).otherwise(linear)
    return F.when(basis_ms <= 0, 0.0).when((rows <= 0) | (model == "constant"), basis_ms.cast("double")).otherwise(grown.cast("double"))


# Capping


def ceiling(confidence: str) -> str:
    """The best verdict that facts of this confidence allow."""
    return "PASS" if RANKS[confidence] >= RANKS["measured"] else "WARN"


def combine(*verdicts: str) -> str:
    return max(verdicts, key=VERDICTS.__getitem__, default="PASS")


def wanted(severity: str) -> str:
    """The verdict that a severity argues for; one that isn't known can't certify anything."""
    return {"error": "FAIL", "info": "PASS", "": "PASS"}.get(severity, "WARN")


class FactBook:
    """How well each fact of a document is known, by path."""

    def __init__(self, shape: Shape):
        self.shape = shape

    def confidence(self, path: str) -> str:
        table = max((t for t in self.shape.tables if path.startswith(t + ".")), key=len, default=None)
        if table is None:
            return "absent"
        found, rest = self.shape.tables[table], path[len(table) + 1 :]
        if rest == "rows":
            return found.rows.confidence
        column, _, name = rest.rpartition(".")
        if name in ("orphan_fraction", "fanout"):
            marks = [(r.orphan_fraction.confidence if r.orphan_fraction else "absent") if name == "orphan_fraction" else (r.fanout or {}).get("confidence", "absent") for r in found.references if r.column == column]
            return weakest(*marks) if marks else "absent"
        c = found.columns.get(column)
        if c is None:
            return "absent"
        if name == "range":
            return (c.range or {}).get("confidence", "absent")
        fact = getattr(c, name, None) if name in ("unique", "null_fraction", "distinct") else None
        if name == "unique" and fact and fact.confidence != "exact":
            return "absent"  # uniqueness is proven or it isn't known
        return fact.confidence if fact else "absent"

    def weakest(self, paths: list[str]) -> str:
        return weakest(*map(self.confidence, paths))

    def resolving_command(self, finding: Finding) -> str:
        loose = [p for p in finding.depends_on if RANKS[self.confidence(p)] < RANKS["measured"]]
        table = max((t for t in self.shape.tables if loose and loose[0].startswith(t + ".")), key=len, default="")
        return f"pull --exact --table {table}" if table else "pull --exact"

    def cap(self, want: str, finding: Finding) -> str:
        """A PASS that rests on weak facts becomes a WARN that says how to resolve it; nothing else changes."""
        finding.confidence = self.weakest(finding.depends_on)
        if want == "PASS" and ceiling(finding.confidence) == "WARN":
            finding.severity = "warn" if finding.severity in ("info", "") else finding.severity
            finding.detail = f"{finding.detail} The facts it rests on are {finding.confidence}; `{self.resolving_command(finding)}` settles it.".strip()
            return "WARN"
        return want


def rank_expression(confidence: Column) -> Column:
    pairs = [x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), confidence), F.lit(-1))


def cap_frame(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """findings (id, severity, depends_on array) with confidence and verdict, by the weakest of the facts (path, rank).

    Paths that no fact has count as absent; of several facts with one path the weakest counts; a
    finding that depends on nothing is exact.
    """
    marks = facts.groupBy("path").agg(F.min("rank").alias("rank"))
    each = findings.select("id", F.explode("depends_on").alias("path")).join(marks, "path", "left")
    least = each.groupBy("id").agg(F.min(F.coalesce("rank", F.lit(-1))).alias("rank"))
    out = findings.join(least, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(3)))
    names = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])
    want = F.when(F.col("severity") == "error", "FAIL").when(F.col("severity").isin("info", ""), "PASS").otherwise("WARN")
    verdict = F.when((want == "PASS") & (F.col("rank") < RANKS["measured"]), "WARN").otherwise(want)
    return out.withColumn("confidence", F.element_at(names, F.col("rank"))).withColumn("verdict", verdict).drop("rank")


def combine_frame(findings: DataFrame) -> DataFrame:
    """One row: the strongest verdict; PASS without any finding."""
    rank = F.max(F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "WARN", 1).otherwise(0))
    return findings.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.coalesce(rank, F.lit(0)) + 1).alias("verdict"))


def findings_frame(spark, result: Result) -> DataFrame:
    schema = "code string, severity string, title string, detail string, file string, line int, bucket string, depends_on array<string>, confidence string, remediation string, verdict string"
    rows = [(f.code, f.severity, f.title, f.detail, (f.location or {}).get("file"), (f.location or {}).get("line"), f.estimate.bucket if f.estimate else None, f.depends_on, f.confidence, f.remediation, result.verdict) for f in result.findings]
    return spark.createDataFrame(rows, schema)


def build(shape: Shape, findings: list[Finding], capture=None, ground_truth: bool = False) -> Result:
    """The result of a change: findings capped and combined, floored at FAIL by a rejected statement and at WARN by an unfinished one.

    With ground truth the data themselves were looked at, so no fact can weaken what was found. Clean
    passes aren't shown.
    """
    book, verdicts, shown = FactBook(shape), [], []
    for f in findings:
        want = wanted(f.severity)
        if ground_truth:
            f.confidence, got = "exact", want
        else:
            got = book.cap(want, f)
        verdicts.append(got)
        if not (got == "PASS" and f.severity in ("info", "")):
            shown.append(f)
    verdict = combine(*verdicts)
    if capture is not None and not capture.success:
        verdict = combine(verdict, "FAIL")
        if any(f.severity == "error" and f.code != "RS-APPLY-001" for f in shown):
            shown = [f for f in shown if f.code != "RS-APPLY-001"]
    if capture is not None and (capture.timed_out or capture.undecided):
        verdict = combine(verdict, "WARN")
    return Result(verdict, shown, str(shape.meta.get("id", "")), str(shape.meta.get("digest", "")), capture.duration_ms if capture else 0)


def capped_facts(spark, shape: Shape) -> DataFrame:
    return facts_frame(spark, shape).select("path", "rank")


# Forms of a result


def human(result: Result) -> str:
    lines = [f"{result.verdict}  ({len(result.findings)} finding{'s' * (len(result.findings) != 1)})"]
    for f in result.findings:
        lines.append(f"\n[{f.severity}] {f.code}  {f.title}")
        if f.location:
            lines.append(f"  at {f.location['file']}:{f.location['line']}")
        lines += [f"  {x}" for x in (f.detail, f.estimate and f"expected duration: {f.estimate.bucket} ({f.estimate.model})", f.confidence and f"confidence: {f.confidence}", f.remediation and f"remedy: {f.remediation}") if x]
    return "\n".join(lines) + "\n"


def annotations(result: Result) -> str:
    """A CI command line for each finding that has a place in a file."""

    def data(s: str) -> str:
        return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")

    def prop(s: str) -> str:
        return data(s).replace(":", "%3A").replace(",", "%2C")

    kinds = {"error": "error", "warn": "warning", "info": "notice"}
    return "".join(f"::{kinds.get(f.severity, 'warning')} file={prop(f.location['file'])},line={f.location['line']},title={prop(f.code)}::{data(f.title)}\n" for f in result.findings if f.location)


def summary(result: Result) -> str:
    """A Markdown table of the findings."""

    def cell(s: str) -> str:
        return s.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")

    rows = [f"| {f.severity} | {f.code} | {cell(f.title)} | {cell(f.location['file'] + ':' + str(f.location['line'])) if f.location else ''} |" for f in result.findings]
    return "\n".join([f"### Verdict: {result.verdict}", "", *(["| severity | code | finding | place |", "|---|---|---|---|", *rows] if rows else ["No findings."])]) + "\n"


def attestation(result: Result, migrations: dict[str, bytes]) -> dict:
    """A statement over the document's digest and the digests of the migration files, with the result as its predicate."""
    subjects = [{"name": "shape", "digest": {"sha256": result.digest.removeprefix("sha256:")}}]
    subjects += [{"name": n, "digest": {"sha256": hashlib.sha256(b).hexdigest()}} for n, b in sorted(migrations.items())]
    return {"_type": "https://in-toto.io/Statement/v1", "subject": subjects, "predicateType": "https://in-toto.io/attestation/test-result/v0.1", "predicate": result.dump()}


class ToolError(Exception):
    """A failure of the tool, which is no verdict; category is one of CATEGORIES."""

    CATEGORIES = ("usage", "not_found", "invalid_shape", "unreachable", "refused", "timeout", "internal")

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category if category in self.CATEGORIES else "internal"

    def json(self) -> str:
        return json.dumps({"kind": "tool_error", "category": self.category, "message": str(self), "exit": EXIT_TOOL})
