import random

import pytest

from gaugework import conformance, model
from gaugework.functions import formats, types
from gaugework.model import Column, Constraint, Fact, Index, Reference, Shape, ShapeError, Table, UserType
from gaugework.operators import privacy


def shape():
    users = Table(Fact(1_200_000, "exact"), columns={"id": Column("bigint", False, unique=Fact(True, "exact", "constraint")), "mail": Column("text", True, null_fraction=Fact(0.0123456789), distinct=Fact(900, "measured", "hll", 0.008125), format="email", length={"min": 3, "max": 40, "mean": 17.123456789, "p95": 33})})
    orders = Table(Fact(8_400_000), columns={"user_id": Column("bigint")}, references=[Reference("user_id", "app.users.id", fanout={"mean": 8.4, "p50": 3, "p95": 41, "max": 12902}, orphan_fraction=Fact(0.0, "exact", "constraint"))])
    return Shape(meta={"engine": {"name": "postgresql", "version": "16.2"}, "generated_at": "now"}, tables={"app.users": users, "app.orders": orders}, types={"mood": UserType("enum", ["a", "b"])}, extra={"x_team": "data"})


def test_round_trip_and_digest():
    s = shape()
    text = model.emit(s)
    again = model.parse(text)
    assert model.digest(again) == s.meta["digest"] == model.digest(shape())
    assert again.tables["app.users"].columns["mail"].distinct == Fact(900, "measured", "hll", 0.008125)
    assert again.tables["app.orders"].rows == Fact(8_400_000) and "rows: 8400000" in text and again.extra == {"x_team": "data"}
    other = shape()
    other.meta["generated_at"] = "later"
    assert model.digest(other) == s.meta["digest"]
    other.tables["app.users"].rows.value += 1
    assert model.digest(other) != s.meta["digest"]


def test_golden_digest():
    s = Shape(meta={"engine": {"name": "e", "version": "1"}}, tables={"t": Table(Fact(3, "exact"), columns={"a": Column("text", format="slug")})})
    assert model.canonical(s).decode() == "meta:\n  engine:\n    name: e\n    version: '1'\n  version: '1.0'\ntables:\n  t:\n    columns:\n      a:\n        format: slug\n        nullable: true\n        type: text\n    rows:\n      confidence: exact\n      value: 3\n"


def test_refusals():
    s = shape()
    text = model.emit(s)
    with pytest.raises(ShapeError):
        model.parse(text.replace("1200000", "1200001"))
    with pytest.raises(ShapeError):
        model.parse("meta: {version: '2.0'}\ntables: {}")
    with pytest.raises(ShapeError):
        model.emit(Shape())
    with pytest.raises(ShapeError):
        model.parse("- 1")
    assert model.parse("tables: {t: {rows: 5, later: 1}}").tables["t"].rows == Fact(5)


def test_parser_never_fails_in_another_way():
    random.seed(1)
    text = model.emit(shape())
    for _ in range(60):
        k = random.randrange(len(text))
        broken = text[:k] + random.choice("{}[]:-'\"\n x0") + text[k + random.randrange(3) :]
        try:
            model.parse(broken)
        except Exception as e:
            assert isinstance(e, (ValueError, TypeError, AttributeError)) or "yaml" in type(e).__module__


def test_look_ups():
    s = shape()
    assert s.resolve("users") == "app.users" and s.resolve("app.users") and s.resolve("x.users") is None
    s.tables["b.users"] = Table()
    assert s.resolve("users") is None
    s.types |= {"d1": UserType("domain", base="d2"), "d2": UserType("domain", base="integer"), "loop": UserType("domain", base="loop")}
    assert s.resolve_type("d1") == "integer" and s.resolve_type("loop") == "loop"
    assert UserType("enum", label_count=2).effective_labels() == ["label_1", "label_2"]


def test_confidence_order():
    assert model.weakest() == "exact" and model.weakest("exact", "declared", "measured") == "declared" and model.weakest("absent", "exact") == "absent"
    assert [model.format_float(x) for x in (1200000.0, 0.0000123, 0.5)] == ["1.2e+06", "1.23e-05", "0.5"]
    assert model.over_budget("x" * 400_000, 10) and not model.over_budget("x" * 400_000, 400)


def test_types():
    assert types.category("double precision") == types.category("numeric(10,2)") == "numeric"
    assert types.category("character varying(20)") == types.category("citext") == "text"
    assert types.category("timestamp with time zone") == "temporal" and types.category("int[]") == "other" and types.category("uuid") == "uuid"
    assert types.char_max_length("char") == 1 and types.char_max_length("varchar(20)") == 20 and types.char_max_length("text") is None
    assert types.is_widening("varchar(20)", "varchar(30)") and types.is_widening("varchar(20)", "text") and not types.is_widening("text", "varchar(3)") and not types.is_widening("char(3)", "char(4)")
    assert types.is_narrowing("bigint", "integer") and types.is_narrowing("text", "varchar(9)") and types.is_narrowing("numeric", "integer") and not types.is_narrowing("integer", "bigint")
    assert types.synthesis_category("int4range") == types.synthesis_category("tsvector") == "unsupported" and types.synthesis_category("text[]") == "array"


def test_formats_in_order():
    full = dict.fromkeys([*formats.STRONG, *formats.WEAK, "prose"], 0.0)
    assert formats.classify({**full, "email": 0.96, "hostname": 1.0}, 3) == "email"
    assert formats.classify({**full, "slug": 1.0}, 3) == "enum_like" and formats.classify({**full, "slug": 1.0}, 99) == "slug"
    assert formats.classify({**full, "numeric_string": 1.0, "hex": 1.0}, 99) == "numeric_string"
    assert formats.classify({**full, "prose": 0.5}, 99) == "free_text" and formats.classify(full, 99) == "opaque" and formats.classify({"prose": None}, 1) == "opaque"


def test_skeletons_merge_in_any_order():
    random.seed(7)
    values = [{"a": 1, "b": [1, "x"]}, {"a": "s", "c": None}, {"b": [], "a": True}, {"b": {"d": 1}}, [1], 3]
    shapes = [formats.skeleton(v) for v in values]
    assert formats.merge(shapes[0], shapes[1]) == {"a": "number|string", "b": ["number|string"], "c": "null"}
    assert formats.merge(formats.skeleton({"b": [1]}), formats.skeleton({"b": {"d": 1}})) == {"b": "mixed"}
    results = set()
    for _ in range(20):
        random.shuffle(shapes)
        out = shapes[0]
        for s in shapes[1:]:
            out = formats.merge(out, s)
        results.add(str(out))
    assert results == {"mixed"}


def test_privacy_levels():
    def made():
        c = Column("text", distinct=Fact(2, "measured"), values=["a", "b"], frequencies=[0.9, 0.1], range={"min": 1, "max": 2})
        return Shape(tables={"t": Table(Fact(1000), columns={"c": c, "s": Column("bigint", range={"min": 1}, redact=["all"])}, constraints=[Constraint("check", "k", [], "c > 1")])}, types={"e": UserType("enum", ["x", "y"])})

    strict = privacy.apply_privacy(made(), "strict")
    assert strict.tables["t"].columns["c"].range is None and strict.tables["t"].constraints[0].expression == "opaque" and strict.types["e"].label_count == 2 and not strict.types["e"].labels
    standard = privacy.apply_privacy(made(), "standard")
    assert standard.tables["t"].columns["c"].range and standard.tables["t"].columns["c"].values is None and standard.tables["t"].columns["s"].range is None
    assert privacy.apply_privacy(made(), "permissive").tables["t"].columns["c"].values == ["a", "b"]
    assert privacy.apply_privacy(made(), "permissive", 200).tables["t"].columns["c"].values is None
    with pytest.raises(ShapeError):
        privacy.apply_privacy(made(), "none")
    assert privacy.same_place("127.0.0.9", "LOCALHOST.") and not privacy.same_place("a", "b")
    with pytest.raises(ShapeError):
        privacy.refuse_source("/data/x/y", "/data/x/")


def test_conformance():
    good = shape()
    assert conformance.check_emitter(good) == []
    bad = shape()
    bad.tables["app.users"].columns |= {"a": Column("text", range={"min": "x"}), "b": Column("bigint", unique=Fact(True, "estimated")), "c": Column("citext")}
    bad.tables["app.users"].indexes = [Index("i", ["a"], include=["a"]), Index("j")]
    bad.types["n"] = UserType("enum")
    assert len(conformance.check_emitter(bad)) == 6
