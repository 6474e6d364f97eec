"""Exact quantiles of numeric columns at any size, by selecting ranks instead of sorting.

All non-null values of a column are one interval at first. Intervals that hold a wanted rank are cut at
approximate quantiles of their own and their parts counted exactly, until a part has few rows or one
value only; then the ranks are read off. Every step is one aggregate with map-side combine over the
rows of the intervals left, and the number of steps grows with the logarithm of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that an interval is cut into, and rows of an interval whose values are read whole.
PARTS, FEW = 16, 4096


@dataclass
class Interval:
    """The values of a column above `low` (None: all) up to `high`; `before` rows lie below."""

    column: str
    low: float | None
    high: float
    least: float
    before: int
    rows: int
    ranks: list[int]

    @property
    def done(self) -> bool:
        return self.rows <= FEW or self.least == self.high

    def has(self, value: str) -> str:
        above = f"{value} IS NOT NULL" if self.low is None else f"{value} > {_literal(self.low)}"
        return f"{above} AND {value} <= {_literal(self.high)}"


def _literal(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def _parts(df: DataFrame, intervals: list[Interval], cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """i (the interval), part (by its cuts) and v of the values within the intervals."""
    cells = []
    for name in dict.fromkeys(x.column for x in intervals):
        value = "cast(`" + name.replace("`", "``") + "` AS double)"
        mine = [(i, x) for i, x in enumerate(intervals) if x.column == name]
        at = " ".join(f"WHEN {x.has(value)} THEN {i}" for i, x in mine)
        part = " ".join(f"WHEN {x.has(value)} THEN size(filter(array({', '.join(map(_literal, cuts[i]))}), c -> c < {value}))" for i, x in mine) if cuts else ""
        cells.append(F.expr(f"struct(CASE {at} END AS i, {f'CASE {part} END' if part else '0'} AS part, {value} AS v)"))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.i", "c.part", "c.v").where("i is not null")


def exact_quantiles(df: DataFrame, columns: list[str], points: list[float]) -> dict[str, list[float]]:
    """The quantiles at the points (0 to 1), interpolated between neighbouring values; columns without values are left out."""
    if not columns:
        return {}
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    got = df.agg(*(f(x).alias(f"{n}{k}") for k, x in enumerate(numbers) for n, f in (("n", F.count), ("l", F.min), ("h", F.max)))).first()
    places, todo, ended = {}, [], []
    for k, name in enumerate(columns):
        rows = got[f"n{k}"]
        if rows:
            places[name] = [p * (rows - 1) for p in points]
            ranks = sorted({r for p in places[name] for r in (math.floor(p), math.ceil(p))})
            todo.append(Interval(name, None, got[f"h{k}"], got[f"l{k}"], 0, rows, ranks))
    while todo:
        ended += [x for x in todo if x.done]
        todo = [x for x in todo if not x.done]
        if not todo:
            break
        shares = [k / PARTS for k in range(1, PARTS)]
        found = _parts(df, todo).groupBy("i").agg(F.percentile_approx("v", shares, 20 * PARTS).alias("q")).collect()
        cuts = {r["i"]: sorted({c for c in r["q"] if c < todo[r["i"]].high}) for r in found}
        if any(not c for c in cuts.values()):
            # Nearly all values are the largest one; half way down is a cut as well.
            cuts = {i: c or [todo[i].least] for i, c in cuts.items()}
        counted = {(r["i"], r["part"]): r for r in _parts(df, todo, cuts).groupBy("i", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("l"), F.max("v").alias("h")).collect()}
        left = []
        for i, x in enumerate(todo):
            before, low = x.before, x.low
            for part in range(len(cuts[i]) + 1):
                r = counted.get((i, part))
                if r is not None:
                    mine = [k for k in x.ranks if before <= k < before + r["n"]]
                    if mine:
                        left.append(Interval(x.column, low, r["h"], r["l"], before, r["n"], mine))
                    before, low = before + r["n"], r["h"]
        todo = left
    values: dict[str, dict[int, float]] = {name: {} for name in places}
    read = [x for x in ended if x.least != x.high]
    rows = {r["i"]: r["vs"] for r in _parts(df, read).groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect()} if read else {}
    for i, x in enumerate(read):
        values[x.column].update((k, rows[i][k - x.before]) for k in x.ranks)
    for x in ended:
        if x.least == x.high:
            values[x.column].update((k, x.high) for k in x.ranks)
    out = {}
    for name, at in places.items():
        known, out[name] = values[name], []
        for p in at:
            below, above = math.floor(p), math.ceil(p)
            out[name].append(known[below] if below == above else (above - p) * known[below] + (p - below) * known[above])
    return out
