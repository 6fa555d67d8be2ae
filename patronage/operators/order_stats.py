"""Exact order statistics in three scans, without sorting or gathering the rows.

A request names a condition, a column and a 0-based rank among the column's
non-missing values; with an id column, rows of equal value are ordered by id.

1. One aggregate makes a mergeable quantile sketch of every requested column
   (``GRID`` + 1 points of ``percentile_approx``) with its count, minimum and
   maximum. The grid points around a rank are its bracket.
2. One aggregate counts, exactly, the rows below, at and between the ends of
   each bracket: the rank is at an end, or inside, or the bracket is widened and
   counted again, so a sketch never decides. For the rows at an end it sketches
   the ids.
3. One grouped count takes the few rows that are left, those inside a bracket
   or between two points of the id sketch, as distinct (value, id) with their
   counts; running counts over that small frame give the row.

The scans read a frame of the needed columns that is written once (``kept``),
not the caller's lineage. Values are compared as doubles; ids in their own
type, the sketch of ids only says where to look.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept
from .rank import prefix_sums

GRID, ACCURACY = 1000, 10_000
#: Grid points that a bracket reaches beyond the rank on either side.
MARGIN = 2


def _sketch(v: Column, points: Column) -> list[Column]:
    return [F.count(v), F.min(v), F.max(v), F.percentile_approx(v, points, ACCURACY)]


def _points() -> Column:
    """0, 1 / GRID, ... 1 as one literal: an array of as many literals costs a call to the driver's JVM each."""
    return F.split(F.lit(" ".join(str(i / GRID) for i in range(GRID + 1))), " ").cast("array<double>")


def _bracket(sketch, rank: int, margin: int) -> tuple[float, float]:
    """Grid points around a rank; the ends of the column where the grid has none."""
    n, lo, hi, grid = sketch
    at = (rank + 0.5) / n * GRID
    a, b = math.floor(at) - margin, math.ceil(at) + margin
    return (grid[a] if a > 0 else lo), (grid[b] if b < GRID else hi)


def _prefix_position(col: Column, shared: int) -> Column:
    """The six bytes after the shared ones as a number: the order of strings, with ties."""
    digits = F.rpad(F.hex(F.substring(col.cast("binary"), shared + 1, 6)), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def _id_position(df: DataFrame, id_col: str) -> Column:
    """A double that never falls as the id rises; many ids may share one. Null ids come first."""
    kind = dict(df.dtypes)[id_col]
    col = F.col(id_col)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        pos = col.cast("double")
    elif kind.startswith("timestamp") or kind == "date":
        pos = F.unix_micros(col.cast("timestamp")).cast("double")
    elif kind == "string":
        ends = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
        lo, hi = ((x or "").encode() for x in ends)
        shared = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
        pos = _prefix_position(col, shared)
    else:
        raise TypeError(f"ids of type {kind} have no order here")
    return F.coalesce(pos, F.lit(float("-inf")))


def select_ranks(df: DataFrame, requests: dict, id_col: str | None = None) -> dict:
    """{name: value} or, with ``id_col``, {name: (value, id)} for {name: (condition or None, column, rank)}.

    ``rank`` counts from 0 over the rows where the condition holds and the
    (double) column is neither null nor NaN; a function of (values, rows), the
    counts of such rows and of all rows, may give it. None, or a rank beyond
    the rows, gives None.
    """
    if not requests:
        return {}
    groups: dict = {}
    for cond, col, _ in requests.values():
        groups.setdefault((id(cond), col), (len(groups), cond, col))
    group = {n: groups[id(cond), col][0] for n, (cond, col, _) in requests.items()}
    yes = F.lit(True)
    df = kept(df.select(*[F.when(yes if cond is None else cond, F.nanvl(F.col(col).cast("double"), F.lit(None))).alias(f"v{g}")
                          for g, cond, col in groups.values()], *([F.col(id_col).alias("id")] if id_col else [])))
    position = _id_position(df, "id") if id_col else None
    points = _points()
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[
        x.alias(f"{g}_{k}") for g, *_ in groups.values() for k, x in enumerate(_sketch(F.col(f"v{g}"), points))]).first()
    sketch = {g: [first[f"{g}_{k}"] for k in range(4)] for g, *_ in groups.values()}
    out, rank, margin = {}, {}, {}
    for n, (_, _, r) in requests.items():
        r = r(sketch[group[n]][0], first["rows"]) if callable(r) else r
        if r is None or not 0 <= r < sketch[group[n]][0]:
            out[n] = None
        else:
            rank[n], margin[n] = r, MARGIN
    place, ids_at = _located(df, {n: (f"v{group[n]}", sketch[group[n]], r) for n, r in rank.items()}, margin, position)
    pick = {}
    for n, (kind, x, t) in place.items():
        if kind == "at" and not id_col:
            out[n] = x
        else:
            pick[n] = (kind, x, t)
    out |= _picked(df, {n: (f"v{group[n]}", *p) for n, p in pick.items()}, ids_at, position)
    return out


def _located(df: DataFrame, wanted: dict, margin: dict, position: Column | None) -> tuple[dict, dict]:
    """{name: ("at", value, rank among its rows) or ("in", (lo, hi), rank inside)}, and the id sketches at values."""
    place, ids_at, points = {}, {}, _points()
    while len(place) < len(wanted):
        open_ = [n for n in wanted if n not in place]
        ends = {n: _bracket(wanted[n][1], wanted[n][2], margin[n]) for n in open_}
        aggs = []
        for i, n in enumerate(open_):
            v, (lo, hi) = F.col(wanted[n][0]), map(F.lit, ends[n])
            for k, c in enumerate((v < lo, v == lo, (v > lo) & (v < hi), (v == hi) & (hi > lo))):
                aggs.append(F.count(F.when(c, 1)).alias(f"c{i}_{k}"))
        at = sorted({(wanted[n][0], x) for n in open_ for x in ends[n]}) if position is not None else []
        for j, (c, x) in enumerate(at):
            aggs += [s.alias(f"s{j}_{k}") for k, s in enumerate(_sketch(F.when(F.col(c) == F.lit(x), position), points))]
        row = df.agg(*aggs).first()
        for j, key in enumerate(at):
            ids_at[key] = [row[f"s{j}_{k}"] for k in range(4)]
        for i, n in enumerate(open_):
            below, low, inside, high = (row[f"c{i}_{k}"] for k in range(4))
            t, (lo, hi) = wanted[n][2] - below, ends[n]
            if 0 <= t < low:
                place[n] = ("at", lo, t)
            elif low <= t < low + inside:
                place[n] = ("in", (lo, hi), t - low)
            elif low + inside <= t < low + inside + high:
                place[n] = ("at", hi, t - low - inside)
            else:  # the sketch was off by more than the margin
                margin[n] = 4 * margin[n]
    return place, ids_at


def _picked(df: DataFrame, pick: dict, ids_at: dict, position: Column | None) -> dict:
    """The value, or (value, id), at a rank inside a bracket or among the rows of one value."""
    out, margin = {}, dict.fromkeys(pick, MARGIN)
    own = F.col("id") if position is not None else F.lit(None).cast("string")
    while len(out) < len(pick):
        open_ = [n for n in pick if n not in out]
        cells = []
        for i, n in enumerate(open_):
            col, kind, x, t = pick[n]
            v = F.col(col)
            if kind == "in":
                here, below = (v > F.lit(x[0])) & (v < F.lit(x[1])), F.lit(False)
            else:
                a, b = _bracket(ids_at[col, x], t, margin[n])
                here, below = (v == F.lit(x)) & (position <= F.lit(b)), position < F.lit(a)
            cells.append(F.when(here, F.struct(F.lit(i).alias("i"), below.alias("below"), F.when(~below, v).alias("v"),
                                               F.when(~below, own).alias("id"))))
        few = kept(df.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
                   .groupBy("i", "below", "v", "id").agg(F.count(F.lit(1)).alias("k")))
        sums = {(r["i"], r["below"]): r["k"] for r in few.groupBy("i", "below").agg(F.sum("k").alias("k")).collect()}
        at = F.lit(False)
        for i, n in enumerate(open_):
            t = pick[n][3] - sums.get((i, True), 0)
            if 0 <= t < sums.get((i, False), 0):
                at = at | ((F.col("i") == i) & (F.col("k_before") <= t) & (F.col("k_before") + F.col("k") > t))
            else:  # the id sketch was off by more than the margin
                margin[n] = 4 * margin[n]
        running = prefix_sums(few.where(~F.col("below")), ["v", "id"], ["k"], ["i"])
        for r in running.where(at).collect():  # one row a request
            out[open_[r["i"]]] = (r["v"], r["id"]) if position is not None else r["v"]
    return out


def quantiles(df: DataFrame, cols, probs) -> dict:
    """{column: [quantile for each of probs]}, linear interpolation; None for a column without values."""
    size: dict = {}

    def rank(c: str, p: float, upper: bool) -> Callable[[int, int], int]:
        def of(n: int, _: int) -> int:
            size[c] = n
            return min(math.floor(p * (n - 1)) + upper, n - 1)
        return of

    found = select_ranks(df, {(c, p, up): (None, c, rank(c, p, up)) for c in cols for p in probs for up in (False, True)})
    out: dict = {c: [] for c in cols}
    for c in cols:
        for p in probs:
            lo, hi = found[c, p, False], found[c, p, True]
            part = math.modf(p * (size[c] - 1))[0]
            out[c].append(None if lo is None else lo + (hi - lo) * part)
    return out
