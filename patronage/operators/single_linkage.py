"""Exact single linkage at any size (M6): the minimum spanning tree in growing grids.

Single linkage merges along the edges of the minimum spanning tree of the
distinct points, shortest first, so the tree is the whole dendrogram and its
``n_clusters - 1`` longest edges are the cut. Edges are ordered by (squared
distance, smaller id, larger id): the tree is unique, reruns agree.

* A level of side s takes the edges of at most s between points of different
  components; all shorter ones have been taken, so levels never disagree. Points
  meet in neighbouring cells of side s only, and two cells of one and the same
  component are not compared: the inside of a cluster is never looked at again.
  The first side is small enough that a point's cell holds few points.
* A cell meets the half of its neighbours in one group (more than ``chunk`` points in
  hash chunks), to which they send the points within s of the bounds of its points; the
  group keeps the minimum spanning forest of its edges between components: an
  edge that is not in it cannot be in the tree. No pair of rows leaves a task
  but those edges, fewer than the components met. Labels join by shuffles: no
  table passes the driver but the counts of cells.
* From the second level on, points of one box of side s / (4 sqrt(d)) are within the
  side of the level before, so of one component: boxes meet first, as rows of bounds.
  Two boxes of different components are opened only if they are nearer than the
  farthest points of any two boxes of these components, as the lightest edge between
  two components is all that can be in the tree. The points of an opened box are sent once, in
  hash chunks; those of the smaller box of a pair look, one edge each, if they are as near as that.
* Files of a level go when it ends but for its points and edges.
* Borůvka rounds in Spark take the lightest edge of every component, join the
  components by pointer jumping and drop the edges inside; when at most
  ``finish`` edges are left, one group of that bounded size ends the level with
  the same rule. Both give the same edges (test).

Defined cases: missing values are filled with the column median; equal points are
one point; no rows give no rows; fewer distinct points than clusters raise; ids are
integers; other columns are not read. A row is copied to the 3^d neighbours of its
cell, so d is meant to be small, as for DBSCAN.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, kept, passing
from .dbscan import _rooted, grid_side, meetings
from .features import impute_median

#: Factor between the sides of two levels.
GROWTH = 4.0
#: Points of an occupied cell at the first level, on average: fewer make many small groups, more make more distances.
FIRST = 64
EDGE = "w double, a long, b long, ca long, cb long"
_EDGE_COLS = ["w", "a", "b", "ca", "cb"]


def forest(w, a, b, ca, cb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of edges between components: (positions taken, components, root of each)."""
    order = np.lexsort((b, a, w))
    nodes, code = np.unique(np.r_[ca[order], cb[order]], return_inverse=True)
    u, v = code[:len(order)], code[len(order):]
    root = np.arange(len(nodes))
    live, taken = np.arange(len(order)), [np.zeros(0, int)]
    while True:
        live = live[root[u[live]] != root[v[live]]]
        if not len(live):
            return order[np.concatenate(taken)], nodes, nodes[root]
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, root[u[live]], live)
        np.minimum.at(best, root[v[live]], live)
        pick = np.unique(best[best < len(order)])
        taken.append(pick)
        root = _rooted(len(nodes), root[u[pick]], root[v[pick]])[root]


def _start_side(pts: DataFrame, xs: list[str]) -> float:
    """The side at which an occupied cell holds about ``FIRST`` points, from the middle half of the values."""
    q = pts.agg(*[F.percentile_approx(x, [0.25, 0.75]).alias(x) for x in xs],
                *[(F.max(x) - F.min(x)).alias(f"{x}_r") for x in xs]).first()
    spread = max([q[x][1] - q[x][0] for x in xs]) or max(q[f"{x}_r"] for x in xs)
    side = grid_side(pts, xs, spread / 2.0 ** 16, FIRST)
    for _ in range(8):  # where points are much denser than in an average cell, cells are smaller
        cells = pts.groupBy(*[F.floor(F.col(x) / F.lit(side)) for x in xs]).agg(F.count(F.lit(1)).cast("double").alias("n"))
        met = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if met <= 4 * FIRST:
            break
        side /= 2.0
    return side


def _candidates(pts: DataFrame, xs: list[str], side: float, chunk: int, seen) -> DataFrame:
    """Edges of at most ``side`` between components that a local spanning forest keeps."""
    d = len(xs)
    cc = [f"__c{i}" for i in range(d)]
    placed = pts.select("*", *[F.floor(F.col(x) / F.lit(side)).cast("long").alias(c) for x, c in zip(xs, cc)])
    pairs, key = meetings(placed, placed, d, side, chunk, ["__label"], half=True, label="__label")
    xcols, limit = [f"__x{i}" for i in range(d)], side * side

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        L, R = pdf[pdf["__l"]], pdf[~pdf["__l"]]
        out = [np.zeros(0), *[np.zeros(0, "int64")] * 4]
        labels = pd.concat([L["__label"], R["__label"]])
        if len(L) and len(R) and labels.nunique() > 1:
            xl, xr = L[xcols].to_numpy(float), R[xcols].to_numpy(float)
            il, ir, kl, kr = (s[c].to_numpy("int64") for c in ("__id", "__label") for s in (L, R))
            for at in range(0, len(L), 256):
                diff = xl[at:at + 256, None, :] - xr[None, :, :]
                if seen is not None:
                    seen.add(diff.shape[0] * diff.shape[1])
                w = (diff * diff).sum(axis=2)
                p, q = np.nonzero((w <= limit) & (kl[at:at + 256, None] != kr[None, :]))
                ids = il[at + p], ir[q]
                new = [w[p, q], np.minimum(*ids), np.maximum(*ids), kl[at + p], kr[q]]
                out = [np.r_[old, n] for old, n in zip(out, new)]
                taken = forest(*out)[0]
                out = [c[taken] for c in out]
        return pd.DataFrame(dict(zip(_EDGE_COLS, out)))

    return pairs.groupBy(*key).applyInPandas(local, EDGE)


def _nearest(pairs: pd.DataFrame) -> pd.DataFrame:
    """The pairs of boxes that may hold the lightest edge between their components."""
    best = pairs.groupby(["la", "lb"])["far"].transform("min")
    return pairs[pairs["gap"] <= best * (1 + 1e-9)]


def _opened(boxes: DataFrame, d: int, side: float, width: float, chunk: int) -> DataFrame:
    """(u, v, squared distances of their bounds, bounds of u): pairs of boxes of different components that may
    hold an edge; v is the box of fewer points."""
    low, high = [f"__x{i}" for i in range(d)], [f"__h{i}" for i in range(d)]
    limit = side * side * (1 + 1e-9)
    reach = (side + width * math.sqrt(d)) * (1 + 1e-9)  # of lower corners
    met, key = meetings(boxes, boxes, d, reach, chunk, ["__label", "__n", *high], half=True, label="__label")
    bounds = ", ".join(f"{x} double" for x in low + high)
    cols = ["u", "v", "n", "m", "la", "lb", "gap", "far", *low, *high]

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        L, R = pdf[pdf["__l"]], pdf[~pdf["__l"]]
        out = pd.DataFrame({c: np.zeros(0, "float64" if c in cols[6:] else "int64") for c in cols})
        (ll, lh), (rl, rh) = ((s[low].to_numpy(float), s[high].to_numpy(float)) for s in (L, R))
        (il, kl, nl), (ir, kr, nr) = (tuple(s[c].to_numpy("int64") for c in ("__id", "__label", "__n")) for s in (L, R))
        for at in range(0, len(L) if len(R) else 0, 64):
            to = slice(at, at + 64)
            gap = np.maximum(np.maximum(ll[to, None] - rh[None], rl[None] - lh[to, None]), 0.0)
            gap = (gap * gap).sum(axis=2)
            p, q = np.nonzero((gap <= limit) & (kl[to, None] != kr[None]))
            gap, p = gap[p, q], at + p
            far = np.maximum(lh[p] - rl[q], rh[q] - ll[p])
            right = (nr[q] > nl[p]) | ((nr[q] == nl[p]) & (ir[q] > il[p]))  # the box on the right is u
            new = {"u": np.where(right, ir[q], il[p]), "v": np.where(right, il[p], ir[q]),
                   "n": np.maximum(nl[p], nr[q]), "m": np.minimum(nl[p], nr[q]),
                   "la": np.minimum(kl[p], kr[q]), "lb": np.maximum(kl[p], kr[q]),
                   "gap": gap, "far": (far * far).sum(axis=1)}
            for i in range(d):
                new[low[i]] = np.where(right, rl[q, i], ll[p, i])
                new[high[i]] = np.where(right, rh[q, i], lh[p, i])
            out = _nearest(pd.concat([out, pd.DataFrame(new)]))
        return out[cols]

    pairs = kept(met.groupBy(*key).applyInPandas(
        near, f"u long, v long, n long, m long, la long, lb long, gap double, far double, {bounds}"))
    best = pairs.groupBy("la", "lb").agg(F.min("far").alias("best"))
    found = pairs.join(best, ["la", "lb"]).where(F.col("gap") <= F.col("best") * F.lit(1 + 1e-9))
    return kept(found.dropDuplicates(["u", "v"])
                .withColumn("within", F.least("best", F.lit(side * side)) * F.lit(1 + 1e-9)).drop("best", "far", "gap", "la", "lb"))


def _between_boxes(pts: DataFrame, xs: list[str], side: float, chunk: int, seen) -> DataFrame:
    """Edges of at most ``side`` between components, among them all of the tree, where points
    within ``side / GROWTH`` are of one component."""
    d = len(xs)
    parts = int(GROWTH * math.sqrt(d)) + 1
    width, limit = side / parts, side * side
    ff, cc, high = ([f"__{c}{i}" for i in range(d)] for c in "fch")
    fine = pts.select("*", *[F.floor(F.col(x) / F.lit(width)).cast("long").alias(f) for x, f in zip(xs, ff)])
    boxes = fine.groupBy(*ff).agg(F.min("__id").alias("__id"), F.max("__label").alias("__label"), F.count(F.lit(1)).alias("__n"),
                                  *[F.min(x).alias(x) for x in xs], *[F.max(x).alias(h) for x, h in zip(xs, high)])
    boxes = kept(boxes.withColumns({c: ((F.col(f) - F.pmod(f, F.lit(parts))) / parts).cast("long") for f, c in zip(ff, cc)}))
    pairs = _opened(boxes, d, side, width, chunk)
    # the points of u in chunks, which those of every v meet
    groups = kept(pairs.groupBy("u").agg(F.ceil(F.max("n") / float(chunk)).cast("int").alias("nr"),
                                         F.ceil(F.sum("m") / (16.0 * chunk)).cast("int").alias("nl")))
    ends = pairs.select(F.col("u").alias("__id")).union(pairs.select("v")).distinct()
    of = boxes.join(ends, "__id").select(*ff, F.col("__id").alias("__box"))
    cols = ["__id", "__label", *xs]
    inside = kept(fine.join(of, ff).select("__box", *cols))
    rgt = inside.withColumnRenamed("__box", "u").join(groups, "u").select(
        "u", F.pmod(F.xxhash64("__id"), F.col("nr")).cast("int").alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.lit(False).alias("__l"), *cols)
    bounds = pairs.select("u", F.col("v").alias("__box"), "within", *[F.col(x).alias(f"{x}l") for x in xs],
                          *[F.col(h).alias(f"{x}h") for x, h in zip(xs, high)])
    gap = sum((F.pow(F.greatest(F.col(f"{x}l") - F.col(x), F.col(x) - F.col(f"{x}h"), F.lit(0.0)), F.lit(2.0)) for x in xs), F.lit(0.0))
    lft = inside.join(bounds, "__box").where(gap <= F.col("within") * F.lit(1 + 1e-9)).select("u", *cols).join(groups, "u").select(
        "u", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"),
        F.pmod(F.xxhash64("__id"), F.col("nl")).cast("int").alias("i"), F.lit(True).alias("__l"), *cols)

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["__l"].to_numpy(bool)
        L, R = pdf[left], pdf[~left].sort_values("__id")  # of equal edges the one to the smaller id
        out = [np.zeros(0), *[np.zeros(0, "int64")] * 4]
        if len(L) and len(R):
            xl, xr = L[xs].to_numpy(float), R[xs].to_numpy(float)
            il, ir, kl, kr = (s[c].to_numpy("int64") for c in ("__id", "__label") for s in (L, R))
            w, q = np.zeros(len(L)), np.zeros(len(L), int)
            for at in range(0, len(L), 256):
                diff = xl[at:at + 256, None, :] - xr[None, :, :]
                if seen is not None:
                    seen.add(diff.shape[0] * diff.shape[1])
                met = (diff * diff).sum(axis=2)
                q[at:at + 256] = met.argmin(axis=1)
                w[at:at + 256] = met.min(axis=1)
            p = np.nonzero(w <= limit)[0]
            ids = il[p], ir[q[p]]
            out = [w[p], np.minimum(*ids), np.maximum(*ids), kl[p], kr[q[p]]]
            taken = forest(*out)[0]
            out = [c[taken] for c in out]
        return pd.DataFrame(dict(zip(_EDGE_COLS, out)))

    return lft.unionByName(rgt).groupBy("u", "j", "i").applyInPandas(look, EDGE)


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One Borůvka round: (edges taken, component -> root)."""
    edge = F.struct(*_EDGE_COLS)
    best = (edges.select("ca", edge.alias("e")).unionByName(edges.select(F.col("cb").alias("ca"), edge.alias("e")))
            .groupBy(F.col("ca").alias("c")).agg(F.min("e").alias("e")))
    best = kept(best.select("c", "e", F.when(F.col("e.ca") == F.col("c"), F.col("e.cb")).otherwise(F.col("e.ca")).alias("to")))
    back = best.select(F.col("c").alias("to"), F.col("to").alias("back")).hint("merge")
    up = best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c"))
                                      .otherwise(F.col("to")).alias("root"))
    while True:
        up = kept(up)
        above = up.select(F.col("c").alias("root"), F.col("root").alias("top")).hint("merge")
        jump = up.join(above, "root")
        if jump.where("top <> root").isEmpty():
            return best.select("e.*").distinct(), up
        up = jump.select("c", F.col("top").alias("root"))


def _relabel(df: DataFrame, roots: DataFrame, col: str) -> DataFrame:
    """``col`` through (c, root); components not in ``roots`` stay."""
    return (df.join(roots.select(F.col("c").alias(col), "root").hint("merge"), col, "left")
            .withColumn(col, F.coalesce("root", col)).drop("root"))


def _merge(edges: DataFrame, finish: int) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of a written edge table: (edges, component -> root)."""
    taken, roots = [], None
    while edges.limit(finish + 1).count() > finish:
        step, up = _round(edges)
        taken.append(step)
        roots = up if roots is None else _through(roots, up)
        edges = kept(_relabel(_relabel(edges, up, "ca"), up, "cb").where("ca <> cb").select(*_EDGE_COLS))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [pdf[c].to_numpy() for c in _EDGE_COLS]
        at, nodes, root = forest(*cols)
        e = pd.DataFrame({c: v[at] for c, v in zip(_EDGE_COLS, cols)})
        return pd.concat([e.assign(c=0, root=0, edge=True), pd.DataFrame(
            {"w": 0.0, "a": 0, "b": 0, "ca": 0, "cb": 0, "c": nodes, "root": root, "edge": False})])

    # at most ``finish`` rows meet in the one group
    ended = kept(edges.groupBy(F.lit("")).applyInPandas(last, EDGE + ", c long, root long, edge boolean"))
    up = ended.where("not edge").select("c", "root")
    found = ended.where("edge").select(*_EDGE_COLS)
    for step in taken:
        found = found.unionByName(step)
    return found.select("w", "a", "b"), up if roots is None else _through(roots, up)


def _through(first: DataFrame, second: DataFrame) -> DataFrame:
    """Component -> root by two maps in turn; every component of ``second`` is a root of ``first``."""
    then = second.select(F.col("c").alias("root"), F.col("root").alias("top")).hint("merge")
    return kept(first.join(then, "root", "left").select("c", F.coalesce("top", "root").alias("root")))


def _level(pts: DataFrame, cols: list[str], side: float, left: int, until: int, chunk: int, finish: int, seen, first: bool, stay: list):
    """(points with new components, edges taken, their number): the tree's edges of at most ``side``, with ``left`` components before."""
    near = _candidates if first else _between_boxes
    edges, up = _merge(kept(near(pts, cols, side, chunk, seen)), finish)
    edges = kept(edges)
    n = edges.count()
    if n > left - until:  # the longest go: fewer than ``until`` edges
        cut = edges.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(n - left + until)
        edges = kept(edges.join(F.broadcast(cut), ["w", "a", "b"], "left_anti"))
        n = left - until
        of = pts.select(F.col("__id"), F.col("__label")).hint("merge")
        ends = edges.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(*_EDGE_COLS)
        up = _merge(kept(ends), finish)[1]
    if n:
        old, pts = pts, kept(_relabel(pts, up, "__label"))
        discard(old)
        stay += [edges, pts]
    return pts, edges, n


def _grow(df: DataFrame, xs, id_col: str, until: int, chunk: int, finish: int, seen):
    """(points with component, tree edges taken) with ``until`` components left."""
    cols = [f"__x{i}" for i in range(len(xs))]
    filled = impute_median(df.select(id_col, *xs), list(xs)).select(
        F.col(id_col).cast("long").alias("__id"), *[(F.col(x).cast("double") + F.lit(0.0)).alias(c) for x, c in zip(xs, cols)])
    rows = kept(filled)
    pts = kept(rows.groupBy(*cols).agg(F.min("__id").alias("__id")).withColumn("__label", F.col("__id")))
    left, tree = pts.count(), []
    if left and pts.where(" OR ".join(f"{c} IS NULL" for c in cols)).limit(1).count():
        raise ValueError("a feature column has no values")
    if left < until and left:
        raise ValueError("fewer distinct points than clusters")
    side = _start_side(pts, cols) if left > until else 1.0
    first = True
    while left > until:
        with passing() as stay:
            pts, edges, n = _level(pts, cols, side, left, until, chunk, finish, seen, first, stay)
        if n:
            tree.append(edges)
            left -= n
        side, first = side * GROWTH, False
    return rows, pts, cols, tree


def merges(df: DataFrame, xs, id_col: str = "customer_id", chunk: int = 1024, finish: int = 1_000_000,
           seen=None) -> DataFrame:
    """(a, b, height): the n - 1 merges of n distinct points, which carry the smallest id of their rows;
    a < b are the two points whose distance, ``height``, joins the clusters."""
    _, pts, _, tree = _grow(df, xs, id_col, 1, chunk, finish, seen)
    out = pts.sparkSession.createDataFrame([], "w double, a long, b long")
    for edges in tree:
        out = out.unionByName(edges)
    return out.select("a", "b", F.sqrt("w").alias("height"))


def single_linkage(df: DataFrame, xs, n_clusters: int = 4, id_col: str = "customer_id", chunk: int = 1024,
                   finish: int = 1_000_000, seen=None) -> DataFrame:
    """(id, cluster) per row; clusters numbered by size, largest first, then by smallest id."""
    rows, pts, cols, _ = _grow(df, xs, id_col, n_clusters, chunk, finish, seen)
    named = rows.join(pts.select(*cols, "__label").hint("merge"), cols).select("__id", "__label")
    sizes = named.groupBy("__label").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("head"))
    order = sizes.select("__label", (F.row_number().over(Window.orderBy(F.desc("n"), "head")) - 1).cast("long").alias("cluster"))
    return named.join(F.broadcast(order), "__label").select(F.col("__id").alias(id_col), "cluster")  # n_clusters rows
