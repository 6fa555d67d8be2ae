"""Exact DBSCAN on Spark (M5), with sklearn's semantics: a point is core
when at least ``min_samples`` points (itself included) lie within ``eps``
(inclusive); clusters are connected components of core points; a border
point joins the first cluster that reaches it (the one with the smallest
core id); the rest is noise (-1). Clusters are numbered by their smallest
core id.

Scale design:
* Two grids. Cells of a fine one (side eps / sqrt(d)) that hold ``min_samples``
  points are full: all their points are core and of one cluster, and are never
  compared with each other. Neighbours are counted for the points of the other
  cells only, of which a cell holds fewer than ``min_samples``.
* Blocks of a coarse grid decide which points meet: its side is eps times the
  power of two at which occupied blocks hold about ``chunk / 2`` points, from
  counts of distinct cells, so that a far point adds one block and changes
  nothing else. Only the 3^d neighbouring blocks can hold neighbours. A block of
  more than ``chunk`` points is split into hash chunks, so one that holds a third
  of the data becomes many bounded ones.
* A chunk of a block is one ``applyInPandas`` group: the points looked at are sent
  once, and the points that look are copied to the neighbouring blocks whose
  bounds are within eps. Those are few where points are dense: the points outside
  full cells and one representative of every full cell. Distances are computed in
  numpy, in row slices; only per-point results and stars leave the task.
* Components are those of nodes (full cells and other core points): first by
  representatives, then full cells of different components whose bounds are within
  eps compare the points that face each other. Labels come from min-label
  propagation with pointer jumping, written every round.
"""
from __future__ import annotations

import itertools
import math
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..storage import kept
from .features import impute_median
from .rank import global_rank


LEVELS = 24


def grid_side(df: DataFrame, xs, eps: float, target: int) -> float:
    """Block side: eps times the largest power of two at which occupied blocks hold ``target`` points or fewer on average."""
    distinct = [F.approx_count_distinct(F.xxhash64(*[F.floor(F.col(x).cast("double") / F.lit(eps * 2.0 ** k)) for x in xs]))
                .alias(f"k{k}") for k in range(LEVELS)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *distinct).first()
    fits = [k for k in range(LEVELS) if row["n"] <= target * row[f"k{k}"]]
    return float(eps) * 2.0 ** (max(fits) if row["n"] and fits else 0)


def _fine_side(eps: float, d: int) -> float:
    """Two points of one fine cell are within eps."""
    return eps / math.sqrt(d) * (1 - 1e-9)


def _cells(df: DataFrame, xs, eps: float, min_samples: int, chunk: int, id_col: str) -> DataFrame:
    """Points with their block (``__c``) and, in a full cell, the smallest id of the cell (``__head``)."""
    d = len(xs)
    side = grid_side(df, xs, eps, max(chunk // 2, 1))
    fine = [F.floor(F.col(f"__x{i}") / F.lit(_fine_side(eps, d))).cast("long").alias(f"__f{i}") for i in range(d)]
    cell_cols = [F.floor(F.col(x) / F.lit(side)).cast("long").alias(f"__c{i}") for i, x in enumerate(xs)]
    pts = df.select(F.col(id_col).alias("__id"), *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)],
                    *cell_cols)
    pts = pts.select("*", *fine)
    full = pts.groupBy(*[f"__f{i}" for i in range(d)]).agg(F.min("__id").alias("__head"), F.count(F.lit(1)).alias("__k"))
    pts = pts.join(full.where(F.col("__k") >= min_samples).drop("__k"), [f"__f{i}" for i in range(d)], "left") \
        .drop(*[f"__f{i}" for i in range(d)])
    return pts


def meetings(left: DataFrame, right: DataFrame, d: int, reach: float, chunk: int, extra=(), half: bool = False,
             label: str | None = None) -> tuple[DataFrame, list[str]]:
    """Rows that may lie within ``reach`` of each other, by group, and the columns of a group.

    A group is a chunk of a block: its rows of ``right`` are sent once, with the rows of
    ``left`` (``__l``) from neighbouring blocks whose distance to the bounds of the block's
    rows is at most ``reach``. Chunks hold about ``chunk`` rows of ``right`` and four times
    as many of ``left``. ``half``: two blocks meet once, for equal sides. Rows do not meet
    a block that has their ``label`` alone.
    """
    cc, xs = [f"__c{i}" for i in range(d)], [f"__x{i}" for i in range(d)]
    offs = F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product((-1, 0, 1), repeat=d)
                     if not half or o >= (0,) * d])

    def spread(df: DataFrame, *cols: str) -> DataFrame:
        moved = df.withColumn("__o", F.explode(offs))
        return moved.select(*cols, *[(F.col(c) + F.col("__o")[i]).alias(c) for i, c in enumerate(cc)])

    range_of = [F.min(label).alias("__low"), F.max(label).alias("__high")] if label else []
    rb = kept(right.groupBy(*cc).agg(F.count(F.lit(1)).alias("__n"), *range_of, *[F.min(x).alias(f"{x}l") for x in xs],
                                     *[F.max(x).alias(f"{x}h") for x in xs]))
    lb = left.groupBy(*cc).agg(F.count(F.lit(1)).alias("__m"), *[F.min(label).alias("__a"), F.max(label).alias("__b")] if label else [])
    near = spread(lb, "__m", *(["__a", "__b"] if label else [])).join(rb, cc)
    if label:
        near = near.where("NOT (__a = __b AND __low = __high AND __a = __low)")
    blocks = rb.join(near.groupBy(*cc).agg(F.sum("__m").alias("__m")), cc)
    blocks = kept(blocks.withColumns({"__nr": F.ceil(F.col("__n") / float(chunk)).cast("int"),
                                      "__nl": F.ceil(F.col("__m") / (4.0 * chunk)).cast("int")}).drop("__n", "__m"))
    gap = sum((F.pow(F.greatest(F.col(f"{x}l") - F.col(x), F.col(x) - F.col(f"{x}h"), F.lit(0.0)), F.lit(2.0)) for x in xs), F.lit(0.0))
    lft = spread(left, "__id", *xs, *extra).join(blocks, cc).where(gap <= F.lit(float(reach) ** 2 * (1 + 1e-9)))
    if label:
        lft = lft.where(f"NOT (__low = __high AND __low = {label})")
    cols = ["__id", *xs, *extra]
    lft = lft.select(*cc, F.explode(F.sequence(F.lit(0), F.col("__nr") - 1)).alias("__rch"),
                     F.pmod(F.xxhash64("__id"), F.col("__nl")).cast("int").alias("__lch"), F.lit(True).alias("__l"), *cols)
    rgt = right.join(blocks, cc).select(*cc, F.pmod(F.xxhash64("__id"), F.col("__nr")).cast("int").alias("__rch"),
                                        F.explode(F.sequence(F.lit(0), F.col("__nl") - 1)).alias("__lch"),
                                        F.lit(False).alias("__l"), *cols)
    return lft.unionByName(rgt), [*cc, "__rch", "__lch"]


def _within(xl, xr, eps2, seen=None, rows=512):
    """Yield (row slice, boolean adjacency block) without a full matrix; ``seen`` counts the distances."""
    for lo in range(0, len(xl), rows):
        diff = xl[lo:lo + rows, None, :] - xr[None, :, :]
        if seen is not None:
            seen.add(diff.shape[0] * diff.shape[1])
        yield lo, (diff * diff).sum(axis=2) <= eps2


def _rooted(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n points under the links (u, v): propagation with pointer jumping."""
    roots = np.arange(n)
    while True:
        old = roots.copy()
        m = np.minimum(roots[u], roots[v])
        np.minimum.at(roots, u, m)
        np.minimum.at(roots, v, m)
        while True:
            jumped = roots[roots]
            if np.array_equal(jumped, roots):
                break
            roots = jumped
        if np.array_equal(roots, old):
            return roots


def _components(nodes: DataFrame, edges: DataFrame, max_rounds: int, t0: float) -> DataFrame:
    """(v, lab): the smallest node reachable, by min-label propagation with pointer jumping."""
    both = kept(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = kept(nodes.select("v", F.col("v").alias("lab")))
    for _ in range(max_rounds):
        nb = (both.join(labels.withColumnRenamed("v", "dst"), "dst")
              .groupBy("src").agg(F.min("lab").alias("nl")))
        l1 = (labels.join(nb, labels.v == nb.src, "left")
              .select("v", "lab", F.least("lab", F.coalesce("nl", "lab")).alias("new")))
        l2 = kept(l1.alias("a").join(l1.alias("b"), F.col("a.new") == F.col("b.v"), "left")
                  .select(F.col("a.v").alias("v"), F.col("a.lab").alias("old"),
                          F.least(F.col("a.new"), F.coalesce(F.col("b.new"), F.col("a.new"))).alias("lab")))
        changed = l2.where(F.col("lab") != F.col("old")).count()
        labels = l2.drop("old")
        _log(f"round changed={changed}", t0)
        if changed == 0:
            return labels
    raise RuntimeError("DBSCAN label propagation did not converge")


def _open_cells(full: DataFrame, labels: DataFrame, d: int, eps: float, chunk: int) -> DataFrame:
    """(a, b, chunks and bounds of both): full cells of different components whose bounds are within eps."""
    xs, bb = [f"__x{i}" for i in range(d)], [f"__b{i}" for i in range(d)]
    cells = full.groupBy("__head").agg(F.ceil(F.count(F.lit(1)) / float(chunk)).cast("int").alias("k"),
                                       *[F.min(x).alias(f"{x}l") for x in xs], *[F.max(x).alias(f"{x}h") for x in xs])
    # lower corners of such cells are within three times eps: a cell is at most eps wide
    cells = kept(cells.join(labels.select(F.col("v").alias("__head"), "lab"), "__head")
                 .select("*", *[F.floor(F.col(f"{x}l") / F.lit(3.0 * eps)).cast("long").alias(b) for x, b in zip(xs, bb)]))
    around = cells.groupBy(*bb).agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"))
    for b in bb:
        around = around.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
        around = around.groupBy(*bb).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    some = kept(cells.join(around.where("lo <> hi").select(*bb), bb))
    offs = F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product((-1, 0, 1), repeat=d)])
    box = ["k", "lab", *[f"{x}{e}" for x in xs for e in "lh"]]
    a = some.withColumn("__o", F.explode(offs)).select(
        F.col("__head").alias("a"), *[F.col(c).alias(f"a_{c}") for c in box],
        *[(F.col(b) + F.col("__o")[i]).alias(b) for i, b in enumerate(bb)])
    b = some.select(F.col("__head").alias("b"), *[F.col(c).alias(f"b_{c}") for c in box], *bb)
    gap = sum((F.pow(F.greatest(F.col(f"a_{x}l") - F.col(f"b_{x}h"), F.col(f"b_{x}l") - F.col(f"a_{x}h"), F.lit(0.0)), F.lit(2.0))
               for x in xs), F.lit(0.0))
    return a.join(b, bb).where((F.col("a") < F.col("b")) & (F.col("a_lab") != F.col("b_lab"))
                               & (gap <= F.lit(eps * eps * (1 + 1e-9)))).drop(*bb, "a_lab", "b_lab")


def _log(msg, t0):
    if os.environ.get("PATRONAGE_DEBUG"):
        print(f"[dbscan] {msg} {time.time() - t0:.2f}s", flush=True)


def dbscan(df: DataFrame, xs, eps: float = 0.5, min_samples: int = 5, id_col: str = "customer_id",
           chunk: int = 2048, max_rounds: int = 200, seen=None) -> DataFrame:
    """(id, cluster) for every row; noise is -1. Missing values are filled
    with the column median first; a column without any value raises.
    ``seen``, an accumulator, counts the distances computed."""
    spark = df.sparkSession
    df = impute_median(df.select(id_col, *xs), list(xs))
    if df.where(" OR ".join(f"`{x}` IS NULL" for x in xs)).limit(1).count():
        raise ValueError("a feature column has no values")
    ensure_checkpoint_dir(spark)
    d = len(xs)
    eps2 = float(eps) * float(eps) * (1 + 1e-12)
    xcols = [f"__x{i}" for i in range(d)]
    t0 = time.time()
    pts = kept(_cells(df, xs, eps, min_samples, chunk, id_col))
    full, loose = pts.where("__head IS NOT NULL"), pts.where("__head IS NULL")
    _log("cells", t0)

    def sides(pdf: pd.DataFrame):
        left = pdf["__l"].to_numpy(bool)
        x = pdf[xcols].to_numpy(float)
        return pdf[left], pdf[~left], x[left], x[~left]

    # 1. neighbour counts (self included) of the points outside full cells
    pairs, key = meetings(loose, pts, d, eps, chunk)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        L, R, xl, xr = sides(pdf)
        n = np.zeros(len(L), dtype="int64")
        for lo, adj in _within(xl, xr, eps2, seen):
            n[lo:lo + len(adj)] = adj.sum(axis=1)
        return pd.DataFrame({"__id": L["__id"].to_numpy("int64"), "__n": n})

    counts = pairs.groupBy(*key).applyInPandas(count, "__id long, __n long").groupBy("__id").agg(F.sum("__n").alias("__n"))
    loose = kept(loose.join(counts, "__id", "left").withColumn("__core", F.coalesce(F.col("__n") >= min_samples, F.lit(False)))
                 .drop("__n", "__head").withColumn("__head", F.lit(None).cast("long")))
    _log("counts", t0)
    single = loose.where("__core").drop("__core")
    core = full.unionByName(single)

    # 2. components of nodes: core points outside full cells, and full cells by their heads
    reps = full.where("__head = __id")
    pairs, key = meetings(reps.unionByName(single), core, d, eps, chunk, ["__head"])

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        L, R, xl, xr = sides(pdf)
        left = L["__id"].to_numpy("int64")  # a representative carries its cell's name
        right = R["__head"].where(R["__head"].notna(), R["__id"]).to_numpy("int64")
        ids = np.unique(np.r_[left, right])
        li, ri = np.searchsorted(ids, left), np.searchsorted(ids, right)
        links = [np.zeros(0, "int64")]
        for lo, adj in _within(xl, xr, eps2, seen):
            a, b = np.nonzero(adj)
            links.append(np.unique(li[lo + a] * len(ids) + ri[b]))
        links = np.unique(np.concatenate(links))
        roots = _rooted(len(ids), links // max(len(ids), 1), links % max(len(ids), 1))
        keep = roots != np.arange(len(ids))
        return pd.DataFrame({"src": ids[keep], "dst": ids[roots[keep]]})

    edges = kept(pairs.groupBy(*key).applyInPandas(stars, "src long, dst long").distinct())
    _log("stars", t0)
    nodes = reps.unionByName(single).select(F.col("__id").alias("v"))
    labels = _components(nodes, edges, max_rounds, t0)

    # 3. full cells of different components that may still touch: only their points meet
    opened = kept(_open_cells(full, labels, d, eps, chunk))
    if not opened.isEmpty():
        def facing(own: str, other: str) -> DataFrame:
            """The points of one cell that lie within eps of the other's bounds."""
            gap = sum((F.pow(F.greatest(F.col(f"{other}_{x}l") - F.col(x), F.col(x) - F.col(f"{other}_{x}h"), F.lit(0.0)), F.lit(2.0))
                       for x in xcols), F.lit(0.0))
            near = full.join(opened.withColumnRenamed(own, "__head").withColumn(own, F.col("__head")), "__head") \
                .where(gap <= F.lit(eps2 * (1 + 1e-9)))
            at = F.pmod(F.xxhash64("__id"), F.col(f"{own}_k")).cast("int")
            met = F.explode(F.sequence(F.lit(0), F.col(f"{other}_k") - 1))
            i, j = (at, met) if own == "a" else (met, at)
            return near.select("a", "b", i.alias("i"), j.alias("j"), F.lit(own == "a").alias("__l"), *xcols)

        def touch(pdf: pd.DataFrame) -> pd.DataFrame:
            _, _, xl, xr = sides(pdf)
            hit = len(xl) > 0 and len(xr) > 0 and any(adj.any() for _, adj in _within(xl, xr, eps2, seen, 64))
            return pd.DataFrame({"src": pdf["a"][:int(hit)], "dst": pdf["b"][:int(hit)]})

        more = facing("a", "b").unionByName(facing("b", "a")).groupBy("a", "b", "i", "j").applyInPandas(touch, "src long, dst long")
        labels = _components(nodes, edges.unionByName(more.distinct()), max_rounds, t0)
    labels = kept(labels)

    # 4. border points: smallest component label among core neighbours
    core_l = core.withColumn("v", F.coalesce("__head", "__id")).join(labels, "v").withColumnRenamed("lab", "__label")
    border = loose.where("NOT __core").withColumn("__label", F.lit(None).cast("long"))
    pairs, key = meetings(border, core_l, d, eps, chunk, ["__label"])

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        L, R, xl, xr = sides(pdf)
        if L.empty or R.empty:
            return pd.DataFrame({"__id": np.array([], "int64"), "__label": np.array([], "int64")})
        lab = R["__label"].to_numpy("int64")
        best = np.full(len(L), np.iinfo(np.int64).max)
        for lo, adj in _within(xl, xr, eps2, seen):
            cand = np.where(adj, lab[None, :], np.iinfo(np.int64).max)
            best[lo:lo + len(adj)] = np.minimum(best[lo:lo + len(adj)], cand.min(axis=1))
        ok = best != np.iinfo(np.int64).max
        return pd.DataFrame({"__id": L["__id"].to_numpy("int64")[ok], "__label": best[ok]})

    reached = pairs.groupBy(*key).applyInPandas(reach, "__id long, __label long") \
        .groupBy("__id").agg(F.min("__label").alias("__label"))

    # 5. number clusters 0.. by their smallest core id
    comp = labels.select(F.col("lab").alias("__label")).distinct()
    comp = global_rank(comp, [F.col("__label")], "__rn").select("__label", (F.col("__rn") - 1).alias("cluster"))
    assigned = core_l.select("__id", "__label").unionByName(border.select("__id").join(reached, "__id", "left"))
    out = (assigned.join(comp, "__label", "left")
           .select(F.col("__id").alias(id_col), F.coalesce(F.col("cluster"), F.lit(-1)).cast("long").alias("cluster")))
    return out
