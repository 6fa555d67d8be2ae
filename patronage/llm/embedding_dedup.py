"""Near-duplicate vectors by cross-polytope hashing.

A table rotates a vector by three rounds of random signs and fast Hadamard
transforms, ``HASHES`` times; each rotation's hash is the signed axis nearest
to the result. A vector lies in the bucket of its hashes and also looks into
``PROBES`` more, those that the smallest losses lead to (multiprobe). Pairs that
meet in a bucket of one of ``TABLES`` tables, at home for one of them at least,
are verified by their cosine in double precision.

Buckets are first only (bucket, id) rows: those of a single vector go, and the
vectors join what is left. Links are counted, not listed: the buckets go to
tasks in blocks, a block pair is a numpy product, and it counts a verified pair
only where the pair meets first (every row has its codes of all tables, so the
tasks know). What leaves a block pair is one row a vector: links found, and its
component among them. Buckets of more than ``BLOCK`` rows are cut by hash into
blocks whose pairs are separate groups, so no group exceeds twice that. Equal
vectors are one class from the start and cost nothing more.

Defined cases: a vector that is null, zero or holds null or non-finite
components, or whose label or id is null, links with nothing; only vectors of
equal dimension are compared; rows that repeat an id are one vector, of several
vectors of an id the one of least hash; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, mix64, written

COSINE = 0.98
TABLES, HASHES, PROBES = 12, 3, 3
BLOCK = 1500
SEED = 20240607


def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and the Hadamard transform of the rows."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
    return x


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home codes (n, TABLES) and probed codes (n, TABLES, PROBES) of unit rows."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.default_rng(SEED + d)
    best = min(d, PROBES + 1)
    home = np.zeros((n, TABLES), np.int64)  # codes run up to (2 * d) ** HASHES
    probe = np.full((n, TABLES, PROBES), -1, np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        near, loss = [], []
        for _ in range(HASHES):
            y = _rotate(x, rng.choice([-1.0, 1.0], (3, d)))
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, :best]
            top = np.take_along_axis(size, order, 1)
            near.append(2 * order + (np.take_along_axis(y, order, 1) < 0))
            loss.append(top[:, :1] - top)
        code = np.zeros(n, np.int64)
        for c in near:
            code = code * (2 * d) + c[:, 0]
        home[:, t] = code
        # other codes of one hash each, by loss
        alike, cost = [], []
        for i in range(HASHES):
            scale = (2 * d) ** (HASHES - 1 - i)
            for r in range(1, best):
                alike.append(code + (near[i][:, r] - near[i][:, 0]) * scale)
                cost.append(loss[i][:, r])
        pick = np.argsort(np.array(cost).T, axis=1, kind="stable")[:, :PROBES]
        probe[:, t, :pick.shape[1]] = np.array(alike).T[rows[:, None], pick]
    return home, probe


_CODED = "id long, label long, size long, home binary, probe binary, vec binary"


def _code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors with their codes."""
    for b in batches:
        for _, g in b.groupby(b["vec"].map(len)):
            x = np.array([np.asarray(v, np.float64) for v in g["vec"]])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            home, probe = codes(x)
            yield pd.DataFrame({"id": g["id"].to_numpy(), "label": g["label"].to_numpy(), "size": g["size"].to_numpy(),
                                "home": [h.tobytes() for h in home], "probe": [p.tobytes() for p in probe],
                                "vec": [v.tobytes() for v in x]})


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each bucket a vector is in or looks into."""
    for b in batches:
        if not len(b):
            continue
        n = len(b)
        home = np.frombuffer(b"".join(b["home"]), np.int64).reshape(n, TABLES, 1)
        probe = np.frombuffer(b"".join(b["probe"]), np.int64).reshape(n, TABLES, PROBES)
        every = np.concatenate([home, probe], axis=2)
        with np.errstate(over="ignore"):
            salt = mix64(b["label"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                         + b["dim"].to_numpy(np.int64).view(np.uint64))
            key = mix64(salt[:, None, None] + mix64(every.view(np.uint64) * np.uint64(TABLES)
                                                    + np.arange(TABLES, dtype=np.uint64)[None, :, None]))
        out = pd.DataFrame({
            "bucket": key.view(np.int64).ravel(), "tab": np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n),
            "id": np.repeat(b["id"].to_numpy(), TABLES * (1 + PROBES)), "at_home": np.tile(np.arange(1 + PROBES) == 0, n * TABLES)})
        yield out[(every >= 0).ravel()]


def _met(h1, p1, h2, p2, t: int) -> np.ndarray:
    """Which pairs meet in table t."""
    met = h1[:, t][:, None] == h2[:, t][None, :]
    for r in range(p1.shape[2]):
        met |= p1[:, t, r][:, None] == h2[:, t][None, :]
        met |= h1[:, t][:, None] == p2[:, t, r][None, :]
    return met


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable for each of n positions over the pairs (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _verify(g: pd.DataFrame) -> pd.DataFrame | None:
    """(id, links, low) of the vectors of a block pair: links counted here, smallest id they lead to."""
    if not g["at_home"].any():
        return None
    g = g.sort_values("id").reset_index(drop=True)
    t = int(g["tab"].iloc[0])
    dim = len(g["vec"].iloc[0]) // 8
    x = np.frombuffer(b"".join(g["vec"]), np.float64).reshape(-1, dim)
    home = np.frombuffer(b"".join(g["home"]), np.int64).reshape(-1, TABLES)
    probe = np.frombuffer(b"".join(g["probe"]), np.int64).reshape(-1, TABLES, PROBES)
    own, ids, size = g["at_home"].to_numpy(), g["id"].to_numpy(), g["size"].to_numpy()
    block, one = g["block"].to_numpy(), g["b1"].iloc[0] == g["b2"].iloc[0]
    links = np.zeros(len(g), np.int64)
    pairs = []
    for lo in range(0, len(g), 256):
        i = slice(lo, min(lo + 256, len(g)))
        v = (x[i] @ x[lo:].T) >= COSINE
        v &= ids[i][:, None] < ids[lo:][None, :]
        v &= own[i][:, None] | own[lo:][None, :]
        if not one:
            v &= block[i][:, None] != block[lo:][None, :]
        if not v.any():
            continue
        # a pair may meet in two buckets of this table: it counts in the lesser home code
        a, b = home[i, t][:, None], home[lo:, t][None, :]
        twice = (a != b) & (probe[i, t][:, :, None] == b[:, None, :]).any(1) & (a[:, :, None] == probe[lo:, t][None, :, :]).any(2)
        here = np.where(own[i][:, None], a, b)
        v &= ~twice | (here == np.minimum(a, b))
        for earlier in range(t):
            if not v.any():
                break
            v &= ~_met(home[i], probe[i], home[lo:], probe[lo:], earlier)
        at, to = np.nonzero(v)
        links[i] += v @ size[lo:]
        links[lo:] += size[i] @ v
        pairs.append((at + lo, to + lo))
    if not links.any():
        return None
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    low = ids[_merge(len(g), a, b)]
    some = links > 0
    return pd.DataFrame({"id": ids[some], "links": links[some], "low": low[some]})


def _verify_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_verify`` of every block pair of a partition sorted by them; one is held at a time."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        key = b[["bucket", "b1", "b2"]].to_numpy()
        if not len(key):
            continue
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        last = cut[-1] if len(cut) else 0
        for lo, hi in zip(np.r_[0, cut[:-1]], cut, strict=False):
            if (out := _verify(b.iloc[lo:hi])) is not None:
                yield out
        rest = b.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest) and (out := _verify(rest)) is not None:
        yield out


def classify(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of vectors (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("vec"))
    good = (F.expr("forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
            & F.expr("exists(vec, v -> v <> 0)") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    x = x.withColumn("good", F.coalesce(good, F.lit(False)))
    marks = [F.xxhash64(F.lit(i), "label", "vec").alias(f"f{i}") for i in (1, 2)]
    # one vector an id
    members = scratch.keep(x.select("vec_id", F.when(F.col("good"), F.struct(*marks)).alias("f"))
                           .groupBy("vec_id").agg(F.min("f").alias("f")).select("vec_id", "f.f1", "f.f2"))
    sizes = scratch.keep(members.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")))
    classes = x.where("good").select(F.col("vec_id").alias("id"), "label", "vec", *marks) \
        .join(sizes, ["id", "f1", "f2"]).dropDuplicates(["id"])
    coded = scratch.keep(classes.select("id", "label", "vec", "size").mapInPandas(_code, _CODED))
    keys = scratch.keep(coded.select("id", "label", F.length("vec").alias("dim"), "home", "probe")
                        .mapInPandas(_spread, "bucket long, tab int, id long, at_home boolean"))
    crowded = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keys.join(crowded, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
    rows = rows.join(coded, "id").select("bucket", "b1", "b2", "tab", "id", "size", "at_home", "home", "probe", "vec", "block")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(rows.repartition(parts, "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")
                         .mapInPandas(_verify_sorted, "id long, links long, low long"))
    comp = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")), scratch)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = sizes.join(links, "id", "left").join(comp, "id", "left").select(
        "f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    out = members.join(of_class, ["f1", "f2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    scratch.clear()
    return out
