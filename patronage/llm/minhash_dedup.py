"""MinHash near-duplicates with an LSH forest.

Every set of shingles gets ``TREES`` signatures of ``LEVELS`` 16-bit MinHash
values. One tree is the sets in signature order; the sets of a tree that share
``MIN_DEPTH`` levels (packed into one long) are a region, and the candidates of
a set are all others of its regions. A pair of similarity 0.8 shares a region
of one of 24 trees with probability 1 - 3e-6.

A row also carries one bit of each of ``SKETCH`` MinHash values. Sets of
similarity s agree in (1 + s) / 2 of them; sets that differ in more than
``DIFFER`` bits are no candidates (at 0.8 that loses one pair in a million).

Equal sets are one class from the start. All trees are sorted together by a
range partitioning on (tree, signature, id), which splits a region of any
size; the first and last rows of each partition are compared in one small
step. The rows side by side in a tree are those with the longest common
prefix, to whatever depth the region has. Candidates are confirmed on the full
shingle sets. The first pass takes only the neighbours of the first ``FIRST``
trees and notes which sets have a neighbour in any tree, the second the
neighbours in all trees; their links join most of each group of copies.

Regions that are still wide (three rows or more, of several components) are
not compared by pairs, as deeper levels do not part sets of similarity 0.75
from those of 0.8. Their sets are filtered exactly: shingles are ordered from
rare to frequent, by a table of ``SLOTS`` counts over these sets that is added
up from all tasks, and a set is listed under its first shingles, as many as a
partner of similarity 0.8 cannot all lack. Two sets listed under one shingle
are candidates only if what follows it in the shorter rest could still make
the similarity (and if their sketches are near). Sets that share a licence or
a passage have it last in their order, so they list no pairs. A shingle of more
than ``BLOCK`` sets is cut into blocks, whose pairs are separate groups. No link
is left after this, as every pair that could be one is listed.

Defined cases: a null or empty text, or one without words, has an empty set
and no links; a text of fewer words than a shingle is one shingle; rows that
repeat a doc_id are one document, linked if any of its texts is; rows with a
null doc_id come back with null component and are kept. ``keep_one`` decides by
row: rows that repeat a doc_id, or have none, are documents of their own.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, mix64, shingles, written

TREES, LEVELS, MIN_DEPTH = 24, 8, 4
#: Sets under a shingle that are compared in one group, at most twice as many in a pair of blocks.
BLOCK = 8192
#: Counts of the table that tells rare shingles from frequent ones; it only sets the order, the result is the same with any.
SLOTS = 1 << 18
#: Groups up to this size are compared together.
NARROW = 64
#: Trees whose adjacent rows the first pass confirms.
FIRST = 3
#: Bits of the sketch, and the most of them that candidates may differ in.
SKETCH, DIFFER = 128, 33
#: Percent of the union that the intersection must reach.
PERCENT = 80
_BATCH = 40_000
#: Rows of an Arrow batch that are worked on together.
_SLICE = 1000

_rng = np.random.default_rng(20240601)
_A = _rng.integers(0, 2**31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * LEVELS, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), TREES * LEVELS) 16-bit MinHash values; every set must hold something."""
    out = np.empty((len(sets), TREES * LEVELS), np.uint16)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= _BATCH):
            n += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        h = np.empty_like(x)
        for k in range(TREES * LEVELS):
            np.multiply(x, _A[k], out=h)
            np.add(h, _B[k], out=h)
            out[at:end, k] = np.minimum.reduceat(h, starts).astype(np.uint16)
        at = end
    return out


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in slices; what is made of a slice is gone before the next."""
    for b in batches:
        for i in range(0, len(b), _SLICE):
            yield b.iloc[i:i + _SLICE].reset_index(drop=True)


def _sign(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches):
            sets = [shingles(t, size) for t in b["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full]) if full else None
            packed: list = [None] * len(sets)
            f1, f2 = [None] * len(sets), [None] * len(sets)
            with np.errstate(over="ignore"):
                for j, i in enumerate(full):
                    s = sets[i]
                    packed[i] = sig[j].tobytes()
                    f1[i] = int(mix64(s).sum(dtype=np.uint64).astype(np.int64))
                    f2[i] = int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": [len(s) for s in sets],
                                "f1": pd.array(f1, "Int64"), "f2": pd.array(f2, "Int64"), "sig": packed})
    return run


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each tree: the signature as two longs, the first holding MIN_DEPTH levels."""
    for b in batches:
        if not len(b):
            continue
        k = np.frombuffer(b"".join(b["sig"]), np.int64).reshape(len(b), TREES, LEVELS // MIN_DEPTH)
        bits = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), -1)[:, :SKETCH].astype(np.uint8) & 1
        sketch = np.packbits(bits, axis=1).view(np.int64)
        yield pd.DataFrame({"tree": np.tile(np.arange(TREES, dtype=np.int32), len(b)),
                            "k1": k[:, :, 0].ravel(), "k2": k[:, :, 1].ravel(), "id": np.repeat(b["id"].to_numpy(), TREES),
                            "comp": np.repeat(b["comp"].to_numpy(), TREES),
                            "s1": np.repeat(sketch[:, 0], TREES), "s2": np.repeat(sketch[:, 1], TREES)})


_COLS = ["tree", "k1", "k2", "id", "comp", "s1", "s2"]
_TREE = "tree int, k1 long, k2 long, id long, comp long, s1 long, s2 long"
_NEAR = f"a long, b long, part int, pos long, {_TREE}"


def _pairs(x: dict[str, np.ndarray], first: bool, gap: np.ndarray | None = None) -> pd.DataFrame:
    """Adjacent rows that share MIN_DEPTH levels and are not of one component.

    In the first pass, those of the first trees; the ids of all rows beside
    another of their region are noted as (id, id), however much they differ.
    """
    region = np.cumsum(np.r_[True, (x["tree"][1:] != x["tree"][:-1]) | (x["k1"][1:] != x["k1"][:-1])
                             | (False if gap is None else gap[1:] != gap[:-1])]) if len(x["id"]) else np.zeros(0, int)
    at = np.flatnonzero((region[1:] == region[:-1]) & (x["comp"][1:] != x["comp"][:-1]))
    noted = np.unique(np.concatenate([x["id"][at], x["id"][at + 1]])) if first else np.zeros(0, np.int64)
    differ = sum(np.bitwise_count((x[s][at] ^ x[s][at + 1]).view(np.uint64)).astype(int) for s in ("s1", "s2"))
    at = at[(differ <= DIFFER) & ((x["tree"][at] < FIRST) | (not first))]
    a, b = x["id"][at], x["id"][at + 1]
    return pd.DataFrame({"a": np.r_[np.minimum(a, b), noted], "b": np.r_[np.maximum(a, b), noted]})


def _ends_of_runs(b: pd.DataFrame) -> pd.DataFrame:
    """Without the rows that stand between two of the same region and component."""
    same = ((b["tree"] == b["tree"].shift()) & (b["k1"] == b["k1"].shift()) & (b["comp"] == b["comp"].shift())).to_numpy()
    return b[~(same & np.r_[same[1:], False])] if len(b) else b


def _neighbours(first: bool):
    """Pairs inside a sorted partition, and its first and last rows for the step over the borders."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        tail, head, seen = None, [], 0
        for b in batches:
            if not len(b):
                continue
            b = _ends_of_runs(b).reset_index(drop=True)
            if not head:
                head.append(b.iloc[:1])
            x = b if tail is None else pd.concat([tail, b], ignore_index=True)
            yield _pairs({c: x[c].to_numpy() for c in _COLS}, first).assign(
                part=None, pos=None, **dict.fromkeys(_COLS))
            tail = x.iloc[-1:]
            seen += len(b)
        if seen:
            begin = pd.concat(head, ignore_index=True)
            # a partition that the borders cover leaves no gap between them
            ends = pd.concat([begin.assign(pos=np.arange(len(begin))),
                              tail.assign(pos=np.arange(seen - len(tail), seen))]).drop_duplicates("pos")
            yield ends.assign(a=None, b=None, part=part)[["a", "b", "part", "pos", *_COLS]]
    return run


def _borders(first: bool):
    """Pairs across the borders of partitions; two rows of each partition."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["part", "pos"])
        new = (np.diff(b["pos"].to_numpy(), prepend=0) != 1) & (b["pos"].to_numpy() > 0)
        return _pairs({c: b[c].to_numpy() for c in _COLS}, first, np.cumsum(new))
    return run


def candidates(reps: DataFrame, scratch: Scratch, first: bool) -> DataFrame:
    """Distinct (a, b) of classes (id, comp, sig) that are adjacent in a tree."""
    rows = reps.mapInPandas(_plant, _TREE)
    order = ["tree", "k1", "k2", "id"]
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .mapInPandas(_neighbours(first), _NEAR))
    inner = found.where("a IS NOT NULL").select("a", "b")
    across = found.where("a IS NULL").select("part", "pos", *_COLS).groupBy(F.lit("")).applyInPandas(
        _borders(first), "a long, b long")
    return scratch.keep(inner.union(across).distinct())


def meetings(rows: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """The rows (region, id, comp, ...) of regions (shingles) of several components, with the groups they meet in.

    A region of ``block`` rows or less is one group. A wider one is cut into
    blocks (name), those of a component of more rows than that apart from the
    others, and every two blocks but those of one component are a group (meet).
    """
    sizes = scratch.keep(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"),
                                                    F.max("comp").alias("hi")).where("lo < hi").select("region", "n"))
    rows = scratch.keep(rows.join(sizes, "region"))
    zero = F.lit(0).cast("long")
    narrow = rows.where(F.col("n") <= block).drop("n").withColumns({"name": zero, "meet": zero})
    wide = rows.where(F.col("n") > block).drop("n")
    units = wide.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c")) \
        .withColumn("big", F.col("c") > block).withColumn("unit", F.when(F.col("big"), F.col("comp")).otherwise(zero))
    whole = units.groupBy("region", "big", "unit").agg(F.ceil(F.sum("c") / block).alias("blocks"))
    units = scratch.keep(units.join(whole, ["region", "big", "unit"]).select("region", "comp", "big", "unit", "blocks"))
    name = F.xxhash64("big", "unit", "block")
    names = scratch.keep(units.drop("comp").distinct().withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
                         .select("region", "big", "unit", name.alias("name")))
    x, y = names.alias("x"), names.alias("y")
    apart = F.expr("x.name < y.name AND NOT (x.big AND y.big AND x.unit = y.unit) OR x.name = y.name AND NOT x.big")
    two = x.join(y, (F.col("x.region") == F.col("y.region")) & apart).select(
        "x.region", F.array_distinct(F.array("x.name", "y.name")).alias("names"), F.xxhash64("x.name", "y.name").alias("meet"))
    two = two.select("region", F.explode("names").alias("name"), "meet")
    dealt = wide.join(units, ["region", "comp"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
        .withColumn("name", name).drop("big", "unit", "blocks", "block").join(two, ["region", "name"])
    return narrow.unionByName(dealt)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by (region, meet), cut only between groups; the last group is held back."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        r, m = b["region"].to_numpy(), b["meet"].to_numpy()
        cut = np.flatnonzero((r[1:] != r[:-1]) | (m[1:] != m[:-1])) + 1
        if held and (held[-1]["region"].iloc[-1], held[-1]["meet"].iloc[-1]) != (r[0], m[0]):
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(cut):
            yield pd.concat([*held, b.iloc[:cut[-1]]], ignore_index=True)
            held = [b.iloc[cut[-1]:]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def _others(comp: np.ndarray, name: np.ndarray, step: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, later rows, which pairs count) of a group sorted by component: all pairs of two components, and of two blocks if there are two."""
    two = len(name) > 0 and (name != name[0]).any()
    for lo in range(0, len(comp), step):
        i, j = slice(lo, min(lo + step, len(comp))), slice(int(np.searchsorted(comp, comp[lo], "right")), len(comp))
        if j.start == j.stop:
            return
        v = comp[i][:, None] < comp[j][None, :]
        yield i, j, v & (name[i][:, None] != name[j][None, :]) if two else v


def _may_link(n, rest, s1, s2, m, rest2, t1, t2):
    """Sets of n and m shingles with ``rest`` from the shared one on: can they overlap enough, and are the sketches near?"""
    return ((100 + PERCENT) * np.minimum(rest, rest2) >= PERCENT * (n + m)) & (
        np.bitwise_count(s1 ^ t1).astype(np.int16) + np.bitwise_count(s2 ^ t2) <= DIFFER)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct pairs of two components of a group that may be similar enough."""
    for g in _groups(batches):
        r, m = g["region"].to_numpy(), g["meet"].to_numpy()
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (m[1:] != m[:-1])])
        size = np.diff(np.r_[first, len(g)])
        ids, comp, name = (g[c].to_numpy() for c in ("id", "comp", "name"))
        facts = [g["n"].to_numpy(np.int64), g["rest"].to_numpy(np.int64), g["s1"].to_numpy().view(np.uint64),
                 g["s2"].to_numpy().view(np.uint64)]
        of = np.repeat(np.arange(len(first)), size)
        narrow = (size <= NARROW) & (m[first] == 0)
        after = np.where(narrow[of], first[of] + size[of] - np.arange(len(g)), 0)  # rows from here to the end of a narrow group
        found = [np.zeros((0, 2), np.int64)]
        for k in range(1, int(after.max(initial=0))):
            a = np.flatnonzero(after > k)
            a = a[comp[a] != comp[a + k]]
            a = a[_may_link(*[x[a] for x in facts], *[x[a + k] for x in facts])]
            found.append(np.stack([ids[a], ids[a + k]], axis=1))
        for k in np.flatnonzero(~narrow):
            at = np.arange(first[k], first[k] + size[k])
            at = at[np.argsort(comp[at], kind="stable")]
            own = [x[at] for x in facts]
            for i, j, v in _others(comp[at], name[at], 256):
                v &= _may_link(*[x[i][:, None] for x in own], *[x[j][None, :] for x in own])
                x, y = np.nonzero(v)
                found.append(np.unique(np.stack([ids[at[i]][x], ids[at[j]][y]], axis=1), axis=0))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        if len(pairs):
            yield pd.DataFrame(pairs, columns=["a", "b"])


def _slot(s: np.ndarray) -> np.ndarray:
    return (mix64(s) & np.uint64(SLOTS - 1)).astype(np.int64)


def _count_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SLOTS, np.int64)
    with np.errstate(over="ignore"):
        for b in batches:
            for s in b["s"]:
                total += np.bincount(_slot(np.frombuffer(s, np.uint64)), minlength=SLOTS)
    full = np.flatnonzero(total)
    if len(full):
        yield pd.DataFrame({"slot": full, "n": total[full]})


def _head(counts: np.ndarray):
    """A row for each of the first shingles of a set, rare ones first: what is left from there on, and the sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches):
            out = []
            with np.errstate(over="ignore"):
                for i, c, sig, raw in zip(b["id"], b["comp"], b["sig"], b["s"], strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    bits = np.frombuffer(sig, np.uint16)[:SKETCH].astype(np.uint8) & 1
                    sketch = np.packbits(bits).view(np.int64)
                    head = s[np.lexsort((s, counts[_slot(s)]))][:len(s) * (100 - PERCENT) // 100 + 1].view(np.int64)
                    out.append(pd.DataFrame({"region": head, "id": i, "comp": c, "s1": sketch[0], "s2": sketch[1],
                                             "n": len(s), "rest": len(s) - np.arange(len(head))}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def wide(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(id) of the classes (id, comp, sig) that stand in a region of three rows or more and several components."""
    rows = scratch.keep(reps.mapInPandas(_plant, _TREE).select(F.xxhash64("tree", "k1").alias("region"), "id", "comp"))
    regions = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where("n > 2 AND lo < hi").select("region")
    return scratch.keep(rows.join(regions, "region", "left_semi").select("id").distinct())


def filtered(reps: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (a, b) of classes (id, comp, sig) of wide regions that may be similar enough, of two components."""
    own = scratch.keep(sets.join(wide(reps, scratch), "id"))
    counts = np.zeros(SLOTS, np.int64)
    slots = own.select("s").mapInPandas(_count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[slots["slot"].to_numpy(np.int64)] = slots["n"].to_numpy(np.int64)  # at most SLOTS rows
    rows = scratch.keep(own.join(reps, "id").select("id", "comp", "sig", "s").mapInPandas(
        _head(counts), "region long, id long, comp long, s1 long, s2 long, n int, rest int"))
    sizes = rows.withColumnRenamed("n", "size")
    dealt = meetings(sizes, BLOCK, scratch).withColumnRenamed("size", "n")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.keep(dealt.repartition(parts, "region", "meet").sortWithinPartitions("region", "meet")
                        .mapInPandas(_compare, "a long, b long").distinct())


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _parts(batches):
        yield pd.DataFrame({"id": b["doc_id"], "z": [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) if t else b""
                                                       for t in b["text"]]})


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches):
            yield pd.DataFrame({"id": b["id"], "s": [
                shingles(zlib.decompress(z).decode("utf-8", "surrogatepass") if z else "", size).tobytes() for z in b["z"]]})
    return run


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _parts(batches):
        ok = []
        for x, y in zip(b["x"], b["y"], strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True)) \
                if PERCENT * max(len(u), len(v)) <= 100 * min(len(u), len(v)) else 0
            ok.append(100 * both >= PERCENT * (len(u) + len(v) - both) and both > 0)
        yield b.loc[ok, ["a", "b"]]


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    return scratch.keep(left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
                 .select("a", "b", "x", "y").mapInPandas(_confirm, "a long, b long"))


def classify(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    try:
        return _classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle_words, scratch)
    finally:
        scratch.clear()


def _classify(docs: DataFrame, shingle_words: int, scratch: Scratch) -> DataFrame:
    rows = scratch.keep(docs.mapInPandas(_sign(shingle_words), "doc_id long, n long, f1 long, f2 long, sig binary"))
    sets_of = rows.where("f1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.keep(sets_of.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
                      .select("f1", "f2", F.col("m.doc_id").alias("id"), F.col("m.sig").alias("sig")))
    # a repeated doc_id may stand for several classes; they are one vertex
    found = candidates(classes.select("id", F.col("id").alias("comp"), "sig"), scratch, True)
    crowd, tried = found.where("a = b").select(F.col("a").alias("id")), found.where("a < b").select("a", "b")
    # the texts travel once, to the partition of their id; the sets made there are that bucket of
    # a table, which every later join reads in place
    packed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(_pack, "id long, z binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = scratch.bucketed(packed.repartition(parts, "id").join(crowd, "id")
                            .mapInPandas(_sets(shingle_words), "id long, s binary"), "id")
    links = confirmed(tried, sets, scratch)
    comp = components(links, scratch)
    for search in (lambda x: candidates(x, scratch, False), lambda x: filtered(x, sets, scratch)):
        again = classes.join(crowd, "id").join(comp, "id", "left") \
            .select("id", F.coalesce("component", "id").alias("comp"), "sig")
        pairs = scratch.keep(search(again).join(tried, ["a", "b"], "left_anti"))
        more = confirmed(pairs, sets, scratch)
        if not more.isEmpty():
            links = links.union(more)
            comp = components(links, scratch)
        tried = tried.union(pairs)
    reps = classes.join(comp, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    out = rows.join(reps, ["f1", "f2"], "left")
    # a document without a set, or one row of several of a doc_id, is its own component
    return written(out.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("c"))
            .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"),
                    F.coalesce(F.col("c").isNull() | (F.col("c") == F.col("doc_id")), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """One row of each component of rows, with the columns of docs: the one of the smallest doc_id, null ones last."""
    scratch = Scratch(docs.sparkSession)
    try:
        row, own = "__row", "__own"
        numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
        ids = numbered.select(F.col(row), F.col("doc_id").cast("long").alias(own))
        of = classify(numbered.select(F.col(row).alias("doc_id"), "text"), shingle_words) \
            .select(F.col("doc_id").alias(row), "component_id")
        first = of.join(ids, row).groupBy("component_id").agg(
            F.min(F.struct(F.isnull(own).alias("none"), F.col(own), F.col(row))).alias("m")).select(F.col(f"m.{row}").alias(row))
        return written(numbered.join(first, row, "left_semi").select(*docs.columns))
    finally:
        scratch.clear()
