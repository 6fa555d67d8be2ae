"""Exact-substring removal by distributed prefix doubling on a sampled suffix set.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
somewhere else. Ranks follow prefix doubling: the rank of a string of 2k bytes
is named from the ranks of its halves, (rank(p, k), rank(p + k, k)); the name
is a 64-bit fingerprint of the pair, so no global renumbering is needed and
Spark only has to bring equal ranks together (grouped sorts). A position
leaves as soon as its rank is unique.

Ranking every byte would be a row a byte. Positions are sampled instead: the
anchor of a 200-byte string is the 32-byte rank that is least among those it
holds (the leftmost of equals), so equal strings have anchors at equal offsets
and one row stands for the strings that share an anchor.

1. rank 32: anchors whose rank is unique leave;
2. rank 144: the strings of an anchor are cut into slices by offset; all
   strings of a slice hold the same 144 bytes, a slice alone with its rank
   leaves. Slices equal in full (pair of 200-byte ranks at their two ends) are
   a class: with two members every string of them is found twice;
3. rank 200: the strings of the classes that share the 144 bytes and differ
   beyond are compared one by one, for one member of a class.

All steps are grouped counts and equi-joins on ranks, which adaptive execution
may split; the texts are written once, bucketed by row, so the three steps
that read them again shuffle no text.

Defined cases: a null text is empty; texts shorter than 200 bytes lose
nothing; rows with equal or null ids are separate documents; columns of docs
are carried along untouched.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import Scratch, column_udf, mix64, written

LENGTH, ANCHOR = 200, 32
#: Offsets between an anchor and the starts of its strings: 0 .. SPAN - 1, cut into slices of SLICE.
SPAN, SLICE = LENGTH - ANCHOR + 1, 57
#: Starts handled at a time; bounds the memory a long text takes.
_CHUNK = 1 << 21
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Name of a pair of ranks."""
    z = (x ^ (x >> np.uint64(29))) * _C1
    z += (y ^ (y >> np.uint64(32))) * _C2
    return z ^ (z >> np.uint64(31))


def ranks(data: bytes) -> dict[int, np.ndarray]:
    """Ranks of every substring of 32, 128 and 200 bytes, by doubling from 8 bytes."""
    r = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,)).copy()
    out = {}
    k = 8
    while k < 128:
        r = _pair(r[:-k], r[k:])
        k *= 2
        out[k] = r
    out[LENGTH] = _pair(r[:len(data) - LENGTH + 1], r[LENGTH - 128:])
    return out


def _chunks(data: bytes) -> Iterator[tuple[int, dict[int, np.ndarray], np.ndarray]]:
    """(start, ranks, anchor of each start relative to the chunk) for runs of starts."""
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        with np.errstate(over="ignore"):
            r = ranks(data[at:at + _CHUNK + LENGTH - 1])
        n = len(r[LENGTH])
        key = (mix64(r[ANCHOR]) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(r[ANCHOR]), dtype=np.uint64)
        # sliding minimum: of the end of one block and the start of the next
        blocks = -(-len(key) // SPAN)
        key = np.concatenate([key, np.full(blocks * SPAN - len(key), ~np.uint64(0))]).reshape(blocks, SPAN)
        head = np.minimum.accumulate(key, axis=1).ravel()
        tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(tail[:n], head[SPAN - 1:SPAN - 1 + n])
        yield at, r, (low & np.uint64(0xFFFFFF)).astype(np.int64)


def _unpack(z: bytes) -> bytes:
    return zstandard.decompress(z) if z else b""


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, rid, a): the 32-byte ranks of the anchors of a text."""
    for b in batches:
        hs, rids, pos = [], [], []
        for rid, z in zip(b["rid"], b["z"], strict=True):
            for at, r, anchor in _chunks(_unpack(z)):
                a = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                hs.append(_i64(r[ANCHOR][a]))
                rids.append(np.full(len(a), rid))
                pos.append(a + at)
        if hs:
            yield pd.DataFrame({"h": np.concatenate(hs), "rid": np.concatenate(rids), "a": np.concatenate(pos)})


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(core, full, rid, lo, hi): the slices of the anchors ``at`` of a text, as runs of starts lo..hi."""
    for b in batches:
        out: list[tuple] = []
        for rid, z, wanted in zip(b["rid"], b["z"], b["at"], strict=True):
            wanted = np.asarray(wanted, np.int64)
            for at, r, anchor in _chunks(_unpack(z)):
                offset = anchor - np.arange(len(anchor))
                part = offset // SLICE
                cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
                lo, hi = cut, np.r_[cut[1:], len(anchor)] - 1
                own = np.isin(anchor[lo] + at, wanted)
                lo, hi = lo[own], hi[own]
                if not len(lo):
                    continue
                # common to the strings of a slice: from its latest possible start to the end of its earliest
                core = anchor[lo] - part[lo] * SLICE
                r128, r200 = r[128], r[LENGTH]
                width = LENGTH - SLICE + 1
                with np.errstate(over="ignore"):
                    c = _pair(_pair(r128[core], r128[core + width - 128]), mix64(part[lo].astype(np.uint64)))
                    shape = ((hi - lo) * 512 + offset[lo]).astype(np.uint64)
                    f = _pair(_pair(r200[lo], r200[hi]), mix64(shape))
                out.append((_i64(c), _i64(f), np.full(len(lo), rid), lo + at, hi + at))
        if out:
            core, full, rid, lo, hi = map(np.concatenate, zip(*out, strict=True))
            yield pd.DataFrame({"core": core, "full": full, "rid": rid, "lo": lo, "hi": hi})


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(r, rid, s, alone): the 200-byte rank of every start of the given slices."""
    for b in batches:
        out = []
        for rid, z, runs in zip(b["rid"], b["z"], b["runs"], strict=True):
            runs = sorted((x["lo"], x["hi"], x["alone"]) for x in runs)
            lo = np.array([x[0] for x in runs])
            for at, r, _ in _chunks(_unpack(z)):
                n = len(r[LENGTH])
                for i in range(np.searchsorted(lo, at - SLICE), np.searchsorted(lo, at + n)):
                    s = np.arange(max(runs[i][0], at), min(runs[i][1], at + n - 1) + 1)
                    if len(s):
                        out.append((_i64(r[LENGTH][s - at]), np.full(len(s), rid), s, np.full(len(s), runs[i][2])))
        if out:
            r, rid, s, alone = map(np.concatenate, zip(*out, strict=True))
            yield pd.DataFrame({"r": r, "rid": rid, "s": s, "alone": alone})


def _cut(data: bytes, runs) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes removed and the maximal removed runs."""
    kept, end, removed, spans = [], 0, 0, 0
    start = 0  # of what is kept next
    for lo, hi in sorted((x["lo"], x["hi"] + LENGTH) for x in runs):
        if lo > end or not spans:
            kept.append(data[start:lo])
            spans += 1
            removed += hi - lo
        else:
            removed += max(0, hi - end)
        end = max(end, hi)
        start = end
    kept.append(data[start:])
    return b"".join(kept), removed, spans


_FINDINGS = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                        StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


class Repeats:
    """The repeated strings of a corpus: ``digest`` reports them, ``cleaned`` removes them."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.spark, self.text, self.columns = docs.sparkSession, text, docs.columns
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"patronage_repeats_{uuid.uuid4().hex}"

        def packer():
            pack = zstandard.ZstdCompressor(level=3)
            return lambda t: pack.compress(t.encode("utf-8", "surrogatepass")) if t else b""

        rest = [F.col(c) for c in docs.columns if c != text]
        (docs.select(F.struct(*rest).alias("rest") if rest else F.struct(F.lit(0)).alias("rest"),
                     column_udf(packer, BinaryType())(F.col(text)).alias("z"),
                     F.col(text).isNull().alias("none"),
                     F.monotonically_increasing_id().alias("rid"))
         .repartition(parts, "rid").write.bucketBy(parts, "rid").format("parquet").saveAsTable(self.table))
        texts = self.spark.table(self.table).select("rid", "z")
        self.scratch = Scratch(self.spark)
        self.runs = self._find(texts, self.scratch.keep)

    def _find(self, texts: DataFrame, keep) -> DataFrame:
        """(rid, lo, hi): runs of starts whose 200 bytes start elsewhere too."""
        anchors = texts.mapInPandas(_anchors, "h long, rid long, a int")
        twice = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        wanted = keep(anchors.join(twice, "h", "left_semi").groupBy("rid").agg(F.collect_list("a").alias("at")))
        slices = keep(texts.join(wanted, "rid").mapInPandas(
            _slices, "core long, full long, rid long, lo int, hi int"))
        classes = slices.groupBy("core", "full").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("one"))
        classes = keep(classes)
        equal = slices.join(classes.where("n > 1").select("core", "full"), ["core", "full"], "left_semi") \
            .select("rid", "lo", "hi")
        # 144 bytes shared by classes that differ beyond, one of them a single slice
        open_ = classes.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")) \
            .where("k > 1 AND least = 1").select("core")
        rest = classes.join(open_, "core", "left_semi").select("one.*", (F.col("n") == 1).alias("alone"))
        runs = rest.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "alone")).alias("runs"))
        starts = keep(texts.join(runs, "rid").mapInPandas(_starts, "r long, rid long, s int, alone boolean"))
        again = starts.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r")
        single = starts.where("alone").join(again, "r", "left_semi") \
            .select("rid", F.col("s").alias("lo"), F.col("s").alias("hi"))
        return equal.union(single)

    def _joined(self) -> DataFrame:
        runs = self.runs.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
        return self.spark.table(self.table).join(runs, "rid", "left")

    def digest(self) -> DataFrame:
        """The other columns of docs with n_bytes, n_removed, n_spans and kept_sha256."""
        @F.pandas_udf(_FINDINGS)
        def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for zs, runs in batches:
                rows = []
                for z, r in zip(zs, runs, strict=True):
                    data = _unpack(z)
                    kept, removed, spans = _cut(data, r if r is not None else [])
                    rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(rows, columns=_FINDINGS.names)
        return self._joined().select("rest", found("z", "runs").alias("found")).select(
            *[F.col("rest")[c].alias(c) for c in self.columns if c != self.text], "found.*")

    def cleaned(self) -> DataFrame:
        """docs without the repeated bytes; a character that loses a byte goes whole."""
        @F.pandas_udf(StringType())
        def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for zs, runs in batches:
                yield pd.Series([_cut(_unpack(z), r if r is not None else [])[0].decode("utf-8", "ignore")
                                 for z, r in zip(zs, runs, strict=True)], dtype=object)
        text = F.when(~F.col("none"), clean("z", "runs")).alias(self.text)
        return self._joined().select(*[text if c == self.text else F.col("rest")[c].alias(c) for c in self.columns])

    def drop(self) -> None:
        """Remove the table of texts and what was kept beside it, once every result has been written."""
        self.scratch.clear()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    found = Repeats(docs.select("doc_id", "text"))
    out = written(found.digest())
    found.drop()
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes of text removed."""
    found = Repeats(docs)
    out = written(found.cleaned())
    found.drop()
    return out
