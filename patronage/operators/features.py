"""Customer feature tables and preparation."""
from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scaling import attach_row, nan_to_null
from ..functions.validation import require_columns
from ..sources import tables as src
from ..storage import kept
from .order_stats import quantiles, select_ranks
from .rfm import rfm_from_transactions


def labelled_customers(spark, sf_dir: str, cut: str = src.TXN_LABEL_CUT) -> DataFrame:
    """Features from orders before ``cut`` (RFM at the cut date plus account
    balance), outcomes after it: ltv = spend after the cut, churn = 1 when
    there is no order after the cut. Region and market segment ride along."""
    t = src.txn(spark, sf_dir)
    cut_ts = F.lit(cut).cast("timestamp_ntz")
    feats = rfm_from_transactions(t.where(F.col("date") < cut_ts), "customer_id", "date", "amount", cut)
    after = (t.where(F.col("date") >= cut_ts).groupBy("customer_id")
             .agg(F.sum("amount").alias("__ltv"), F.count(F.lit(1)).alias("__n")))
    attrs = src.customer_attributes(spark, sf_dir)
    return (feats.join(after, "customer_id", "left").join(attrs, "customer_id", "left")
            .select("customer_id", "recency", "frequency", "monetary", "acctbal", "region", "mktsegment",
                    F.coalesce("__ltv", F.lit(0.0)).alias("ltv"),
                    F.when(F.col("__n").isNull(), 1).otherwise(0).alias("churn")))


def numeric_features(df: DataFrame, target: str | None = None, exclude=()) -> list:
    """All numeric columns but the target and the excluded ones."""
    skip = set(exclude) | ({target} if target else set())
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def impute_median(df: DataFrame, cols) -> DataFrame:
    """Fill missing values (null or NaN) with the exact column median; a
    column without values stays missing."""
    if not cols:
        return df
    casted = nan_to_null(df.withColumns({c: F.col(c).cast("double") for c in cols}), cols)
    medians = {c: q[0] for c, q in quantiles(casted, list(cols), [0.5]).items()}
    return casted.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def standardize(df: DataFrame, cols, ddof: int = 0, stats: DataFrame | None = None):
    """Standard scaling with the population deviation (as the reference's
    scaler; Spark's StandardScaler uses the sample one). ``stats`` lets a
    test split reuse the training statistics. Returns (frame, stats)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    if stats is None:
        stats = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[std(c).alias(f"{c}__s") for c in cols])
    joined = attach_row(df, stats)
    scaled = []
    for c in cols:
        s = F.col(f"{c}__s")
        scaled.append(((F.col(c) - F.col(f"{c}__m")) / F.when(s.isNull() | (s == 0), 1.0).otherwise(s)).alias(c))
    keep = [F.col(c) for c in df.columns if c not in cols]
    return joined.select(*keep, *scaled), stats


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def prepare(df: DataFrame, cols, out: str = "features"):
    """Impute medians, scale, assemble a vector column (M1). Returns (frame, stats)."""
    require_columns(df, cols, "prepare")
    filled = impute_median(df, list(cols))
    scaled, stats = standardize(filled, list(cols))
    return assemble(scaled, cols, out), stats


def hash_unit(*parts):
    """A number in [0, 1) from the md5 of the parts: stable under repartitioning
    and re-execution, and the same in any engine with md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _class_ranks(df: DataFrame, u, stratify: str | None, ranks) -> tuple[dict, dict]:
    """Class sizes, and per class the value of ``u`` at each rank of ``ranks(class, sizes)``."""
    cls = F.col(stratify) if stratify else F.lit(0)
    keyed = kept(df.select(cls.alias("c"), u.alias("u")))
    sizes = {r["c"]: r["n"] for r in keyed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    own = {c: F.col("c").eqNullSafe(F.lit(c)) for c in sizes}
    requests = {(c, r): (own[c], "u", r) for c in sizes for r in ranks(c, sizes) if r >= 0}
    return sizes, {k: v for k, v in select_ranks(keyed, requests).items() if v is not None}


def split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42, exact: bool = False,
          stratify: str | None = None) -> DataFrame:
    """Add ``is_test`` from a hash of (id, seed) (M9): deterministic, and
    stratified in expectation because the draw is independent of the label.

    ``exact=True`` takes ceil(test_size * n) test rows, and with ``stratify``
    each class gets its share of them (floors first, the remainder to the
    largest fractions): the rows with the smallest hashes of the class. Only
    the hash at the quota is looked for (counting passes, no sort); rows of
    equal hash fall on the same side.
    """
    u = hash_unit(F.col(id_col), F.lit(int(seed)))
    if not exact:
        return df.withColumn("is_test", u < F.lit(float(test_size)))
    quota: dict = {}

    def ranks(c, sizes):
        if not quota:
            n = sum(sizes.values())
            n_test = math.ceil(test_size * n)
            keys = sorted(sizes, key=lambda v: (v is not None, v))
            quota.update({k: (n_test * sizes[k]) // n for k in keys})
            rest = n_test - sum(quota.values())
            for k in sorted(keys, key=lambda k: (-((n_test * sizes[k]) % n), keys.index(k)))[:rest]:
                quota[k] += 1
        return [quota[c] - 1]

    sizes, last = _class_ranks(df, u, stratify, ranks)
    test = F.lit(False)
    for (c, _), value in last.items():
        own = F.col(stratify).eqNullSafe(F.lit(c)) if stratify else F.lit(True)
        test = test | (own & (u <= F.lit(value)))
    return df.withColumn("is_test", test)


def folds(df: DataFrame, id_col: str, cv: int = 5, seed: int = 43, stratify: str | None = None) -> DataFrame:
    """Add ``fold`` 0 .. cv - 1 (M14, M22): the rows of each class in hash
    order, cut into cv parts whose sizes differ by one at most."""
    u = hash_unit(F.col(id_col), F.lit(int(seed)))
    sizes, edge = _class_ranks(df, u, stratify, lambda c, n: [n[c] * k // cv - 1 for k in range(1, cv)])
    fold = F.lit(0)
    for c, n in sizes.items():
        own = F.col(stratify).eqNullSafe(F.lit(c)) if stratify else F.lit(True)
        for k in range(1, cv):
            value = edge.get((c, n * k // cv - 1))
            after = own if value is None else own & (u > F.lit(value))
            fold = fold + F.when(after, 1).otherwise(0)
    return df.withColumn("fold", fold)
