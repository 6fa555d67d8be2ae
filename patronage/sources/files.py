"""File sources (S1-S4): CSV with an explicit schema, column mapping,
date parsing, preview."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.validation import require_columns

# Schemas of the reference's two sample files.
CUSTOMERS_SCHEMA = ("customer_id BIGINT, recency INT, frequency INT, monetary DOUBLE, age INT, "
                    "gender STRING, region STRING, churn INT, ltv DOUBLE")
TRANSACTIONS_SCHEMA = ("customer_id BIGINT, transaction_date DATE, amount DOUBLE, "
                       "product_category STRING, channel STRING")


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header row. Give a schema in production; without one the
    types are inferred (an extra pass over the file)."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def map_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename source columns to the names the operators expect (S2):
    ``mapping`` is {target: source}; other columns are kept."""
    require_columns(df, list(mapping.values()), "map_columns")
    sources = set(mapping.values())
    rest = [F.col(c) for c in df.columns if c not in sources and c not in mapping]
    return df.select(*[F.col(src).alias(dst) for dst, src in mapping.items()], *rest)


def parse_dates(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """Parse a date/time column to TIMESTAMP (S3)."""
    c = F.to_timestamp(F.col(col), fmt) if fmt else F.to_timestamp(F.col(col))
    return df.withColumn(col, c)


def preview(df: DataFrame, n: int = 5):
    """First rows and shape (S4): (rows as a DataFrame, (row count, column count))."""
    return df.limit(n), (df.count(), len(df.columns))
