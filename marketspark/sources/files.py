"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from marketspark.sources.schema import LISTING_FILE


def read_listings(spark: SparkSession, path: str, schema: T.StructType = LISTING_FILE) -> DataFrame:
    """Listing file: header, ``#`` comment lines, ``MM-dd-yyyy`` dates, empty field = null."""
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        comment="#",
        dateFormat="MM-dd-yyyy",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
        enforceSchema=True,
    )


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Small lookup file whose values may carry blanks on either side."""
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
    )


def read_processed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Enriched dump with ISO dates and the literal ``NA`` for null."""
    return spark.read.csv(
        path, schema=schema, header=True, nullValue="NA", dateFormat="yyyy-MM-dd", mode="FAILFAST"
    )


def write_csv(df: DataFrame, path: str, null_value: str = "NA", date_format: str = "yyyy-MM-dd") -> None:
    """One part file per task: the write stays distributed and no row passes through the driver."""
    df.write.mode("overwrite").csv(
        path, header=True, nullValue=null_value, emptyValue="", dateFormat=date_format
    )
