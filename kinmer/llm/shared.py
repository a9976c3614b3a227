"""Small helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmer.operators.common import spread, unused  # noqa: F401
from kinmer.shared import cut  # noqa: F401 - for this subpackage's modules

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is dealt over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
