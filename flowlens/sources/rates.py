"""Exchange rates from the documents a daily rates service answers with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.currency import BASE_CODE
from flowlens.operators.projection import project_to
from flowlens.schema import RATES

_DOCUMENT = "date date, base string, rates map<string, double>"


def read_rates(spark: SparkSession, path: str, base: str = BASE_CODE) -> DataFrame:
    """JSON lines ``{"date": "2022-09-01", "base": "USD", "rates": {"EUR": 0.99, ...}}`` as
    one row per day and code. Documents for another base are left out."""
    documents = spark.read.schema(_DOCUMENT).json(path).where(F.col("base") == base)
    rows = documents.select(F.col("date").alias("rate_date"), F.explode("rates").alias("code", "rate"))
    return project_to(rows, RATES)
