"""Result directories: one headerless CSV table per query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from flowlens.operators.projection import project_to
from flowlens.schema import RESULTS

CHUNK_ROWS = 5_000  # of a file, where whoever reads the results takes them in batches


def write_results(
    results: Mapping[str, DataFrame],
    folder: str,
    client: str | None = None,
    max_records_per_file: int | None = None,
) -> None:
    """Replaces ``folder/<query>``. With `client`, a column, there is one subdirectory per client
    in it, and only those of clients with rows in this answer are replaced: writing one client's
    answers leaves those of others alone. `max_records_per_file` bounds the files, see CHUNK_ROWS."""
    for query, df in results.items():
        by = [client] if client else []
        rows = project_to(df, RESULTS[query], by) if query in RESULTS else df
        writer = rows.write.mode("overwrite").option("header", False)
        if max_records_per_file is not None:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        if client is not None:
            writer = writer.partitionBy(client).option("partitionOverwriteMode", "dynamic")
        writer.csv(f"{folder}/{query}")


def read_result(spark: SparkSession, path: str, query: str, client: str | None = None) -> DataFrame:
    """A result as it was written; with `client`, the clients come back as that column."""
    schema = RESULTS[query]
    if client is not None:
        schema = T.StructType([*schema.fields, T.StructField(client, T.StringType())])
    return spark.read.schema(schema).csv(path)
