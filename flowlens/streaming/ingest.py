"""Tables read file by file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from flowlens.schema import ACCOUNTS, TRANSACTIONS
from flowlens.sources.csv_tables import (
    CSV_OPTIONS,
    accounts_from_raw,
    raw_schema,
    read_accounts,
    read_header,
    read_transactions,
    transactions_from_raw,
)
from flowlens.streaming.runs import committed, run


def stream_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    max_files: int | None = None,
    name_filter: str | None = None,
    used_up: bool = False,
) -> DataFrame:
    """The Parquet files of a folder; `max_files` bounds what one batch takes in. `used_up` files, for copies
    that one stream reads, are deleted once a later batch has begun."""
    reader = spark.readStream.schema(schema)
    if used_up:
        reader = reader.option("cleanSource", "delete")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def _stream_csv(
    spark: SparkSession, path: str, header: Sequence[str] | None, max_files: int | None
) -> DataFrame:
    names = list(header) if header is not None else read_header(spark, path)
    reader = spark.readStream.options(**CSV_OPTIONS).schema(raw_schema(names))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(path)


def stream_transactions(
    spark: SparkSession, path: str, header: Sequence[str] | None = None, max_files: int | None = None
) -> DataFrame:
    """Transaction CSV files as they arrive. Without `header` a file must be there to read
    it from; repeated names in a given header need their ".1" already."""
    return transactions_from_raw(_stream_csv(spark, path, header, max_files))


def stream_accounts(
    spark: SparkSession, path: str, header: Sequence[str] | None = None, max_files: int | None = None
) -> DataFrame:
    return accounts_from_raw(_stream_csv(spark, path, header, max_files))


#: What a stream of file names looks like; only the path is asked for, so no content is read.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
LANDED_FILES = 1_000  # that one micro-batch takes in; their names come to the driver


def _land(
    spark: SparkSession, path: str, folder: str, schema: T.StructType, read: Callable[..., DataFrame], max_files: int
) -> DataFrame:
    names = (
        spark.readStream.schema(_FILES).format("binaryFile").option("maxFilesPerTrigger", max_files).load(path).select("path")
    )

    def branches(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        return {"rows": read(batch.sparkSession, *(row["path"] for row in batch.collect()))}

    run(names, folder, branches, atomic=True)
    return committed(spark, folder, "rows", schema)


def land_transactions(spark: SparkSession, path: str, folder: str, max_files: int = LANDED_FILES) -> DataFrame:
    """Takes in the transaction CSV files that have arrived under `path` since the last call, every
    file by its own header, at most `max_files` in a micro-batch, and returns all rows landed so
    far with the number of their `batch`. The rows lie as Parquet in ``folder/rows``, which
    `stream_parquet` reads as a stream. A repeated batch overwrites its own rows; a file without
    rows brings none."""
    return _land(spark, path, folder, TRANSACTIONS, read_transactions, max_files)


def land_accounts(spark: SparkSession, path: str, folder: str, max_files: int = LANDED_FILES) -> DataFrame:
    """The same for accounts."""
    return _land(spark, path, folder, ACCOUNTS, read_accounts, max_files)
