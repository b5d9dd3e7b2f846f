"""Transactions and accounts from CSV files with a header row."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.cleaning import blank_to_null, parse_timestamp, to_amount
from flowlens.operators.joins import union_streams
from flowlens.operators.projection import project_to
from flowlens.schema import ACCOUNT_COLUMNS, ACCOUNTS, TRANSACTION_COLUMNS, TRANSACTIONS

_AMOUNTS = ("amount_received", "amount_paid")


def dedupe_header(header: Sequence[str]) -> list[str]:
    """Repeated names get ".1", ".2", ... so that a second `Account` stays apart."""
    repeats: dict[str, int] = {}
    names = []
    for name in (h.strip() for h in header):
        count = repeats.get(name, 0)
        repeats[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


WHOLE_FILE = 1 << 50  # more bytes than a file has


def layouts(spark: SparkSession, *paths: str) -> dict[tuple[str, ...], list[str]]:
    """The files under `paths` by their header, repeated names told apart; empty files have none.

    One task per file, however long, which stops after the first batch of lines; only headers and
    the names of files come to the driver, which lists them for any reader."""
    single = spark.newSession()  # its own settings: files stay whole, no two in one partition
    for setting in ("maxPartitionBytes", "openCostInBytes"):
        single.conf.set(f"spark.sql.files.{setting}", str(WHOLE_FILE))
    lines = single.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    firsts = lines.mapInArrow(_first_rows, "value string, file string, at bigint").where("at = 0")
    found = firsts.groupBy("value").agg(F.collect_list("file").alias("files")).collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for row in found:
        names = tuple(dedupe_header(next(csv.reader([row["value"].lstrip("\ufeff")]), [])))
        out.setdefault(names, []).extend(map(unquote, row["files"]))  # Spark gives them as uris
    return out


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of the files under `path`; [] if there are none. Files that do not share one
    layout are an error, since a reader with one schema would swap their columns unnoticed."""
    found = layouts(spark, path)
    if len(found) > 1:
        raise ValueError(f"files of {len(found)} layouts under {path}: {sorted(found)[:3]}")
    return list(*found)


def raw_schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


CSV_OPTIONS = {"header": "true", "encoding": "UTF-8", "escape": '"'}


def _read_raw(spark: SparkSession, paths: Sequence[str], multi_line: bool) -> list[DataFrame]:
    """One DataFrame per layout of the files under `paths`, read by name."""
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
    found = [reader.schema(raw_schema(names)).csv(sorted(files)) for names, files in (layouts(spark, *paths) if paths else {}).items()]
    return found or [spark.createDataFrame([], T.StructType())]


def _renamed(raw: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return raw.select(
        *(F.col(f"`{name}`").alias(field) for name, field in columns.items() if name in raw.columns)
    )


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Text columns under their field names, typed; absent ones become NULL."""
    columns = {}
    for name in raw.columns:
        if name == "timestamp":
            columns["ts"] = parse_timestamp(F.col(name))
        elif name in _AMOUNTS:
            columns[name] = to_amount(F.col(name))
        else:
            columns[name] = blank_to_null(F.col(name))
    return project_to(raw.select(*(c.alias(n) for n, c in columns.items())), TRANSACTIONS)


def clean_accounts(raw: DataFrame) -> DataFrame:
    return project_to(raw.select(*(blank_to_null(F.col(c)).alias(c) for c in raw.columns)), ACCOUNTS)


def transactions_from_raw(raw: DataFrame) -> DataFrame:
    """Raw CSV columns, mapped by header name and cleaned; also for streams."""
    return clean_transactions(_renamed(raw, TRANSACTION_COLUMNS))


def accounts_from_raw(raw: DataFrame) -> DataFrame:
    return clean_accounts(_renamed(raw, ACCOUNT_COLUMNS))


def read_transactions(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Columns are found by their names, file by file. Leave `multi_line` off unless quoted fields
    hold line breaks: with it a file cannot be split between tasks."""
    return union_streams(*(transactions_from_raw(raw) for raw in _read_raw(spark, paths, multi_line)))


def read_accounts(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    return union_streams(*(accounts_from_raw(raw) for raw in _read_raw(spark, paths, multi_line)))
