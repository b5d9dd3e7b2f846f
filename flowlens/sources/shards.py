"""Exports in a fixed number of shards by key, for readers that each take one of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.operators.routing import with_shard

FILE_ROWS = 1_000_000
MANIFEST = "shard int, files bigint, rows bigint, most_rows bigint"


def write_shards(df: DataFrame, key: Sequence[str], shards: int, folder: str, rows_per_file: int = FILE_ROWS) -> None:
    """Writes each row to the shard of its key, ``folder/data/shard=<1..n>``, in files of at most
    `rows_per_file` rows, and last a manifest with one line per shard, empty ones too. The folder must
    be new. Rows meet by shard in a rebalancing shuffle, which cuts a shard with a hot key into several
    tasks and keeps small ones in one file."""
    if "shard" in (c.lower() for c in df.columns):
        raise ValueError("a column is named shard already")
    spark = df.sparkSession
    dealt = with_shard(df, key, shards).hint("rebalance", F.col("shard"))
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(f"{folder}/data")
    numbers = spark.range(1, shards + 1).select(F.col("id").cast("int").alias("shard"))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType())])
    written = spark.read.schema(schema).parquet(f"{folder}/data")
    per_file = written.groupBy("shard", F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    per_shard = per_file.groupBy("shard").agg(
        F.count("*").alias("files"), F.sum("n").alias("rows"), F.max("n").alias("most_rows")
    )
    listed = numbers.join(per_shard, "shard", "left").fillna(0)
    listed.coalesce(1).write.parquet(f"{folder}/manifest")  # a line per shard


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files, rows and rows of the largest file of every shard. Without it an export isn't complete."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shard(spark: SparkSession, folder: str, shard: int, schema: T.StructType) -> DataFrame:
    """The rows of one shard, from its own files alone."""
    line = manifest(spark, folder).where(F.col("shard") == shard).first()
    if line is None:
        raise ValueError(f"no shard {shard} in this export")
    if line["rows"] == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/data/shard={shard}")
