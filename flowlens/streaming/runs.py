"""Running a stream over what is there and getting its result as a table.

Results are files below the shared folder, never rows on the driver. Each micro-batch owns a
directory named by its number and overwrites it, so a batch repeated after a failure leaves
one copy. Starting again on the same folder continues where the last run ended.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.session import GIVEN_BACK, settings

COMMITTED = "committed"
BatchBranches = Callable[[DataFrame, int], Mapping[str, DataFrame]]


def start(
    stream: DataFrame,
    folder: str,
    branches: BatchBranches,
    mode: str = "append",
    every: str | None = None,
    atomic: bool = False,
    conf: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Starts a query that writes each branch of each batch to
    ``folder/<branch>/batch=<number>``. It stops when the available input is used up, or
    goes on with a batch `every` so often. With `atomic` a row in ``folder/committed/batch=<number>``
    says, last of all, that a batch's branches are all there, for readers by `committed`. `conf` are
    settings of this query alone, such as `live.STATE_CONF`."""

    def write(batch: DataFrame, number: int) -> None:
        outputs = branches(batch, number)
        shared = batch.persist() if len(outputs) > 1 else None
        try:
            for name, df in outputs.items():
                with settings(batch.sparkSession, GIVEN_BACK):
                    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            if atomic:
                done = batch.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("number"))
                done.write.mode("overwrite").parquet(f"{folder}/{COMMITTED}/batch={number}")
        finally:
            if shared is not None:
                shared.unpersist()
            _give_back(batch)

    with settings(stream.sparkSession, conf or {}):  # a query keeps the settings it was started with
        return (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**({"processingTime": every} if every else {"availableNow": True}))
            .start()
        )


def _give_back(batch: DataFrame) -> None:
    """The shuffle files that the batch's own plan has left. They belong to the stream, not to what was written,
    and would stay until the driver's next garbage collection."""
    rows = batch._jdf.queryExecution().toRdd()
    rows.dependencies()  # only what is known is followed
    rows.cleanShuffleDependencies(False)


def run(
    stream: DataFrame,
    folder: str,
    branches: BatchBranches | None = None,
    mode: str = "append",
    atomic: bool = False,
    conf: Mapping[str, str] | None = None,
) -> None:
    """`start` and wait. The recommended settings keep state in RocksDB, where it may outgrow
    memory; they belong to the session, which several streams share."""
    start(stream, folder, branches or (lambda df, _: {"rows": df}), mode, atomic=atomic, conf=conf).awaitTermination()


def committed(spark: SparkSession, folder: str, branch: str, schema: T.StructType) -> DataFrame:
    """A branch as far as all branches of its batches are written, with the batch's number: what a
    batch left behind that failed between two branches isn't seen. The numbers are one per batch."""
    done = _read_or_empty(spark, f"{folder}/{COMMITTED}", T.StructType([T.StructField("number", T.LongType())]))
    rows = numbered(spark, folder, branch, schema)
    return rows.join(done, rows["batch"] == done["number"], "left_semi")


def appended(spark: SparkSession, folder: str, branch: str, schema: T.StructType) -> DataFrame:
    """All rows of a branch."""
    return numbered(spark, folder, branch, schema).drop("batch")


def of_batch(spark: SparkSession, folder: str, branch: str, schema: T.StructType, number: int) -> DataFrame:
    """What one batch wrote to a branch, without a look at other batches; nothing if there is none."""
    return _read_or_empty(spark, f"{folder}/{branch}/batch={number}", schema)


def numbered(spark: SparkSession, folder: str, branch: str, schema: T.StructType) -> DataFrame:
    """A branch with the number of the batch that wrote each row."""
    schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return _read_or_empty(spark, f"{folder}/{branch}", schema)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
