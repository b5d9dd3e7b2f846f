"""Session settings the library is tuned for, and where it may put durable data."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_held: set[str] = set()  # folders of this process that are still to be removed

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Shuffle files go with the query that wrote them.
GIVEN_BACK = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for what is started inside."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting falls back to a temporary folder; on a
    cluster a machine-local path would be lost with its machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="flowlens-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/flowlens/{spark.sparkContext.applicationId}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one run. It lies in a folder of this application,
    which `release` removes, at the latest when the driver's Python ends."""
    own = _own_folder(spark)
    if own not in _held:
        _held.add(own)
        atexit.register(_release, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _release(spark: SparkSession, folder: str) -> None:
    if folder in _held and spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _held.discard(folder)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. To be called when no DataFrame that
    reads them is needed any more, and before the session is stopped."""
    _release(spark, _own_folder(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Compute `df` once and go on from a table in the shared folder. That cuts the lineage,
    survives lost executors, and gives the planner real sizes and columns to prune. The shuffles that
    led to the table are given back at once."""
    path = run_folder(df.sparkSession, "table")
    with settings(df.sparkSession, GIVEN_BACK):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
