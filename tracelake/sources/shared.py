"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a new local one if the master is local
    (tests), else an error: executors could not see the driver's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tracelake-"))


#: Whether shuffle files go as soon as their query has ended, and not when the driver's JVM happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def swept(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, shuffle files of a query are deleted at its end, as nothing reads a written table's shuffles again."""
    return _set(spark, {CLEANUP: "true"})


#: Rows and bytes that go to a Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, queries that are run hand rows of texts or sets to Python in small batches: each is held several times over, in
    the executor and in the worker, and neither gives back what it once held."""
    return _set(spark, BATCH)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder and read again: later steps plan from a short lineage and known
    sizes, and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)  # ids are hexadecimal: half the bytes
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def dealt(df: DataFrame, each: int) -> DataFrame:
    """df in partitions of about `each` rows, by count, for work that costs by the row: a table of few bytes is read by few
    tasks, however many rows it has."""
    return df.repartition(max(1, -(-df.count() // each)))


def drop(*written: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read any more."""
    for df in written:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
