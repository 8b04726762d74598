"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "spendmart") -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass in the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    A temporary one only where that is unset and every executor is in this process, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spendmart-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(rows: DataFrame, name: str, compression: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Cuts lineage: writes the rows to a table in the checkpoint folder, at once, and reads them back.

    For intermediates used several times. Unlike a cache it survives lost executors, and unlike a row
    checkpoint its readers still prune columns and know its size.
    """
    folder = _scratch.get() or checkpoint_folder(rows.sparkSession)
    return _written(rows, f"{folder}/{name}-{uuid.uuid4().hex}", compression, partition_by)


def _written(rows: DataFrame, path: str, compression: str | None = None, partition_by: str | None = None) -> DataFrame:
    rows.write.parquet(path, compression=compression, partitionBy=partition_by)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables materialized inside the block are deleted when it ends, so an operator leaves no more than its result.

    Yields `keep(rows, name)`, which materializes rows that outlive the block; nothing else computed inside may be
    read after it. Blocks nest: what an inner one keeps goes with the outer one.
    """
    outer = _scratch.get() or checkpoint_folder(spark)
    folder = f"{outer}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield lambda rows, name: _written(rows, f"{outer}/{name}-{uuid.uuid4().hex}")
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
