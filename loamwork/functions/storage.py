"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext
        if not jsc.master.startswith("local") or jsc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = jsc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/loamwork/{label}-{uuid.uuid4().hex}"


#: For tables whose rows are blobs: a writer looks at its size every few rows, and neither it nor a reader holds over 16 MB or so at once.
BLOBS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4}


def stage(df: DataFrame, label: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 8 << 20) -> Iterator[None]:
    """Jobs that run inside send Python workers at most so many rows and about so many bytes at once: texts may be long.

    The session's own settings come back afterwards.
    """
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(most_bytes)}
    before = {k: spark.conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside read many small files: a file counts as 64 KB at least, not 4 MB, and those of a batch are
    looked up by a few tasks, not one each. The session's own settings come back afterwards."""
    tasks = spark.sparkContext.defaultParallelism
    ours = {"spark.sql.files.openCostInBytes": str(64 << 10), "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(tasks)}
    before = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
