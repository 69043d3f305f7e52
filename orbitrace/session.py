"""Session helpers: shared scratch space and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables of this process that are not deleted yet.
_written: set[str] = set()


#: Rows that a task should hold where the number of tasks follows the number of rows.
TASK_ROWS = 1_000_000


def tasks_for(rows: int, df: DataFrame) -> int:
    """Number of tasks for so many rows: the session's, or as many as keep a task near ``TASK_ROWS``, so that what one task
    holds does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that the driver and every executor can reach.

    This is ``spark.checkpoint.dir`` where the cluster names one. Otherwise it is a temporary folder in local mode
    and a folder below the warehouse on a cluster, if that is in a shared store; the choice is kept on the session.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        found = spark.conf.get("spark.orbitrace.scratch.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="spark-orbitrace-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            if found.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: the warehouse is on this machine")
        spark.conf.set("spark.orbitrace.scratch.dir", found)
    return found.rstrip("/")


def new_scratch(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that nothing stands at; ``clear_scratch`` deletes what is written there."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet below the scratch folder and read it back.

    The written table cuts the lineage and survives the loss of executors. The path is kept in ``_path`` of the
    returned frame for ``discard``.
    """
    spark = df.sparkSession
    path = new_scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote for ``df``; later reads of ``df`` fail."""
    _delete(df.sparkSession, df._path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables that this process has written; frames that operators returned before can then not be read.

    For callers that have written or collected their results.
    """
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)
