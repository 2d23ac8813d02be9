"""Tables written once and read by later jobs.

Everything lands under the folder the cluster names in ``spark.checkpoint.dir``, which every
executor can reach, so a lost executor costs a re-read and not a re-run of the upstream join.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_steps = threading.local()  # paths materialized inside each running ``written``


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for an unset *local* session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="marketspark-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path per call, so two jobs of one session never overwrite each other."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, laid out by ``partition_by``.

    The rebalance hint lets AQE pick the number of files and split a year that holds most rows.
    """
    if partition_by is None:
        df.write.mode("overwrite").parquet(path)
        return
    df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, keeps column pruning, and tells the optimizer the real size of a small aggregate:
    it then broadcasts it if it fits, without first shuffling the large side of the join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_snapshot(df, path, partition_by)
    for paths in getattr(_steps, "open", [])[-1:]:
        paths.append(path)
    return read_snapshot(spark, path)


def written(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` what ``build`` returns and delete the tables it materialized on the way.

    Only the result may be used afterwards. Shuffle files of finished jobs go when the driver has
    collected what refers to them, so a collection is asked for here.
    """
    if not hasattr(_steps, "open"):
        _steps.open = []
    _steps.open.append([])
    try:
        last = materialize(build(), name)
    finally:
        paths = _steps.open.pop()
    for path in paths[:-1]:
        _delete(spark, path)
    for outer in _steps.open[-1:]:
        outer.append(paths[-1])
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    return last


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
