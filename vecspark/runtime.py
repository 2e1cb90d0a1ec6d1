"""Session helpers shared by every operator: where checkpoints go, and tables written to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings while a table is written: a query's shuffle files go when it ends, rather than when the driver's garbage is collected, and
#: what goes to a Python worker at once is small, so that long texts fit in its memory.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_WRITTEN: dict[int, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that setting is absent (tests, one machine)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local") and sc.getCheckpointDir() is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vecspark-checkpoint-"))
    return named or sc.getCheckpointDir()


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Lineage ends there, so a lost executor costs no recomputation of what came before, and every executor sees the files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vecspark-tables/{uuid.uuid4().hex}-{name}"
    was = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _WRITTEN.setdefault(id(spark.sparkContext), []).append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # broadcasts and checkpoints that nothing refers to any more go as well
    out = spark.read.schema(df.schema).parquet(path)
    out._vecspark_path = path
    return out


def remember(spark: SparkSession, path: str) -> str:
    """A folder that ``release`` is to delete, too."""
    _WRITTEN.setdefault(id(spark.sparkContext), []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(spark: SparkSession) -> set[str]:
    """Paths of the tables that ``save`` wrote in this session and that are still there."""
    return set(_WRITTEN.get(id(spark.sparkContext), []))


def remove(spark: SparkSession, paths: set[str]) -> None:
    """Delete such tables; only once everything computed from them is written itself."""
    for path in paths & written(spark):
        _delete(spark, path)
        _WRITTEN[id(spark.sparkContext)].remove(path)


def discard(*saved: DataFrame) -> None:
    """Delete tables that ``save`` wrote; only once everything computed from them is written itself."""
    for df in saved:
        remove(df.sparkSession, {df._vecspark_path})


def release(spark: SparkSession) -> int:
    """Delete every table that ``save`` wrote in this session, and what was to be remembered; frames that read them must not be used afterwards."""
    paths = _WRITTEN.pop(id(spark.sparkContext), [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small frame (loop state)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions so that none exceeds about ``each``; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-amount // each)))
