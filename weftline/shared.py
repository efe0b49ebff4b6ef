"""The folder that driver and executors share, and tables written there to cut lineage.

The cluster names the folder in `spark.checkpoint.dir`; only where that is unset (tests, a laptop)
a temporary folder is taken, and only where the master is local. Tables written here are ordinary Parquet, so a lost executor costs a
reread and not a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables written here and not released yet, in order.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, or a folder set once where there is none and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
            base = sc.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
    """Write `df` into the shared folder, in folders by the column `by` if given, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The folders of the tables that were written and not released, in order."""
    return list(_made)


def release(paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        spark = _made.pop(path, None)
        if spark is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    try:
        release(tables())
    except Exception:  # the session has ended; whoever owns the folder clears it
        return
