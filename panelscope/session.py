"""Session helpers: scratch space and default settings.

Operators never create a session; they use the one their input belongs to.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Where a local-mode session without ``spark.checkpoint.dir`` keeps its tables;
# set by the program that starts such a session, never by the package.
_local_root: list[str] = []


def use_local_scratch(folder: str) -> None:
    """Name the scratch folder of local sessions that have no ``spark.checkpoint.dir``."""
    _local_root[:] = [folder]


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` for one written table.

    The cluster names that folder, which all executors share. Only a local-mode
    session without the setting uses the folder given to ``use_local_scratch``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or not _local_root:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{_local_root[0]}/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared scratch folder and read it back.

    Unlike a cache this survives lost executors, and unlike ``checkpoint()``
    the copy is columnar, so later reads prune columns and skip row groups.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def last_change(spark: SparkSession, paths: Sequence[str]) -> int:
    """When the newest of some files or folders was written; one file-system call each."""
    conf = spark._jsc.hadoopConfiguration()
    newest = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(conf)
        if system.exists(at):
            newest = max(newest, system.getFileStatus(at).getModificationTime())
    return newest
