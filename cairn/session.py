"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The session's ``spark.checkpoint.dir`` wins. Where it is unset a local master (tests, one machine)
    takes a folder under the system's temporary folder; on a cluster that folder would be another one on
    each machine, so there it is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
    if by_call.isDefined():
        return by_call.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "cairn-shared")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cairn-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, conf: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder once and read again.

    Unlike a local checkpoint the files outlive a lost executor. They stay until ``clean`` is called, as
    results are lazy and may read them at any time. The shuffle files of the write go with it, or the steps
    of one query would add up on the disks until the driver's garbage is collected. ``conf`` holds for the
    write only.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/cut-{uuid.uuid4().hex}"
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (conf or {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes what ``cut`` wrote in this application; results that still read it become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
