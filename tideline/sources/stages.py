"""Stage snapshots: Parquet folders that cut lineage and hand a cohort to the next step.

A named stage is one that is kept. It carries a mark that is taken away before it is written and put back when it
is complete, so that what a lost driver left half done is not read. Other stages live as long as their run.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.session import shared_folder

MARK = "_COMPLETE"
_open_runs: list[str] = []


def _file(spark: SparkSession, path: str):
    """The path and its file system, which may be any that Spark reaches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _mark(spark: SparkSession, path: str) -> str | None:
    """What the mark of a complete stage says; None without one."""
    system, mark = _file(spark, f"{path.rstrip('/')}/{MARK}")
    if not system.exists(mark):
        return None
    stream = system.open(mark)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _set_mark(spark: SparkSession, path: str, says: str | None) -> None:
    system, mark = _file(spark, f"{path.rstrip('/')}/{MARK}")
    if says is None:
        system.delete(mark, False)
        return
    stream = system.create(mark, True)
    stream.write(bytearray(says.encode()))
    stream.close()


def fingerprint(df: DataFrame) -> str:
    """Equal for plans that compute the same from the same files (files are known by their names)."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    parts = [plan, str(df.semanticHash()), *sorted(df.inputFiles())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, says: str = "") -> None:
    """Overwrite a stage; variant, phase and subgroup belong in ``partition_by``, not in the path.

    With ``partition_by`` only the partitions that ``df`` has rows of are replaced, so stages live side by side.
    """
    spark = df.sparkSession
    _set_mark(spark, path, None)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    _set_mark(spark, path, says)


def read_stage(spark: SparkSession, path: str, **partition) -> DataFrame:
    """Reload a stage; partition values prune folders instead of naming files. One that is not complete is refused."""
    if _mark(spark, path) is None:
        raise ValueError(f"{path} is not a stage that was written to its end")
    df = spark.read.parquet(path)
    for name, value in partition.items():
        df = df.where(F.col(name) == value)
    return df


def kept_stage(df: DataFrame, path: str) -> DataFrame:
    """The named stage at ``path``: read if it is complete and was made by the same plan, written otherwise."""
    says = fingerprint(df)
    if _mark(df.sparkSession, path) != says:
        write_stage(df, path, says=says)
    return read_stage(df.sparkSession, path)


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Stages that are written inside live until its end; named ones stay. Collect or write results before it ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/stages/run-{uuid.uuid4().hex}"
    _open_runs.append(folder)
    try:
        yield folder
    finally:
        _open_runs.remove(folder)
        system, path = _file(spark, folder)
        system.delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several passes need the same rows (a propensity fit and the analysis after it). The
    written table survives lost executors and, unlike a cached plan, keeps column pruning.
    """
    folder = _open_runs[-1] if _open_runs else f"{shared_folder(df.sparkSession).rstrip('/')}/stages"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
