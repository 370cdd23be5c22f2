"""Stages laid out by matched set, so that work on whole sets moves no rows.

Rows with a set id are bucketed and sorted on it; rows without one, which count as a single set, lie in files of
their own, as one bucket could not hold them where they are many.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tideline.sources.stages import _mark, _set_mark


@dataclass(frozen=True)
class SetStage:
    """``sets`` is bucketed on ``key``; ``none`` are the rows where it is NULL."""

    sets: DataFrame
    none: DataFrame
    key: str

    @property
    def rows(self) -> DataFrame:
        return self.sets.unionByName(self.none)


def _table(path: str) -> str:
    return f"tideline_sets_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_set_stage(df: DataFrame, path: str, key: str = "match", buckets: int | None = None) -> None:
    """Overwrite the stage at ``path``, in as many buckets as the session has shuffle partitions unless told otherwise.

    This shuffles the rows with an id once; a set is expected to be small beside a bucket.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _set_mark(spark, path, None)
    named = df.where(F.col(key).isNotNull()).repartition(buckets, F.col(key))
    writer = named.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.format("parquet").option("path", f"{path}/sets").saveAsTable(_table(path))
    df.where(F.col(key).isNull()).write.mode("overwrite").parquet(f"{path}/none")
    _set_mark(spark, path, json.dumps({"key": key, "buckets": buckets, "schema": df.schema.json()}))


def read_set_stage(spark: SparkSession, path: str) -> SetStage:
    """The stage at ``path``, also in a session that did not write it. One that is not complete is refused."""
    path = path.rstrip("/")
    says = _mark(spark, path)
    if says is None:
        raise ValueError(f"{path} is not a stage that was written to its end")
    made = json.loads(says)
    key, schema = made["key"], StructType.fromJson(json.loads(made["schema"]))
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")  # the files stay; another session may have written them anew
    spark.sql(
        f"CREATE TABLE {_table(path)} ({schema.toDDL()}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {made['buckets']} BUCKETS LOCATION '{path}/sets'"
    )
    return SetStage(spark.table(_table(path)), spark.read.schema(schema).parquet(f"{path}/none"), key)
