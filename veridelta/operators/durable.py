"""Steps of iterative operators as Parquet tables in the folder that all executors share, so that no lineage grows and a lost executor costs no recomputation."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without it there is an error, as executors could not read what others wrote."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession) -> None:
    """Deletes the tables written so far; results of iterative operators that were not stored can't be read afterwards."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
