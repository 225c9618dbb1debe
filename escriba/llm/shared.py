"""Helpers that several operators of this package use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; set a local one only where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


class Tables:
    """Tables in the shared folder for steps that repeat. Unlike a checkpoint, a table that is read again carries no estimates of
    the joins before it, which else multiply with every round until planning takes longer than the work."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
        self.count = 0

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them from there."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Write the rows as a checkpoint and delete all tables before."""
        out = df.checkpoint(True)
        self._delete(self.folder)
        return out


def unit_interval(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone, so a retried task draws it again."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)).cast("double")) / F.lit(float(1 << 53))


def is_blank(column: Column) -> Column:
    """True where a value is null or holds white space only."""
    return column.isNull() | ~column.rlike(r"[^\p{Z}\x09-\x0d\x1c-\x1f\x85]")
