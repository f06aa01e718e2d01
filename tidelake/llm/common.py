"""Shared pieces of the training-data operators: table access, shared scratch space, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a Java and Python regular expression class.
WHITE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a batch that goes to a Python worker, where the session doesn't say otherwise.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package as the driver does; on a cluster it comes as --py-files. Also
    bounds their batches by bytes, so that long texts don't add up."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the optimizer would else repeat an inlined column for each element of
    a lambda that refers to it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, separators: str = WHITE) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (tests), a new one is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tidelake-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes the frame once and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint in as many partitions as keep about ``rows`` rows each, if it has more: small frames then don't start a
    task, and write no files, for every shuffle partition. A frame that is large enough stays as it is."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))  # does nothing where there are fewer


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only when at most ``rows`` rows are there (counted); else the join shuffles as usual."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bytes_of(df: DataFrame, column: str) -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])
