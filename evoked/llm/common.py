"""What the operators share: reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text's words in the contracts are runs of anything but these six characters.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where none is set, a local master, as in tests, has a temporary
    one; on a cluster, whose machines would not see each other's files, that is an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if held.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if held.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="evoked-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written to the shared one and is read no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df``, materialised once in the shared folder: losing an executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint after which the shuffles that led to it can go. Spark deletes their files when the driver's
    garbage collector finds them unused, which it may not look for in a long while."""
    out = checkpoint(df)
    out.sparkSession._jvm.System.gc()
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """With the session's setting ``key`` at ``value``, for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does just that to ASCII texts and is several times as fast."""
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(exact)


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks no further than that."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if small(df, rows) else df


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``df`` in the struct ``_row``, whatever their names, and ``more``."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *more)


def unpacked(df: DataFrame, columns: list[str], *outputs: Column, names=(), **replaced: Column) -> DataFrame:
    """The ``columns`` of ``_row``, less those that one of ``outputs`` is named like (``names``), and the outputs. ``replaced``:
    new values of columns, which keep their place."""
    taken = {n.lower() for n in names}
    return df.select(*(replaced[c].alias(c) if c in replaced else F.col(f"_row.`{c}`") for c in columns if c.lower() not in taken), *outputs)
