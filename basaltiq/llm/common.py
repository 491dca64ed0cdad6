"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CHUNK = 256  # rows of one key that one task takes together
_scratch: list[str] = []
NOWHERE = StorageLevel(False, False, False, False)
_held: list[DataFrame] = []


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers of at most 1,000 rows, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder; on a
    cluster without it this raises, since executors' own disks are not shared.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="basaltiq-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """df, computed once for several uses and kept on the executors' disks; parts of a lost executor are computed again.

    What was let go of elsewhere, by clearCache() or a stopped context, is forgotten: this list would keep the plans of all earlier runs in the driver.
    """
    _held[:] = [x for x in _held if x.sparkSession.sparkContext is df.sparkSession.sparkContext and x.storageLevel != NOWHERE]
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def holding() -> list[DataFrame]:
    """The tables held now."""
    return list(_held)


def let_go(but: list[DataFrame] = ()) -> None:
    """Lets go of all held tables but those given."""
    for x in [x for x in _held if x not in but]:
        _held.remove(x)
        x.unpersist()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, for a table of an operator's own; release() deletes it."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def release(spark: SparkSession) -> None:
    """Lets go of what operators of this process have kept, once their results are written: held tables and scratch folders."""
    let_go()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def salted(left: DataFrame, right: DataFrame, on: str, to: str, by: str, how: str = "inner") -> DataFrame:
    """left joined with right (unique `to`) on left.on = right.to; values of `on` with more than CHUNK rows are dealt to salts by a hash of `by`."""
    hot = left.groupBy(F.col(on).alias("_hot")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_salts")).filter("_salts > 1")
    left = left.join(hot, left[on] == hot["_hot"], "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0))).drop("_hot", "_salts")
    right = right.join(hot, right[to] == hot["_hot"], "left").withColumn("_z", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_hot", "_salts")
    return left.join(right, (left[on] == right[to]) & (F.col("_s") == F.col("_z")), how).drop("_s", "_z")


def crc_mod(column: str, mod: int):
    """crc32(column as text) mod `mod`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def unit_hash(*columns, seed: int = 0):
    """A repeatable pseudorandom number in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / float(1 << 53)


def sampled(df: DataFrame, group, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each value of `group`, repeatably drawn by a hash of `key`.

    Counts come first, so that the window that makes the bound exact sees about
    twice the bound of rows, whatever the size of a group.
    """
    from pyspark.sql import Window

    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    drawn = (
        df.join(F.broadcast(counts), group)
        .withColumn("_u", unit_hash(key, seed=seed))
        .filter(F.col("_u") * F.col("_n") < 2.0 * most + 50)
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_u", key))
    return drawn.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r", "_u", "_n")
