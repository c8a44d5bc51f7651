"""What several operators share: reading tables, cutting lineage, joins whose keys may be hot."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that share a key in one task at least before the key is hot, and the number of hot keys at most.
HOT_ROWS, HOT_KEYS = 256, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over the cores if its files make fewer tasks than that; larger ones are left where they are."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's, else ``spark.checkpoint.dir``; one is made only where all runs in one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, spread: tuple[str | Column, ...], how: str = "inner", count: str = "n") -> DataFrame:
    """``left`` (``total`` rows) joined with ``right``, which is unique by ``keys`` and counts its rows of left in ``count``.

    A key of very many rows is hot: its rows of left are dealt by a hash of ``spread`` over several
    tasks, and its row of right goes to each of them. A key is hot above a total / HOT_KEYS share, so at
    most HOT_KEYS rows say which keys are, whatever the tables; those are broadcast. ``right`` is read
    twice, so give a cut one; ``count`` isn't returned.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_parts"))
    dealt = left.join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    parts = F.when(F.col(count) > most, F.ceil(F.col(count) / most).cast("int")).otherwise(F.lit(1))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
