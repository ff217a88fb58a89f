"""Session helpers shared by the library: table access and checkpointing."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A cluster names it in its configuration.  Only where it is unset on one machine, as in tests,
    a temporary folder is made; on a cluster that is an error, as executors wouldn't see it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, on whatever file system it is; none is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut from its lineage.

    Reliable, unlike a local checkpoint: a lost executor costs nothing.  Spark keeps its estimate of the
    size, for a join the product of both sides': in rounds of joins its digits double each time, until
    they fill the driver's memory.  One beyond a long is dropped with the plan that it came from.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint()
    if done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63:
        return done
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def release_shuffles(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go.

    Spark deletes them once the driver has collected what refers to them, which a driver with little to
    do hardly ever does by itself.  To be called between steps that shuffle whole texts.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", most_rows: int = 200_000) -> DataFrame:
    """``big`` joined with ``small``, which is sent to all executors only if it has few rows.

    ``small`` is written to the shared checkpoint folder and counted.  Beyond ``most_rows`` rows
    Spark shuffles both sides.  Its rows must be of bounded width.
    """
    from pyspark.sql import functions as F

    small = checkpoint(small)
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)
