"""A table of a judge's answers that several writers add to: the newest answer of a question counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "digest string, answer double, saved timestamp"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parts that count: whole ones that no other replaces."""
    path, files = _files(spark, folder)
    if not files.exists(path(folder)):
        return []
    names = [x.getPath().getName() for x in files.listStatus(path(folder)) if x.isDirectory() and x.getPath().getName().startswith("part-")]
    gone: set[str] = set()
    for name in names:
        if files.exists(path(f"{folder}/{name}/replaces")):
            gone |= {r["name"] for r in spark.read.schema("name string").parquet(f"{folder}/{name}/replaces").collect()}
    return sorted(set(names) - gone)


def _add(answers: DataFrame, folder: str, replaces: list[str]) -> str:
    """Writes a part beside the others: to a hidden folder, then renamed, so that readers see all of it or nothing."""
    spark = answers.sparkSession
    path, files = _files(spark, folder)
    name = f"part-{uuid.uuid4().hex}"
    answers.write.parquet(f"{folder}/_new-{name}/answers")
    if replaces:
        spark.createDataFrame([(x,) for x in replaces], "name string").coalesce(1).write.parquet(f"{folder}/_new-{name}/replaces")
    if not files.rename(path(f"{folder}/_new-{name}"), path(f"{folder}/{name}")):
        raise OSError(f"{name} could not be put in place")
    return name


def save_answers(answers: DataFrame, folder: str) -> str:
    """Adds ``answers`` (digest, answer, saved) to the table; null answers, failed calls, aren't kept.  Writers don't meet."""
    return _add(answers.where("digest is not null and answer is not null").select("digest", "answer", "saved"), folder, [])


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, answer, saved): of each question the newest answer, the larger one of equally new ones."""
    parts = [f"{folder}/{x}/answers" for x in _parts(spark, folder)]
    rows = spark.read.schema(ANSWERS).parquet(*parts) if parts else spark.createDataFrame([], ANSWERS)
    return rows.groupBy("digest").agg(F.max(F.struct("saved", "answer")).alias("x")).select("digest", "x.answer", "x.saved")


def compact_answers(spark: SparkSession, folder: str) -> str | None:
    """Puts one part in place of all that there are now; what is saved meanwhile stays beside it.

    The new part names those that it replaces, and from its rename on readers pass these over; they are removed afterwards.  A
    compaction that stops before the rename changes nothing, and one that stops after it leaves only files that nobody reads.
    """
    old = _parts(spark, folder)
    if len(old) < 2:
        return None
    rows = spark.read.schema(ANSWERS).parquet(*(f"{folder}/{x}/answers" for x in old))
    newest = rows.groupBy("digest").agg(F.max(F.struct("saved", "answer")).alias("x")).select("digest", "x.answer", "x.saved")
    name = _add(newest, folder, old)
    path, files = _files(spark, folder)
    for x in old:
        files.delete(path(f"{folder}/{x}"), True)
    return name


def ask_all(asked: DataFrame, cache: DataFrame, judge: Callable[[dict], float], *key: str) -> DataFrame:
    """``asked`` (with the columns ``key``) with digest, answer, cached and error.

    A question that ``cache`` (digest, answer) has isn't asked again, and equal questions are asked once.
    A call that fails gives a null answer and the first line of its error, and the others go on.
    """
    digest = F.sha1(F.to_json(F.struct(*key)).cast("binary"))
    rows = asked.withColumn("digest", digest)
    known = cache.select("digest", F.col("answer").alias("had"))
    open_ = rows.select("digest", *key).dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                name = row.pop("digest")
                try:
                    out.append((name, float(judge(row)), None))
                except Exception as e:  # whatever an outside judge raises is an outcome
                    out.append((name, None, (str(e).splitlines() or [type(e).__name__])[0]))
            yield pd.DataFrame(out, columns=["digest", "said", "error"])

    came = open_.mapInPandas(call, "digest string, said double, error string")
    both = rows.join(known, "digest", "left").join(came, "digest", "left")
    return both.select(*asked.columns, "digest", F.coalesce("had", "said").alias("answer"), F.col("had").isNotNull().alias("cached"), "error")


def call_figures(answered: DataFrame) -> DataFrame:
    """One row: questions, of these different ones, cached, called and failed ones, and the last error in order."""
    once = answered.groupBy("digest").agg(F.any_value("cached").alias("cached"), F.any_value("error").alias("error"), F.count("*").alias("n"))
    return once.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("questions"), F.count("*").alias("different"), F.count_if("cached").alias("cached"),
        F.count_if(~F.col("cached")).alias("called"), F.count("error").alias("failed"), F.max("error").alias("last_error"),
    )
