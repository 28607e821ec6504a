"""Sinks of streams: an endpoint's body that is replaced as a whole, and tables that take each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    """Hadoop's view of a path, so that any store Spark writes to will do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def replace_body(row: DataFrame, endpoint: str, batch_id: int | None = None) -> bool:
    """Write a one-row report as the JSON body of an endpoint: `endpoint`/body.json.

    The body is written beside it and moved over the old one, so a reader finds the old body or the new one, whole. A
    batch that is already marked as done is left out; one that failed between the move and its mark is written again, with
    the same body. A report without a row leaves the old body. Returns whether the body was replaced.
    """
    spark = row.sparkSession
    jvm, fs, base = _fs(spark, endpoint)
    path = lambda name: jvm.org.apache.hadoop.fs.Path(base, name)
    mark = path(f"_batches/{batch_id}") if batch_id is not None else None
    if mark is not None and fs.exists(mark):
        return False
    staged = path("_staged")
    row.limit(1).coalesce(1).write.mode("overwrite").json(staged.toString())
    parts = [f.getPath() for f in fs.listStatus(staged) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
    if parts:
        options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(base.toUri(), spark._jsc.hadoopConfiguration()).rename(parts[0], path("body.json"), options)
    fs.delete(staged, True)
    if mark is not None:
        fs.create(mark, True).close()
    return bool(parts)


def body(spark: SparkSession, endpoint: str) -> str | None:
    """The body as it stands."""
    jvm, fs, base = _fs(spark, endpoint)
    at = jvm.org.apache.hadoop.fs.Path(base, "body.json")
    return "\n".join(r.value for r in spark.read.text(at.toString()).collect()) if fs.exists(at) else None


def to_endpoint(endpoint: str, report: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's report becomes the endpoint's body."""

    def write(batch: DataFrame, batch_id: int) -> None:
        replace_body(report(batch), endpoint, batch_id)

    return write


def to_table(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch under batch_id=N, so that a batch that is tried again takes the place of itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write
