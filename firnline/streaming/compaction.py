"""Many tiny files into few well-sized ones: a checkpointed streaming compactor.

The file source discovers every input file once (its log lies in the
checkpoint).  Each micro-batch is written below ``batch=<id>`` of the output
with overwrite, so that a retried batch replaces its first attempt and never
adds to it.  ``REBALANCE`` lets the adaptive planner cut the output into files
of the advisory size, however small or unequal the inputs are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.common import broadcast_if_few
from firnline.functions.json_canon import canonical


def compact_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 100_000,
) -> DataFrame:
    """Process every file of ``source`` not seen before and return the compacted table.

    ``source`` is a folder or glob of Parquet files.  Call again with the same
    ``target`` and ``checkpoint`` to take in new files only.  ``prepare`` maps
    each batch before it is written.  An empty source gives an empty table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = prepare(batch) if prepare else batch
        out.hint("rebalance").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    query.awaitTermination()
    shape = prepare(spark.createDataFrame([], schema)).schema if prepare else schema
    shape = T.StructType([*shape.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(shape).option("basePath", target).option("recursiveFileLookup", "false").parquet(target) if _exists(spark, target) else spark.createDataFrame([], shape)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprinted(records: DataFrame) -> DataFrame:
    """``prepare`` step for raw records: 128 bits of their canonical content.  No shuffle."""
    # the content is parsed once, before the hashes refer to it twice
    with_canon = records.select("rec_id", "file_id", "rec_no", "payload", F.inline(F.array(F.struct(canonical(F.col("payload")).alias("canon")))))
    marked = with_canon.withColumns({"fp_a": F.when(F.col("canon").isNotNull(), F.xxhash64("canon")), "fp_b": F.xxhash64(F.lit(17), F.col("canon"))})
    return marked.select("rec_id", "file_id", "rec_no", "fp_a", "fp_b", "payload")


def with_streams(compacted: DataFrame, files: DataFrame) -> DataFrame:
    """The compacted records with the ``stream_id`` of their file; null for unknown files."""
    streams = files.where("file_id is not null").groupBy("file_id").agg(F.min("stream_id").alias("stream_id"))
    return compacted.join(broadcast_if_few(streams, 200_000), "file_id", "left")


def repeated(compacted: DataFrame, files: DataFrame) -> DataFrame:
    """``rec_id`` of records whose stream holds the same content under a smaller ``rec_id``.

    The streams are joined to ids and fingerprints alone, payloads are not
    moved.  Counts are combined before the shuffle; only contents that occur
    more than once take part in the join, whose hot keys the adaptive planner
    splits.  Records without payload or id are no cases; a record of an unknown
    file has no stream and is compared with none; a file listed twice belongs
    to the stream that sorts first.
    """
    slim = compacted.where("rec_id is not null and fp_a is not null").select("file_id", "fp_a", "fp_b", "rec_id")
    slim = with_streams(slim, files).where("stream_id is not null").select("stream_id", "fp_a", "fp_b", "rec_id")
    keys = ["stream_id", "fp_a", "fp_b"]
    first = slim.groupBy(*keys).agg(F.min("rec_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return slim.join(first, keys).where("rec_id > first_id").select("rec_id")


def settled(compacted: DataFrame, files: DataFrame) -> DataFrame:
    """The compacted records with every content once per stream (the smallest ``rec_id``)."""
    return with_streams(compacted.join(repeated(compacted, files), "rec_id", "left_anti"), files)
