from pyspark.sql import functions as F

from firnline.streaming import incremental
from firnline.streaming.compaction import compact_files


def test_compactor_takes_each_file_once(spark, tmp_path):
    src, out, log = (str(tmp_path / p) for p in ("src", "out", "log"))
    spark.range(100).repartition(25).write.parquet(src)
    schema = spark.read.parquet(src).schema
    first = compact_files(spark, src, schema, out, log, files_per_batch=10)
    assert sorted(r.id for r in first.collect()) == list(range(100))
    spark.range(100, 130).repartition(5).write.mode("append").parquet(src)
    second = compact_files(spark, src, schema, out, log)
    assert sorted(r.id for r in second.collect()) == list(range(130))
    files = {r[0] for r in second.select(F.input_file_name()).distinct().collect()}
    assert len(files) < 30


def test_retry_replaces_a_batch(spark, tmp_path):
    src, out, log = (str(tmp_path / p) for p in ("src", "out", "log"))
    spark.range(10).write.parquet(src)
    schema = spark.read.parquet(src).schema
    compact_files(spark, src, schema, out, log)
    # the same files under a fresh log run as batch 0 again
    again = compact_files(spark, src, schema, out, str(tmp_path / "log2"))
    assert again.count() == 10


def test_empty_source(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    got = compact_files(spark, str(src), spark.range(1).schema, str(tmp_path / "out"), str(tmp_path / "log"))
    assert got.count() == 0


def test_append_once_and_grow_index(spark, tmp_path):
    src = str(tmp_path / "src")
    d = spark.range(40).select((F.col("id") % 20).cast("double").alias("x"), F.lit(1.0).alias("y"), F.timestamp_seconds(1_600_000_000 + F.col("id") % 20).alias("t"), F.concat(F.lit("f"), F.col("id") % 3).alias("src"), F.col("id").alias("pt_id"))
    d.write.parquet(src)
    stream = lambda: spark.readStream.schema(d.schema).parquet(src)
    incremental.append_points(stream(), ["x", "y", "t"], "t", "1 hour", str(tmp_path / "pts"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "pts")).count() == 20
    for n in (1, 2):
        incremental.grow_index(stream(), 10.0, str(tmp_path / "idx"), str(tmp_path / f"c2{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "idx")).select("src").distinct().count() == 3


def test_windows_and_mosaic(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parque[t]")
    q = incremental.windowed_counts(s, "ts", "1 day", "1 hour", []).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {r.window.start.date(): r.n for r in spark.table("w").collect()}
    batch = {r.d: r["count"] for r in e.groupBy(F.to_date("ts").alias("d")).count().collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())
    m = incremental.running_mosaic(s.withColumn("w", F.lit(2.0)), "value", "w", ["event_type"]).writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    m.awaitTermination()
    assert spark.table("m").count() == e.select("event_type").distinct().count()
