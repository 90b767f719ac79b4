"""Incremental runs: file stream with checkpoint, a cache of failures with a time to live, request spacing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioforge.runtime import shared_dir


def stream_counts(spark: SparkSession, path: str, glob: str, keys: list[str], checkpoint: str) -> DataFrame:
    """Counts by key of all files seen so far, as one available-now run of a file stream.

    ``checkpoint`` is a folder in shared storage that lives from run to run: a
    later run with the same folder reads only the files that came since. Without
    any file, or without new ones in a first run, the result is empty.
    """
    batch = spark.read.parquet(f"{path}/{glob}")
    one_file = [f.rstrip("/").rsplit("/", 1)[1] for f in batch.inputFiles()] == [glob]
    reader = spark.readStream.schema(batch.schema)
    # a stream watches a folder: the table's own, or the one its single file stands in
    stream = reader.option("pathGlobFilter", glob).parquet(path) if one_file or "*" in glob else reader.parquet(f"{path}/{glob}")
    counted = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = f"{checkpoint}/out"
    query = (
        counted.writeStream.outputMode("complete").option("checkpointLocation", f"{checkpoint}/state")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start())
    query.awaitTermination()
    shape = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).schema
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(out)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(shape).parquet(out) if there else spark.createDataFrame([], shape)


def requests_to_fetch(requests: DataFrame, key: str, time: str, order: str, failed: str, ttl_seconds: int) -> DataFrame:
    """The requests that go out, when answers are cached: a good one for ever, a failure for the time to live.

    A request is answered from the cache if one fetched before it succeeded, or
    the last fetched one failed less than the time to live ago. Rows pass sorted by
    key and time with one remembered answer, so a hot key needs no memory; requests
    of NULL keys or times are left out, a NULL ``failed`` counts as a failure.
    """
    ttl = ttl_seconds * 1_000_000
    slim = requests.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).cast("string").alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("o"), F.coalesce(failed, F.lit(True)).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until, good = None, 0, False
        for batch in batches:
            kept = []
            for k, t, o, f in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if k != last:
                    last, until, good = k, None, False
                if good or (until is not None and t < until):
                    continue
                kept.append(o)
                good, until = not f, t + ttl
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["o"])

    sent = slim.repartition("k").sortWithinPartitions("k", "t", "o").mapInArrow(run, "o long")
    return requests.join(sent, requests[order] == sent["o"], "left_semi")


def spaced_requests(requests: DataFrame, host: str, time: str, order: str, delay: str) -> DataFrame:
    """``requests`` with ``starts_at``: not before its time, nor before the one before it has started and waited its delay.

    The running form of: the greatest over the earlier ones of their time and the delays since.
    """
    w = Window.partitionBy(host).orderBy(time, order)
    before = F.coalesce(F.sum(delay).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = requests.withColumn("_s", before)
    latest = F.max(F.col(time) - F.col("_s")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("starts_at", F.col("_s") + latest).drop("_s")


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One of each (kind, url); the rest wait for its answer."""
    return requests.dropDuplicates(["kind", "url"])


def answered(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with the cached body, requests still to be fetched); an entry of NULL body is an answer too."""
    hit = cache.select("kind", "url", "body").dropDuplicates(["kind", "url"])
    return requests.join(hit, ["kind", "url"]), distinct_requests(requests.join(hit, ["kind", "url"], "left_anti"))


def lasting(cache: DataFrame) -> DataFrame:
    """Cache entries worth keeping: parsed answers and known misses, no page texts."""
    return cache.where("kind = 'json' OR body is null")


def new_checkpoint(spark: SparkSession, label: str) -> str:
    """A folder in the shared storage for a stream that is to run once."""
    import uuid

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
