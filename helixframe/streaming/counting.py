"""Counting k-mers of arriving reads with Structured Streaming."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import packed
from helixframe.operators.spectrum import explode_kmers
from helixframe.plans.storage import shared_root


def running_counts(arriving: DataFrame, k: int) -> DataFrame:
    """kid, n over a stream of reads (seq): counts only add up, so the state is one number per k-mer."""
    return explode_kmers(arriving, k, both_strands=False).groupBy("kid").agg(F.count(F.lit(1)).alias("n"))


def count_stream(spark: SparkSession, reads: DataFrame, k: int, *, files_per_batch: int = 4) -> DataFrame:
    """The counts after all files of ``reads`` (a stored table) have arrived, a few at a time.

    A batch adds its packed pieces to a table that is laid out by their buckets, with no state and no shuffle; at the end a bucket is counted where it lies.
    """
    path = reads.inputFiles()[0].rsplit("/", 1)[0]
    arriving = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    out, state = (f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}" for name in ("stream-pieces", "stream-state"))
    table, n, done = f"stream_pieces_{uuid.uuid4().hex}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), set()

    def keep(batch: DataFrame, number: int) -> None:
        if number not in done:
            packed.pieces(batch, k).write.mode("append").bucketBy(n, "bucket").option("path", out).saveAsTable(table)
            done.add(number)

    def count(pieces: pa.Table) -> pa.Table:
        tally, codec = packed.Tally(k), pa.Codec("zstd")
        blobs = (codec.decompress(data, size, asbytes=True) for size, data in zip(pieces["size"].to_pylist(), pieces["data"].to_pylist(), strict=True))
        for data in packed._chunks(blobs, packed.words_of(k)[0]):
            tally.add(data)
        return pa.table(dict(zip(("kid", "n"), tally.sighted(), strict=True)))

    arriving.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], "kid long, n long")
    return spark.table(table).groupBy("bucket").applyInArrow(count, "kid long, n long")
