"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

File format (little-endian), files ``tokens-<shard>-<part>-<attempt>.zids``, documents in ascending doc_id::

    magic b"ZIDS0001" | 32 bytes SHA-256 of the dictionary | u64 documents in the shard
    frames: per document one zstandard frame of its u32 ids
    index: per document i64 doc_id, u64 offset of its frame, u32 frame bytes, u32 ids
    footer: u64 offset of the index | magic

The dictionary lies beside the shards as ``dictionary-0.zdict``. A document is read
by its index entry and one byte range, without touching its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textids

MAGIC = b"ZIDS0001"
HEAD = struct.Struct("<8s32sQ")
FOOT = struct.Struct("<Q8s")
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n_ids", "<u4")])
DICTIONARY = "dictionary-0.zdict"
#: Distinct chunks in one generation of a worker's table.
TABLE_ROWS = 300_000


def train_dictionary(source: DataFrame, tokenizer_path: str, *, sample_docs: int = 2000, sample_chars: int = 20_000, dict_bytes: int = 112_640) -> bytes:
    """A dictionary from the serialized ids of a bounded sample: of the ``sample_docs`` smallest doc_ids one text of
    1 to ``sample_chars`` characters each, whatever the order of tasks. Only compression depends on it, never the
    stored ids. Empty if there is too little to train on."""
    known = source.where(F.col("doc_id").isNotNull())
    last = known.select("doc_id").distinct().orderBy("doc_id").limit(sample_docs).agg(F.max("doc_id")).first()[0]
    if last is None:
        return b""
    fit = known.where((F.col("doc_id") <= last) & F.length("text").between(1, sample_chars))
    fit = fit.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    texts = [r.one.text for r in sorted(fit.collect())]  # at most sample_docs rows
    samples = list(textids.library_table(tokenizer_path, True, TABLE_ROWS).ids(texts))
    if sum(map(len, samples)) < 10 * 4096 or len(samples) < 20:
        return b""
    return zstandard.train_dictionary(min(dict_bytes, sum(map(len, samples)) // 10), samples).as_bytes()


def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d)


def _first_offset() -> int:
    return HEAD.size


def _file(dictionary: bytes, frames: list[bytes], index: np.ndarray) -> list[bytes]:
    body = b"".join(frames)
    return [HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), len(index)), body, index.tobytes(), FOOT.pack(HEAD.size + len(body), MAGIC)]


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 2, shard_docs: int = 4096, file_bytes: int = 128 << 20, **training) -> DataFrame:
    """Encodes the texts of ``docs`` (doc_id, text), appends ``end_id`` and writes the shards to ``folder``.

    Returns the manifest, one row per file: shard, part, file, n_docs, n_ids; files in
    ascending doc_id. The doc_id ranges come from quantiles of the doc_id column, one
    range for ``shard_docs`` rows but no more than shuffle partitions, so what the driver
    merges does not grow with the rows; only compressed frames are shuffled. A range with
    more rows (or a doc_id repeated very often) goes on in further files, so no file or buffer exceeds
    ``2 * shard_docs`` documents or ``file_bytes`` and one document.

    A null text counts as empty (the end id alone). Null doc_ids come first and are
    stored as the smallest 64-bit integer. Repeated doc_ids are all stored, ordered by
    their compressed bytes. An empty table writes no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dictionary = train_dictionary(source, tokenizer_path, **training)
    shared.write_file(folder, "dictionary.zdict", 0, [dictionary])
    shipped = spark.sparkContext.broadcast(dictionary)  # at most dict_bytes
    total = source.count()
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n_shards = max(1, min(-(-total // shard_docs), n_tasks), min(total // 64, spark.sparkContext.defaultParallelism))
    cuts = sorted(set(source.approxQuantile("doc_id", [i / n_shards for i in range(1, n_shards)], 0.1 / n_shards))) if n_shards > 1 and total else []
    cuts = np.array([int(c) for c in cuts], dtype="i8")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (packer, _) = textids.library_table(tokenizer_path, True, TABLE_ROWS), _codec(shipped.value)
        end = np.array([end_id], "<u4").tobytes()
        for b in shared.sliced(batches, 4096):
            out, sizes = [], []
            for ids in table.ids(b.column(1).to_pylist()):
                ids += end
                out.append(packer.compress(ids))
                sizes.append(len(ids) // 4)
            keys = np.array([-(2**63) if k is None else k for k in b.column(0).to_pylist()], dtype="i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, keys, side="right").astype("i4")), pa.array(keys), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["shard", "doc_id", "n_ids", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()

        def done(shard, part, parts, entries):
            index = np.array(entries, dtype=ENTRY)
            name = f"tokens-{shard:06d}-{part:04d}.zids"
            name, _ = shared.write_file(folder, name, attempt, _file(shipped.value, parts, index))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(entries)], pa.int64()), "n_ids": pa.array([int(index["n_ids"].sum())], pa.int64())})

        now, part, parts, entries, at = None, 0, [], [], 0
        for b in batches:
            for shard, doc_id, n, frame in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != now or len(entries) >= 2 * shard_docs or at >= file_bytes:
                    if entries:
                        yield done(now, part, parts, entries)
                    now, part = shard, part + 1 if shard == now else 0
                    parts, entries, at = [], [], _first_offset()
                parts.append(frame)
                entries.append((doc_id, at, len(frame), n))
                at += len(frame)
        if entries:
            yield done(now, part, parts, entries)

    rows = source.mapInArrow(frames, "shard int, doc_id long, n_ids int, frame binary")
    manifest = rows.repartition(n_tasks, "shard").sortWithinPartitions("shard", "doc_id", "frame").mapInArrow(shards, "shard int, part int, file string, n_docs long, n_ids long")
    return shared.written(manifest, "token-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Reads the shards of ``manifest`` back: doc_id, start (ids of all documents before it), n_ids, ids_crc32, ids.

    The manifest has one small row per file; its running sum is one task's.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard", "part")) - F.col("n_ids")
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    plan = manifest.withColumn("start", before).repartition(n_tasks, "shard", "part").select("file", "start")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = shared.filesystem(folder)
        with files.open_input_stream(f"{base}/{DICTIONARY}", compression=None) as f:
            dictionary = f.read()
        _, unpacker = _codec(dictionary)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{name}") as f:
                    yield from _documents(f, dictionary, unpacker, at)

    return plan.mapInArrow(load, "doc_id long, start long, n_ids long, ids_crc32 long, ids binary")


def _index(f, dictionary: bytes) -> np.ndarray:
    magic, digest, n = HEAD.unpack(f.read_at(HEAD.size, 0))
    at, foot = FOOT.unpack(f.read_at(FOOT.size, f.size() - FOOT.size))
    if magic != MAGIC or foot != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file, or written with another dictionary")
    return np.frombuffer(f.read_at(n * ENTRY.itemsize, at), dtype=ENTRY)


def _documents(f, dictionary: bytes, unpacker, start: int, group: int = 1024) -> Iterator[pa.RecordBatch]:
    index = _index(f, dictionary)
    for i in range(0, len(index), group):
        part = index[i : i + group]
        low = int(part["offset"][0])
        block = f.read_at(int(part["offset"][-1]) + int(part["size"][-1]) - low, low)
        ids = [unpacker.decompress(block[o - low : o - low + s], max_output_size=4 * n) for _, o, s, n in part.tolist()]
        counts = np.array([len(x) // 4 for x in ids], dtype="i8")
        starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("i8")
        start += int(counts.sum())
        keys = [None if k == -(2**63) else k for k in part["doc_id"].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_ids", "ids_crc32", "ids"])


def read_document(folder: str, file: str, doc_id: int) -> list[np.ndarray]:
    """The ids of every document of that id in one shard, by index entry and byte range alone."""
    files, base = shared.filesystem(folder)
    with files.open_input_stream(f"{base}/{DICTIONARY}", compression=None) as f:
        dictionary = f.read()
    _, unpacker = _codec(dictionary)
    with files.open_input_file(f"{base}/{file}") as f:
        index = _index(f, dictionary)
        low, high = np.searchsorted(index["doc_id"], doc_id, "left"), np.searchsorted(index["doc_id"], doc_id, "right")
        return [np.frombuffer(unpacker.decompress(f.read_at(int(e["size"]), int(e["offset"])), max_output_size=4 * int(e["n_ids"])), "<u4") for e in index[low:high]]
