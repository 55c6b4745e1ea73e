"""Places that the driver and all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The column that holds the columns an operator does not use.
EXTRA = "extra columns"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary folder if driver and executors are one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read back, which cuts the lineage.

    ``done``: tables that this function wrote and that nothing reads from now on; they are deleted.
    """
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    for old in done:
        delete(spark, old.shared_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets the executors delete the shuffles of plans that have ended: Spark does so once the driver's JVM has collected
    them, which it may not do for half an hour. What listeners still hold goes in the second round."""
    for _ in range(2):
        gc.collect()  # Python's handles on the JVM's objects
        spark._jvm.System.gc()
        time.sleep(0.3)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared root."""
    if not path.startswith(checkpoint_root(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrowed(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but ``used`` in one struct, so that no name of theirs meets one of an operator's."""
    rest = [quoted(c) for c in docs.columns if c not in used]
    return docs.select(*[c for c in docs.columns if c in used], F.struct(*rest).alias(EXTRA) if rest else F.lit(None).alias(EXTRA))


def widened(df: DataFrame, columns: list[str]) -> DataFrame:
    """Undoes ``narrowed``: the named columns in their order."""
    held = getattr(df.schema[EXTRA].dataType, "names", [])
    return df.select(*[F.col(EXTRA).getField(c).alias(c) if c in held else quoted(c) for c in columns])


def divided(df: DataFrame, key: Column, keys: DataFrame, log2_bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be among ``keys`` (its one column), and rows whose key surely isn't.

    A bitmap of 2**log2_bits hashed keys is broadcast, whatever their number, so that texts which no later join
    concerns are not shuffled. With very many keys it only divides less. Null keys surely aren't there.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << log2_bits))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    b = bit(F.col(keys.columns[0]))
    bitmap = written(keys.groupBy(F.shiftright(b, 6).alias("_cell")).agg(F.bit_or(one(b)).alias("_bits")), "bitmap")
    marked = df.withColumn("_bit", F.when(key.isNotNull(), bit(key))).withColumn("_cell", F.shiftright("_bit", 6))
    marked = marked.join(F.broadcast(bitmap), "_cell", "left")  # at most 2**(log2_bits - 6) rows
    maybe = F.coalesce(F.col("_bits").bitwiseAND(one(F.col("_bit"))) != 0, F.lit(False))
    return marked.where(maybe).select(df.columns), marked.where(~maybe).select(df.columns)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand at most ``rows`` rows at once to Python workers of this session, unless it is set already: texts are long,
    and a batch stands in the memory of the JVM and of the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, str(rows))


def sliced(batches, rows: int = 1024):
    """The batches in slices of at most ``rows``: Python objects are made for one slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def releasing(run):
    """``run`` for mapInArrow, after which the worker gives memory that it no longer uses back to the system:
    workers outlive their tasks and share an executor's memory with the stages that follow."""

    def and_release(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return and_release


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a Hadoop-style URI."""
    uri = re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, attempt: int, chunks) -> tuple[str, int]:
    """Writes ``chunks`` to a file of ``folder`` whose name is ``name`` with the attempt's number before the first dot.

    Returns that name and the bytes. No two attempts share a file, so one that runs beside or after another
    never changes what the other's index names; the rows that Spark commits name the files that count.
    """
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    stem, _, kind = name.partition(".")
    own, size = f"{stem}-{attempt}.{kind}", 0
    with files.open_output_stream(f"{base}/{own}", compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return own, size
