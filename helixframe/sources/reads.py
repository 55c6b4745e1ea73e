"""Reads: the synthetic view over the star tables, FASTQ files, truth files, and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.plans.storage import stored

#: File splits whose first line numbers are broadcast; more are joined.
MOST_SPLITS = 1_000_000
RECORD_NAMES = ["read_id", "head", "seq", "qual", "whole"]
RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]


def reads_sql(dialect: str) -> str:
    """The CTEs of the synthetic reads (``reads``: read_id, identifier, seq, qual, len, truth_seq, ep), for "spark" or "duckdb".

    Eight consecutive parts give a contig of 256 bases; every distinct
    (orderkey, linenumber, partkey) is a read of 50 bases with known errors. read_id
    packs the key, so no global numbering is needed.
    """
    div = (lambda a, b: f"{a} div {b}") if dialect == "spark" else (lambda a, b: f"{a}//{b}")
    text = "string" if dialect == "spark" else "varchar"
    gather = "listagg(b,'') within group (order by p_partkey)" if dialect == "spark" else "string_agg(b,'' order by p_partkey)"
    return f"""
contigs as (
  select ({div("p_partkey", 8)}) as contig, {gather} as cseq, count(*) as np
  from (select p_partkey, translate(md5(cast(p_partkey as {text})),'0123456789abcdef','ACTGACTGACTGACTG') as b from part)
  group by ({div("p_partkey", 8)})),
li as (select l_orderkey as o, l_linenumber as n, l_partkey as p, min(l_suppkey) as s
  from lineitem group by l_orderkey, l_linenumber, l_partkey),
frag as (select o, n, p,
    cast((o+n)%2 as int) as strand, cast((o*31+n*17+p)%151 as int) as ep,
    substr(cseq, 1+cast((o*7919+n*104729+s*31+p*17)%207 as int), 50) as fwd
  from li join contigs on ({div("p", 8)})=contig where np=8),
tr as (select *, case when strand=1 then translate(reverse(fwd),'ACGT','TGCA') else fwd end as truth_seq from frag),
reads as (select (o*8+n)*1048576+p as read_id,
    concat('r',cast(o as {text}),'_',cast(n as {text}),'_',cast(p as {text})) as identifier,
    case when ep<50 then concat(substr(truth_seq,1,ep), translate(substr(truth_seq,ep+1,1),'ACGT','CGTA'), substr(truth_seq,ep+2))
         when ep<53 then concat(substr(truth_seq,1,cast(o%50 as int)),'N',substr(truth_seq,cast(o%50 as int)+2))
         else truth_seq end as seq,
    case when ep<50 then concat(repeat('I',ep), case when o%2=0 then '#' else '+' end, repeat('I',49-ep))
         when ep<53 then concat(repeat('I',cast(o%50 as int)),'#',repeat('I',49-cast(o%50 as int)))
         when ep>=145 then repeat('5',50)
         else concat(repeat('I',45),repeat('A',5)) end as qual,
    50 as len, truth_seq, ep
  from tr)
"""


def synthetic_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic reads of a table folder."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spark.sql(f"with {reads_sql('spark').replace('from part)', 'from {part})').replace('from lineitem group', 'from {line} group')} select * from reads", part=part, line=line)


def truth(reads: DataFrame) -> DataFrame:
    """The known substitutions: identifier, pos (1-based), base (the true one)."""
    return reads.where("ep < 50").select("identifier", (F.col("ep") + 1).alias("pos"), F.substr("truth_seq", F.col("ep") + 1, F.lit(1)).alias("base"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines of FASTQ text: read_id (0-based ordinal), identifier, seq, qual, len.

    Files are split anywhere. The splits' line counts, one small row each, give every split its first line's number; a split then assembles its
    records by itself, and only the one that goes on in the next split is shuffled. The reads are written once. The last record counts with or
    without a final newline.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"))
    counts = stored(lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")), "fastq-splits")
    in_file = Window.partitionBy("file").orderBy("start")
    files = counts.groupBy("file").agg(F.sum("n").alias("all"))
    files = files.select("file", (F.sum("all").over(Window.orderBy("file")) - F.col("all")).alias("before"))  # a row per file
    first = counts.withColumn("upto", F.sum("n").over(in_file) - F.col("n")).join(files, "file").select("file", "start", (F.col("upto") + F.col("before")).alias("line"))
    first = stored(first, "fastq-lines", counts)
    placed = lines.join(F.broadcast(first) if first.count() <= MOST_SPLITS else first, ["file", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, open_record = None, 0, {}

        def row(no: int, fields: dict) -> tuple:
            return (no, fields.get(0), fields.get(1), fields.get(3), len(fields) == 4)

        for b in batches:
            out = []
            for file, start, value, line in zip(*(b.column(c).to_pylist() for c in ("file", "start", "value", "line")), strict=True):
                if (file, start) != now:
                    if open_record:
                        out.append(row(at // 4, open_record))
                    now, at, open_record = (file, start), line - 1, {}
                if open_record and (at + 1) % 4 == 0:
                    out.append(row(at // 4, open_record))
                    open_record = {}
                at += 1
                open_record[at % 4] = value
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, RECORD_TYPES, strict=True)], RECORD_NAMES)
        if open_record:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(at // 4, open_record), RECORD_TYPES, strict=True)], RECORD_NAMES)

    found = stored(placed.select("file", "start", "value", "line").mapInArrow(run, "read_id long, head string, seq string, qual string, whole boolean"), "fastq-records")
    parts = found.where("not whole").groupBy("read_id").agg(F.max("head").alias("head"), F.max("seq").alias("seq"), F.max("qual").alias("qual"))
    records = found.where("whole").drop("whole").unionByName(parts)
    seq = F.upper("seq")
    return records.select("read_id", F.split(F.substr("head", F.lit(2)), "[ \t]", 2)[0].alias("identifier"), seq.alias("seq"), "qual", F.length(seq).alias("len"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth lines ``identifier pos base pos base ...``; ``#`` lines are skipped."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), "[ \t]+").alias("f"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("f") - 2, F.lit(2)), lambda i: F.struct(F.get("f", i).cast("int").alias("pos"), F.get("f", i + 1).alias("base")))
    return t.where(F.size("f") >= 3).select(F.get("f", F.lit(0)).alias("identifier"), F.explode(pairs).alias("e")).select("identifier", "e.pos", "e.base")


def write_fastq(reads: DataFrame, path: str, *, tag: str | None = "zl", repeat_identifier: bool = False) -> None:
    """Writes ``@id [ZL:flag]``, sequence, ``+[id]``, quality; records in read_id order within sorted files."""
    head = F.concat(F.lit("@"), "identifier", *([F.lit(" ZL:"), F.col(tag).cast("string")] if tag else []))
    plus = F.concat(F.lit("+"), F.col("identifier")) if repeat_identifier else F.lit("+")
    n = max(1, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    reads.repartitionByRange(n, "read_id").sortWithinPartitions("read_id").select(F.concat_ws("\n", head, "seq", plus, "qual").alias("value")).write.text(path)


def write_truth(truth: DataFrame, path: str) -> None:
    """Truth lines ``identifier pos base pos base ...``, one per identifier."""
    edits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda e: F.concat_ws(" ", e["pos"].cast("string"), e["base"])), " ")
    truth.groupBy("identifier").agg(edits.alias("edits")).select(F.concat_ws(" ", "identifier", "edits").alias("value")).write.text(path)


def output_name(prefix: str, config, suffix: str = "", extension: str = "txt", *, parameters: bool = True, at: datetime | None = None) -> str:
    """A file name of the options: prefix, month, day and time if ``at`` is given, K, D, E (penalty, or auto), G and R, suffix, extension."""
    when = at.strftime("_%m%d_%H%M") if at else ""
    eta = "auto" if config.eta is None else f"{config.eta:.0f}"
    options = f"_K{config.k}D{config.hamming}_E{eta}G{config.gamma:.0e}R{config.rel_tol:.0e}" if parameters else ""
    return f"{prefix}{when}{options}{suffix}.{extension}"


def write_model(model: DataFrame, path: str, k: int, *, compression: str = "none") -> None:
    """The model as text: k-mer, label, log initial probability, log transition probabilities of A C T G ("nan" where absent). compression: none or gzip."""
    from helixframe.functions.bits import kmer_string

    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    model.select(F.concat_ws(" ", kmer_string(F.col("kid"), k), F.col("label").cast("string"), number("log_init"), *[number(f"lp{b}") for b in range(4)]).alias("value")).write.text(path, compression=compression)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The model that ``write_model`` wrote."""
    from helixframe.functions.bits import kmer_id

    f = spark.read.text(path).select(F.split("value", " ").alias("f"))
    number = lambda i: F.when(F.col("f")[i] != "nan", F.col("f")[i].cast("double"))
    return f.select(kmer_id(F.col("f")[0]).alias("kid"), F.col("f")[1].cast("int").alias("label"), number(2).alias("log_init"), *[number(3 + b).alias(f"lp{b}") for b in range(4)])
