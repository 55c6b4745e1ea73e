"""Cost-balanced packing of token ids into sequences of a fixed length.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n**2``
(projections, and attention within the piece). Whole sequences are cut off
documents that are longer than one; the rest is gathered into blocks, and within
a block pieces are taken in descending cost, each to the sequence of the lowest
cost that still has room. A block opens no more sequences than its tokens need;
a piece that does not fit the chosen sequence fills it and goes on in the next
one, so a block leaves less than one sequence of padding.

Tokenizing and packing happen in one pass without a shuffle: a block lies within
one partition, its size is bounded, and sequence ids carry the partition's
number, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_block(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of items no longer than ``capacity``.

    Descending cost; the lowest-cost sequence with room takes the item, in part if need be.
    Ties go to the earlier item and the lower sequence.
    """
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])  # cost rises with length
    n_sequences = -(-sum(lengths) // capacity)
    heap = [(0.0, s) for s in range(n_sequences)]
    used, pieces = [0] * n_sequences, []
    for i in order:
        start = 0
        while start < lengths[i]:
            cost, s = heapq.heappop(heap)
            n = min(lengths[i] - start, capacity - used[s])
            pieces.append((i, start, n, s, used[s]))
            used[s] += n
            start += n
            if used[s] < capacity:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, s))
    return pieces


class _Packer:
    def __init__(self, first_sequence: int, capacity: int, block_tokens: int, linear: float, quadratic: float, keep_ids: bool):
        self.next, self.capacity, self.block_tokens = first_sequence, capacity, block_tokens
        self.linear, self.quadratic, self.keep_ids = linear, quadratic, keep_ids
        self.block: list[tuple] = []
        self.waiting, self.rows = 0, []

    def put(self, doc_id, ids: bytes, start: int, n: int, total: int, sequence: int, offset: int) -> None:
        own = ids[4 * start : 4 * (start + n)]
        self.rows.append((doc_id, start, n, zlib.crc32(own), total, sequence, offset, own if self.keep_ids else None))

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self.put(doc_id, ids, start, self.capacity, total, self.next, 0)
            self.next += 1
        if whole < total:
            self.block.append((doc_id, ids[4 * whole :], whole, total))
            self.waiting += total - whole
            if self.waiting >= self.block_tokens:
                self.flush()

    def flush(self) -> None:
        for i, start, n, s, offset in pack_block([len(x[1]) // 4 for x in self.block], self.capacity, self.linear, self.quadratic):
            doc_id, ids, before, total = self.block[i]
            own = ids[4 * start : 4 * (start + n)]
            self.rows.append((doc_id, before + start, n, zlib.crc32(own), total, self.next + s, offset, own if self.keep_ids else None))
        self.next += -(-self.waiting // self.capacity)
        self.block, self.waiting = [], 0

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 1_000_000,
    keep_ids: bool = False,
    table_rows: int = textids.TABLE_ROWS,
    keep_vocabulary: bool = True,
) -> DataFrame:
    """Packs the texts of ``docs`` (doc_id, text) with the word vocabulary at ``tokenizer_path``.

    One row per piece: doc_id, start (ids of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset in the sequence, and the ids
    themselves (little-endian unsigned 32-bit) with ``keep_ids``.

    A null text counts as empty, which gives the end id alone. A null or repeated
    doc_id is kept: every row is packed for itself. An empty table gives no rows.
    Other columns are ignored. Memory: one block (``block_tokens`` ids), one batch, and the table of distinct chunks (``table_rows``).
    Without ``keep_vocabulary`` a worker loads the vocabulary for every task and gives its memory back.
    """
    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = textids.library_table(tokenizer_path, False, table_rows)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, block_tokens, linear, quadratic, keep_ids)
        end = np.array([end_id], "<u4").tobytes()
        for b in shared.sliced(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), table.ids(b.column(1).to_pylist()), strict=True):
                packer.add(doc_id, ids + end)
            yield packer.batch()
        packer.flush()
        del table
        textids.forget(not keep_vocabulary)  # other operators' stages share the worker's memory
        yield packer.batch()

    out = source.mapInArrow(shared.releasing(run), SCHEMA)
    return out if keep_ids else out.drop("ids")
