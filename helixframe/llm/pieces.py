"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the vocabulary crosses from another character to a white-space
marker (checked when the model is loaded), so a text's segmentation is that of
its marked words, one after another; a run of spaces belongs to the word after
it. Each distinct marked word is segmented once per worker and generation of its
table, and the ids are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textids import Table, _packed

MARK = "\u2581"
SCHEMA = "doc_id long, ids binary, id_text string, decoded string"
#: A run of spaces with the word after it; a text's first word has the marker that the library puts before it.
MARKED = re.compile(" +[^ ]*")
_tables: dict = {}


class PieceTable:
    """Values are (ids as bytes, ids in decimals joined by spaces)."""

    def __init__(self, path: str, rows: int = 100_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.independent = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # the marker and nothing else must stand for a space, at the start of a text too
        self.independent &= self.model.encode("a  b ", out_type=str) == [f"{MARK}a", MARK, f"{MARK}b", MARK]
        self.independent &= self.model.encode(f"a{MARK}b") == self.model.encode("a b") and self.model.encode(" ") == self.model.encode(MARK)
        alone = self.model.piece_to_id(MARK)
        self.marker = (_packed([alone]), str(alone))
        self.table = Table(self.value, rows)

    def value(self, text: str) -> tuple[bytes, str]:
        ids = self.model.encode(text)
        return _packed(ids), " ".join(map(str, ids))

    def marked(self, word: str) -> tuple[bytes, str]:
        """The value of a run of spaces with the word after it: of its spaces one is the marker that the library adds."""
        return self.table[word[1:]] if len(word) > 1 else self.marker

    def values(self, texts: list[str]):
        """For each text the list of its marked words' values, or the value of the whole text in a list."""
        table = self.table
        for text in texts:
            if text == "" or not self.independent:
                yield [self.value(text)]
                continue
            if MARK in text:
                text = text.replace(MARK, " ")
            if "  " in text or text[0] == " " or text[-1] == " ":
                yield [self.marked(w) for w in MARKED.findall(" " + text)]
            else:
                yield [table[w] for w in text.split(" ")]


def piece_table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encode_decode(docs: DataFrame, model_path: str, *, digests_only: bool = False) -> DataFrame:
    """Encodes and decodes the texts of ``docs`` (doc_id, text).

    Per row: doc_id, ids (little-endian unsigned 32-bit, the end id included),
    id_text (decimals joined by one space) and decoded (the library's decode of
    those ids). With ``digests_only`` the digests are taken where the ids are
    made and the rows are doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: the end id alone, decoded as the empty string.
    Null and repeated doc_ids are kept, one row out per row in; an empty table
    gives no rows; other columns are ignored.
    """
    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def encoded(b: pa.RecordBatch):
        table = piece_table(model_path)
        end = table.model.eos_id()
        end_bytes, end_text = _packed([end]), str(end)
        for value in table.values(b.column(1).to_pylist()):
            ids = b"".join([v[0] for v in value] + [end_bytes])
            text = " ".join([v[1] for v in value if v[1]] + [end_text])
            yield ids, text, table.model.decode(np.frombuffer(ids, "<u4").tolist())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.sliced(batches):
            rows = list(encoded(b))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "ids", "id_text", "decoded"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.sliced(batches):
            n, a, d = [], [], []
            for ids, text, decoded in encoded(b):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(text.encode()).hexdigest())
                d.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    if digests_only:
        return source.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return source.mapInArrow(full, SCHEMA)
