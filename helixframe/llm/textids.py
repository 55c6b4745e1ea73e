"""Token ids of whole texts by way of a table of distinct chunks.

A chunk is what stands between two spaces. Where a tokenizer never builds a
token across the boundary, every distinct chunk is segmented once per worker and
the ids of a text are joined back by position. Within a slice of texts chunks are
grouped by a 64-bit hash and compared byte for byte; the table itself is keyed by the chunk. Texts for which that does not
hold are encoded whole, so the ids always equal the library's for the whole text.
The table has a fixed size: when it is full, it becomes the older generation and
entries that are used again move to the new one.
"""

from __future__ import annotations

import codecs
import os
import struct

import numpy as np
import pyarrow as pa
import regex

from .spans import LOWER, Spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct chunks in one generation of a worker's table (about 180 bytes each; two generations are kept).
TABLE_ROWS = 120_000
#: A longer chunk is not kept.
KEEP_BYTES = 200
#: Chunks of these characters are cut into the model's words here; any others go through the library's whole chain.
#: All of them are stable under NFC and have had their classes since the first versions of Unicode.
PLAIN = regex.compile(r"[\n!-~¡-¬®-ɏ]+")
#: Letters before this one are in PLAIN.
LATIN_END = "\u0250"

#: Characters of texts whose chunks are looked up together: the more, the fewer lookups a text.
SLICE_CHARS = 4_000_000
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_pack = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _pack[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class Table(dict):
    """Values by key, made by ``make`` where missing; at most two generations of ``rows`` entries."""

    def __init__(self, make, rows: int = TABLE_ROWS):
        super().__init__()
        self.make, self.rows, self.older = make, rows, {}

    def __missing__(self, key):
        value = self.older.get(key) or self.make(key)
        if len(key) <= KEEP_BYTES:
            if len(self) >= self.rows:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: Stands for the ids of a chunk whose text must be encoded whole.
WHOLE = b"?"


class Generations:
    """Values by chunk (in UTF-8) in two generations of at most ``rows``; used entries of the older one move to the newer."""

    def __init__(self, rows: int):
        self.rows, self.new, self.old = rows, {}, {}

    def get(self, keys: list[bytes]) -> tuple[list, dict]:
        """The values of keys (None where missing), and the dict to put missing ones in."""
        if len(self.new) > self.rows:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        values = list(map(new.get, keys))
        if old:
            for i, v in enumerate(values):
                if v is None and (v := old.get(keys[i])) is not None:
                    values[i] = new[keys[i]] = v
        return values, new


class LibraryTable:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, spaced: bool, rows: int = TABLE_ROWS):
        """spaced: byte-level vocabulary whose chunks keep the space before them;
        else white space is dropped and letters are lower-cased, and chunks are independent of both sides."""
        from tokenizers import Tokenizer

        self.spaced = spaced
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        # the pre-tokenizers' own patterns (fixed values of the vocabularies' files)
        if spaced:
            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        else:
            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        codes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(others)}
        space = chr(codes[32])
        self.alphabet = "".join(chr(codes[b]) for b in range(256))
        self.tokenize, self.space, self.words = self.model.tokenize, space, Table(self._word, rows // 4)
        self.first, self.rest = Generations(rows // 4 if spaced else rows), Generations(rows)

    def _word(self, word: str) -> bytes:
        seen = codecs.charmap_decode(word.encode(), "strict", self.alphabet)[0]
        return _packed([t.id for t in self.tokenize(seen)])

    def _chunk(self, chunk: str, space: str) -> bytes:
        words = self.words
        if chunk[-1] in ".," and (stem := chunk[:-1]).isalpha() and max(stem) < LATIN_END:
            return words[space + stem] + words[chunk[-1]]
        if chunk.isalpha():
            if max(chunk) < LATIN_END:
                return self._word(space + chunk)
        elif PLAIN.fullmatch(chunk):
            return b"".join([words[w] for w in self.cut(space + chunk)])
        return self.whole(space + chunk)

    def _first(self, chunk: str) -> bytes:
        if not self.spaced:
            return self._chunk(chunk.lower() if chunk.isascii() or PLAIN.fullmatch(chunk) else chunk, "") if chunk else b""
        # white space at a chunk's edge joins the space beside it into one token
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return WHOLE
        return self._chunk(chunk, "")

    def _rest(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return WHOLE
        return self._chunk(chunk, " ")

    def _values(self, chunks: list[bytes], head: bool) -> list[bytes]:
        table = self.first if head else self.rest
        make, tokenize, decode, alphabet = self._first if head else self._rest, self.tokenize, codecs.charmap_decode, self.alphabet
        space = self.space if self.spaced and not head else ""
        values, new = table.get(chunks)
        for i, v in enumerate(values):
            if v is None:
                c = chunks[i]
                if c.isalpha():  # ASCII letters stand for themselves in the byte-level alphabet
                    seen = c.decode()
                else:
                    text = c.decode() if self.spaced else c.decode().lower()
                    seen = decode(text.encode(), "strict", alphabet)[0] if text.isalpha() and max(text) < LATIN_END else None
                if seen is None:
                    v = make(c.decode())
                else:
                    ids = [t.id for t in tokenize(space + seen)]
                    v = _pack[len(ids)](*ids) if len(ids) < 64 else _packed(ids)
                values[i] = v
                if len(c) <= KEEP_BYTES:
                    new[c] = v
        return values

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, texts: list[str]):
        """For each text its ids as bytes."""
        todo, size = [], 0
        for text in texts:
            todo.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                yield from self._slice(todo)
                todo, size = [], 0
        if todo:
            yield from self._slice(todo)

    def _slice(self, texts: list[str]):
        """Chunks of all texts by their hash, looked up once each, and their ids joined back by position."""
        own = [t.encode() for t in texts]
        last = np.cumsum([t.count(b" ") + 1 for t in own])  # chunks up to the end of each text
        first = np.concatenate([[0], last[:-1]])
        data = b" ".join(own)
        if not self.spaced:
            data = data.translate(LOWER)  # as the model's chain does to these letters
        buf = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(buf == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
        # a full stop or comma after a letter is a word of its own: the chunk is looked up without it
        end_byte = np.where(ends - starts >= 2, buf[np.maximum(ends, 1) - 1], 0) if len(buf) else np.zeros(len(starts), np.uint8)
        mark = ((end_byte == 46) | (end_byte == 44)) & ends_in_letter(buf, ends - 1, starts)
        ends = ends - mark
        spans = Spans(data, starts, ends)
        hashes, head = spans.hashes(), np.zeros(len(starts), bool)
        if self.spaced:
            head[first] = True  # without the space before it, a chunk is another one
            hashes[first] ^= np.uint64(0x5851F42D4C957F2D)
        coded = pa.array(hashes).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        one = np.empty(len(coded.dictionary), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]  # where each is met first
        odd = spans.differ(one[code])  # equal hashes of different chunks: the later ones stand for themselves
        if self.spaced:
            odd = np.union1d(odd, np.flatnonzero(head != head[one[code]]))
        code[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
        n_distinct = len(one)
        heads = head[one] if self.spaced else np.ones(n_distinct, bool)
        chunks = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        if heads.all():
            values = self._values(chunks, True)
        else:
            values = [b""] * len(chunks)
            for head in (True, False):
                at = np.flatnonzero(heads == head).tolist()
                for i, v in zip(at, self._values([chunks[i] for i in at], head), strict=True):
                    values[i] = v
        whole = np.array(list(map(len, values))) == len(WHOLE)
        values = [*([v if v is not WHOLE else b"" for v in values] if whole.any() else values), self.words["."], self.words[","]]
        table = np.frombuffer(b"".join(values), "<u4")
        lengths = np.array(list(map(len, values))) // 4
        offsets = np.cumsum(lengths) - lengths
        # chunks and their marks in order
        units = np.cumsum(1 + mark)
        code_ = np.repeat(code, 1 + mark)
        code_[units[mark] - 1] = n_distinct + (end_byte[mark] == 44)
        n = lengths[code_]
        end = np.cumsum(n)
        joined = table[np.repeat(offsets[code_] - end + n, n) + np.arange(end[-1])].tobytes()
        stops = end[units[last - 1] - 1].tolist()
        odd = np.add.reduceat(whole[code], first) > 0 if whole.any() else np.zeros(len(texts), bool)
        at = 0
        for text, stop, is_odd in zip(texts, stops, odd.tolist(), strict=True):
            yield self.whole(text) if is_odd else joined[4 * at : 4 * stop]
            at = stop


def ends_in_letter(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the spans end in an ASCII letter or in one from U+00C0 to U+027F (lead bytes C3 to C9; not the signs
    D7 and F7, and not 0130, whose lower case ends in a mark)."""
    if len(buf) < 2:
        return np.zeros(len(starts), bool)
    last, lead = buf[np.maximum(ends, 1) - 1], buf[np.maximum(ends, 2) - 2]
    latin = (lead >= 0xC3) & (lead <= 0xC9) & (last >= 0x80) & (last <= 0xBF) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)) | (lead == 0xC4) & (last == 0xB0))
    return (ends > starts) & (LETTER[last] | latin & (ends - starts >= 2))


_tables: dict = {}


def forget(vocabulary: bool = False) -> None:
    """Gives the tables' memory back; the next task starts with empty ones. vocabulary: the tokenizers go too, and are loaded again."""
    if vocabulary:
        _tables.clear()
    for t in _tables.values():
        for g in (t.first, t.rest):
            g.new, g.old = {}, {}


def library_table(path: str, spaced: bool, rows: int = TABLE_ROWS) -> LibraryTable:
    """This process's table for a vocabulary."""
    if (path, spaced) not in _tables:
        _tables[path, spaced] = LibraryTable(path, spaced, rows)
    return _tables[path, spaced]
