"""Words and fingerprints over Arrow text buffers, shared by the operators.

Functions here work on one batch of whole documents at a time: the UTF-8 bytes
of a text column are read in place, words are byte ranges, and fingerprints are
64-bit integers computed for all words of a batch at once. No Python string is
made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# bytes of text handled at once; single longer texts form their own piece
PIECE_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (multiply and shift, invertible)."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def numbers(count: int, seed: int) -> np.ndarray:
    """`count` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, count + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


def _table(keep) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[b for b in range(256) if keep(b)]] = True
    return table


# bytes that make up words: anything but ASCII white space; ASCII letters and digits and all non-ASCII
SPACED = _table(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = _table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
LINES = _table(lambda b: b != 10)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Piece:
    """Words of a run of documents: rows, byte ranges and fingerprints."""

    rows: np.ndarray  # row numbers of the batch
    buffer: np.ndarray  # bytes of these rows
    first: np.ndarray  # index of each row's first word, and the number of words
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    word: np.ndarray  # fingerprint of each word
    edge: np.ndarray  # byte offsets of the rows in the buffer

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Position in `rows` of each word's document."""
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def place(self) -> np.ndarray:
        """Number of each word within its document, from 0."""
        return np.arange(len(self.word)) - np.repeat(self.first[:-1], self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), at


def runs(at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Split rows into runs of about `limit` bytes, never inside a row."""
    low, count = 0, len(at) - 1
    while low < count:
        high = int(np.searchsorted(at, at[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), count)
        yield low, high
        low = high


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches that hold about `limit` bytes of text, never less than a row."""
    for batch in batches:
        _, at = text_bytes(column(batch, text))
        for low, high in runs(at, limit):
            yield batch.slice(low, high - low)
    # workers live on: what earlier batches took goes back
    pa.default_memory_pool().release_unused()


def split_words(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, seed: int = 1) -> Iterator[Piece]:
    """Cut texts into words of the given kind of bytes, piece by piece."""
    data, at = text_bytes(column)
    scale = np.empty(0, dtype=_U)
    letters = numbers(256, seed) | _U(1)
    for low, high in runs(at):
        buffer = data[at[low] : at[high]]
        edge = at[low : high + 1] - at[low]
        if lower:
            buffer = _LOWER[buffer]
        inside = kind[buffer]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(inside):
            before[0] = after[-1] = False
            cut = edge[1:-1]
            before[cut[cut < len(inside)]] = False
            after[cut[cut > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        length = end - start
        longest = int(length.max()) if len(length) else 0
        if longest > len(scale):
            scale = numbers(max(64, longest), seed + 1) | _U(1)
        if len(start):
            at_byte = np.flatnonzero(inside)
            offset = np.zeros(len(length), dtype=np.int64)
            np.cumsum(length[:-1], out=offset[1:])
            with np.errstate(over="ignore"):
                terms = letters[buffer[at_byte]] * scale[np.arange(len(at_byte)) - np.repeat(offset, length)]
                word = mix(np.add.reduceat(terms, offset) + length.astype(_U))
        else:
            word = np.empty(0, dtype=_U)
        yield Piece(np.arange(low, high), buffer, np.searchsorted(start, edge), start, end, word, edge)


def sequences(word: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Fingerprint of `size` consecutive words from each position that has them."""
    count = len(word) - size + 1
    if count <= 0:
        return np.empty(0, dtype=_U)
    scale = _U(int(numbers(1, seed + 7)[0]) | 1)
    out = word[:count].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out *= scale
            out += word[k : k + count]
    return mix(out)


def whole(piece: Piece, size: int) -> np.ndarray:
    """Whether `size` words from each position lie in one document."""
    doc = piece.doc()
    count = len(doc) - size + 1
    return doc[:count] == doc[size - 1 :] if count > 0 else np.empty(0, dtype=bool)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    at = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def long_values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A long column without nulls as numpy."""
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


# documents whose ids repeat or are missing are told apart by their text
KEY = ["_id", "_th"]
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the key (_id, _th) by which documents are ordered and joined.

    `_id` is the document's id, a missing one last. `_th` is 0 where every id is
    present and unique, which a count over the ids alone settles; otherwise it is
    a hash of the text, so rows sharing an id are ordered by it, and rows that
    share both are one document read more than once.
    """
    ids = docs.groupBy(F.col(doc_id).alias("_id")).count()
    odd = ids.where("count > 1 or _id is null").limit(1).count()
    return docs.withColumns(
        {
            "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
            "_th": F.xxhash64(F.col(text)) if odd else F.lit(0).cast("long"),
        }
    )


def spread(*parts: np.ndarray) -> np.ndarray:
    """A key that scatters rows evenly."""
    out = np.zeros(len(parts[0]), dtype=_U)
    with np.errstate(over="ignore"):
        for part in parts:
            out = mix(out * _U(0x9E3779B97F4A7C15) + part.astype(np.int64).view(_U))
    return out


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns but the needed ones out of the way, and how to name them again."""
    names = [c if c in needed else f"_x{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), dict(zip(names, docs.columns, strict=True))


def restored(docs: DataFrame, names: dict[str, str], *added: str) -> DataFrame:
    """The renamed columns under their own names, then those that were added."""
    return docs.select(*(F.col(n).alias(c) for n, c in names.items() if c not in added), *added)


# bytes of text whose words are brought together at once
WORDS_BYTES = 1 << 22


def letters_of(pattern_bytes) -> np.ndarray:
    """A table of word bytes from a test of one byte."""
    return _table(pattern_bytes)


def packed(buffer: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte ranges that follow each other as a binary column."""
    at = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buffer))])


def word_values(
    column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, limit: int = WORDS_BYTES
) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(rows, words, counts) of runs of documents: their words as binary values, and how many each row has."""
    data, at = text_bytes(column)
    for low, high in runs(at, limit):
        buffer = data[at[low] : at[high]]
        edge = at[low : high + 1] - at[low]
        inside = kind[buffer]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = edge[1:-1]
        cut = cut[cut < len(buffer)]
        first[cut] = inside[cut]
        start = np.flatnonzero(first)
        small = buffer[inside]
        offsets = np.append(np.cumsum(inside, dtype=np.int64)[start] - 1, len(small))
        yield np.arange(low, high), packed(_LOWER[small] if lower else small, offsets), np.diff(np.searchsorted(start, edge))


def distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a column and, for each row, which of them it is."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of the given lengths; empty runs give 0."""
    out = np.zeros(len(counts), dtype=values.dtype)
    have = np.flatnonzero(counts > 0)
    if len(have):
        out[have] = np.add.reduceat(values, (np.cumsum(counts) - counts)[have])
    return out


def expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for counts[0] places, then the same for the next."""
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(first - begin, counts)


def crc_remainder(doc_id: str, by: int):
    """crc32 of an id as text, modulo `by`; null for a missing id."""
    return F.crc32(F.col(doc_id).cast("string")) % by
