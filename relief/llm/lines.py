"""Line dedup by content-defined chunks of lines.

A rolling hash over the fingerprints of two neighbouring lines chooses where a
chunk ends, so that a passage inserted above does not shift the boundaries
below. Chunks have at least two lines. A fingerprint covers the lines of a chunk
and the line feeds between them, so each layout of the same lines has a first
copy of its own. Chunks whose fingerprint occurs again are compared byte by byte
with the first of their kind, and equal ones are removed; the first stays.

Fingerprints alone are shuffled for all chunks; bytes only for those that
repeat. Documents are brought together with their marks once.

Lines are what line feeds separate; empty lines belong to no chunk and stay
unless they lie inside a removed one. A single line is never removed by itself.
Defined results: null texts stay null, empty ones empty; a missing id sorts
last; rows that share an id are ordered by a hash of their text, rows that share
id and text are one document and keep the same lines; an empty table gives an
empty result. Other columns stay, but for those of the names that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relief.llm.common import (
    KEY,
    LINES,
    NO_ID,
    Piece,
    aside,
    column,
    keyed,
    long_values,
    mix,
    restored,
    signed,
    slices,
    split_words,
)
from relief.session import materialise

ENDS = 3  # a boundary falls after one line in this many
LEAST, MOST = 2, 64
ADDED = ["n_lines", "n_removed"]


def chunk_ends(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 line of each chunk of two lines or more."""
    with np.errstate(over="ignore"):
        rolled = piece.word.copy()
        rolled[1:] += piece.word[:-1] * np.uint64(0x9E3779B97F4A7C15)
    ends = mix(rolled) % np.uint64(ENDS) == 0
    first, last = [], []
    for low, high in zip(piece.first[:-1], piece.first[1:], strict=True):
        if high - low < LEAST:
            continue
        at = low
        cuts = np.flatnonzero(ends[low:high]) + low + 1
        for cut in [*cuts.tolist(), high]:
            while cut - at > MOST:
                first.append(at)
                last.append(at + MOST)
                at += MOST
            # what is left after a cut must be a chunk too
            if cut - at >= LEAST and (high - cut >= LEAST or cut == high):
                first.append(at)
                last.append(cut)
                at = cut
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def chunk_marks(piece: Piece, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprint of each chunk's lines in order and of how many line feeds part them."""
    length = last - first
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    offset = np.cumsum(length) - length
    step = np.arange(length.sum()) - np.repeat(offset, length)
    line = np.repeat(first, length) + step
    feeds = np.append(piece.start[1:], 0)[line] - piece.end[line]
    feeds[offset + length - 1] = 0
    with np.errstate(over="ignore"):
        scale = mix(np.arange(1, MOST + 2, dtype=np.uint64)) | np.uint64(1)
        terms = (piece.word[line] + mix(feeds)) * scale[step]
        return mix(np.add.reduceat(terms, offset) + length.astype(np.uint64))


def _chunks(docs: DataFrame) -> DataFrame:
    """(_k, _id, _th, line): fingerprint and first line of every chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = long_values(batch, "_id"), long_values(batch, "_th")
            for piece in split_words(column(batch, "text"), LINES):
                first, last = chunk_ends(piece)
                row = piece.rows[piece.doc()[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(chunk_marks(piece, first, last))),
                        pa.array(ids[row]),
                        pa.array(th[row]),
                        pa.array(piece.place()[first].astype(np.int32)),
                    ],
                    ["_k", *KEY, "line"],
                )

    return docs.select(*KEY, "text").mapInArrow(cut, "_k long, _id long, _th long, line int")


def _bytes(marked: DataFrame) -> DataFrame:
    """Bytes of the chunks that start at the marked lines: (_k, _id, _th, line, first, bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = column(batch, "marks")
            columns: list[list] = [[] for _ in range(6)]
            for piece in split_words(column(batch, "text"), LINES):
                first, last = chunk_ends(piece)
                row, place = piece.rows[piece.doc()[first]], piece.place()[first]
                known = {(int(r), int(p)): k for k, (r, p) in enumerate(zip(row, place, strict=True))}
                for r in piece.rows.tolist():
                    for mark in marks[r].as_py():
                        k = known.get((r, mark["line"]))
                        if k is None:
                            continue
                        low, high = piece.start[first[k]], piece.end[last[k] - 1]
                        values = (mark["k"], column(batch, "_id")[r].as_py(), column(batch, "_th")[r].as_py(),
                                  mark["line"], mark["first"], piece.buffer[low:high].tobytes())
                        for c, v in zip(columns, values, strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_k", *KEY, "line", "first", "bytes"]
            )

    return marked.select(*KEY, "text", "marks").mapInArrow(
        read, "_k long, _id long, _th long, line int, first boolean, bytes binary"
    )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """First lines of each keyed document's chunks that occur earlier: (_id, _th, lines)."""
    chunks = _chunks(docs)
    place = F.struct(*KEY, "line")
    kinds = chunks.groupBy("_k").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last")
    # written, as Spark splits a join over a common chunk only between two shuffles
    kinds = materialise(kinds)
    members = chunks.join(kinds.select("_k", "_first"), "_k").withColumn("first", place == F.col("_first"))
    marks = members.groupBy(*KEY).agg(
        F.collect_list(F.struct(F.col("_k").alias("k"), "line", "first")).alias("marks")
    )
    texts = _bytes(docs.join(marks, KEY))
    leaders = texts.where("first").select("_k", *KEY, "line", F.col("bytes").alias("_bytes"))
    leaders = leaders.dropDuplicates(["_k", *KEY, "line"]).select("_k", "_bytes")
    same = texts.where("not first").join(leaders, "_k").where(F.col("bytes") == F.col("_bytes"))
    return same.groupBy(*KEY).agg(F.collect_list("line").alias("lines"))


def remove_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Remove repeated chunks from `text`; adds n_lines and n_removed (lines)."""
    docs, names = aside(docs.drop(*ADDED).withColumnRenamed(text, "text"), "doc_id", "text")
    columns = docs.columns
    others = [c for c in columns if c not in ("text", "doc_id")]
    base = keyed(docs.withColumn("_text", F.col("text").cast("string")), text="_text")
    # both joins read one shuffle of the documents; the id is taken back from the key
    whole = base.select(*KEY, F.col("_text").alias("text"), *others)
    doc_id = F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id")
    joined = whole.join(repeated_chunks(whole), KEY, "left").select(doc_id, *others, F.col("text").alias("_text"), "lines")
    others = ["doc_id", *others]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts, lines = column(batch, "_text"), column(batch, "lines")
            kept = texts.to_pylist()
            n_lines, n_removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for piece in split_words(texts, LINES):
                n_lines[piece.rows] = piece.counts
                first, last = chunk_ends(piece)
                row, place = piece.rows[piece.doc()[first]].tolist(), piece.place()[first].tolist()
                known = {(r, p): k for k, (r, p) in enumerate(zip(row, place, strict=True))}
                for k, r in enumerate(piece.rows.tolist()):
                    gone = lines[r].as_py()
                    if not gone:
                        continue
                    low, high = piece.edge[k], piece.edge[k + 1]
                    stay = np.ones(high - low, dtype=bool)
                    for line in set(gone):
                        c = known[r, line]
                        # the chunk and the line feed after it
                        stay[piece.start[first[c]] - low : piece.end[last[c] - 1] + 1 - low] = False
                        n_removed[r] += last[c] - first[c]
                    left = piece.buffer[low:high][stay].tobytes()
                    # a chunk at the end takes the line feed before it
                    kept[r] = (left if stay[-1] else left.removesuffix(b"\n")).decode()
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in others), pa.array(kept, pa.string()), pa.array(n_lines), pa.array(n_removed)],
                [*others, "text", *ADDED],
            )

    schema = joined.select(*others).schema.add("text", "string").add("n_lines", "long").add("n_removed", "long")
    cleaned = restored(joined.mapInArrow(cut, schema).select(*columns, *ADDED), names, *ADDED)
    return cleaned.withColumnRenamed("text", text)
