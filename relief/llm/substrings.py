"""Substring dedup with difference-cover anchors.

Words are runs of bytes other than ASCII white space, unchanged. Fingerprints of
eight words are taken only at positions whose number modulo 13 lies in the
difference cover {0, 1, 3, 9}: every residue is a difference of two of its
members, so for two copies of 20 words at any positions there is an offset of at
most 12 at which both are sampled, and eight words from there still lie in the
copy. Places whose anchor occurs twice are then extended to all 20-word windows
that hold them, and windows that also start earlier are removed.

Defined results: null and empty texts have no words; documents of fewer words
than a window lose none; a missing id sorts last; rows that share an id are
ordered by a hash of their text, and rows that share id and text are one
document, so neither takes words from the other; an empty table gives an empty
result. Other columns stay, but for those of the names that are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relief.llm.common import KEY, NO_ID, SPACED, Piece, aside, column, keyed, restored, sequences, split_words, whole
from relief.llm.repeats import repeated_sequences, shared_anchors

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
ADDED = ["n_words", "n_removed", "kept_sha256"]


def cover_anchors(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the difference cover and the fingerprints of the words there."""
    sampled = np.zeros(PERIOD, dtype=bool)
    sampled[list(COVER)] = True
    count = max(0, len(piece.word) - ANCHOR + 1)
    at = np.flatnonzero(sampled[piece.place()[:count] % PERIOD] & whole(piece, ANCHOR))
    return at, sequences(piece.word, ANCHOR)[at]


def near_marks(piece: Piece, marked: np.ndarray) -> np.ndarray:
    """Whether one of the PERIOD words from each word on is marked."""
    total = np.concatenate(([0], np.cumsum(marked)))
    end = np.minimum(np.arange(len(marked)) + PERIOD, len(marked))
    return total[end] > total[:-1]


def covered(piece: Piece, runs: pa.Array, size: int) -> np.ndarray:
    """Which words lie in a window that starts in one of their row's runs."""
    own = runs.slice(int(piece.rows[0]), len(piece.rows))
    counts = np.asarray(own.value_lengths().fill_null(0)).astype(np.int64)
    flat = own.flatten()
    start = np.asarray(flat.field("place")).astype(np.int64) + np.repeat(piece.first[:-1], counts)
    edge = np.zeros(len(piece.word) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.asarray(flat.field("many")) - 1 + size, -1)
    return np.cumsum(edge[:-1]) > 0


def removed_words(docs: DataFrame) -> DataFrame:
    """(_id, _th, runs): runs of windows of each keyed document that occur earlier."""
    hits = shared_anchors(docs, cover_anchors)
    return repeated_sequences(docs, hits, WINDOW, near_marks, others=False)


def remove_repeats(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove every word of a window that also starts earlier.

    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one
    space); `text` becomes the kept words where something is removed.
    """
    docs, names = aside(docs.drop(*ADDED).withColumnRenamed(text, "text"), "doc_id", "text")
    if not keep_text:
        del names["text"]
    columns = list(names)
    # the id is taken back from the key, so that the join below reads what the first one shuffled
    others = [c for c in columns if c not in ("text", "doc_id")]
    base = keyed(docs.withColumn("_text", F.col("text").cast("string")), text="_text")
    plain = base.select(*KEY, F.col("_text").alias("text"))
    doc_id = F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id")
    joined = (base.select(*KEY, F.col("_text").alias("text"), *others) if others else plain).join(
        removed_words(plain), KEY, "left"
    ).select(doc_id, *others, F.col("text").alias("_text"), "runs")
    others = ["doc_id", *others]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = column(batch, "_text"), column(batch, "runs")
            n_words = np.zeros(len(texts), dtype=np.int64)
            n_removed = np.zeros(len(texts), dtype=np.int64)
            digest, kept_text = [""] * len(texts), texts.to_pylist() if keep_text else []
            for piece in split_words(texts, SPACED):
                gone = covered(piece, runs, WINDOW)
                lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[piece.first])
                # kept words and one space after each, by copying byte ranges at once
                keep = ~gone
                length = (piece.end - piece.start + 1)[keep]
                offset = np.concatenate(([0], np.cumsum(length)))
                source = np.repeat(piece.start[keep] - offset[:-1], length) + np.arange(offset[-1])
                out = piece.buffer[np.minimum(source, len(piece.buffer) - 1)] if len(source) else np.empty(0, np.uint8)
                out[offset[1:] - 1] = 32
                out = out.tobytes()
                kept_first = np.concatenate(([0], np.cumsum(keep)))[piece.first]
                for k, row in enumerate(piece.rows):
                    low, high = offset[kept_first[k]], offset[kept_first[k + 1]]
                    kept = out[low : max(low, high - 1)]
                    digest[row] = hashlib.sha256(kept).hexdigest()
                    if keep_text and lost[k]:
                        kept_text[row] = kept.decode()
                n_words[piece.rows] = piece.counts
                n_removed[piece.rows] = lost
            extra = [pa.array(kept_text, pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in others), *extra, pa.array(n_words), pa.array(n_removed), pa.array(digest, pa.string())],
                [*others, *(["text"] if keep_text else []), *ADDED],
            )

    schema = joined.select(*others).schema
    if keep_text:
        schema = schema.add("text", "string")
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    cleaned = restored(joined.mapInArrow(cut, schema).select(*columns, *ADDED), names, *ADDED)
    return cleaned.withColumnRenamed("text", text)
