"""Repeated passages by sparse suffixes, with fingerprints in place of a sorted array.

A suffix of a document is retained only where a minimiser starts: in every
`passage` consecutive words, the eight-word sequence with the least fingerprint.
The choice depends on content alone, so two copies of a passage retain the same
suffixes whatever surrounds them. Retained suffixes are not sorted: those whose
eight leading words have equal fingerprints are found by grouping, and then the
fingerprints of all stretches of `passage` words that such a suffix is the
minimiser of are compared. Stretches that agree are joined into maximal spans.

Defined results: null, empty and short texts hold no passage; passages within
one document count; a missing id sorts last and is returned as null; rows that
share an id are told apart by their text, rows that share id and text are one
document; other columns are unused; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relief.llm.common import KEY, NO_ID, Piece, column, keyed, long_values, sequences, whole
from relief.llm.repeats import repeated_sequences, shared_anchors

PASSAGE = 50
LEAD = 8  # words that suffixes must share before the stretches around them are compared


def _least_within(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of `width` values from each position, the first of equals.

    Minima of spans that double in length give those of any width as two spans.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        best = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = best[:count], best[width - span : width - span + count]
    return np.where(values[right] < values[left], right, left)


def minimisers(piece: Piece, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of leading words, starts of passages, and the suffix each one retains."""
    lead = sequences(piece.word, LEAD, 5)
    start = np.flatnonzero(whole(piece, passage))
    return lead, start, _least_within(lead, passage - LEAD + 1)[start]


def suffix_fingerprints(passage: int):
    """Retained suffixes of a piece and the fingerprints of their leading words."""

    def select(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        lead, _, suffix = minimisers(piece, passage)
        at = np.unique(suffix)
        return at, lead[at]

    return select


def extended(passage: int):
    """Passages whose retained suffix shares its leading words with another."""

    def reach(piece: Piece, marked: np.ndarray) -> np.ndarray:
        _, start, suffix = minimisers(piece, passage)
        out = np.zeros(len(piece.word), dtype=bool)
        out[start] = marked[suffix]
        return out

    return reach


def _spans(passage: int):
    """Join starts of repeated passages of a document into maximal spans."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column(batch, "runs")
            counts = np.asarray(rows.value_lengths()).astype(np.int64)
            flat = rows.flatten()
            has = flat.field("other_place").is_valid().to_numpy(zero_copy_only=False)
            place, many, other_id, other = (
                flat.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for k in ("place", "many", "other_id", "other_place")
            )
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            # how far the runs of a document reach so far, each document beyond the one before
            far = doc * (1 << 32) + place + many[order] - 1 + passage
            far = np.maximum.accumulate(far)
            new = np.ones(len(doc), dtype=bool)
            new[1:] = doc[1:] * (1 << 32) + place[1:] > far[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            # a span points to the earlier copy of its first passage that has one
            has, other_id, other = has[order], other_id[order], other[order]
            follow = np.append(np.where(has, np.arange(len(has)), len(has)), len(has))
            follow = np.minimum.accumulate(follow[::-1])[::-1][first]
            found = follow <= last
            follow = np.minimum(follow, len(has) - 1)
            ids = long_values(batch, "_id")[doc[first]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=ids == NO_ID),
                    pa.array(place[first].astype(np.int32)),
                    pa.array((far[last] - doc[last] * (1 << 32)).astype(np.int32)),
                    pa.array(other_id[follow], mask=~found | (other_id[follow] == NO_ID)),
                    pa.array((other[follow] - (place[follow] - place[first])).astype(np.int32), mask=~found),
                ],
                ["doc_id", "start_word", "end_word", "earlier_id", "earlier_word"],
            )

    return join


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Maximal spans of words made of passages that stand at two places at least.

    Returns (doc_id, start_word, end_word, earlier_id, earlier_word), one row for
    each span of each document. The span's first passage with an earlier copy
    gives the earlier document and the word there that lines up with the span's
    start; both are null where all of the span stands here first.
    """
    base = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select(*KEY, "text")
    hits = shared_anchors(base, suffix_fingerprints(passage))
    found = repeated_sequences(base, hits, passage, extended(passage), others=True)
    return found.mapInArrow(
        _spans(passage), "doc_id long, start_word int, end_word int, earlier_id long, earlier_word int"
    )
