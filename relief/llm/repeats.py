"""Repeated word sequences in two steps: shared anchors, then the sequences around them.

Step one marks places of documents whose anchor (a short word sequence at
selected positions) occurs more than once anywhere. Step two extends marked
places to all full sequences that hold a marked anchor. Neighbouring sequences
form runs that end where content says so, and whole runs are compared first: a
copied document is a few equal runs. The sequences of each run that is the first
of its kind are then compared one by one, which settles copies that begin or end
inside a run; a run that has an earlier equal needs no more, as whatever agrees
with it also agrees with that one.

Every comparison works alike: each task first settles what repeats within its
own batch, so that a sequence found in a third of all documents reaches the
shuffle once per batch and not once per document; what is unique within its
batch is compared across batches by its fingerprint.

A full sequence is identified by 96 bits, so that chance agreement is not
expected even over 10^13 words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from relief.llm.common import KEY, SPACED, Piece, column, lists, long_values, mix, runs, sequences, signed, split_words, spread, text_bytes, whole

# text of documents whose repeats are settled before the shuffle
BATCH_BYTES = 16 << 20
# neighbouring sequences are compared in runs of about this many
RUN = 8

Select = Callable[[Piece], tuple[np.ndarray, np.ndarray]]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, at = text_bytes(column(batch, "text"))
    for low, high in runs(at, BATCH_BYTES):
        yield batch.slice(low, high - low)


def _new(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    out = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for values in sorted_columns:
            out[1:] |= values[1:] != values[:-1]
    return out


def _by_document(doc: np.ndarray, *columns: np.ndarray) -> tuple:
    """Documents in order, and a list column of each one's values."""
    order = np.argsort(doc, kind="stable")
    which, count = np.unique(doc, return_counts=True)
    return which, *(lists(c[order], count) for c in columns)


def _padded(values: np.ndarray, before: np.ndarray, gap: int, after: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate((values[before], np.zeros(gap, dtype=np.int64), values[after])))


def shared_anchors(docs: DataFrame, select: Select) -> DataFrame:
    """Places whose anchor occurs at two places at least: (_id, _th, places).

    `select` returns, for one piece, positions of words and the anchor's fingerprint there.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                mark, doc, place = [], [], []
                for piece in split_words(column(part, "text"), SPACED):
                    at, fingerprint = select(piece)
                    mark.append(fingerprint)
                    doc.append(piece.rows[piece.doc()[at]])
                    place.append(piece.place()[at])
                if not mark:
                    continue
                mark, doc, place = np.concatenate(mark), np.concatenate(doc), np.concatenate(place)
                order = np.argsort(mark)
                first = _new(mark[order])
                group = np.empty(len(mark), dtype=np.int64)
                group[order] = np.cumsum(first) - 1
                known = np.bincount(group)[group] > 1 if len(mark) else first
                ids, th = long_values(part, "_id"), long_values(part, "_th")
                # an anchor that repeats here stands once for the whole batch, its places are settled
                stand = mark[order][first & known[order]]
                alone = np.flatnonzero(~known)
                docs_, places = _by_document(doc[known], place[known].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.concatenate((mark[alone], stand, spread(ids[docs_], th[docs_]))))),
                        pa.array(np.concatenate((place[alone], np.full(len(stand) + len(docs_), -1))).astype(np.int32)),
                        _padded(ids, doc[alone], len(stand), docs_),
                        _padded(th, doc[alone], len(stand), docs_),
                        pa.concat_arrays([pa.nulls(len(alone) + len(stand), places.type), places]),
                    ],
                    ["_k", "place", *KEY, "settled"],
                )

    # the fields that vary stand together: rows of one document then pack well in the shuffle
    schema = "_k long, place int, _id long, _th long, settled array<int>"
    many = F.count(F.lit(1)).over(Window.partitionBy("_k"))
    hits = docs.select(*KEY, "text").mapInArrow(anchors, schema).withColumn("_n", many)
    return (
        hits.where("settled is not null or (_n > 1 and place >= 0)")
        .groupBy(*KEY)
        .agg(F.flatten(F.collect_list(F.coalesce("settled", F.array("place")))).alias("places"))
    )


@dataclass
class _Found:
    """Candidate sequences of a batch: two fingerprints, document and place, in document order."""

    a: np.ndarray
    b: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def _candidates(part: pa.RecordBatch, size: int, starts: Callable) -> _Found:
    """Sequences at the words that `starts(piece, first row)` names."""
    a, b, doc, place = ([np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)])
    for piece in split_words(column(part, "text"), SPACED):
        at = np.flatnonzero(starts(piece)[: max(0, len(piece.word) - size + 1)] & whole(piece, size))
        a.append(sequences(piece.word, size, 11)[at])
        b.append(sequences(piece.word, size, 12)[at])
        doc.append(piece.rows[piece.doc()[at]])
        place.append(piece.place()[at])
    return _Found(*(np.concatenate(x) for x in (a, b, doc, place)))


def _runs(found: _Found) -> tuple[_Found, np.ndarray]:
    """Join neighbouring sequences into runs; the length of each comes along."""
    # a run ends at a gap and after a sequence whose fingerprint says so
    new = np.ones(len(found.a), dtype=bool)
    new[1:] = (
        (found.doc[1:] != found.doc[:-1])
        | (found.place[1:] != found.place[:-1] + 1)
        | ((found.b[:-1] >> np.uint64(40)) % np.uint64(RUN) == 0)
    )
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(new)))
    if not len(first):
        return found, length
    step = np.arange(len(new)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        scale = mix(step.astype(np.uint64)) | np.uint64(1)
        marks = (mix(np.add.reduceat(x * scale, first) + length.astype(np.uint64)) for x in (found.a, found.b))
    return _Found(*marks, found.doc[first], found.place[first]), length


def _settled(part: pa.RecordBatch, found: _Found, length: np.ndarray | None) -> pa.RecordBatch:
    """One row for each distinct sequence of the batch, and for each document what that settles.

    Rows of the first kind have a place; those of the second have lists of the
    places of later copies, their lengths, and where the first of the batch is.
    """
    a, b, doc, place = found.a, found.b >> np.uint64(32), found.doc, found.place
    ids, th = long_values(part, "_id"), long_values(part, "_th")
    # rows of equal key are one document
    rank = np.empty(len(ids), dtype=np.int64)
    by_key = np.lexsort((th, ids))
    rank[by_key] = np.cumsum(_new(ids[by_key], th[by_key])) - 1
    order = np.lexsort((rank[doc] * (1 << 32) + place, b, a))
    first = _new(a[order], b[order])
    lead = np.empty(len(order), dtype=np.int64)
    lead[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else order
    later = (rank[doc] != rank[doc[lead]]) | (place != place[lead])
    twin = np.zeros(len(lead), dtype=bool)
    twin[lead[later]] = True
    leads = np.flatnonzero(lead == np.arange(len(lead)))
    rest = np.flatnonzero(later)
    length = np.ones(len(a), dtype=np.int64) if length is None else length
    docs, *columns = _by_document(
        doc[rest],
        place[rest].astype(np.int32),
        length[rest].astype(np.int32),
        ids[doc[lead[rest]]],
        place[lead[rest]].astype(np.int32),
    )
    gone = len(docs)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(np.concatenate((a[leads], spread(ids[docs], th[docs]))))),
            pa.array(np.concatenate(((place[leads] << 32) | b[leads].astype(np.int64), np.zeros(gone, np.int64)))),
            _padded(ids, doc[leads], 0, docs),
            _padded(th, doc[leads], 0, docs),
            pa.array(np.concatenate((length[leads], np.zeros(gone, np.int64))).astype(np.int32)),
            pa.array(np.concatenate((twin[leads], np.zeros(gone, bool)))),
            *(pa.concat_arrays([pa.nulls(len(leads), c.type), c]) for c in columns),
        ],
        _NAMES,
    )


# _p holds the place above and the second fingerprint below 32 bits
_NAMES = ["_k", "_p", *KEY, "many", "_twin", "settled", "_many", "_oid", "_op"]
_ROWS = (
    "_k long, _p long, _id long, _th long, many int, _twin boolean, "
    "settled array<int>, _many array<int>, _oid array<long>, _op array<int>"
)


def _compared(rows: DataFrame, others: bool, opened: bool) -> DataFrame:
    """Compare across batches: (_id, _th, found), a list of runs for each document.

    A run with `open` is the first of its kind (listed if `opened`); the rest
    have an earlier copy or, with `others`, are first of their kind and have a
    later one.
    """
    by = Window.partitionBy("_k").orderBy(*KEY, "_p")

    def run(is_open: bool, place, many, other_id=None, other_place=None):
        fields = [F.lit(is_open).alias("open"), place.alias("place"), many.alias("many")]
        if others:
            none_id, none_place = F.lit(None).cast("long"), F.lit(None).cast("int")
            fields.append((none_id if other_id is None else other_id).alias("other_id"))
            fields.append((none_place if other_place is None else other_place).alias("other_place"))
        return F.struct(*fields)

    place, many = F.shiftright("_p", 32).cast("int"), F.col("many")
    # rows of one document read more than once are the same place, so not later than each other
    first_p = F.first("_p").over(by)
    # where only the first fingerprint agrees, nothing is known to be a copy
    same = F.col("_first_p").bitwiseAND(0xFFFFFFFF) == F.col("_p").bitwiseAND(0xFFFFFFFF)
    rows = rows.withColumns({"_first_p": first_p, "_rank": F.rank().over(by)})
    rows = rows.withColumn("_later", (F.col("_rank") > 1) & same)
    nothing = F.array(run(True, place, many))
    nothing = F.slice(nothing, 1, 0)
    if others:
        group = Window.partitionBy("_k")
        rows = rows.withColumns(
            {"_least": F.first("_id").over(by), "_any": F.col("_twin") | F.max("_later").over(group)}
        )
        later = F.array(run(False, place, many, F.col("_least"), F.shiftright("_first_p", 32).cast("int")))
        leading = F.when(F.col("_any"), F.array(run(False, place, many))).otherwise(nothing)
        known = F.transform(
            F.arrays_zip("settled", "_many", "_oid", "_op"),
            lambda x: run(False, x["settled"], x["_many"], x["_oid"], x["_op"]),
        )
    else:
        later, leading = F.array(run(False, place, many)), nothing
        known = F.transform(F.arrays_zip("settled", "_many"), lambda x: run(False, x["settled"], x["_many"]))
    if opened:
        leading = F.concat(leading, F.array(run(True, place, many)))
    found = F.when(F.col("settled").isNotNull(), known).when(F.col("_later"), later).otherwise(leading)
    # one list for both readers, so that they share its shuffle
    lists_ = rows.select(*KEY, found.alias("found")).where(F.size("found") > 0)
    return lists_.groupBy(*KEY).agg(F.flatten(F.collect_list("found")).alias("found"))


def repeated_sequences(docs: DataFrame, hits: DataFrame, size: int, reach: Callable, others: bool) -> DataFrame:
    """Sequences of `size` words that occur more than once, among those `reach` names.

    `reach(piece, marked)` says for each word whether a sequence that starts
    there holds a marked anchor. Returns (_id, _th, runs): runs of neighbouring
    sequences that have an earlier copy, as place of the first and how many. With
    `others`, runs that are first of their kind and have a later copy are listed
    too, and other_id and other_place say where the earlier copy of a run is.
    """

    def marked_in(part: pa.RecordBatch, piece: Piece) -> np.ndarray:
        own = column(part, "places").slice(int(piece.rows[0]), len(piece.rows))
        count = np.asarray(own.value_lengths()).astype(np.int64)
        marked = np.zeros(len(piece.word), dtype=bool)
        marked[np.asarray(own.flatten()) + np.repeat(piece.first[:-1], count)] = True
        return marked

    def in_runs(part: pa.RecordBatch, piece: Piece) -> np.ndarray:
        own = column(part, "open").slice(int(piece.rows[0]), len(piece.rows))
        count = np.asarray(own.value_lengths()).astype(np.int64)
        flat = own.flatten()
        start = np.asarray(flat.field("place")).astype(np.int64) + np.repeat(piece.first[:-1], count)
        edge = np.zeros(len(piece.word) + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + np.asarray(flat.field("many")), -1)
        return np.cumsum(edge[:-1]) > 0

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = _candidates(part, size, lambda piece, part=part: reach(piece, marked_in(part, piece)))
                yield _settled(part, *_runs(found))

    def sequences_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _settled(part, _candidates(part, size, lambda piece, part=part: in_runs(part, piece)), None)

    first = docs.join(hits, KEY).select(*KEY, "text", "places").mapInArrow(runs_of, _ROWS)
    first = _compared(first, others, opened=True)
    opened = first.select(*KEY, F.filter("found", lambda r: r["open"]).alias("open")).where(F.size("open") > 0)
    second = docs.join(opened, KEY).select(*KEY, "text", "open").mapInArrow(sequences_of, _ROWS)
    second = _compared(second, others, opened=False)
    closed = first.select(*KEY, F.filter("found", lambda r: ~r["open"]).alias("found")).where(F.size("found") > 0)
    return closed.unionByName(second).groupBy(*KEY).agg(F.flatten(F.collect_list("found")).alias("runs"))
