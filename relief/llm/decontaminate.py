"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment.

A test item is described by its word n-grams (words are runs of ASCII letters,
digits and non-ASCII bytes, A-Z lower-cased). Every n-gram of an item is a seed,
however often it occurs: which of them an edited copy still holds does not
depend on how rare they are. A document whose words hold seeds of an item near one
diagonal is aligned with the whole item around that diagonal, unless too few of
the item's words stand there for any alignment to reach the threshold; the local
alignment score, as a share of the score of a perfect copy, tells copies that
were edited or cut from chance.

Items are handled in blocks of bounded size, each against all documents, so the
seed table that travels with the tasks never grows with the benchmark.

Items of fewer than `min_words` words, or with too few n-grams for `min_seeds`,
are looked up by their whole word sequence instead: a place that holds all of
it in order matches with score 1 and counts as one seed.

Defined results: null or empty texts and items without words match nothing; repeated
document rows give repeated result rows, repeated items are separate items;
a null doc_id or item_id is returned as it is. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relief.llm.common import ALNUM, column, sequences, split_words, whole

SCHEMA = "doc_id long, item_id long, score double, start_word int, end_word int, seeds int"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("score", pa.float64()),
        ("start_word", pa.int32()),
        ("end_word", pa.int32()),
        ("seeds", pa.int32()),
    ]
)
MATCH, MISMATCH, GAP = 2, -1, -1
AT_ONCE = 1 << 20  # meetings of words and seeds that are sorted together


@dataclass
class Seeds:
    """Sorted n-gram fingerprints, and for each the items and places that hold it."""

    gram: np.ndarray  # sorted, distinct
    first: np.ndarray  # range in item/place of each gram
    item: np.ndarray  # position in items
    place: np.ndarray
    items: list  # item ids
    words: list  # fingerprints of each item's words
    exact: list  # (length, sorted distinct sequences, ranges, item ids) of the short items

    def meetings(self, at: np.ndarray, which: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        """Words `at` beside all places of their grams `which`, about AT_ONCE at a time: (at, entry).

        All meetings of a document and an item come together.
        """
        key = np.repeat(np.arange(len(self.gram)), np.diff(self.first)) * len(self.words) + self.item
        total = np.append(0, np.cumsum(self.first[which + 1] - self.first[which]))
        ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))  # of the documents
        low = 0
        while low < len(at):
            fit = ends[(ends > low) & (total[ends] - total[low] <= AT_ONCE)]
            high = int(fit[-1] if len(fit) else ends[ends > low][0])
            # a single document with more meetings takes the items in ranges
            parts = min(len(self.words), int(-(-(total[high] - total[low]) // AT_ONCE)))
            cut = np.linspace(0, len(self.words), parts + 1).astype(np.int64)
            base = which[low:high] * len(self.words)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                begin = np.searchsorted(key, base + a)
                many = np.searchsorted(key, base + b) - begin
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield np.repeat(at[low:high], many), np.repeat(begin, many) + step
            low = high


def _item_words(rows) -> tuple[list, list]:
    ids, words = [], []
    for piece in split_words(pa.array([r["text"] for r in rows], pa.string()), ALNUM, lower=True):
        for k, row in enumerate(piece.rows):
            own = piece.word[piece.first[k] : piece.first[k + 1]]
            if len(own):
                ids.append(rows[int(row)]["item_id"])
                words.append(own.copy())
    return ids, words


def _grams(words: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = [sequences(w, size) for w in words]
    gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    return gram, item, place


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `wanted` meets the sorted table: positions in both."""
    if not len(table) or not len(wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # most values miss; a small bit table settles them before the binary search
    bits = np.zeros(1 << 22, dtype=bool)
    bits[(table >> np.uint64(42)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(wanted >> np.uint64(42)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, wanted[maybe]), len(table) - 1)
    hit = table[at] == wanted[maybe]
    return maybe[hit], at[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best local score and the text range it covers.

    The row recurrence is solved for a whole row at once: with a gap cost of one
    per word, the best cell reached from the left is a running maximum.
    """
    count = len(text)
    step = np.arange(count + 1)
    score = np.zeros(count + 1, dtype=np.int64)
    begin = step.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        take = diagonal >= above
        cell = np.concatenate(([0], np.maximum(np.where(take, diagonal, above), 0)))
        origin = np.concatenate(([0], np.where(cell[1:] == 0, step[1:], np.where(take, begin[:-1], begin[1:]))))
        # from the left: cell[j] = max over i <= j of cell[i] - (j - i)
        lifted = cell - GAP * step
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, step, 0))
        score, begin = top + GAP * step, origin[source]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(begin[j]), j)
    return best


def _short(ids: list, words: list) -> list:
    """The items' whole word sequences by their length: (length, sequences, ranges, item ids)."""
    out = []
    for length in sorted({len(w) for w in words}):
        own = [k for k, w in enumerate(words) if len(w) == length]
        mark = np.concatenate([sequences(words[k], length) for k in own])
        order = np.argsort(mark, kind="stable")
        table, first = np.unique(mark[order], return_index=True)
        out.append((length, table, np.append(first, len(order)), [ids[own[k]] for k in order]))
    return out


def _matches(docs: DataFrame, seeds: Seeds, size: int, threshold: float, min_seeds: int) -> DataFrame:
    band = 16  # words that a diagonal may drift within one group of seeds

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            ids = column(batch, "doc_id")
            for piece in split_words(column(batch, "text"), ALNUM, lower=True):
                doc_of, place_of = piece.doc(), piece.place()
                for length, table, first, owners in seeds.exact:
                    at, which = _find(table, np.where(whole(piece, length), sequences(piece.word, length), 0))
                    for a, w in zip(at.tolist(), which.tolist(), strict=True):
                        doc_id, place = ids[int(piece.rows[doc_of[a]])].as_py(), int(place_of[a])
                        found += [(doc_id, i, 1.0, place, place + length, 1) for i in owners[first[w] : first[w + 1]]]
                at, which = _find(seeds.gram, np.where(whole(piece, size), sequences(piece.word, size), 0))
                if not len(at):
                    continue
                for at, entry in seeds.meetings(at, which, doc_of[at]):
                    doc, item = doc_of[at], seeds.item[entry]
                    shift = place_of[at] - seeds.place[entry]
                    order = np.lexsort((shift, item, doc))
                    doc, item, shift = doc[order], item[order], shift[order]
                    new = np.ones(len(doc), dtype=bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > band)
                    group = np.flatnonzero(new)
                    last = np.append(group[1:], len(doc)) - 1
                    enough = last - group + 1 >= min_seeds
                    for low, high in zip(group[enough], last[enough], strict=True):
                        words = seeds.words[item[low]]
                        base, end = piece.first[doc[low]], piece.first[doc[low] + 1]
                        left = max(base, base + shift[low] - band)
                        right = min(end, base + shift[high] + len(words) + band)
                        # no alignment scores more than all words of the item that stand here
                        if np.isin(words, piece.word[left:right]).sum() < threshold * len(words):
                            continue
                        score, a, b = align(words, piece.word[left:right])
                        share = score / (MATCH * len(words))
                        if share >= threshold:
                            found.append(
                                (
                                    ids[int(piece.rows[doc[low]])].as_py(),
                                    seeds.items[item[low]],
                                    share,
                                    int(left - base + a),
                                    int(left - base + b),
                                    int(high - low + 1),
                                )
                            )
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), _ARROW, strict=True)], schema=_ARROW
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SCHEMA)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 3,
    threshold: float = 0.5,
    min_seeds: int = 2,
    min_words: int = 8,
    block: int = 20_000,
) -> DataFrame:
    """Passages of documents that align with a test item.

    Returns (doc_id, item_id, score, start_word, end_word, seeds), one row for
    each aligned place. `block` items at a time are matched with all documents.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block))
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        ids, words = _item_words(rows)
        if not ids:
            continue
        long = [len(w) >= max(min_words, size + min_seeds - 1) for w in words]
        exact = _short(*([x for x, is_long in zip(v, long, strict=True) if not is_long] for v in (ids, words)))
        ids, words = ([x for x, is_long in zip(v, long, strict=True) if is_long] for v in (ids, words))
        gram, item, place = _grams(words, size)
        order = np.argsort(gram, kind="stable")
        unique, first = np.unique(gram[order], return_index=True)
        seeds = Seeds(unique, np.append(first, len(order)), item[order], place[order], ids, words, exact)
        parts.append(_matches(docs, seeds, size, threshold, min_seeds))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that hold no test item; rows with a null doc_id are judged alike.

    The matches are few beside the documents, so the anti join keeps the
    documents in place when Spark finds the list below its broadcast limit and
    shuffles otherwise.
    """
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")
