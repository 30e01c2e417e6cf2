"""Toxicity: a word-presence classifier regularised by counterfactual identity swaps.

A logistic model over the presence of words is fitted to labelled documents.
Beside the usual loss it minimises the squared change of the log-odds when the
identity terms of a document are swapped for others of their set ("she" for
"he", one faith or people for another), so that a group's name alone does not
raise a score. Scoring reads every whole text once, next to the data.

The model is fitted on the driver from at most `max_rows` labelled documents,
those with the smallest hash of their id: this bound is a parameter and the only
sample; all documents are scored.

Defined results: null and empty texts get the score of a document without known
words; a document labelled more than once takes its largest label; labels that
are null are left out; a null doc_id is scored and never learnt from; without
labels of both kinds every score is the smoothed share of toxic labels, 1/4 if
there are none; repeated rows are scored each. All other columns are kept, but
for those of the names that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relief.llm.common import ALNUM, aside, column, lists, long_values, restored, split_words

# fixed values: sets of words that name groups of people; members are swapped in turn
IDENTITY_SETS = (
    ("he", "she"), ("him", "her"), ("his", "hers"), ("man", "woman"), ("men", "women"), ("boy", "girl"),
    ("boys", "girls"), ("male", "female"), ("father", "mother"), ("son", "daughter"), ("husband", "wife"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "chinese", "mexican", "arab", "indian"),
    ("immigrant", "native"), ("immigrants", "natives"), ("refugee", "citizen"), ("refugees", "citizens"),
    ("disabled", "abled"), ("old", "young"),
    ("mann", "frau"), ("männer", "frauen"), ("christ", "muslim", "jude"), ("ausländer", "inländer"), ("schwul", "hetero"),
    ("homme", "femme"), ("hommes", "femmes"), ("chrétien", "musulman", "juif"), ("noir", "blanc", "arabe"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("cristiano", "musulmán", "judío"), ("negro", "blanco", "árabe"),
)


def short(word: np.ndarray) -> np.ndarray:
    """32-bit fingerprints: the vocabulary is far smaller, and the driver holds half the bytes."""
    return (word >> np.uint64(32)).astype(np.uint32)


@dataclass
class Model:
    """Sorted 32-bit word fingerprints with a weight each, and the intercept."""

    word: np.ndarray
    weight: np.ndarray
    intercept: float

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if not len(self.word):
            return out
        bits = np.zeros(1 << 22, dtype=bool)
        bits[self.word >> np.uint32(10)] = True
        for piece in split_words(texts, ALNUM, lower=True):
            word = short(piece.word)
            maybe = np.flatnonzero(bits[word >> np.uint32(10)])
            at = np.minimum(np.searchsorted(self.word, word[maybe]), len(self.word) - 1)
            hit = self.word[at] == word[maybe]
            # presence: each word of the model once per document
            pairs = np.unique(piece.doc()[maybe[hit]] * len(self.word) + at[hit])
            out[piece.rows] += np.bincount(
                pairs // len(self.word), self.weight[pairs % len(self.word)], minlength=len(piece.rows)
            )
        return out


def is_held_out(doc_id) -> F.Column:
    """Rows kept out of learning: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_words(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(toxic, words): the distinct word fingerprints of each document learnt from."""
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~is_held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = long_values(batch, "_toxic")
            for piece in split_words(column(batch, "text"), ALNUM, lower=True):
                word = short(piece.word)
                order = np.lexsort((word, piece.doc()))
                doc, word = piece.doc()[order], word[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
                counts = np.bincount(doc[new], minlength=len(piece.rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic[piece.rows].astype(np.int32)), lists(word[new].view(np.int32), counts)], ["toxic", "words"]
                )

    # at most max_rows ids, so this side is small by its parameter
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    return joined.select("text", "_toxic").mapInArrow(words, "toxic int, words array<int>")


def _identity_ids(vocabulary: np.ndarray) -> list[list[int]]:
    """Positions in the vocabulary of the identity sets that it holds."""
    sets = []
    for names in IDENTITY_SETS:
        (piece,) = split_words(pa.array([" ".join(names)]), ALNUM, lower=True)
        word = short(piece.word)
        at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
        sets.append([int(a) for a, w in zip(at, word, strict=True) if vocabulary[a] == w])
    return [s for s in sets if len(s) > 1]


def fit(
    toxic: np.ndarray,
    words: np.ndarray,
    counts: np.ndarray,
    min_docs: int = 3,
    ridge: float = 0.3,
    swap_penalty: float = 1.0,
    steps: int = 150,
) -> Model:
    """Minimise log loss + ridge + swap penalty over words seen in `min_docs` documents."""
    n = len(toxic)
    positive = int(toxic.sum())
    prior = (positive + 1) / (n + 4)
    none = Model(np.empty(0, np.uint32), np.empty(0), float(np.log(prior / (1 - prior))))
    if positive in (0, n):
        return none
    vocabulary, column_of, docs_of = np.unique(words, return_inverse=True, return_counts=True)
    keep = docs_of >= min_docs
    # words of which there are no more than chance puts beside either label carry nothing
    row = np.repeat(np.arange(n), counts)
    hits = np.bincount(column_of, toxic[row], minlength=len(vocabulary))
    share = positive / n
    spread = np.abs(hits - docs_of * share) / np.sqrt(docs_of * share * (1 - share))
    keep &= spread >= 2.5
    for ids in _identity_ids(vocabulary):
        keep[ids] = True
    if not keep.any():
        return none
    new_id = np.cumsum(keep) - 1
    used = keep[column_of]
    row, col = row[used], new_id[column_of[used]]
    vocabulary = vocabulary[keep]
    size = len(vocabulary)
    # a swap moves a word's weight to the next of its set: rows of +1 and -1
    partner = np.full(size, -1)
    for ids in _identity_ids(vocabulary):
        partner[ids] = np.roll(ids, -1)
    moved = partner[col] >= 0
    swap_row = np.concatenate((row[moved], row[moved]))
    swap_col = np.concatenate((col[moved], partner[col[moved]]))
    swap_sign = np.repeat([1.0, -1.0], moved.sum())

    weight, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, weight[col], minlength=n) + bias)))
        error = p - toxic
        change = np.bincount(swap_row, swap_sign * weight[swap_col], minlength=n)
        slope = np.bincount(col, error[row], minlength=size) + ridge * weight
        slope += 2 * swap_penalty * np.bincount(swap_col, swap_sign * change[swap_row], minlength=size)
        slope = np.append(slope, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        move *= min(1.0, 2 * (1 - step / (steps + 1)))
        weight -= move[:-1]
        bias -= move[-1]
    return Model(vocabulary, weight, float(bias))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Model:
    sample = labelled_words(docs, labels, max_rows).toArrow()
    words = sample.column("words").combine_chunks()
    counts = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64) if len(words) else np.empty(0, np.int64)
    flat = np.asarray(words.flatten()).astype(np.int32, copy=False).view(np.uint32)
    toxic = (np.asarray(sample.column("toxic")) == 1).astype(float)
    # any order of arrival gives the same sums: sort documents by label and content
    first = np.cumsum(counts) - counts
    tag = np.add.reduceat(flat, np.minimum(first, max(0, len(flat) - 1))) if len(flat) else np.zeros(len(counts), np.uint32)
    order = np.lexsort((tag, counts, toxic))
    shift = (first[order] - (np.cumsum(counts[order]) - counts[order])).astype(np.int32)
    flat = flat[np.repeat(shift, counts[order]) + np.arange(len(flat), dtype=np.int32)]
    del words, sample
    return fit(toxic[order], flat, counts[order], **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) to whole documents."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = 1 / (1 + np.exp(-model.log_odds(column(batch, "text"))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    schema = docs.select(*kept).schema
    for name, kind in (("score", "double"), ("predicted", "integer")):
        schema = schema.add(name, kind)
    return docs.select(*kept).mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learn from the labelled documents, then score all of them."""
    return score(docs, learn(docs, labels, **options))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents that the classifier does not reject; all their columns are kept."""
    docs, names = aside(docs, "doc_id", "text")
    return restored(classify(docs, labels, **options).where("predicted = 0"), names)
