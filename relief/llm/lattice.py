"""LM scoring: the likelihood of a text over all its segmentations into subwords.

The subwords are those of an existing vocabulary. A unigram model gives each a
probability; a text's probability is the sum over every way to spell it, found
by a forward recursion in log space along the lattice of its subwords. A word
carries the space before it, and no subword reaches over a space, so the
recursion over a text is the product of those of its words and of the end: the
lattice of a word is summed once for each distinct word and not once for each
place. Every single byte is a subword, so each text has a probability.

The vocabulary's own scores are ranks of merges, not probabilities. They give
the first estimate (Zipf's law by rank); rounds of expectation and maximisation
over all distinct learnt words then make it a model of the corpus. A round reads
the table of distinct words once and brings one number for each subword to the
driver, at most the size of the vocabulary. Expected counts are rounded to
1/1024 before they are summed, so that no order of tasks changes them.

A learnt word is one more edge of its lattice, from its begin to its end. Its
weight is the word's share of all tokens after an absolute discount, which is
estimated from how many words occur once and twice; what the discount frees
weighs the ways through subwords. All probabilities sum to one.

Counts of words are exact and cover all learnt documents. The most frequent
words, `frequent` at most, travel to the documents; the rest are joined.

Lower-cased are A-Z only; tokens are runs of bytes other than ASCII white space,
then one end for each text. Defined results: null texts count as empty (the end
alone); a null id is scored, never learnt from and not held out; repeated rows
count and are scored each; without learnt rows the word counts are 0 and the
subwords keep their first estimate; an empty table gives an empty result. Other
columns stay, but for those of the names that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relief.llm.common import (
    SPACED,
    WORDS_BYTES,
    aside,
    column,
    crc_remainder,
    distinct,
    expand,
    lists,
    restored,
    row_sums,
    runs,
    text_bytes,
    word_values,
)
from relief.session import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 4
FREQUENT = 1 << 18
UNIT = 1024  # expected counts are whole multiples of 1/UNIT
SMOOTH = 0.1  # added to each word's count in the base model, and to each subword's
ADDED = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_SPACE = "▁"


@dataclass
class Subwords:
    """A vocabulary as a trie: edges (node * 256 + byte -> child) and the subword that ends at each node.

    Nodes that have children are numbered first.
    """

    key: np.ndarray
    child: np.ndarray
    inner: int
    piece: np.ndarray
    rank: np.ndarray  # place of each subword in the vocabulary's order, from 1

    def table(self) -> np.ndarray:
        """Child of each inner node by byte, -1 where there is none."""
        table = np.full(self.inner * 256, -1, dtype=np.int32)
        table[self.key] = self.child
        return table


def read_subwords(model_file: str = VOCABULARY) -> Subwords:
    """The subwords that can occur in lower-cased words with one space before them, and all single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    known: dict[bytes, int] = {bytes([b]): model.get_piece_size() for b in range(256)}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        text = model.id_to_piece(k).replace(_SPACE, " ").encode()
        if b" " in text[1:] or any(65 <= b <= 90 for b in text):
            continue
        known[text] = min(known.get(text, k + 1), k + 1)
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    texts = sorted(known)
    for number, text in enumerate(texts):
        node = 0
        for byte in text:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
            node = children[node][byte]
        ends[node] = number
    order = sorted(range(len(children)), key=lambda n: (not children[n], n))
    new = {old: k for k, old in enumerate(order)}
    edges = sorted((new[n] * 256 + b, new[c]) for n, found in enumerate(children) for b, c in found.items())
    piece = np.full(len(children), -1, dtype=np.int32)
    for node, number in ends.items():
        piece[new[node]] = number
    return Subwords(
        np.array([k for k, _ in edges], dtype=np.int64),
        np.array([c for _, c in edges], dtype=np.int32),
        sum(1 for c in children if c),
        piece,
        np.array([known[t] for t in texts], dtype=np.int64),
    )


@dataclass
class Lattice:
    """All subwords in a run of words, ordered by the place in the word where they end."""

    order: np.ndarray  # bytes by their place in the word
    level: np.ndarray  # how many bytes lie before each place, and in all
    group: np.ndarray  # first edge that ends at each byte, in that order, and the number of edges
    before: np.ndarray  # byte before each edge; the number of bytes stands for a word's begin
    end: np.ndarray  # last byte of each edge
    piece: np.ndarray
    last: np.ndarray  # last byte of each word

    def edges(self, level: int) -> tuple[int, int]:
        return self.group[self.level[level]], self.group[self.level[level + 1]]


def lattice(subwords: Subwords, table: np.ndarray, buffer: np.ndarray, at: np.ndarray) -> Lattice:
    """The lattice of the words buffer[at[i]:at[i+1]], none of them empty."""
    size = len(buffer)
    length = np.diff(at)
    begin, stop = np.repeat(at[:-1], length), np.repeat(at[1:], length)
    found, ways = [], np.zeros(size, dtype=np.int32)
    start, node, step = np.arange(size), np.zeros(size, dtype=np.int32), 0
    while len(start):
        place = start + step
        inside = (place < stop[start]) & (node < subwords.inner)
        start, node, place = start[inside], node[inside], place[inside]
        node = table[node.astype(np.int64) * 256 + buffer[place]]
        alive = node >= 0
        start, node, place = start[alive], node[alive], place[alive]
        hit = subwords.piece[node] >= 0
        ends = place[hit]
        # each byte is the end of one subword of this length at most
        found.append((start[hit], ends, subwords.piece[node[hit]], ways[ends]))
        ways[ends] += 1
        step += 1
    depth = np.arange(size) - begin
    order = np.argsort(depth, kind="stable")
    group = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(ways[order], out=group[1:])
    first = np.empty(size, dtype=np.int64)
    first[order] = group[:-1]
    count = int(group[-1])
    before, end, piece = np.empty(count, np.int64), np.empty(count, np.int64), np.empty(count, np.int32)
    for starts, ends, pieces, nth in found:
        to = first[ends] + nth
        before[to] = np.where(starts == begin[starts], size, starts - 1)
        end[to] = ends
        piece[to] = pieces
    level = np.zeros(int(depth.max(initial=-1)) + 2, dtype=np.int64)
    np.cumsum(np.bincount(depth, minlength=len(level) - 1), out=level[1:])
    return Lattice(order, level, group, before, end, piece, at[1:] - 1)


def forward(lat: Lattice, log_p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all ways to each byte; the last entry is the begin."""
    alpha = np.zeros(len(lat.order) + 1)
    value = log_p[lat.piece]
    for k in range(len(lat.level) - 1):
        low, high = lat.edges(k)
        here = slice(lat.level[k], lat.level[k + 1])
        alpha[lat.order[here]] = np.logaddexp.reduceat(alpha[lat.before[low:high]] + value[low:high], lat.group[here] - low)
    return alpha


def shares(lat: Lattice, log_p: np.ndarray) -> np.ndarray:
    """How probable it is that each edge is part of its word's segmentation."""
    alpha = forward(lat, log_p)
    share = np.exp(alpha[lat.before] + log_p[lat.piece] - alpha[lat.end])
    passed = np.zeros(len(alpha))
    passed[lat.last] = 1.0
    for k in range(len(lat.level) - 2, -1, -1):
        low, high = lat.edges(k)
        share[low:high] *= passed[lat.end[low:high]]
        np.add.at(passed, lat.before[low:high], share[low:high])
    return share


def spaced(words: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, buffer, offsets): runs of words, each after one space."""
    data, at = text_bytes(words)
    for low, high in runs(at, 1 << 18):
        length = np.diff(at[low : high + 1]) + 1
        begin = np.cumsum(length) - length
        buffer = np.full(int(length.sum()), 32, dtype=np.uint8)
        buffer[expand(begin + 1, length - 1)] = data[at[low] : at[high]]
        yield low, high, buffer, np.append(begin, len(buffer))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, n_all): occurrences in the rows learnt from and in all rows; `docs` has text and _learn."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = column(batch, "_learn").to_numpy(zero_copy_only=False)
            for rows, words, counts in word_values(column(batch, "text"), SPACED, lower=True, limit=2 * WORDS_BYTES):
                values, code = distinct(words)
                weight = np.repeat(learn[rows], counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        values.cast(pa.string()),
                        pa.array(np.bincount(code[weight], minlength=len(values))),
                        pa.array(np.bincount(code, minlength=len(values))),
                    ],
                    ["word", "n", "n_all"],
                )

    found = docs.select("text", "_learn").mapInArrow(count, "word string, n long, n_all long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def first_estimate(subwords: Subwords) -> np.ndarray:
    p = 1.0 / (10 + subwords.rank)
    return np.log(p / p.sum())


def expected_counts(words: DataFrame, subwords: Subwords, log_p: np.ndarray) -> np.ndarray:
    """Expected occurrences of each subword in the distinct words."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = subwords.table()
        total = np.zeros(len(log_p), dtype=np.int64)
        for batch in batches:
            for _, _, buffer, at in spaced(column(batch, "word")):
                lat = lattice(subwords, table, buffer, at)
                units = np.rint(shares(lat, log_p) * UNIT)
                total += np.bincount(lat.piece, units, minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["piece", "units"])

    sums = words.select("word").mapInArrow(expect, "piece long, units long")
    # one row for each subword at most
    found = sums.groupBy("piece").agg(F.sum("units").alias("units")).toArrow()
    out = np.zeros(len(log_p))
    out[found.column("piece").to_numpy()] = found.column("units").to_numpy()
    return out / UNIT


def fit(words: DataFrame, subwords: Subwords, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the subwords, learnt from distinct words; they sum to one over all words."""
    log_p = first_estimate(subwords)
    for _ in range(rounds):
        count = expected_counts(words, subwords, log_p) + SMOOTH
        log_p = np.log(count / count.sum())
    return log_p


@dataclass
class Counts:
    """What the learnt rows hold: tokens with the ends, distinct words, words that occur once and twice, texts."""

    tokens: int
    words: int
    once: int
    twice: int
    texts: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def base(self, n):
        """log10 of a token's share under smoothed counts."""
        kinds = self.words + (self.texts > 0)
        return np.log10((n + SMOOTH) / (self.tokens + SMOOTH * (kinds + 1)))

    def log_end(self) -> float:
        return float(np.log(self.texts / self.tokens)) if self.texts else float(np.log(0.5))

    def log_whole(self, n: np.ndarray) -> np.ndarray:
        """Log weight of the edge that is the word itself."""
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(n - self.discount, 0.0) / max(1, self.tokens))

    def log_spelt(self) -> float:
        """Log weight of all ways through subwords; half of all, as of the end, where nothing is learnt."""
        if not self.texts:
            return float(np.log(0.5))
        return float(np.log(max(self.discount * self.words, SMOOTH) / self.tokens))


def score_words(words: DataFrame, subwords: Subwords, log_p: np.ndarray, counts: Counts) -> DataFrame:
    """(word, known, base, log10_p) of each counted word."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = subwords.table()
        for batch in batches:
            n = column(batch, "n").to_numpy()
            value = counts.log_whole(n)
            for low, high, buffer, at in spaced(column(batch, "word")):
                lat = lattice(subwords, table, buffer, at)
                spelt = forward(lat, log_p)[lat.last] + counts.log_spelt()
                value[low:high] = np.logaddexp(value[low:high], spelt)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "word"), *(pa.array(x) for x in ((n > 0).astype(np.int64), counts.base(n), value / np.log(10)))],
                ["word", "known", "base", "log10_p"],
            )

    return words.select("word", "n").mapInArrow(rate, "word string, known long, base double, log10_p double")


def _threshold(words: DataFrame, most: int) -> int:
    """The least power of two that at most `most` words reach in number."""
    levels = words.groupBy(F.floor(F.log2("n_all")).cast("int").alias("level")).count().collect()
    reach, level = 0, 62
    for row in sorted(levels, key=lambda r: -r["level"]):
        reach += row["count"]
        if reach > most:
            break
        level = row["level"]
    return 1 << level


def score_texts(
    docs: DataFrame,
    model_file: str = VOCABULARY,
    learn: Column | None = None,
    rounds: int = ROUNDS,
    frequent: int = FREQUENT,
    keep_text: bool = True,
) -> DataFrame:
    """Add held_out, n_tokens, n_known, train_tokens, base_score and score to whole documents.

    `learn` tells the rows to learn from, by default those whose id's crc32 is
    not divisible by ten. `base_score` is the log10 probability under smoothed
    word counts, `score` that of the subword lattice.
    """
    remainder = crc_remainder("doc_id", 10)
    docs = docs.drop(*(c for c in ADDED if learn is None or c != "held_out"))
    docs = docs.withColumns(
        {
            "_held": F.coalesce(remainder == 0, F.lit(False)),
            "_learns": F.coalesce(remainder != 0 if learn is None else learn, F.lit(False)),
        }
    ).drop(*ADDED)
    docs, names = aside(docs, "text", "_held", "_learns")
    docs = docs.withColumns({"text": F.col("text").cast("string"), "_learn": F.col("_learns")})
    subwords = read_subwords(model_file)
    words = materialise(count_words(docs))
    texts = docs.where("_learn").count()
    n = F.col("n")
    sums = words.agg(F.sum(n), F.count_if(n > 0), F.count_if(n == 1), F.count_if(n == 2)).first()
    counts = Counts((sums[0] or 0) + texts, *sums[1:], texts)
    log_p = fit(words.where(n > 0), subwords, rounds) if counts.words else first_estimate(subwords)
    least = _threshold(words, frequent)
    hot = score_words(words.where(F.col("n_all") >= least), subwords, log_p, counts).toArrow().combine_chunks()
    hot_word = hot.column("word").combine_chunks() if hot.num_rows else pa.array([], pa.string())
    hot_word = hot_word.cast(pa.binary())
    hot_value = {c: np.append(hot.column(c).to_numpy(), 0) for c in ("known", "base", "log10_p")}
    end = (int(texts > 0), float(counts.base(texts)), counts.log_end() / float(np.log(10)))
    kept = [c for c in docs.columns if c != "_learn" and (keep_text or c != "text")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, tokens, length in word_values(column(batch, "text"), SPACED, lower=True):
                values, code = distinct(tokens)
                at = pc.index_in(values, value_set=hot_word).fill_null(len(hot_word)).to_numpy(zero_copy_only=False)
                place = at[code]
                known, base, value = (row_sums(hot_value[c][place], length) for c in ("known", "base", "log10_p"))
                rare = np.flatnonzero(place == len(hot_word))
                doc = np.repeat(np.arange(len(rows)), length)
                pair, times = np.unique(doc[rare] * max(1, len(values)) + code[rare], return_counts=True)
                owner = np.bincount(pair // max(1, len(values)), minlength=len(rows))
                part = batch.slice(int(rows[0]), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(part, c) for c in ["_row", *kept]),
                        pa.array(length + 1),
                        pa.array(known + end[0]),
                        pa.array(base + end[1]),
                        pa.array(value + end[2]),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, np.cumsum(owner)).astype(np.int32)),
                            values.take(pa.array(pair % max(1, len(values)))).cast(pa.string()),
                        ),
                        lists(times.astype(np.int32), owner),
                    ],
                    ["_row", *kept, *parts],
                )

    parts = ["n_tokens", "n_known", "base_score", "score", "_words", "_times"]
    schema = docs.select(F.lit(0).cast("long").alias("_row"), *kept).schema
    for name, kind in zip(parts, ("long", "long", "double", "double", T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())), strict=True):
        schema = schema.add(name, kind)
    # numbered as they are written: a row keeps its number in what follows
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *docs.columns)
    scanned = materialise(numbered.mapInArrow(scan, schema))
    rare = scanned.where(F.size("_words") > 0).select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("w"))
    rated = score_words(words.where(F.col("n_all") < least), subwords, log_p, counts)
    rest = (
        rare.select("_row", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
        .join(rated, "word")
        .groupBy("_row")
        .agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("known", "base", "log10_p")))
    )
    whole = scanned.drop("_words", "_times").join(rest, "_row", "left")
    whole = whole.withColumns(
        {
            "held_out": F.col("_held"),
            "n_known": F.col("n_known") + F.coalesce("known", F.lit(0)),
            "train_tokens": F.lit(counts.tokens).cast("long"),
            "base_score": F.col("base_score") + F.coalesce("base", F.lit(0.0)),
            "score": F.col("score") + F.coalesce("log10_p", F.lit(0.0)),
        }
    )
    names = {n: c for n, c in names.items() if n not in ("_held", "_learns") and n in kept}
    return restored(whole, names, *ADDED)
