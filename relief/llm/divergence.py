"""Source divergence audit: how far the term shares of sources lie apart, in exact numbers.

Terms travel as 64-bit digests: what is shuffled to count them is a group
number, a digest and counts. Beside that, each digest's least and greatest term
are found once; where the two differ, several terms share the digest, and only
these terms are counted again by their text. Texts are joined back to the terms
that are returned and to ties with the last of them, to no others.

Each language keeps the V terms that stand in at least `least` of its documents.
A group is a language and source, or a whole language; with N occurrences of
kept terms it gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V)).
f = floor((p - q)^2 / q) compares a group's p with q of another source (part
`pair`, summed over all kept terms) or of the whole language (part `term`, for
terms the group holds and favours, the `top` largest).

Sums over pairs never spell out terms that a source lacks. With p0 and q0 the
share of an absent term, the sum over all terms is

    sum of f(p, q0) over the terms of one + sum of f(p0, q) over those of the other
    + (V - terms of one - terms of the other) f(p0, q0)
    + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first two are read from how many terms of a group have each count; the last
is added up in tasks over the terms' source lists, a number for each pair of
sources and task.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are
lower-cased. Defined results: null text, lang and source are ''; a group without
terms still has its pairs; repeated rows are documents of their own; a language
without kept terms has pairs of 0; an empty table gives an empty result. Other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from relief.llm.common import WORDS_BYTES, column, distinct, letters_of, mix, numbers, packed, signed, text_bytes, word_values
from relief.session import materialise

LEAST, TOP = 3, 200
SCALE = 1_000_000_000
PAIRS = 1 << 20  # pairs of sources that a task adds up at once
TERM_BYTES = letters_of(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122)
_DIGEST = (numbers(256, 41) | np.uint64(1), 42)


def digests(values: pa.Array, bits: int = 64) -> np.ndarray:
    """A number of so many bits for each binary value, none of them empty."""
    data, at = text_bytes(values.cast(pa.string()))
    length = np.diff(at)
    if not len(length):
        return np.empty(0, dtype=np.uint64)
    letters, seed = _DIGEST
    scale = numbers(int(length.max()), seed) | np.uint64(1)
    begin = at[:-1] - at[0]
    with np.errstate(over="ignore"):
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        terms = letters[data[at[0] : at[-1]]] * scale[place]
        return mix(np.add.reduceat(terms, begin) + length.astype(np.uint64)) >> np.uint64(64 - bits)


def _terms(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, digests, groups, code, counts): distinct terms of a run of documents, the group and term of each word."""
    groups = column(batch, "group").to_numpy()
    for rows, words, counts in word_values(column(batch, "text"), TERM_BYTES, lower=True, limit=2 * WORDS_BYTES):
        values, code = distinct(words)
        yield values, digests(values, bits), groups[rows], code, counts


def count_digests(docs: DataFrame, bits: int) -> DataFrame:
    """(group, digest, n, d): occurrences and documents of each digest in each group; `docs` has group and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, digest, groups, code, counts in _terms(batch, bits):
                size = max(1, len(values))
                # equal digests of a document are one, whatever their terms
                kinds, code = (lambda k: (k[0], k[1][code]))(np.unique(digest, return_inverse=True))
                doc = np.repeat(np.arange(len(groups)), counts)
                per_doc, n = np.unique(doc * size + code, return_counts=True)
                names, number = np.unique(groups, return_inverse=True)
                key, at, d = np.unique(number[per_doc // size] * size + per_doc % size, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[key // size]),
                        pa.array(signed(kinds[key % size])),
                        pa.array(np.bincount(at, n, minlength=len(key)).astype(np.int64)),
                        pa.array(d),
                    ],
                    ["group", "digest", "n", "d"],
                )

    found = docs.mapInArrow(count, "group int, digest long, n long, d long")
    return found.groupBy("group", "digest").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def dictionary(docs: DataFrame, bits: int) -> DataFrame:
    """(digest, word, other): each digest's least term, and its greatest where that is another."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, digest, *_ in _terms(batch, bits):
                yield pa.RecordBatch.from_arrays([pa.array(signed(digest)), values.cast(pa.string())], ["digest", "word"])

    found = docs.mapInArrow(spell, "digest long, word string")
    ends = found.groupBy("digest").agg(F.min("word").alias("word"), F.max("word").alias("last"))
    return ends.select("digest", "word", F.when(F.col("word") != F.col("last"), F.col("last")).alias("other"))


def _count_texts(docs: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """(group, digest, word, n, d) of the terms whose digests are shared, by their text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, digest, groups, code, counts in _terms(batch, bits):
                size = max(1, len(values))
                doc = np.repeat(np.arange(len(groups)), counts)
                key, n = np.unique(doc * size + code, return_counts=True)
                term = key % size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(groups[key // size]),
                        pa.array(signed(digest)[term]),
                        values.take(pa.array(term)).cast(pa.string()),
                        pa.array(n),
                    ],
                    ["group", "digest", "word", "n"],
                )

    found = docs.mapInArrow(count, "group int, digest long, word string, n long")
    found = found.join(collided, "digest", "left_semi")
    return found.groupBy("group", "digest", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))


def kept_terms(docs: DataFrame, groups: DataFrame, words: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, digest, word, members, total) of the terms each language keeps; word only where a digest is shared."""
    counted = count_digests(docs, bits).withColumn("word", F.lit(None).cast("string"))
    collided = words.where(F.col("other").isNotNull()).select("digest")
    if not collided.isEmpty():
        collided = materialise(collided)
        alone = counted.join(collided, "digest", "left_anti")
        counted = alone.unionByName(_count_texts(docs, collided, bits))
    found = counted.join(groups.select("group", "lang"), "group")
    return (
        found.groupBy("lang", "digest", "word")
        .agg(
            F.sum("d").alias("d"),
            F.sum("n").alias("total"),
            F.collect_list(F.struct("group", "n")).alias("members"),
        )
        .where(F.col("d") >= least)
        .drop("d")
    )


def share(count, size, terms):
    """p of a term with so many occurrences in a group of `size`, among so many kept terms; null without any."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(1)).cast("decimal(19,0)")
    both = F.when(terms > 0, size + terms).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, both)


def distance(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _common(members: DataFrame) -> DataFrame:
    """(a, b, value): what terms that two groups share add to their sum; `members` are lists of (group, p, p0)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, values = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged() -> None:
            nonlocal pairs, values
            pairs, at = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(sums, at, values)
            values = sums

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(values)],
                ["a", "b", "value"],
            )

        for batch in batches:
            lists = column(batch, "members")
            length = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            group, p, p0 = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            # each member of a term meets all members of it: so many pairs at once, members in runs
            owner = np.repeat(np.arange(len(length)), length)
            first = (np.cumsum(length) - length)[owner]
            reach = np.cumsum(length[owner])
            low = 0
            while low < len(owner):
                high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + PAIRS, side="right")))
                count = length[owner[low:high]]
                x = np.repeat(np.arange(low, high), count)
                begin = np.cumsum(count) - count
                y = np.arange(len(x)) + np.repeat(first[low:high] - begin, count)
                other = group[x] != group[y]
                x, y = x[other], y[other]
                value = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
                pairs = np.concatenate((pairs, group[x] << 32 | group[y]))
                values = np.concatenate((values, value))
                merged()
                if len(pairs) > 4 * PAIRS:
                    yield rows()
                    pairs, values = pairs[:0], values[:0]
                low = high
        yield rows()

    return members.select("members").mapInArrow(add, "a int, b int, value long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents with text, lang and source.

    `bits` is the width of digests; results don't depend on it.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    # one row for each language and source, which is fewer than the pairs that are returned
    names = materialise(plain.select("lang", "source").distinct())
    groups = materialise(names.select(F.row_number().over(Window.orderBy("lang", "source")).alias("group"), "lang", "source"))
    numbered = plain.join(groups, ["lang", "source"]).select("group", "text")
    words = materialise(dictionary(numbered, bits))
    terms = materialise(kept_terms(numbered, groups, words, least, bits))

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    held = terms.select("lang", "digest", "word", "total", F.explode("members").alias("m"))
    held = held.select("lang", "digest", "word", "total", "m.group", "m.n")
    sizes = held.groupBy("group").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"))
    zero = F.lit(0).cast("long")
    stats = groups.join(sizes, "group", "left").join(langs, "lang", "left")
    stats = stats.withColumns({c: F.coalesce(c, zero) for c in ("size", "kinds", "v", "lang_size")})
    stats = materialise(stats.withColumn("p0", share(zero, F.col("size"), F.col("v"))))

    rated = held.join(stats.select("group", "source", "size", "v", "lang_size", "p0"), "group").withColumns(
        {"p": share(F.col("n"), F.col("size"), F.col("v")), "q": share(F.col("total"), F.col("lang_size"), F.col("v"))}
    )
    return _pair_part(rated, stats).unionByName(_term_part(rated, words, top))


def _pair_part(rated: DataFrame, stats: DataFrame) -> DataFrame:
    exact = "decimal(38,0)"
    members = rated.groupBy("lang", "digest", "word").agg(F.collect_list(F.struct("group", "p", "p0")).alias("members"))
    common = _common(members.where(F.size("members") > 1)).withColumn("value", F.col("value").cast(exact))
    # how many terms of a group have each share, against the absent share of the language's other groups
    levels = rated.groupBy("lang", "group", "p").agg(F.count(F.lit(1)).cast(exact).alias("k"))
    mine = stats.select("group", F.col("p0").alias("a0"))
    other = stats.select("lang", F.col("group").alias("b"), F.col("p0").alias("b0"))
    met = levels.join(mine, "group").join(other, "lang").where("group <> b")
    sums = met.groupBy("group", "b").agg(
        F.sum(distance(F.col("p"), F.col("b0")) * F.col("k")).alias("x"),
        F.sum(distance(F.col("b0"), F.col("p")) * F.col("k")).alias("y"),
    )
    single = sums.select(F.col("group").alias("a"), "b", F.col("x").cast(exact).alias("value")).unionByName(
        sums.select(F.col("b").alias("a"), F.col("group").alias("b"), F.col("y").cast(exact).alias("value"))
    )
    one = stats.select("lang", F.col("group").alias("a"), "source", "v", F.col("kinds").alias("ka"), F.col("p0").alias("a0"))
    two = other.join(stats.select(F.col("group").alias("b"), F.col("source").alias("item"), F.col("kinds").alias("kb")), "b")
    pairs = one.join(two, "lang").where("a <> b")
    absent = F.coalesce(distance(F.col("a0"), F.col("b0")), F.lit(0)).cast("decimal(19,0)") * (F.col("v") - F.col("ka") - F.col("kb"))
    base = pairs.select("a", "b", absent.cast(exact).alias("value"))
    found = base.unionByName(single).unionByName(common).groupBy("a", "b").agg(F.sum("value").cast("long").alias("value"))
    named = pairs.select("lang", "source", "a", "b", "item").join(found, ["a", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _term_part(rated: DataFrame, words: DataFrame, top: int) -> DataFrame:
    value = distance(F.col("p"), F.col("q")).alias("value")
    found = rated.where("p > q").select("lang", "source", "digest", F.col("word").alias("own"), value)
    # by value alone, with all that tie with the last; their order needs the texts
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    best = found.withColumn("place", place).where(F.col("place") <= top)
    spelt = best.join(words.select("digest", "word"), "digest").withColumn("item", F.coalesce("own", "word"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
