"""Near-duplicates by BagMinHash signatures over multisets of five-word shingles.

A shingle that occurs w times stands for the weights 0 to w of one unit each.
Its weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), [4,8), ...,
and each interval has a Poisson process in time whose rate is its length; a
point also draws a level within its interval and one of the signature's
components. A document sees the points whose level lies below its weight, and
every component keeps the earliest point that it sees. Two documents agree in a
component with probability equal to their weighted Jaccard similarity, since
both see the same points of a shared shingle. Points are drawn in order of time
and a process stops once it is later than the slowest component, so a document
costs about one draw for each shingle and a few for each component, whatever
the number of components.

Documents with equal multisets form one class at once. Classes meet where a
band of components agrees; in each such bucket members are compared with two
centers, so the number of comparisons grows with the members of a bucket and not
with their pairs. The first center is the member that meets most others in all
its buckets, which in a family of copies is the text they were made from; the
second and those of later rounds are drawn. Each comparison is exact, on the
multisets of 32-bit marks of shingles. Rounds go on for buckets that still hold
several groups, until one finds no link or `rounds` are over. Members of the
buckets that hold several groups even then are joined exactly: two multisets
that are similar enough share an element among the rarest of both, so all such
pairs of different groups are found. Links join groups; a group is named after
its least document.

Words are runs of bytes other than ASCII white space, unchanged. Fewer than five
words form one shingle. Defined results: documents without words are nobody's
duplicates; a missing id sorts last and gives a null group where it is the
least; rows sharing an id are told apart by their text, rows that share id and
text are one document; an empty table gives an empty result. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from relief.llm.common import (
    KEY,
    NO_ID,
    SPACED,
    Piece,
    aside,
    column,
    keyed,
    lists,
    long_values,
    mix,
    numbers,
    restored,
    sequences,
    signed,
    split_words,
)
from relief.operators.components import contract
from relief.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
ROUNDS = 4
PARITIES = 512
LARGE = 64  # members of an unsettled group that has its partners looked up by group


def shingles(piece: Piece, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document, fingerprint, count; sorted."""
    full = sequences(piece.word, size)
    doc = piece.doc()
    inside = doc[: len(full)] == doc[size - 1 :] if len(full) else np.empty(0, bool)
    owner, mark = doc[: len(full)][inside], full[inside]
    short = np.flatnonzero((piece.counts > 0) & (piece.counts < size))
    alone = np.zeros(len(short), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, d in enumerate(short):
            for word in piece.word[piece.first[d] : piece.first[d + 1]]:
                alone[k] = mix(alone[k] * np.uint64(0x9E3779B97F4A7C15) + word)
    owner, mark = np.concatenate((owner, short)), np.concatenate((mark, alone))
    order = np.lexsort((mark, owner))
    owner, mark = owner[order], mark[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
    at = np.flatnonzero(new)
    return owner[at], mark[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, mark: np.ndarray, count: np.ndarray, docs: int, size: int = COMPONENTS) -> np.ndarray:
    """Earliest time of each component of each document; infinite without shingles."""
    best = np.full(docs * size, np.inf)
    # one process for each dyadic interval that reaches below the weight
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    doc = np.repeat(owner, levels)
    weight = np.repeat(count, levels)
    level = np.arange(len(doc)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.where(level > 0, low, 1)
    with np.errstate(over="ignore"):
        seed = mix(np.repeat(mark, levels) + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    time = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        with np.errstate(over="ignore"):
            draw = mix(seed + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            place = mix(draw)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        component = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) * size >> 32
        seen = low + ((place >> np.uint64(32)).astype(np.int64) * length >> 32) < weight
        np.minimum.at(best, (doc * size + component)[seen], time[seen])
        # a process later than all components of its document can change nothing more
        active, back = np.unique(doc, return_inverse=True)
        slowest = best.reshape(docs, size)[active].max(axis=1)
        go = time < slowest[back]
        doc, weight, low, length, seed, time = doc[go], weight[go], low[go], length[go], seed[go], time[go]
    return best.reshape(docs, size)


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One fingerprint for each band of each document."""
    values = best.view(np.uint64).reshape(len(best), bands, rows)
    scale = numbers(rows, 21) | np.uint64(1)
    with np.errstate(over="ignore"):
        return mix((mix(values) * scale).sum(axis=2, dtype=np.uint64) + numbers(bands, 22))


def _signed_docs(docs: DataFrame) -> DataFrame:
    """(_id, _th, a, b, size, bands) of each document that has words; equal (a, b) is an equal multiset."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = long_values(batch, "_id"), long_values(batch, "_th")
            for piece in split_words(column(batch, "text"), SPACED):
                owner, mark, count = shingles(piece)
                have = np.flatnonzero(piece.counts > 0)
                keys = band_keys(signatures(owner, mark, count, len(piece.rows))[have])
                start = np.searchsorted(owner, have)
                with np.errstate(over="ignore"):
                    of = [mix(mark + count.astype(np.uint64) * k) for k in numbers(2, 23)]
                    whole = [np.add.reduceat(x, start) if len(have) else x[:0] for x in of]
                    size = np.add.reduceat(count, start) if len(have) else count[:0]
                row = piece.rows[have]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row]),
                        pa.array(th[row]),
                        *(pa.array(signed(x)) for x in whole),
                        pa.array(size.astype(np.int64)),
                        lists(signed(keys).reshape(-1), np.full(len(have), BANDS)),
                    ],
                    [*KEY, "a", "b", "size", "bands"],
                )

    return docs.select(*KEY, "text").mapInArrow(sign, "_id long, _th long, a long, b long, size long, bands array<long>")


def _multisets(docs: DataFrame) -> DataFrame:
    """(v, marks): the 32-bit shingle marks of each document, sorted, with repeats."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = long_values(batch, "v")
            for piece in split_words(column(batch, "text"), SPACED):
                owner, mark, count = shingles(piece)
                small = np.repeat((mark >> np.uint64(32)).astype(np.uint32), count)
                edge = np.searchsorted(np.repeat(owner, count), np.arange(len(piece.rows) + 1)) * 4
                data = pa.Array.from_buffers(
                    pa.binary(), len(piece.rows), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(small)]
                )
                yield pa.RecordBatch.from_arrays([pa.array(names[piece.rows]), data], ["v", "marks"])

    return docs.select("v", "text").mapInArrow(cut, "v long, marks binary")


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(x) or not len(y):
        return 0.0
    (u, n), (v, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(u, v), len(u) - 1)
    both = u[at] == v
    shared = int(np.minimum(n[at[both]], m[both]).sum())
    return shared / (len(x) + len(y) - shared)


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) and whether their multisets are that similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = column(batch, "marks"), column(batch, "other")
            good = [
                overlap(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)) >= similarity
                for a, b in zip(left, right, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(good, pa.bool_())], ["x", "y", "good"])

    met = pairs.join(sets.withColumnRenamed("v", "x"), "x")
    met = met.join(sets.select(F.col("v").alias("y"), F.col("marks").alias("other")), "y")
    return met.select("x", "y", "marks", "other").mapInArrow(compare, "x long, y long, good boolean")


def _places(classes: DataFrame) -> DataFrame:
    """(v, size, met, buckets): the buckets of each class that hold others too, and the members of all of them."""
    buckets = classes.select("v", "size", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("bucket"), "v", "size")
    shared = materialise(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    # at most one bucket for each band, so a class is one short row
    return buckets.join(shared, "bucket").groupBy("v", "size").agg(
        F.sum("members").alias("met"), F.collect_list("bucket").alias("buckets")
    )


def _buckets(places: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(bucket, v, size, root, met): members of buckets and the groups they are in."""
    # classes meet their groups before they are told apart by bucket
    found = places.withColumn("target", F.col("v")) if groups is None else places.join(groups, "v", "left")
    return found.select(F.explode("buckets").alias("bucket"), "v", "size", F.coalesce("target", "v").alias("root"), "met")


def _centers(buckets: DataFrame, turn: int) -> DataFrame:
    """(bucket, c): two centers of each bucket that holds several groups."""
    # first the member that meets most others in its buckets: in a family of copies that is the one they were made from
    first = F.col("met") if turn == 0 else F.xxhash64("v", F.lit(turn))
    ends = buckets.groupBy("bucket").agg(
        F.max(F.struct(first.alias("o"), "v", "size", "root")).alias("p"),
        F.min(F.struct(F.xxhash64("v", F.lit(-turn - 1)).alias("o"), "v", "size", "root")).alias("q"),
        F.min("root").alias("r"),
        F.max("root").alias("s"),
    )
    return ends.where("r <> s").select("bucket", F.explode(F.array("p", "q")).alias("c"))


def _met(buckets: DataFrame, ends: DataFrame, similarity: float) -> DataFrame:
    """Members of buckets beside centers of another group: pairs (x, y), x < y."""
    pairs = buckets.join(ends, "bucket").where("root <> c.root")
    pairs = pairs.where(F.least("size", "c.size") >= similarity * F.greatest("size", "c.size"))
    return pairs.select(F.least("v", "c.v").alias("x"), F.greatest("v", "c.v").alias("y")).distinct()


def parity(token: np.ndarray) -> np.ndarray:
    """One bit for each of 512 classes of elements: whether an odd number falls into it.

    Sets whose bits differ in d classes differ in d elements at least.
    """
    odd = np.bincount((mix(token) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _elements(sets: DataFrame) -> DataFrame:
    """(v, size, root, tokens, bits): all elements of a multiset, repeats told apart, and their parity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(column(batch, "marks")):
                mark = np.frombuffer(data.as_buffer(), np.uint32)
                again = np.arange(len(mark)) - np.searchsorted(mark, mark)
                token = mark.astype(np.uint64) << np.uint64(32) | again.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(batch, c).slice(k, 1) for c in ("v", "size", "root", "tag")),
                        lists(signed(token), np.array([len(token)])),
                        lists(parity(token), np.array([PARITIES // 64])),
                    ],
                    ["v", "size", "root", "tag", "tokens", "bits"],
                )

    return sets.select("v", "size", "root", "tag", "marks").mapInArrow(
        cut, "v long, size long, root long, tag long, tokens array<long>, bits array<long>"
    )


def _close_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (x, y), x < y, of different groups that may be that similar.

    Elements are ordered by how many members hold them. Similar multisets x and
    y, x not the larger, share at least `similarity` of y and twice that over one
    plus it of x; so they share an element among as many of their rarest as the
    rest leaves, and one. At the first such element there must be enough left of
    both, and their parities may not differ in more classes than similar sets
    have elements apart: what is not similar hardly leaves the join.
    """
    # partners are looked up by large group, so that members of one never meet each other; small ones are one lot
    many = members.groupBy("root").count().where(F.col("count") >= LARGE).select("root", F.col("root").alias("tag"))
    tagged = members.join(materialise(many), "root", "left").withColumn("tag", F.coalesce("tag", F.lit(0)))
    whole = materialise(_elements(sets.join(tagged, "v")))
    elements = whole.select("v", "size", "root", "tag", F.explode("tokens").alias("token"))
    held = materialise(elements.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    share = (1 - similarity) / (1 + similarity)

    def rarest(share: float):
        return F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1

    # elements of a single member meet nothing, but they come first in the order
    alone = elements.join(held, "token", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("n", "token"))
    rare = alone.withColumn("rank", rank).where((F.col("rank") <= rarest(similarity)) & (F.col("n") > 1))
    rare = materialise(rare.join(whole.select("v", "bits"), "v"))
    groups = materialise(rare.select("token", F.col("tag").alias("other")).distinct())
    left = rare.where(F.col("rank") <= rarest(2 * similarity / (1 + similarity)))
    left = left.join(groups, "token").where("tag <> other or tag = 0").select(
        "token", "other", F.col("v").alias("a"), F.col("size").alias("m"), F.col("root").alias("mine"),
        F.col("rank").alias("i"), F.col("bits").alias("x"),
    )
    left = materialise(left)
    right = rare.select("token", F.col("tag").alias("other"), F.col("v").alias("b"), "size", "root", F.col("rank").alias("j"), "bits")
    size, m = F.col("size"), F.col("m")
    needed = F.ceil((m + size) * (similarity / (1 + similarity)) - 1e-6)
    apart = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("bits")[k])) for k in range(PARITIES // 64)), F.lit(0))
    same = left.withColumnRenamed("token", "t").withColumnRenamed("other", "o")
    met = same.join(
        right,
        (F.col("t") == F.col("token"))
        & (F.col("o") == F.col("other"))
        & (F.col("mine") != F.col("root"))
        & ((m < size) | ((m == size) & (F.col("a") < F.col("b"))))
        & (m >= F.lit(similarity) * size)
        & (F.least(m - F.col("i"), size - F.col("j")) + 1 >= needed)
        & (apart <= (m + size) * share + 1e-6),
    )
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """Group documents: (_id, _th, group_id, group_th, group_size, links).

    The group's least document names it; `links` counts the similar pairs that
    were confirmed for the document's class of equal multisets. Documents without
    words are absent. `docs` holds the key and text.
    """
    marks = materialise(_signed_docs(docs))
    # a class of equal multisets goes on as one vertex, its least document
    classes = marks.groupBy("a", "b", "size").agg(
        F.min(F.struct(*KEY)).alias("m"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")
    )
    classes = materialise(classes.withColumn("v", F.xxhash64("a", "b", "size")))
    places = materialise(_places(classes))
    members = classes.join(places.select("v"), "v", "left_semi").select("v", "m.*")
    sets = materialise(_multisets(docs.dropDuplicates(KEY).join(members, KEY) if _repeats(docs) else docs.join(members, KEY)))
    tried = groups = None
    for turn in range(rounds):
        buckets = _buckets(places, groups)
        # written, as Spark splits a join over a common bucket only between two shuffles
        ends = materialise(_centers(buckets, turn))
        pairs = _met(buckets, ends, similarity)
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        found = materialise(_compared(pairs, sets, similarity))
        tried = found if tried is None else tried.unionByName(found)
        found = found.where("good")
        if turn and found.isEmpty():
            break
        groups = _groups(found, groups)
    else:
        buckets = _buckets(places, groups)
        ends = materialise(_centers(buckets, rounds))
    # members of the buckets that hold several groups
    members = materialise(buckets.join(ends, "bucket", "left_semi").select("v", "size", "root").distinct())
    if not members.isEmpty():
        pairs = _close_pairs(members, sets, similarity).join(tried, ["x", "y"], "left_anti")
        found = materialise(_compared(pairs, sets, similarity))
        tried = tried.unionByName(found)
        found = found.where("good")
        if not found.isEmpty():
            groups = _groups(found, groups)
    links = tried.where("good")
    degree = links.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
    named = (
        classes.select("a", "b", "size", "v", "m", "n")
        .join(groups, "v", "left")
        .join(degree, "v", "left")
        .withColumn("root", F.coalesce("target", "v"))
    )
    named = materialise(named)
    whole = named.groupBy("root").agg(F.min("m").alias("g"), F.sum("n").alias("group_size"))
    classes_of = named.join(whole, "root").select("a", "b", "size", "g", "group_size", F.coalesce("links", F.lit(0)).alias("links"))
    return marks.join(classes_of, ["a", "b", "size"]).select(
        *KEY, F.col("g._id").alias("group_id"), F.col("g._th").alias("group_th"), "group_size", "links"
    )


def _groups(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(v, target): the least vertex of each group for its others, once `links` join the groups there were."""
    if groups is None:
        return _contracted(links)
    ends = [groups.select(F.col("v").alias(k), F.col("target").alias(f"{k}_root")) for k in ("x", "y")]
    edges = links.join(ends[0], "x", "left").join(ends[1], "y", "left")
    edges = edges.select(F.coalesce("x_root", "x").alias("x"), F.coalesce("y_root", "y").alias("y"))
    # only the groups that a link joins are contracted
    joined = _contracted(materialise(edges.distinct()))
    onward = joined.select(F.col("v").alias("target"), F.col("target").alias("further"))
    moved = groups.join(onward, "target", "left").select("v", F.coalesce("further", "target").alias("target"))
    return materialise(moved.unionByName(joined))


def _contracted(links: DataFrame) -> DataFrame:
    edges = links.select(F.lit("").alias("scene_id"), F.col("x").alias("a"), F.col("y").alias("b"))
    return contract(edges).select(F.col("root").alias("v"), "target")


def _repeats(docs: DataFrame) -> bool:
    return docs.where("_th <> 0").limit(1).count() > 0


def groups_of(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, group_id, group_size, links."""
    base = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found = near_duplicates(base.select(*KEY, "text")).dropDuplicates(KEY)
    return base.select("doc_id", *KEY).join(found, KEY, "left").select(
        "doc_id",
        F.coalesce(F.when(F.col("group_id") != NO_ID, F.col("group_id")), F.when(F.col("group_id").isNull(), F.col("doc_id"))).alias("group_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The least document of every group; documents without words all stay."""
    docs, names = aside(docs, "doc_id", "text")
    base = keyed(docs)
    plain = base.select(*KEY, F.col("text").cast("string").alias("text"))
    found = near_duplicates(plain)
    other = found.where("_id <> group_id or _th <> group_th").select(*KEY).distinct()
    kept = base.join(other, KEY, "left_anti")
    if _repeats(plain):
        # rows that share id and text are one document; those without words are not compared
        again = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
        kept = kept.where(again).dropDuplicates(KEY).unionByName(kept.where(~again))
    return restored(kept, names)
