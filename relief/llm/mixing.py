"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they
belong to. Words flow from patterns to sources: a pattern offers its words once
at no cost, a second time at cost 1, a third time at cost 3, and so on, so that
repeating is convex in cost; each source takes up to its quota. As costs sit on
the patterns' own arcs alone, the cheapest flow is found by filling one
repetition of all patterns after the other, each by augmenting paths. Patterns
that share no source are solved apart.

A pattern's flow is then dealt to its documents: all of them whole as often as
it goes, and the rest to the first documents in a seeded order, the last of them
in part. The order's cut is found by counting (hash digits of all documents,
then those of the digit that holds the cut), so nothing is sorted as a whole.
Only the table of patterns and sources, a catalogue, reaches the driver.

Defined results: null texts have size 0 and take nothing; a null source is a
source of its own and sorts last; a document without sources takes nothing;
rows with the same id are one place in the order and share its words evenly;
an empty table gives an empty result. Other columns stay, but for those of the
names that are added.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from relief.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3


@dataclass
class Mix:
    """Sources with size, weight, target and words taken; patterns with their flow."""

    sources: list[dict]
    patterns: list[dict]


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Share the sum of the sizes by weight, none above `repeats` times its size."""
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    target = [0.0] * len(sizes)
    for i in order:
        level = left / weight
        target[i] = min(float(repeats * sizes[i]), level * weights[i])
        if target[i] < repeats * sizes[i]:  # from here on all lie below their cap
            for j in order[order.index(i) :]:
                target[j] = level * weights[j]
            break
        left -= repeats * sizes[i]
        weight -= weights[i]
    return target


def _parts(patterns: list[tuple[tuple, int]]) -> list[tuple[list[int], set]]:
    """Patterns linked by common sources."""
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for names, _ in patterns:
        for name in names[1:]:
            parent[top(name)] = top(names[0])
    parts: dict = defaultdict(lambda: ([], set()))
    for k, (names, _) in enumerate(patterns):
        if names:
            parts[top(names[0])][0].append(k)
            parts[top(names[0])][1].update(names)
    return list(parts.values())


def flow(patterns: list[tuple[tuple, int]], quota: dict, repeats: int = REPEATS) -> dict:
    """Cheapest largest flow: words of pattern k that go to a source, by (k, source)."""
    sent: dict = defaultdict(int)
    for members, names in _parts(patterns):
        need = {s: quota.get(s, 0) for s in names}
        holders = defaultdict(list)
        for k in members:
            for s in patterns[k][0]:
                holders[s].append(k)
        for _ in range(repeats):
            spare = {k: patterns[k][1] for k in members}
            while True:
                # shortest path: pattern with spare words -> source ( -> pattern that gives way -> source )*
                came = {("p", k): None for k in members if spare[k] > 0}
                queue, found = deque(came), None
                while queue and found is None:
                    kind, x = here = queue.popleft()
                    if kind == "p":
                        for s in patterns[x][0]:
                            if ("s", s) not in came:
                                came["s", s] = here
                                if need[s] > 0:
                                    found = ("s", s)
                                    break
                                queue.append(("s", s))
                    else:
                        for k in holders[x]:
                            if sent[k, x] > 0 and ("p", k) not in came:
                                came["p", k] = here
                                queue.append(("p", k))
                if found is None:
                    break
                path = [found]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(spare[path[0][1]], need[found[1]])
                for i in range(1, len(path) - 1, 2):  # source that gives up words of the next pattern
                    amount = min(amount, sent[path[i + 1][1], path[i][1]])
                for i in range(0, len(path) - 1, 2):
                    sent[path[i][1], path[i + 1][1]] += amount
                    if i:
                        sent[path[i][1], path[i - 1][1]] -= amount
                spare[path[0][1]] -= amount
                need[found[1]] -= amount
    return sent


def _ordered(docs: DataFrame, members: Column, size: Column, seed: int, doc_id: str) -> DataFrame:
    """Each document as `_row` with its pattern, size and place in the seeded order."""
    return docs.select(
        F.struct("*").alias("_row"),
        F.array_sort(F.array_distinct(members)).alias("_members"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("_order"),
    ).withColumn("_pattern", F.to_json("_members", {"ignoreNullFields": "false"}))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The place in each pattern's order at which the rest of its words is used up.

    Returns (_pattern, _cut, _part): documents before `_cut` are taken once more,
    those at `_cut` take `_part` words each.
    """
    found = plan.where("_rest > 0").select("_pattern", F.col("_rest").alias("_left"), F.lit("").alias("_cut"))
    digits = 0
    for step in (3, 3, None):
        key = F.substring("_order", 1, digits + step) if step else F.col("_order")
        near = rows.join(found, "_pattern").where(F.substring("_order", 1, digits) == F.col("_cut") if digits else F.lit(True))
        sums = near.groupBy("_pattern", "_left", key.alias("_key")).agg(F.sum("_size").alias("_s"), F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_s").over(Window.partitionBy("_pattern").orderBy("_key"))
        # the first key whose running sum passes what is left
        found = (
            sums.withColumn("_upto", upto)
            .where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_s") <= F.col("_left")))
            .groupBy("_pattern")
            .agg(F.min(F.struct("_key", (F.col("_left") - F.col("_upto") + F.col("_s")).alias("left"), "_n")).alias("_f"))
            .select("_pattern", F.col("_f.left").alias("_left"), F.col("_f._key").alias("_cut"), F.col("_f._n").alias("_n"))
        )
        found = materialise(found)
        digits += step or 0
        if step is None:
            return found.select("_pattern", "_cut", F.expr("_left div _n").alias("_part"))
        found = found.drop("_n")
    raise AssertionError


def mix(
    docs: DataFrame,
    members: Column,
    size: Column | None = None,
    weights: tuple = WEIGHTS,
    seed: int = 1,
    repeats: int = REPEATS,
    doc_id: str = "doc_id",
) -> tuple[DataFrame, Mix]:
    """Deal words to documents so that each source takes its target.

    `members` is an array of source names for each document, `size` its words.
    Sources in code-point order, null last, weigh `weights` in turn; their
    targets share the sum of the sizes of all documents. Returns the documents
    with size, full (times taken whole) and taken (words), and the plan.
    """
    spark = docs.sparkSession
    size = word_count() if size is None else size
    docs = docs.drop("size", "full", "taken")
    narrow = materialise(
        _ordered(docs, members, size, seed, doc_id).select("_pattern", "_members", "_size", "_order")
    )
    table = narrow.groupBy("_pattern").agg(F.first("_members").alias("m"), F.sum("_size").alias("s")).collect()
    table = sorted((r for r in table if r["m"]), key=lambda r: r["_pattern"])
    patterns = [(tuple(r["m"]), r["s"]) for r in table]
    held: dict = defaultdict(int)
    for names, words in patterns:
        for name in names:
            held[name] += words
    names = sorted((s for s in held if s is not None), key=lambda s: s.encode()) + [None] * (None in held)
    wanted = fill([held[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], repeats) if sum(held.values()) else [0.0] * len(names)
    sent = flow(patterns, {s: int(t + 0.5) for s, t in zip(names, wanted, strict=True)}, repeats)
    gone: dict = defaultdict(int)
    got: dict = defaultdict(int)
    for (k, s), words in sent.items():
        gone[k] += words
        got[s] += words
    # written, so that Spark knows how small it is and need not shuffle the documents to meet it
    plan = materialise(spark.createDataFrame(
        [(r["_pattern"], gone[k] // max(1, r["s"]), gone[k] % max(1, r["s"])) for k, r in enumerate(table)],
        "_pattern string, _full long, _rest long",
    ))
    cuts = _cuts(narrow, plan)
    chosen = plan.join(cuts, "_pattern", "left")
    once_more = (
        F.when(F.col("_order") < F.col("_cut"), F.col("_size"))
        .when(F.col("_order") == F.col("_cut"), F.least("_size", "_part"))
        .otherwise(F.lit(0))
    )
    full = F.coalesce(F.col("_full"), F.lit(0))
    out = (
        _ordered(docs, members, size, seed, doc_id)
        .join(chosen, "_pattern", "left")
        .select(
            "_row.*",
            F.col("_size").alias("size"),
            full.alias("full"),
            (full * F.col("_size") + once_more).cast("long").alias("taken"),
        )
    )
    sources = [
        {"source": s, "size": held[s], "weight": weights[i % len(weights)], "target": float(wanted[i]), "taken": got[s]}
        for i, s in enumerate(names)
    ]
    return out, Mix(sources, [{"members": p[0], "size": p[1], "taken": gone[k]} for k, p in enumerate(patterns)])


SOURCES = T.StructType(
    [
        T.StructField("_source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
    ]
)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Mix documents of one `source` each; adds size, source_size, target, full and taken."""
    docs = docs.drop("source_size", "target")
    mixed, plan = mix(docs, F.array(F.col("source").cast("string")), **options)
    rows = [(s["source"], s["size"], s["target"]) for s in plan.sources]
    sources = materialise(docs.sparkSession.createDataFrame(rows, SOURCES))
    same = mixed["source"].cast("string").eqNullSafe(sources["_source"])
    return mixed.join(sources, same, "left").drop(sources["_source"])
