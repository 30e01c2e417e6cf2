"""Near-duplicates and benchmark decontamination."""

import random
from collections import Counter

import numpy as np
from helpers import prose, shingle_counts, table, weighted_jaccard
from relief.llm import bagminhash, decontaminate
from relief.llm.common import mix


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(4)
    for spread in (5, 20, 45):
        x = Counter(rng.integers(0, 60, 500).tolist())
        y = Counter(rng.integers(spread, 60 + spread, 300).tolist())

        def arrays(c):
            keys = np.array(sorted(c))
            return mix(keys.astype(np.uint64) + np.uint64(9)), np.array([c[k] for k in keys])

        (a, n), (b, m) = arrays(x), arrays(y)
        owner = np.repeat([0, 1], [len(a), len(b)])
        best = bagminhash.signatures(owner, np.concatenate((a, b)), np.concatenate((n, m)), 2, 20_000)
        assert np.isfinite(best).all()
        assert abs((best[0] == best[1]).mean() - weighted_jaccard(x, y)) < 0.015


def edited(words, rng, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def test_groups_match_all_pairs(spark):
    rng = random.Random(8)
    docs = {}
    for family in range(6):
        base = prose(family, 200 + 50 * family, 5000)
        for copy in range(rng.randrange(2, 9)):
            docs[len(docs)] = " ".join(edited(base, rng, 0.008 * copy))
        docs[len(docs)] = " ".join(base)
    chorus = prose(77, 12) * 20
    docs[len(docs)] = " ".join(chorus)
    docs[len(docs)] = " ".join(chorus + prose(78, 10))
    for k in range(10):
        docs[len(docs)] = " ".join(prose(900 + k, 150, 5000))
    counts = {k: shingle_counts(t) for k, t in docs.items()}
    group = {k: k for k in docs}
    for x in docs:
        for y in docs:
            if x < y and weighted_jaccard(counts[x], counts[y]) >= 0.8 and group[x] != group[y]:
                low, high = sorted((group[x], group[y]))
                group = {k: low if g == high else g for k, g in group.items()}
    df = table(spark, [(k, t, None) for k, t in docs.items()]).repartition(4)
    got = {r.doc_id: r.group_id for r in bagminhash.groups_of(df).collect()}
    assert got == group and len(set(group.values())) < len(docs) - 12
    left = bagminhash.one_of_each(df)
    assert {r.doc_id for r in left.collect()} == set(group.values()) and left.columns == df.columns


def test_pairs_within_a_family_of_almost_similar_texts_are_linked(spark):
    template = prose(70, 351, 5000)
    docs, want = {}, {}
    for k in range(150):  # any two are 0.78 alike
        pair = k // 2 if k < 60 else None  # and these pairs 0.804
        shared = [f"pair{pair}x{i}" for i in range(6)] if pair is not None else []
        docs[k] = " ".join(template + shared + [f"own{k}x{i}" for i in range(49 - len(shared))])
        want[k] = k - k % 2 if pair is not None else k
    counts = [shingle_counts(docs[k]) for k in (0, 1, 2)]
    assert weighted_jaccard(counts[0], counts[1]) >= 0.8 > weighted_jaccard(counts[0], counts[2]) > 0.77
    df = table(spark, [(k, t, None) for k, t in docs.items()]).repartition(4)
    assert {r.doc_id: r.group_id for r in bagminhash.groups_of(df).collect()} == want


def test_later_links_join_the_groups_there_were(spark, monkeypatch):
    def links(pairs):
        return spark.createDataFrame([(x, y, True) for x, y in pairs], "x long, y long, good boolean")

    contracted = []
    contract = bagminhash.contract
    monkeypatch.setattr(bagminhash, "contract", lambda df: contracted.append(df.count()) or contract(df))
    first = bagminhash._groups(links([(5, 6), (6, 7), (8, 9), (1, 2), (20, 30)]), None)
    groups = bagminhash._groups(links([(7, 9), (6, 8), (2, 40)]), first)
    want = {6: 5, 7: 5, 8: 5, 9: 5, 2: 1, 40: 1, 30: 20}
    assert {r.v: r.target for r in groups.collect()} == want and groups.count() == len(want)
    # the second time only what new links join: 5 with 8 once, and 1 with 40
    assert contracted == [5, 2]
    same = bagminhash._groups(links([]), groups)
    assert {r.v: r.target for r in same.collect()} == want


def test_near_dedup_writes_each_table_once(spark, monkeypatch):
    written = []
    for module in (bagminhash, bagminhash.contract.__globals__):
        owner = module if isinstance(module, dict) else vars(module)
        monkeypatch.setitem(owner, "materialise", lambda df, write=owner["materialise"]: written.append(1) or write(df))
    base = prose(31, 200, 5000)
    docs = [(k, " ".join(base[: 200 - k]), None) for k in range(8)] + [(9, " ".join(prose(32, 90, 5000)), None)]
    groups = {r.doc_id: r.group_id for r in bagminhash.groups_of(table(spark, docs)).collect()}
    assert groups == {k: 0 for k in range(8)} | {9: 9}
    # five before the rounds, two for each of two turns, one or two for the groups, members, names
    assert len(written) <= 13


def test_odd_rows_of_near_dedup(odd, empty):
    rows = bagminhash.groups_of(odd).collect()
    assert len(rows) == odd.count()
    named = {r.doc_id: r.group_id for r in rows if r.doc_id is not None}
    assert named[2] == 1 and named[8] == 7 and named[3] == 3 and named[4] == 4 and named[6] == 6 and named[10] == 10
    left = bagminhash.one_of_each(odd)
    assert set(left.columns) == set(odd.columns)
    ids = [r.doc_id for r in left.collect()]
    # null and blank texts stay, the repeated row and its copies leave one
    assert ids.count(1) == 1 and 2 not in ids and 8 not in ids and {3, 4, 5, 6, 7, 10} <= set(ids)
    assert ids.count(None) == 1
    assert bagminhash.groups_of(empty).collect() == [] and bagminhash.one_of_each(empty).collect() == []


def smith_waterman(item, text):
    """The textbook table, for the best score."""
    best, row = 0, [0] * (len(text) + 1)
    for word in item:
        new = [0]
        for j, other in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if word == other else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_score_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64)
        score, begin, end = decontaminate.align(item, text)
        assert score == smith_waterman(item.tolist(), text.tolist())
        if score:
            assert smith_waterman(item.tolist(), text[begin:end].tolist()) == score


def test_copies_and_edited_copies_are_found(spark):
    rng = random.Random(1)
    items = {k: prose(3000 + k, 36, 3000) for k in range(20)}
    docs, want = {}, set()
    for k in range(60):
        words = prose(5000 + k, 200, 3000)
        if k % 3 == 0:
            item = items[k % 20]
            if k % 2:  # every sixth word replaced, one dropped, one added
                item = [w if i % 6 else f"q{i}" for i, w in enumerate(item)]
                del item[10]
                item.insert(20, "added")
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
            want.add((k, k % 20))
        docs[k] = " ".join(words)
    df = table(spark, [(k, t, None) for k, t in docs.items()]).repartition(3)
    bench = table(spark, [(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(0.5 <= r.score <= 1 for r in found) and any(r.score == 1 for r in found)
    # blocks of items give the same
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, block=7).collect()} == want
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == set(docs) - {d for d, _ in want}


def test_odd_rows_of_decontamination(spark, odd, empty):
    bench = table(
        spark,
        [(1, " ".join(prose(2, 40))), (1, " ".join(prose(2, 40))), (None, " ".join(prose(1, 30, 100_000))), (2, None), (3, "the of")],
        "item_id long, text string",
    )
    found = decontaminate.contaminated(odd, bench)
    pairs = sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str)
    # two rows of document 1, each with both items 1
    assert pairs.count((1, 1)) == 4 and pairs.count((2, 1)) == 2 and pairs.count((None, 1)) == 2
    assert pairs.count((7, None)) == 1 and pairs.count((8, None)) == 1 and len(pairs) == 10
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 9, 10}
    none = bench.limit(0)
    assert decontaminate.contaminated(odd, none).count() == 0
    assert decontaminate.drop_contaminated(odd, none).count() == odd.count()
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_edited_copies_beside_an_intact_one_are_found(spark):
    item = prose(4000, 36, 3000)
    broken = [w if i % 6 else f"q{i}" for i, w in enumerate(item)]
    docs = {k: prose(4100 + k, 60, 3000) for k in range(9)}
    for k in range(8):  # the trigrams that the edit broke occur in document 0 only
        docs[k][20:20] = broken if k else item
    df = table(spark, [(k, " ".join(t), None) for k, t in docs.items()])
    bench = table(spark, [(1, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    assert {r.doc_id for r in found} == set(range(8)) and {r.doc_id for r in found if r.score == 1} == {0}


def test_meetings_in_parts_are_all_meetings(monkeypatch):
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 4, 30).astype(np.uint64) for _ in range(9)]
    gram, item, place = decontaminate._grams(words, 3)
    order = np.argsort(gram, kind="stable")
    unique, first = np.unique(gram[order], return_index=True)
    seeds = decontaminate.Seeds(unique, np.append(first, len(order)), item[order], place[order], list(range(9)), words, [])
    at = np.arange(200)
    which, doc = rng.integers(0, len(unique), 200), np.sort(rng.integers(0, 6, 200))
    want = sorted((a, e) for a in at for e in range(seeds.first[which[a]], seeds.first[which[a] + 1]))
    for limit in (1, 50, 400, 1 << 20):
        monkeypatch.setattr(decontaminate, "AT_ONCE", limit)
        met, pairs = [], set()
        for a, e in seeds.meetings(at, which, doc):
            met += zip(a.tolist(), e.tolist(), strict=True)
            own = set(zip(doc[a].tolist(), seeds.item[e].tolist(), strict=True))
            assert not own & pairs
            pairs |= own
        assert sorted(met) == want


def test_short_items_are_found_whole(spark):
    docs = {
        1: "Ask: what is the capital of France? Then go on.",
        2: "what is the capital of Spain",
        3: "what is the capital of",
        4: "France yes? France, Yes!",
        5: "of France",
        6: "one two three four five six seven eight nine ten",
    }
    df = table(spark, [(k, t, None) for k, t in docs.items()]).coalesce(1)
    items = [
        (1, "What is the capital of France?"), (2, "what is the capital of France"), (3, "yes"), (4, "?!"),
        (5, "two three four five six seven eight nine"), (6, "one two three four five six seven"),
    ]
    bench = table(spark, items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in decontaminate.contaminated(df, bench).collect())
    assert found == [
        (1, 1, 1, 1, 7), (1, 2, 1, 1, 7), (4, 3, 1, 1, 2), (4, 3, 1, 3, 4), (6, 5, 1, 1, 9), (6, 6, 1, 0, 7),
    ]
    assert decontaminate.contaminated(df, bench.where("item_id = 4")).count() == 0
    assert decontaminate.contaminated(df, bench.where("item_id = 3")).count() == 2
