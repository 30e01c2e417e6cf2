"""Toxicity, URL filter, license scan, nearest neighbours and mixing."""

import random
import zlib

import numpy as np
import pytest
from helpers import prose, table
from pyspark.sql import functions as F
from relief.llm import licenses, mixing, neighbours, toxicity, urls


# toxicity


def labelled(spark, count=400):
    rng = random.Random(6)
    rude = ["vilewort", "scumbrel", "loathly"]
    docs, labels = [], []
    for k in range(count):
        words = prose(k, 60, 50)
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(rude).title() + "!"
        docs.append((k, " ".join(words), f"s{k % 3}"))
        labels.append((k, int(toxic)))
    return table(spark, docs), table(spark, labels, "doc_id long, toxic int")


def test_classifier_tells_held_out_documents_apart(spark):
    docs, labels = labelled(spark)
    scored = toxicity.classify(docs.withColumn("held_out", toxicity.is_held_out("doc_id")), labels)
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # held-out labels play no part
    others = labels.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.classify(docs, others.repartition(3)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_identity_swaps_lower_the_gap_between_groups():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts, toxic = [], []
    for k in range(600):
        bad = rng.random() < 0.4
        words = prose(k, 20, 30)
        # one group is named far oftener in toxic texts
        if rng.random() < (0.7 if bad else 0.1):
            words.append("woman")
        elif rng.random() < 0.3:
            words.append("man")
        if bad and rng.random() < 0.8:
            words.append("vilewort")
        texts.append(" ".join(words))
        toxic.append(float(bad))
    hashes = []
    for piece in toxicity.split_words(pa.array(texts), toxicity.ALNUM, lower=True):
        hashes += [np.unique(toxicity.short(piece.word)[a:b]) for a, b in zip(piece.first[:-1], piece.first[1:], strict=True)]
    counts = np.array([len(h) for h in hashes])
    plain = toxicity.fit(np.array(toxic), np.concatenate(hashes), counts, swap_penalty=0.0)
    fair = toxicity.fit(np.array(toxic), np.concatenate(hashes), counts, swap_penalty=20.0)
    neutral = pa.array(["a woman reads", "a man reads", "a vilewort reads"])
    gap = lambda m: abs(np.subtract(*m.log_odds(neutral)[:2]))
    assert gap(plain) > 1 and gap(fair) < 0.25 * gap(plain)
    assert fair.log_odds(neutral)[2] > fair.log_odds(neutral)[0] + 1


def test_odd_rows_of_toxicity(spark, odd, empty):
    docs, labels = labelled(spark, 60)
    mixed = docs.unionByName(odd.select("doc_id", "text", "source"))
    marks = labels.unionByName(table(spark, [(1, 1), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert toxicity.classify(mixed, marks).count() == 60 + odd.count()
    out = toxicity.drop_toxic(odd, labels.limit(0))
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(r.score == pytest.approx(0.25) for r in toxicity.classify(odd, labels.limit(0)).collect())
    assert toxicity.classify(empty, labels).count() == 0


# URLs


def brute_rule(host, path):
    best = None
    for verdict, name, start in urls.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            if best is None or len(name + start) > len(best[1]):
                best = (verdict, name + start)
    return best


def test_rules_hosts_and_paths(spark):
    given = [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1"),
        ("https://example.org/en/12?x", "example.org", "/en/12"),
        ("https://notexample.org/en/12", "notexample.org", "/en/12"),
        ("http://x.org", "x.org", ""),
        ("ftp://x.com/fr/#a", "x.com", "/fr/"),
        ("a://b://c/d", "b:", "//c/d"),
        ("http://x.com?/de/", "x.com", ""),
        ("x.org/nothing", "", ""),
        ("", "", ""),
        (None, "", ""),
        ("http://ÄB.com/de/\nline", "Äb.com", "/de/\nline"),
    ]
    df = table(spark, [(k, u) for k, (u, _, _) in enumerate(given)] * 2, "page_id long, url string")
    rows = urls.judge(df).collect()
    assert len(rows) == 2 * len(given)
    for r in rows:
        url, host, path = given[r.page_id]
        best = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), url
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).collect() == []


def test_models_follow_the_rules_taste(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        good = k % 2
        word = "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(12))
        end = rng.choice(["org", "net"]) if good else rng.choice(["com/de", "net"])
        rows.append((k, f"http://{word}.{end}/{word}"))
    out = urls.judge(table(spark, rows, "page_id long, url string")).collect()
    free = [r for r in out if r.rule is None]
    assert len(free) > 80 and sum((r.verdict == "allow") == bool(r.page_id % 2) for r in free) >= 0.97 * len(free)


# licenses


def test_license_places_and_notices(spark):
    long_text = "word " * 40_000 + "Apache License, Version 2.0"
    given = {
        1: ("Released under the MIT License. MIT-license again", 2, 3, 5, "mit", "mit"),
        2: ("the GNU General Public\nLicense", 1, 2, 2, "gpl", "gpl"),
        3: ("licensed under CC BY-NC 4.0", 0, None, None, "", "cc-by-nc"),
        4: ("mit and a license", 0, None, None, "", ""),
        5: (None, 0, None, None, "", ""),
        6: ("", 0, None, None, "", ""),
        7: (long_text, 1, 40_000, 40_000, "apache", "apache"),
        8: ("MITlicense émit license mit Licensé", 0, None, None, "", ""),
    }
    df = table(spark, [(k, v[0], "a") for k, v in given.items()] + [(1, given[1][0], "b")])
    rows = licenses.scan(df).collect()
    assert len(rows) == 9
    for r in rows:
        text, places, first, last, base, labels = given[r.doc_id]
        spots = [s.word for s in r.spots]
        assert len(spots) == places and (min(spots, default=None), max(spots, default=None)) == (first, last)
        assert (r.base_labels, r.labels) == (base, labels) and 0 <= r.score <= 1
    assert licenses.scan(df.limit(0)).collect() == []


def test_odd_rows_of_license_scan(odd):
    out = licenses.scan(odd, keep=("doc_id", "score", "hits") if "hits" in odd.columns else ("doc_id",))
    assert out.count() == odd.count()


# nearest neighbours


def test_neighbours_reach_their_recall_and_scores_are_exact(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[299] *= 5
    x[300:700] = x[299]  # one vector, very often, and the longest
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, leaf_rows=50).collect()
    exact = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(r.score == pytest.approx(float(score[r.vec_id]), rel=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        kth = np.sort(score)[-10]
        hits += sum(r.score >= kth - 1e-12 for r in rows)
        if 300 <= q < 700:  # ties go to the smaller ids
            assert [r.vec_id for r in rows] == [k for k in range(299, 311) if k != q][:10]
    assert hits >= 0.9 * 10 * 75


def test_outliers_in_small_leaves_get_all_their_neighbours(spark):
    rng = np.random.default_rng(11)
    x = np.tile(rng.normal(size=16), (600, 1))
    x[:100:5] = 3 * rng.normal(size=(20, 16))  # outliers, each in a leaf of few rows
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, leaf_rows=20).collect()
    ranks = {q: sorted(r["rank"] for r in found if r.query_id == q) for q in range(0, 600, 20)}
    assert all(r == list(range(1, 21)) for r in ranks.values())
    assert len({(r.query_id, r.vec_id) for r in found}) == len(found) and all(r.query_id != r.vec_id for r in found)


def test_odd_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    out = neighbours.search(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [
        (20, 1, 1, 0.5),
        (20, 2, 9, -1.0),
    ]
    assert neighbours.search(df.where("vec_id = 2"), F.lit(True)).collect() == []
    assert neighbours.search(df.limit(0), F.lit(True)).collect() == []


# mixing


def test_targets_fill_by_weight_up_to_their_cap():
    assert mixing.fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.fill([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.fill([0, 9], [5, 2]) == [0.0, 9.0]


def cheapest(patterns, quota, repeats):
    """Min-cost flow by trying cost levels with a plain max-flow for each."""
    names = sorted(quota)
    best = None
    level = [0, 1, 3]

    def max_flow(caps):
        flow = 0
        graph = {("S", ("p", k)): c for k, c in enumerate(caps)}
        for k, (names_, _) in enumerate(patterns):
            for s in names_:
                graph[("p", k), ("s", s)] = 10**9
        for s in names:
            graph[("s", s), "T"] = quota[s]
        while True:
            came, queue = {"S": None}, ["S"]
            while queue and "T" not in came:
                u = queue.pop(0)
                for (a, b), c in list(graph.items()):
                    if a == u and c > 0 and b not in came:
                        came[b] = u
                        queue.append(b)
            if "T" not in came:
                return flow
            path, u = [], "T"
            while came[u] is not None:
                path.append((came[u], u))
                u = came[u]
            step = min(graph[e] for e in path)
            for a, b in path:
                graph[a, b] -= step
                graph[b, a] = graph.get((b, a), 0) + step
            flow += step

    total, cost, before = 0, 0, 0
    for r in range(1, repeats + 1):
        total = max_flow([r * w for _, w in patterns])
        cost += level[r - 1] * (total - before)
        before = total
    best = (total, cost)
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(4)
    for _ in range(25):
        sources = "abcd"[: rng.randrange(2, 5)]
        patterns = [
            (tuple(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1)))), rng.randrange(0, 30)) for _ in range(rng.randrange(1, 6))
        ]
        quota = {s: rng.randrange(0, 60) for s in sources}
        sent = mixing.flow(patterns, quota)
        assert all(v >= 0 and s in patterns[k][0] for (k, s), v in sent.items())
        gone = [sum(v for (k, _), v in sent.items() if k == i) for i in range(len(patterns))]
        got = {s: sum(v for (_, t), v in sent.items() if t == s) for s in sources}
        assert all(got[s] <= quota[s] for s in sources) and all(g <= 3 * w for g, (_, w) in zip(gone, patterns, strict=True))
        cost = sum(min(g, w) * 0 + max(0, min(g, 2 * w) - w) + 3 * max(0, g - 2 * w) for g, (_, w) in zip(gone, patterns, strict=True))
        assert (sum(gone), cost) == cheapest(patterns, quota, 3)


def test_documents_give_their_sources_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(prose(k, rng.randrange(1, 80))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(300)]
    rows.append((300, None, "a"))
    out = mixing.mix_sources(table(spark, rows).repartition(7)).collect()
    assert [r.size for r in sorted(out, key=lambda r: r.doc_id)] == [len((t or "").split()) for _, t, _ in rows]
    for source in ("a", "b", "c", None):
        own = [r for r in out if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target + 0.5)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    again = mixing.mix_sources(table(spark, rows).repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_overlapping_sources_share_documents(spark):
    rows = [(k, " ".join(prose(k, 10)), ["x"] if k < 20 else (["x", "y"] if k < 40 else ["y", None])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    out, plan = mixing.mix(df, F.col("tags"))
    by = {s["source"]: s for s in plan.sources}
    assert list(by) == ["x", "y", None] and (by["x"]["size"], by["y"]["size"], by[None]["size"]) == (400, 400, 200)
    assert sum(r.taken for r in out.collect()) == sum(p["taken"] for p in plan.patterns) == sum(s["taken"] for s in plan.sources)


def test_odd_rows_of_mixing(odd, empty):
    out = mixing.mix_sources(odd)
    assert set(odd.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert all(r["_pattern"] == "own _pattern" and r["_row"] == "own _row" and r["_source"] == "own _source" for r in rows)
    assert mixing.mix_sources(empty).collect() == []
