"""Source divergence against exact sums over every kept term and pair of sources."""

import re
from collections import Counter, defaultdict

import helpers
import pytest

from relief.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def direct(rows, least=3, top=200):
    """Result rows of (text, lang, source) by plain loops over Python integers."""
    terms = [(lang or "", source or "", [w.lower() for w in WORD.findall((text or "").encode())]) for text, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        groups[lang].add(source)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        held = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(held[s][t] for s in sources) for t in kept}

        def shares(count, kept=kept):
            size = sum(count.values()) + len(kept)
            return {t: 1 + 10**9 * (n + 1) // size for t, n in count.items()}

        p, q = {s: shares(held[s]) for s in sources}, shares(whole)

        def f(x, y):
            return (x - y) ** 2 // y

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), "pair") for o in sources if o != s]
            found = [(-f(p[s][t], q[t]), t, "term") for t in kept if held[s][t] and p[s][t] > q[t]]
            for part in (sorted(pairs), sorted(found)[:top]):
                out += [(lang, s, kind, item.decode(), -value, k + 1) for k, (value, item, kind) in enumerate(part)]
    return sorted(out)


def rows_of(seed: int, count: int):
    import random

    rng = random.Random(seed)
    words = [*"the of and Straße É été 漢字 a B c1d e_f".split(), *(f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(25))]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for k in range(count):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))
        # one source has half of all rows
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b", "B", None, "ä"])))
    return [*rows, (900, None, "en", "none"), (901, "", "xx", "only"), (902, "12 34", "xx", "other"), rows[0], rows[0]]


@pytest.mark.parametrize("bits", [64, 5])
@pytest.mark.parametrize("top", [200, 4])
def test_audit_matches_loops(spark, bits, top):
    rows = rows_of(3, 300)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, top=top, bits=bits).collect())
    assert got == direct([r[1:] for r in rows], top=top)


def test_small_runs_of_pairs(spark, monkeypatch):
    rows = rows_of(4, 120)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = direct([r[1:] for r in rows])
    monkeypatch.setattr(divergence, "PAIRS", 7)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want


def test_odd_rows_of_audit(spark, odd, empty):
    from pyspark.sql import functions as F

    docs = odd.withColumn("lang", F.lit("en"))
    want = direct([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want
    assert divergence.audit(empty.withColumn("lang", F.lit("en"))).count() == 0
    assert helpers.SCHEMA
