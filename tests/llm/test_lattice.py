"""Subword lattice likelihood against sums over all spellings, one by one."""

import math
from collections import Counter
from zlib import crc32

import helpers
import numpy as np
import pytest

from relief.llm import lattice
from relief.llm.common import packed


@pytest.fixture(scope="module")
def subwords():
    return lattice.read_subwords()


def spellings(text: bytes, subwords) -> dict[int, list[tuple[int, int]]]:
    """Subwords that start at each byte of a text: (end, number)."""
    edge = dict(zip(subwords.key.tolist(), subwords.child.tolist()))
    out = {}
    for i in range(len(text)):
        node, out[i] = 0, []
        for j in range(i, len(text)):
            node = edge.get(node * 256 + text[j], -1)
            if node < 0:
                break
            if subwords.piece[node] >= 0:
                out[i].append((j + 1, int(subwords.piece[node])))
    return out


def probability(word: str, subwords, p) -> tuple[float, Counter]:
    """Sum over all spellings of a word after one space, and the expected number of each subword."""
    text = b" " + word.encode()
    ways, expected, total = spellings(text, subwords), Counter(), 0.0

    def walk(i, weight, used):
        nonlocal total
        if i == len(text):
            total += weight
            for k in used:
                expected[k] += weight
            return
        for j, k in ways[i]:
            walk(j, weight * p[k], [*used, k])

    walk(0, 1.0, [])
    return total, Counter({k: v / total for k, v in expected.items()})


def test_forward_and_shares_match_all_spellings(subwords):
    words = ["the", "a", "thethe", "Zoë".lower(), "x" * 9, "ingtion,", "läuft", "\x00é"]
    log_p = lattice.first_estimate(subwords)
    p = np.exp(log_p)
    column = packed(np.frombuffer("".join(words).encode(), np.uint8), np.append(0, np.cumsum([len(w.encode()) for w in words])))
    ((low, high, buffer, at),) = lattice.spaced(column)
    lat = lattice.lattice(subwords, subwords.table(), buffer, at)
    value = lattice.forward(lat, log_p)[lat.last]
    got = np.bincount(lat.piece, lattice.shares(lat, log_p), minlength=len(p))
    want = Counter()
    for word, found in zip(words, value, strict=True):
        total, expected = probability(word, subwords, p)
        assert found == pytest.approx(math.log(total), rel=1e-12)
        want.update(expected)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    assert got.sum() == pytest.approx(sum(want.values()))


def direct(rows, subwords, rounds):
    """Scores of (doc_id, text) rows by plain loops."""
    tokens = [(i, (t or "").encode().translate(bytes.maketrans(*[bytes(range(a, a + 26)) for a in (65, 97)])).split()) for i, t in rows]
    learnt = [w for i, w in tokens if i is not None and crc32(str(i).encode()) % 10]
    n, texts = Counter(x for w in learnt for x in w), len(learnt)
    total = sum(n.values()) + texts
    size = len(n) + (texts > 0)
    once, twice = (sum(1 for v in n.values() if v == k) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    log_p = lattice.first_estimate(subwords)
    for _ in range(rounds):
        count = np.full(len(log_p), lattice.SMOOTH)
        for word in n:
            for k, v in probability(word.decode(), subwords, np.exp(log_p))[1].items():
                count[k] += round(v * lattice.UNIT) / lattice.UNIT
        log_p = np.log(count / count.sum())
    p, out = np.exp(log_p), []
    for i, words in tokens:
        base = score = 0.0
        for word in words:
            base += math.log10((n[word] + 0.1) / (total + 0.1 * (size + 1)))
            score += math.log10(
                max(0, n[word] - discount) / total + discount * len(n) / total * probability(word.decode(), subwords, p)[0]
            )
        base += math.log10((texts + 0.1) / (total + 0.1 * (size + 1)))
        score += math.log10(texts / total)
        known = sum(1 for w in words if n[w]) + (texts > 0)
        out.append((i, i is not None and crc32(str(i).encode()) % 10 == 0, len(words) + 1, known, total, base, score))
    return out


@pytest.mark.parametrize("frequent", [5, 1 << 18])
def test_scores_match_plain_loops(spark, subwords, frequent):
    rows = [(k, " ".join(helpers.prose(k, 12 + k, 30))[: 40 + 9 * k], "a") for k in range(24)]
    rows += [(40, None, "a"), (41, "", "b"), (42, " \t\n", None), (None, "The THE zoë ß", "c"), (3, "twice", "a"), (3, "twice", "a")]
    got = lattice.score_texts(helpers.table(spark, rows), rounds=2, frequent=frequent)
    got = sorted((tuple(r) for r in got.select("doc_id", *lattice.ADDED).collect()), key=lambda r: (r[0] is None, r))
    want = sorted(direct([r[:2] for r in rows], subwords, 2), key=lambda r: (r[0] is None, r))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_word_probabilities_sum_to_one():
    counts = lattice.Counts(tokens=20, words=3, once=2, twice=1, texts=5)
    whole = sum(math.exp(v) for v in counts.log_whole(np.array([1, 1, 13])))
    assert whole + math.exp(counts.log_spelt()) + math.exp(counts.log_end()) == pytest.approx(1)


def test_odd_rows_of_lattice(spark, odd, empty):
    scored = lattice.score_texts(odd)
    assert set(odd.columns) <= set(scored.columns)
    rows = scored.collect()
    assert len(rows) == odd.count()
    assert all(r["score"] <= 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    ends = {r["score"] for r in rows if r["n_tokens"] == 1}
    assert len(ends) == 1
    assert {r["size"] for r in rows} == {"own size"}
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert lattice.score_texts(empty).count() == 0


def test_no_learnt_rows(spark):
    docs = helpers.table(spark, [(None, "the end", "a")])
    (row,) = lattice.score_texts(docs).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["base_score"] == 0
    assert row["score"] < 0
