"""Substring dedup, repeated passages and line dedup against direct computation."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import covered_by_repeats, prose, repeated_words, table
from relief.llm import lines, substrings, suffixes
from relief.llm.common import LINES, split_words


def texts():
    rng = random.Random(5)
    passage, other = prose(10, 80), prose(11, 60)
    docs = {k: prose(100 + k, rng.randrange(5, 150)) for k in range(24)}
    for k in (3, 4, 9, 20):
        docs[k][2:2] = passage[rng.randrange(0, 25) :]
    docs[12] = docs[9] + other + prose(12, 7) + other  # repeats inside one document
    docs[13] = docs[12][1:]
    docs[21] = ["x"] * 90  # one word over and over
    docs[22] = ["x"] * 40
    return {k: " ".join(w) for k, w in docs.items()}


def kept(words, gone):
    return hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_difference_cover_meets_every_shift():
    cover = set(substrings.COVER)
    assert all(
        any((a + i) % 13 in cover and (b + i) % 13 in cover for i in range(13)) for a in range(13) for b in range(13)
    )


def test_substring_dedup_matches_direct_computation(spark):
    docs = texts()
    df = table(spark, [(k, t, None) for k, t in docs.items()]).repartition(5)
    want = repeated_words(docs, substrings.WINDOW)
    assert sum(map(len, want.values())) > 300
    rows = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    for k, t in docs.items():
        words = t.encode().split()
        assert (rows[k].n_words, rows[k].n_removed) == (len(words), len(want[k]))
        assert rows[k].kept_sha256 == kept(words, want[k])
        if want[k]:
            assert rows[k].text.encode().split() == [w for i, w in enumerate(words) if i not in want[k]]
        else:
            assert rows[k].text == t


@pytest.mark.parametrize("batch", [400, 16 << 20])
def test_small_batches_give_the_same(spark, monkeypatch, batch):
    from relief.llm import repeats

    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    docs = texts()
    df = table(spark, [(k, t, None) for k, t in docs.items()]).coalesce(1)
    want = {k: len(v) for k, v in repeated_words(docs, substrings.WINDOW).items()}
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df, keep_text=False).collect()} == want


def test_repeated_passages_match_direct_computation(spark):
    docs = texts()
    df = table(spark, [(k, t, None) for k, t in docs.items()]).repartition(5)
    spans = suffixes.repeated_passages(df).collect()
    got = {k: set() for k in docs}
    for s in spans:
        got[s.doc_id].update(range(s.start_word, s.end_word))
        if s.earlier_id is not None:
            own, other = docs[s.doc_id].encode().split(), docs[s.earlier_id].encode().split()
            shift = s.earlier_word - s.start_word
            assert any(
                own[i : i + 50] == other[i + shift : i + shift + 50]
                for i in range(s.start_word, s.end_word - 49)
                if i + shift >= 0
            )
    assert got == covered_by_repeats(docs, suffixes.PASSAGE)
    assert any(got.values())


def test_line_dedup_matches_direct_computation(spark):
    rng = random.Random(3)
    block = [" ".join(prose(50 + k, 6)) for k in range(12)]
    docs = {}
    for k in range(20):
        own = [" ".join(prose(200 + 20 * k + i, 5)) for i in range(rng.randrange(1, 9))]
        if k % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = block[: rng.randrange(6, 12)]
        if k % 5 == 0:
            own[1:1] = ["", ""]
        docs[k] = "\n".join(own)
    docs[20] = docs[3]
    docs[21] = "alone"
    docs[22] = "alone"
    df = table(spark, [(k, t, None) for k, t in docs.items()]).repartition(4)
    rows = {r.doc_id: r for r in lines.remove_lines(df).collect()}
    seen, removed = set(), 0
    for k in sorted(docs):
        data = docs[k].encode()
        (piece,) = split_words(pa.array([docs[k]]), LINES)
        stay, gone = np.ones(len(data), bool), 0
        for low, high in zip(*lines.chunk_ends(piece), strict=True):
            assert high - low >= 2
            chunk = data[piece.start[low] : piece.end[high - 1]]
            if chunk in seen:
                stay[piece.start[low] : piece.end[high - 1] + 1] = False
                gone += high - low
            seen.add(chunk)
        left = bytes(np.frombuffer(data, np.uint8)[stay])
        want = left if not len(stay) or stay[-1] else left.removesuffix(b"\n")
        assert (rows[k].text.encode(), rows[k].n_removed) == (want, gone)
        removed += gone
    assert removed > 10 and rows[20].text == "" and rows[22].text == "alone"


def test_boundaries_resist_shifts():
    block = [" ".join(prose(400 + k, 4)) for k in range(60)]
    (a,) = split_words(pa.array(["\n".join(block)]), LINES)
    (b,) = split_words(pa.array(["\n".join(["new line", "and another", *block])]), LINES)
    first = {tuple(a.word[x:y]) for x, y in zip(*lines.chunk_ends(a), strict=True)}
    second = {tuple(b.word[x:y]) for x, y in zip(*lines.chunk_ends(b), strict=True)}
    assert len(first & second) >= len(first) - 2


@pytest.mark.parametrize("operator", [substrings.remove_repeats, lines.remove_lines])
def test_odd_rows_keep_their_columns(odd, empty, operator):
    out = operator(odd)
    added = {substrings.remove_repeats: substrings.ADDED, lines.remove_lines: lines.ADDED}[operator]
    assert set(out.columns) == set(odd.columns) | set(added)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r["_k"] == "own _k" and r["runs"] == "own runs" for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2
    assert operator(empty).collect() == []


def test_odd_rows_of_substring_dedup(odd):
    rows = substrings.remove_repeats(odd).collect()
    by = lambda i: [r for r in rows if r.doc_id == i]
    assert [r.n_removed for r in by(1)] == [0, 0]  # one document read twice
    assert by(2)[0].n_removed == by(2)[0].n_words == 120 and by(2)[0].text == ""
    assert by(3)[0].text is None and by(3)[0].n_words == 0 and by(4)[0].text == ""
    assert by(8)[0].n_removed == 30_000 and by(8)[0].text == "more"
    last = next(r for r in rows if r.doc_id is None and r.n_words)
    assert last.n_removed == 120 and last.text == "tail"


def test_odd_rows_of_passages(odd, empty):
    spans = suffixes.repeated_passages(odd).collect()
    assert {s.doc_id for s in spans} == {1, 2, None, 7, 8}
    assert suffixes.repeated_passages(empty).collect() == []


def test_each_layout_of_a_chunk_has_its_own_first_copy(spark):
    docs = ["one line\nanother line", *["one line\n\nanother line"] * 3, "one line\nanother line", "one line\n\n\nanother line"]
    rows = lines.remove_lines(table(spark, [(k, t, None) for k, t in enumerate(docs)])).collect()
    assert [r.n_removed for r in sorted(rows, key=lambda r: r.doc_id)] == [0, 0, 2, 2, 2, 0]
