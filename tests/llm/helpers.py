"""Small tables with the odd cases that every operator must take, and direct computations."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

WORDS = "the of and river stone window paper green letter table moving under quiet night garden silver moon".split()
SCHEMA = "doc_id long, text string, source string"


def prose(seed: int, count: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"{rng.choice(WORDS)}{rng.randrange(vocabulary)}" for _ in range(count)]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Null id, null and empty texts, white space only, repeated rows, a shared id, a very long text."""
    long_text = " ".join(prose(1, 30_000, 100_000))
    base = " ".join(prose(2, 120))
    return [
        (1, base, "a"),
        (1, base, "a"),  # repeated row
        (2, base, None),
        (3, None, "b"),
        (4, "", "b"),
        (5, " \t\n ", "c"),
        (None, base + " tail", "a"),
        (None, None, None),
        (6, "one", "a"),
        (7, long_text, "a"),
        (8, long_text + " more", "b"),
        (9, "first text of a shared id", "a"),
        (9, "second text of a shared id", "a"),
        (10, "Zoë läuft 🙂 über die Straße", "c"),
    ]


def clashing(df):
    """The table with extra columns named like what operators add or use inside."""
    from pyspark.sql import functions as F

    names = ["_id", "_th", "_text", "_k", "place", "size", "score", "n_words", "n_removed", "taken", "_pattern",
             "_members", "open", "found", "label", "target", "runs", "marks", "v", "_row", "_source", "rank", "predicted"]
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def repeated_words(docs: dict, size: int) -> dict[int, set[int]]:
    """Words covered by a window that also starts earlier, for documents in order."""
    seen, out = set(), {}
    for doc_id in sorted(docs):
        words = docs[doc_id].encode().split()
        gone = set()
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out[doc_id] = gone
    return out


def covered_by_repeats(docs: dict, size: int) -> dict[int, set[int]]:
    places = defaultdict(list)
    for doc_id, text in docs.items():
        words = text.encode().split()
        for i in range(len(words) - size + 1):
            places[tuple(words[i : i + size])].append((doc_id, i))
    out = {d: set() for d in docs}
    for found in places.values():
        if len(found) > 1:
            for doc_id, i in found:
                out[doc_id].update(range(i, i + size))
    return out


def shingle_counts(text: str | None, size: int = 5) -> Counter:
    words = (text or "").encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def weighted_jaccard(x: Counter, y: Counter) -> float:
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0
