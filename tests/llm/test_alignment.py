"""Token alignment against whole texts encoded and compared one by one."""

import hashlib
import random
from collections import Counter

import helpers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from relief.llm import alignment

LETTERS = alignment.byte_letters()


def direct(texts):
    """Result rows of whole texts by plain loops."""
    tokenizer = Tokenizer.from_file(alignment.TOKENIZER_A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.TOKENIZER_B)
    found, count = [], Counter()
    for text in texts:
        sides = []
        if text:
            whole = (" " + text).encode()
            encoding = tokenizer.encode(" " + text, add_special_tokens=False)
            sides.append([(k, bytes(LETTERS[c] for c in t)) for k, t in zip(encoding.ids, encoding.tokens, strict=True)])
            ids = model.encode(text)
            pieces = [(k, model.id_to_piece(k)) for k in ids]
            sides.append([(k, bytes([int(p[1:-1], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()) for k, p in pieces])
        if not sides or any(b"".join(t for _, t in side) != whole for side in sides):
            found.append(None)
            continue
        spans = []
        for side in sides:
            at, out = 0, []
            for k, t in side:
                out.append((k, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for k, low, high in spans[0]:
            while spans[1][j][2] <= low:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][1] < high:
                links.append((k, spans[1][m][0]))
                m += 1
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        names, low = [], 0
        for high in common:
            names.append("|".join(",".join(str(k) for k, s, e in side if low <= s and e <= high) for side in spans))
            low = high
        count.update(links)
        found.append((spans, links, names))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for item in found:
        if item is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        spans, links, names = item
        out.append(
            (len(spans[0]), len(spans[1]), len(names), len(links), sum(count[x] == top[x[1]] for x in links),
             sum(count[x] for x in links), hashlib.sha256(";".join(names).encode()).hexdigest())
        )
    return out


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", " ", "　", " ", "🙂", "漢字", "'s", "I'll", "1234", "!!", "…", "\x00", "\r\n",
                "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\u0085", "é", "​", "\x1c", "-", "ing ", " of"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [" ".join(helpers.prose(k, 80, 50)) for k in range(20)]
    return [*texts, None, "", " ", "\n", "a▁b", "word ▁ word", " leading", "trailing ", "x" * 5000, "same text", "same text"]


@pytest.mark.parametrize("frequent", [50, 1 << 19])
def test_alignment_matches_whole_texts(spark, frequent):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in alignment.ADDED) for r in alignment.align_texts(docs, frequent=frequent).collect()}
    want = direct(texts)
    assert len(got) == len(texts)
    for k, row in enumerate(want):
        assert got[k] == row, texts[k]


def test_odd_rows_of_alignment(spark, odd, empty):
    rows = alignment.align_texts(odd).collect()
    assert len(rows) == odd.count()
    assert set(odd.columns) | set(alignment.ADDED) == set(rows[0].asDict())
    zero = [r for r in rows if r["doc_id"] in (3, 4)]
    assert all(r["n_a"] == r["n_links"] == 0 and r["groups_sha256"] == "" for r in zero)
    assert len({r["groups_sha256"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert all(r["size"] == "own size" for r in rows)
    assert alignment.align_texts(empty).count() == 0
