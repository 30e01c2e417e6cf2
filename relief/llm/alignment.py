"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text, with one space before it, is encoded by a byte-level tokenizer (A) and
by a piece tokenizer (B). Where tokens of both end at the same byte, the text is
cut into groups. Two tokens are linked where their byte ranges overlap, and a
pair of ids is counted over all links of the corpus.

The work is done on Arrow columns of a batch: token lists are flattened, the
parent of each token is kept beside it, byte ends are cumulative sums of token
lengths that start anew with each parent, ends common to both tokenizers are
found by a hash join on (parent, end), and counts of id pairs are grouped within
the batch before Spark merges them.

Neither tokenizer lets a token reach over a space that follows a character other
than white space and precedes one. Texts are cut there into stretches, and
equal stretches of a batch are one parent that is encoded and aligned once. The
cuts are the same for both, so they bound groups too.

Counts of the corpus come back to documents in two parts: the most frequent id
pairs, `frequent` at most, travel to the documents; links of the others are
joined with their counts. The highest count of each B id is one number for each
id of its vocabulary.

Defined results: texts that are null or empty, or whose tokens of A or of B do
not spell the space and the text, have no tokens, zeros, and '' for the groups;
a null id stays null; repeated rows count and are returned each; an empty table
gives an empty result. Strings of special tokens in a text are plain text. Other
columns stay, but for those of the names that are added.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from relief.llm.common import aside, column, distinct, expand, lists, packed, restored, row_sums, runs, text_bytes
from relief.session import materialise

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 1 << 19
PIECE_BYTES = 1 << 22  # bytes of text whose stretches are brought together at once
CHUNK_BYTES = 1 << 15  # bytes of stretches that are encoded in one call
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
# fixed value: how byte-level tokenizers cut a text into words before merging
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# fixed values: first bytes of the UTF-8 forms of white space beyond ASCII
_WIDE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Coder:
    """Encodes a string to ids; `data[at[id]:at[id+1]]` are the bytes of an id."""

    encode: Callable[[str], list[int]]
    data: np.ndarray
    at: np.ndarray

    def length(self, ids: np.ndarray) -> np.ndarray:
        return np.diff(self.at)[ids]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[expand(self.at[ids], self.length(ids))]


def _coder(encode: Callable[[str], list[int]], texts: list[bytes]) -> Coder:
    return Coder(encode, np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))


@cache
def coder_a(file: str) -> Coder:
    """A byte-level tokenizer file; encodes strings as they are.

    Its merges must make tokens in the order of their ids, as then the same ids
    come from merging by rank, which is several times as fast.
    """
    with open(file) as source:
        model = json.load(source)["model"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if all(c in letters for c in token)}
    made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in made]
    if order != sorted(set(order)) or len(ranks) != 256 + len(order):
        raise ValueError(f"{file}: merges are not in the order of ids")
    coder = tiktoken.Encoding(file, pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
    texts = [b""] * (max(ranks.values()) + 1)
    for text, k in ranks.items():
        texts[k] = text
    return _coder(coder.encode_ordinary, texts)


@cache
def coder_b(file: str) -> Coder:
    """A piece tokenizer file; encodes strings that begin with a space, which it adds itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        texts.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
        if " " in texts[-1].decode(errors="ignore").lstrip(" "):
            raise ValueError(f"{piece!r} reaches over a space: stretches cannot be encoded apart")
    return _coder(lambda text: model.encode(text[1:], num_threads=1), texts)


def stretches(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(low, high, stretches, counts): texts with a space before each, cut where no token can reach over."""
    data, at = text_bytes(column)
    for low, high in runs(at, PIECE_BYTES):
        length = np.diff(at[low : high + 1])
        # null and empty texts have no stretches
        size = length + (length > 0)
        edge = np.append(0, np.cumsum(size))
        buffer = np.full(int(edge[-1]), 32, dtype=np.uint8)
        buffer[expand(edge[:-1] + 1, length)] = data[at[low] : at[high]]
        white = (buffer == 32) | ((buffer >= 9) & (buffer <= 13)) | ((buffer >= 28) & (buffer <= 31))
        cut = np.zeros(len(buffer), dtype=bool)
        cut[1:-1] = (buffer[1:-1] == 32) & ~white[:-2] & ~white[2:]
        # a character that may be wide white space stays beside the space
        wide = np.isin(buffer, _WIDE_SPACE)
        for back in (2, 3):
            cut[back:] &= ~wide[:-back] | (buffer[back - 1 : -1] < 128)
        for ahead in (1,):
            cut[:-ahead] &= ~wide[ahead:]
        cut[edge[:-1][size > 0]] = True
        start = np.flatnonzero(cut)
        yield low, high, packed(buffer, np.append(start, len(buffer))), np.diff(np.searchsorted(start, edge))


def encoded(values: pa.Array, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of binary stretches; one that its tokens do not spell has none."""
    data, at = text_bytes(values.cast(pa.string()))
    ids, counts = [], np.zeros(len(values), dtype=np.int64)

    def code(low: int, high: int) -> None:
        raw = data[at[low] : at[high]]
        found = np.array(coder.encode(raw.tobytes().decode()), dtype=np.int64)
        length = coder.length(found)
        spelt = len(raw) == int(length.sum()) and np.array_equal(coder.spell(found), raw)
        if spelt:
            ends = np.cumsum(length)
            upto = np.searchsorted(ends, at[low + 1 : high + 1] - at[low], side="right")
            spelt = bool((np.append(0, ends)[upto] == at[low + 1 : high + 1] - at[low]).all())
        if spelt:
            counts[low:high] = np.diff(np.append(0, upto))
            ids.append(found)
        elif high - low > 1:
            middle = (low + high) // 2
            code(low, middle)
            code(middle, high)

    low = 0
    for low, high in runs(at - at[0], CHUNK_BYTES):
        code(low, high)
    return (np.concatenate(ids) if ids else np.empty(0, np.int64)), counts


def token_ends(ids: pa.ListArray, length: np.ndarray) -> pa.Table:
    """(parent, id, end) of every token; ends are sums of lengths that start anew with each parent."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pa.array(length[flat.to_numpy()]))
    # what stands before each parent's first token is taken off
    before = np.append(0, total.to_numpy())[ids.offsets.to_numpy()[:-1]]
    end = pc.subtract(total, pa.array(before).take(parent))
    return pa.table({"parent": parent, "end": end, "id": flat, "at": pa.array(np.arange(len(flat)))})


@dataclass
class Aligned:
    """Groups and links of the stretches of a batch."""

    tokens: list[np.ndarray]  # per tokenizer: tokens of each stretch
    groups: np.ndarray  # groups of each stretch
    links: np.ndarray  # links of each stretch
    a: np.ndarray  # ids of each link, in the order of stretches
    b: np.ndarray
    names: list[bytes]  # `a1,a2|b1;...` of each stretch


def _named(ids: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Ids of each group, which ends with a token marked as last, joined by commas."""
    text = pa.array(ids).cast(pa.string())
    counts = np.diff(np.append(-1, np.flatnonzero(last)))
    grouped = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), text)
    return pc.binary_join(grouped, ",")


def align(values: pa.Array, file_a: str, file_b: str) -> Aligned:
    """Encode and align stretches; those that one of the tokenizers does not spell have no tokens."""
    sides, coders = [], (coder_a(file_a), coder_b(file_b))
    for coder in coders:
        sides.append(encoded(values, coder))
    good = (sides[0][1] > 0) & (sides[1][1] > 0)
    tables = []
    for (ids, counts), coder in zip(sides, coders, strict=True):
        kept = np.repeat(good, counts)
        tables.append(token_ends(lists(ids[kept], np.where(good, counts, 0)), np.diff(coder.at)))
    keys = ["parent", "end"]
    a, b = (t.rename_columns([*keys, f"{n}_id", f"{n}_at"]) for t, n in zip(tables, "ab", strict=True))
    # ends that both have bound groups; all ends bound the stretches of bytes that one pair of tokens covers
    both = a.select([*keys, "a_at"]).join(b.select([*keys, "b_at"]), keys, join_type="inner", use_threads=False)
    last_a, last_b = np.zeros(a.num_rows, dtype=bool), np.zeros(b.num_rows, dtype=bool)
    last_a[both.column("a_at").to_numpy()] = True
    last_b[both.column("b_at").to_numpy()] = True
    links = a.select(keys).join(b.select(keys), keys, join_type="full outer", use_threads=False).sort_by([(k, "ascending") for k in keys])
    parent, end = (links.column(k).to_numpy() for k in keys)
    owner = np.zeros(len(values), dtype=np.int64)
    owner[: len(values)] = np.bincount(parent, minlength=len(values))
    ids = []
    for table in (a, b):
        # the token that covers a range of bytes is the first that ends at its end or later
        scale = int(end.max(initial=0)) + 1
        ends = table.column("parent").to_numpy().astype(np.int64) * scale + table.column("end").to_numpy()
        at = np.searchsorted(ends, parent.astype(np.int64) * scale + end)
        ids.append(table.column(2).to_numpy()[at])
    groups = np.bincount(a.column("parent").to_numpy()[last_a], minlength=len(values))
    pairs = pc.binary_join_element_wise(
        _named(a.column("a_id").to_numpy(), last_a), _named(b.column("b_id").to_numpy(), last_b), "|"
    )
    name = pc.binary_join(
        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(groups)).astype(np.int32)), pairs), ";"
    )
    tokens = [np.where(good, counts, 0) for _, counts in sides]
    return Aligned(tokens, groups, owner, *ids, name.cast(pa.binary()).to_pylist())


def _batches(texts: pa.Array, file_a: str, file_b: str):
    """(low, high, counts, code, aligned, good): each run of texts with its distinct stretches aligned."""
    for low, high, parts, counts in stretches(texts):
        values, code = distinct(parts)
        aligned = align(values, file_a, file_b)
        # a text is good if all its stretches are; others have no tokens at all
        bad = row_sums((aligned.tokens[0] == 0)[code].astype(np.int64), counts) > 0
        yield low, high, counts, code, aligned, ~bad & (counts > 0)


def pair_counts(docs: DataFrame, file_a: str = TOKENIZER_A, file_b: str = TOKENIZER_B) -> DataFrame:
    """(a, b, n): links of each pair of ids over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, counts, code, aligned, good in _batches(column(batch, "text"), file_a, file_b):
                times = np.bincount(code[np.repeat(good, counts)], minlength=len(aligned.links))
                links = pa.table({"a": aligned.a, "b": aligned.b, "n": np.repeat(times, aligned.links)})
                partial = links.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
                partial = partial.filter(pc.greater(partial.column("n"), 0))
                yield from partial.cast(pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])).to_batches()

    found = docs.select("text").mapInArrow(count, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _least_count(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most `most` pairs reach in number."""
    levels = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()
    reach, level = 0, 62
    for row in sorted(levels, key=lambda r: -r["level"]):
        reach += row["count"]
        if reach > most:
            break
        level = row["level"]
    return 1 << level


def align_texts(
    docs: DataFrame,
    file_a: str = TOKENIZER_A,
    file_b: str = TOKENIZER_B,
    frequent: int = FREQUENT,
    keep_text: bool = True,
) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 to whole documents.

    `n_best` are links whose pair is the most frequent of its B id over all
    texts, ties included; `count_sum` adds the corpus-wide count of each link.
    """
    docs, names = aside(docs.drop(*ADDED), "text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    pairs = materialise(pair_counts(docs, file_a, file_b))
    # one row for each id of B at most
    best = materialise(pairs.groupBy("b").agg(F.max("n").alias("top")))
    rated = pairs.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    least = _least_count(pairs, frequent)
    hot = rated.where(F.col("n") >= least).toArrow()
    key = hot.column("a").to_numpy().astype(np.int64) << 32 | hot.column("b").to_numpy()
    order = np.argsort(key)
    key = key[order]
    known = {c: np.append(hot.column(c).to_numpy()[order], 0) for c in ("n", "best")}
    kept = [c for c in docs.columns if keep_text or c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, counts, code, aligned, good in _batches(column(batch, "text"), file_a, file_b):
                def total(values, counts=counts, code=code, good=good):
                    """Sums over documents of a number of each stretch."""
                    return np.where(good, row_sums(values[code], counts), 0)

                link = aligned.a.astype(np.int64) << 32 | aligned.b
                at = np.searchsorted(key, link)
                at[np.append(key, -1)[at] != link] = len(key)
                value = {c: total(row_sums(v[at], aligned.links)) for c, v in known.items()}
                # links of other pairs, document by document
                rare = at == len(key)
                n_rare = row_sums(rare.astype(np.int64), aligned.links)
                first = np.cumsum(n_rare) - n_rare
                used = code[np.repeat(good, counts)]
                owner = np.repeat(np.arange(high - low), np.where(good, counts, 0))
                doc = np.repeat(owner, n_rare[used])
                rare_links, number = np.unique(link[rare], return_inverse=True)
                both, times = np.unique(
                    doc * max(1, len(rare_links)) + number[expand(first[used], n_rare[used])], return_counts=True
                )
                per_doc = np.bincount(both // max(1, len(rare_links)), minlength=high - low)
                edge = np.append(0, np.cumsum(counts))
                hashes = [
                    hashlib.sha256(b";".join([aligned.names[c] for c in code[i:j].tolist()])).hexdigest() if ok else ""
                    for i, j, ok in zip(edge[:-1].tolist(), edge[1:].tolist(), good.tolist(), strict=True)
                ]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(part, c) for c in ["_row", *kept]),
                        *(pa.array(total(v)) for v in (*aligned.tokens, aligned.groups, aligned.links)),
                        pa.array(value["best"]),
                        pa.array(value["n"]),
                        pa.array(hashes),
                        lists(rare_links[both % max(1, len(rare_links))], per_doc),
                        lists(times.astype(np.int32), per_doc),
                    ],
                    ["_row", *kept, *ADDED, "_links", "_times"],
                )

    schema = docs.select(F.lit(0).cast("long").alias("_row"), *kept).schema
    for name in ADDED:
        schema = schema.add(name, "string" if name == "groups_sha256" else "long")
    schema = schema.add("_links", T.ArrayType(T.LongType())).add("_times", T.ArrayType(T.IntegerType()))
    # numbered as they are written: a row keeps its number in what follows
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *docs.columns)
    scanned = materialise(numbered.mapInArrow(scan, schema))
    rare = scanned.where(F.size("_links") > 0).select("_row", F.explode(F.arrays_zip("_links", "_times")).alias("w"))
    others = rated.where(F.col("n") < least).select(
        (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("link"), "n", "best"
    )
    rest = (
        rare.select("_row", F.col("w._links").alias("link"), F.col("w._times").alias("times"))
        .join(others, "link")
        .groupBy("_row")
        .agg(F.sum(F.col("best") * F.col("times")).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    )
    whole = scanned.drop("_links", "_times").join(rest, "_row", "left")
    whole = whole.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
        }
    )
    return restored(whole, {n: c for n, c in names.items() if n in kept}, *ADDED)
