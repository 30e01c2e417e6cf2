"""The pipeline and the registered queries on the smallest tables."""

import random

import pytest
from helpers import prose, table

import __spark_entry__
import corpus_pipeline
from relief.session import materialise

SF = "/root/testdata/sf0.001"


def test_every_text_query_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Planted cases among clean documents, with labels and a benchmark."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    item = " ".join(prose(9001, 30, 3000))
    block = "\n".join(" ".join(prose(9100 + k, 8, 3000)) for k in range(9))
    docs, labels = [], []
    for k in range(200):
        lines = [" ".join(prose(1000 * k + i, 12, 3000)) for i in range(8)]
        labels.append((k, 1, 0))
        docs.append([k, "\n".join(lines), "en", f"s{k % 4}", 0])
    for k in range(0, 60):
        docs[k][1] += " " + " ".join(rng.sample(["vilewort", "scumbrel", "loathly"], 2))
        labels[k] = (k, 0, 1)
    docs[100][1] += "\n" + item
    # near copies by their words, of which no line is the same
    docs[101][1] = docs[102][1].replace(" ", "  ")
    docs[103][1] = docs[110][1].replace(" ", "  ").rsplit(" ", 1)[0] + " altered"
    docs[120][1] += "\n" + block
    docs[121][1] += "\n" + block
    rows = [tuple([*d[:4], len(d[1])]) for d in docs]
    table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    table(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    table(spark, [(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_catch_planted_cases_and_keep_the_rest(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids, texts = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, corpus))
        rows = docs.collect()
        ids[name], texts[name] = {r.doc_id for r in rows}, {r.doc_id: r.text for r in rows}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, lines, near, leaks, mixed = (ids[n] for n, _ in corpus_pipeline.STAGES)
    assert toxic == set(range(60, 200)) and lines == toxic
    # the shared block loses its chunks in the later document only
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    after = texts["line dedup"]
    assert after[120] == before[120] and len(after[121]) < len(before[121]) - 300
    assert near == lines - {102, 110}
    assert leaks == near - {100}
    assert mixed <= leaks and all(r.taken > 0 for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, corpus).collect()} == mixed


def test_pipeline_takes_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, corpus))
        assert docs.count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_queries_run_on_the_smallest_tables(spark, number):
    name, query = next((n, q) for n, q in __spark_entry__.queries().items() if n.startswith(f"op{number}_"))
    out = query(spark, SF)
    assert out.count() >= 0 and out.columns
