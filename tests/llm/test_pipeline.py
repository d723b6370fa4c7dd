"""The corpus pipeline on small tables: what each stage takes out, odd rows, and an empty table."""

import random

import pytest

import corpus_pipeline as pipeline
from tidemark.llm import tokens
from tidemark.llm.shared import keep

COLUMNS = "doc_id long, text string, lang string, n_chars long, own int, spans string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = [text(120) for _ in range(40)]
    passage = text(12)
    rows = {i: t for i, t in enumerate(good)}
    rows[100] = good[3]                                    # an exact copy
    rows[101] = " ".join(good[4].split()[:-1] + ["other"])  # a near copy
    rows[102] = f"{text(80)} {passage} {text(30)}"         # a benchmark passage
    rows[103] = f"{text(90)} password: hunter2hunter2 {text(20)}"
    rows |= {200: None, 201: "", 202: "too short", 203: "same " * 200}
    home = str(tmp_path_factory.mktemp("corpus"))
    write = lambda rs, kind, name: spark.createDataFrame(rs, kind).write.parquet(f"{home}/{name}.parquet")
    write([(d, t, "en", len(t or ""), d, "x") for d, t in rows.items()] + [(None, text(100), "en", 1, None, None)], COLUMNS, "documents")
    write([(1, passage), (2, None)], "item_id long, text string", "benchmark")
    write([(d, 1, 0) for d in range(0, 40, 2)], "doc_id long, quality int, toxic int", "labels")
    return home, rows


def test_stages_take_out_what_they_should_and_nothing_else(spark, tables):
    home, rows = tables
    docs, kept = spark.read.parquet(f"{home}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, home))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    first = kept["quality_rules"]
    assert not first.keys() & {200, 201, 202, 203} and first.keys() <= rows.keys() | {None}
    near = kept["near_copies"]
    assert len({3, 100} & near.keys()) == len({3, 100} & first.keys() and {3}) and len({4, 101} & near.keys()) <= 1
    assert near.keys() | {3, 100, 4, 101} >= first.keys()
    clean = kept["benchmark_passages"]
    assert near.keys() - clean.keys() == {102} & near.keys()
    out = kept["secrets_out"]
    assert out.keys() == clean.keys()
    for d, row in out.items():
        assert (row.own, row.spans) == (clean[d].own, clean[d].spans)
        assert row.text == (clean[d].text if d != 103 else clean[d].text.replace("password: hunter2hunter2", "[secret]"))
    pieces = pipeline.run(spark, home).collect()
    length = {}
    for r in pieces:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {d: len(tokens.encode(r.text)) + 1 for d, r in out.items()}


def test_empty_documents_give_an_empty_result(spark, tables, tmp_path):
    home, _ = tables
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{home}/{name}.parquet").limit(0 if name == "documents" else 9).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
