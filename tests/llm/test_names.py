"""Columns of a user's that bear the inner names of operators come back as they were."""

import pytest

from tidemark.llm import decontaminate, near_join, packing, quality, shard_shuffle

NAMES = ["__scan", "__row", "__order", "__quality", "__bucket", "__place", "__start", "__number", "__before", "__from",
         "__sequence", "own_1", "row", "key", "component", "a.b", "n", "order", "hash"]


def words(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 997}" for i in range(n))


def frame(spark, n=6):
    rows = [(i, words(i), 1 + i, *(f"{c}{i}" for c in NAMES)) for i in range(n)]
    columns = ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, length long, {columns}")


BENCH = "item_id long, text string"
OPERATORS = {
    "drop_documents": lambda s, df: decontaminate.drop_documents(df, s.createDataFrame([(1, words(2, 12))], BENCH)),
    "remove_spans": lambda s, df: decontaminate.remove_spans(df, s.createDataFrame([(1, words(99, 12))], BENCH)),
    "keep_good": lambda s, df: quality.keep_good(df, s.createDataFrame([], "doc_id long, quality int")),
    "drop_near_copies": lambda s, df: near_join.drop_near_copies(df.unionAll(df)),
    "shuffle": lambda s, df: shard_shuffle.shuffle(df, 3).drop("__shard", "__slot"),
    "pack": lambda s, df: packing.pack(df, 16).drop("sequence_id", "offset")}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_come_back(spark, name):
    df = frame(spark)
    out = OPERATORS[name](spark, df)
    assert out.columns == df.columns
    want = [tuple(r) for r in df.collect() if name != "drop_documents" or r.doc_id != 2]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert OPERATORS[name](spark, df.limit(0)).collect() == []
