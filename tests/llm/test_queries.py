"""The registered queries: names, columns, and what the contract says of their rows."""

import zlib

from codestrata.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_toxicity_columns(spark):
    rows = QUERIES["op1_toxicity"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_chat_probe(spark):
    row = QUERIES["op3_chat"](spark, DATA).filter("conv_id = -7").collect()[0]
    assert row["n_turns"] == 2 and row["loss_chars"] == len("\\### Assistant: </turn> ok")
