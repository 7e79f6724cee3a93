import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quercus.operators import sequences
from quercus.plans import load, registry
from quercus.plans.tables import MIN_FREQ, PLAIN, K

load()


@pytest.mark.parametrize("name", ["repeated_sequences", "maximal_repeats"])
def test_odd_ids_and_many_ranges(spark, tmp_path, monkeypatch, name):
    """Ids of several rows count once and missing ids never; chunks of several tasks meet in several ranges."""
    monkeypatch.setattr(sequences, "CHUNK", 64)  # on the driver: more ranges
    rnd = random.Random(3)
    phrases = [" ".join(rnd.choice("abcdefg") + str(rnd.randrange(9)) for _ in range(rnd.randrange(5, 30))) for _ in range(12)]
    texts = [" ".join(rnd.choices(phrases, k=rnd.randrange(1, 6))) for _ in range(60)] + ["a a a a a a a a a a a a a a", "too short", "", None]
    texts += ["only here and there and here and there once more"] * 3  # two without an id: one document
    ids = [*rnd.choices(range(40), k=60), 50, 51, 52, 53, 54, None, None]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr) and got


def test_few_bytes_for_each_place(spark):
    """No row for a place: a few packed ones, with under 12 bytes for each different sequence, and a sequence that is everywhere once a task."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=500))) for i in range(200)], "doc_id long, text string").repartition(2)
    size = sum(F.octet_length(c) for c in "abcde")
    rows, n = sequences._dealt(docs, PLAIN, K, False)[0].agg(F.count("*"), F.sum(size)).first(), 200 * (500 - K + 1)
    assert rows[0] <= 4 and rows[1] < 12 * n
    assert sequences._dealt(docs, PLAIN, K, True)[0].agg(F.sum(size)).first()[0] < 15 * n
    same = spark.createDataFrame([(i, " ".join(["again"] * 500)) for i in range(200)], "doc_id long, text string").repartition(2)
    assert sequences._dealt(same, PLAIN, K, False)[0].agg(F.sum("n")).first()[0] == 2
    assert [tuple(r) for r in sequences.recurring(same, PLAIN, K, MIN_FREQ).collect()] == [(200 * 493, 200, 1)]
