import os
import random
import zlib

import numpy as np
import pytest

from quercus.llm import quality_classifier as q
from quercus.llm import registry


def corpus(n):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 80))]
        y = rnd.random() < 0.7
        if not y:
            words = [w + rnd.choice(["***", "%%%"]) for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_votes_equal_a_plain_search():
    rows = corpus(80)
    model = q.VotingModel(neighbours=5)
    space = q.fit([(t, y) for _, t, y in rows[:50]], model)
    got = q.vote(space, [t for _, t, _ in rows[50:]], model)
    for (_, t, _), score in zip(rows[50:], got, strict=True):
        assert abs(score - plain_vote(space, t, model)) < 1e-9


def plain_vote(space, t, model):
    """Every labelled text in turn, by whole numbers; of equally near ones the first."""
    v = [int(x) for x in space.embed([t])[0]]
    near = [(sum(a * int(b) for a, b in zip(v, u, strict=True)), -i, y) for i, (u, y) in enumerate(zip(space.vectors, space.labels, strict=True))]
    near = sorted(near, reverse=True)[: model.neighbours]
    w = [max(0, s / q.GRID**2) ** model.sharpness for s, *_ in near]
    return sum(a * y for a, (*_, y) in zip(w, near, strict=True)) / sum(w)


def test_scores_do_not_depend_on_the_batch():
    rows = corpus(120)
    space = q.fit([(t, y) for _, t, y in rows[:70]] + [(rows[3][1], 1 - rows[3][2])] * 20)
    docs = [t for _, t, _ in rows]
    whole = q.vote(space, docs)
    assert whole.tolist() == [q.vote(space, [t])[0] for t in docs] == np.concatenate([q.vote(space, docs[a : a + 7]) for a in range(0, 120, 7)]).tolist()


def test_words_alone_can_tell_quality_apart():
    """Texts of one shape, told apart by what they say."""
    rnd = random.Random(4)
    good, bad = ["calm", "deep", "kind", "true", "warm"], ["spam", "junk", "fake", "scam", "trap"]
    rows = [(" ".join(rnd.choice(good if i % 2 else bad) for _ in range(40)), i % 2) for i in range(80)]
    space = q.fit(rows[:60])
    assert [s >= 0.5 for s in q.vote(space, [t for t, _ in rows[60:]])] == [y == 1 for _, y in rows[60:]]


def test_query_equals_a_plain_search(spark, tmp_path):
    """The whole query: sample, vocabulary, counts over all documents, votes."""
    rows = corpus(150)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op6_quality_classifier"](spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    sample = [(t, y) for i, t, y in rows if i % 5 and not held[i]]
    own = q.vocabulary(sample)
    counts = np.asarray([sum(k in q.terms(t)[0] for _, t, _ in rows) for k in own])
    space = q.fit(sample, own=own, counts=counts, total=len(rows))
    assert set(got) == set(held)
    for i, t, _ in rows:
        want = plain_vote(space, t, q.VotingModel())
        assert abs(got[i].score - want) < 1e-6 and got[i].held_out == held[i] and got[i].predicted == (got[i].score >= 0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_ranking_of_the_labels_table(spark):
    """The share of pairs of held-out documents of either label that the scores order rightly."""
    folder = "/root/testdata/sf0.1"
    got = registry.QUERIES["op6_quality_classifier"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = (np.asarray([r.score for r in got if r.quality == y]) for y in (1, 0))
    assert len(bad) > 100 and ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.98


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in rows] + [(1000, None, 0.1, 1), (1001, "", 0.1, 1), (None, "some text", 0.1, 1), (3, rows[3][1], 0.5, 1)], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (5, None, "x"), (1, 7, "x"), (999, 1, "x")], "doc_id long, quality int, text string")
    got = q.classify(docs, labels).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert q.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_held_out_are_not_learnt(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = q.classify(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    b = q.classify(docs, spark.createDataFrame(flip, "doc_id long, quality int"))
    assert sorted(a.collect()) == sorted(b.collect())
