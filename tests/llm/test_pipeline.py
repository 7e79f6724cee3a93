import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quercus.llm import quality_rules as q

from .test_dedup import brute_dedup, brute_lines, passage
from .test_near_copies import brute as brute_near
from .test_quality_rules import brute as brute_quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(9)
    shared = passage(rnd, 60)
    foot = "All rights are reserved by us here"
    rows = [(i, "\n".join([passage(rnd, 70), *([shared] if i % 4 == 0 else []), foot])) for i in range(30)]
    rows += [(40 + i, rows[i][1]) for i in range(5)] + [(50, None), (51, ""), (52, "few words"), (53, "a " * 90), (6, rows[6][1]), (None, rows[8][1])]
    return rows


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t in rows if brute_quality(t, q.RepetitionRules())[-1]]
    kept = brute_lines(kept, 3)
    comp = dict(zip(range(len(kept)), brute_near([(10**9 if i is None else i, t) for i, t in kept], ordered=True), strict=True))
    one, seen = [], set()
    for k, (i, t) in sorted(enumerate(kept), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        if comp[k] not in seen:
            one.append((i, t))
            seen.add(comp[k])
    last = brute_dedup(one, 100)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, len(ids), zlib.crc32(np.asarray(ids[:1024], "<u4").tobytes())) for i, x in last for ids in [t.encode(x, add_special_tokens=False).ids + [0]]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.start == 0} == want


def test_stages_keep_the_columns(spark):
    rows = [(i, t, "en", None, None) for i, t in corpus()]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), "").count() == 0
        docs = spark.createDataFrame(out.collect(), COLUMNS)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, "").count() >= docs.count()
    assert last(spark, docs.limit(0), "").count() == 0
