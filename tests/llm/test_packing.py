import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quercus.llm import packing as p

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_uses_up_the_histogram():
    rnd = np.random.default_rng(1)
    for hist in (np.zeros(65, int), rnd.integers(0, 50, 65), np.eye(65, dtype=int)[40] * 1000, rnd.integers(0, 2, 65)):
        hist[0] = 0
        used = np.zeros(65, int)
        for lengths, times in p.plan(hist, 64):
            assert sum(lengths) <= 64 and times > 0
            np.add.at(used, list(lengths), times)
        assert used.tolist() == hist.tolist()


def test_little_padding():
    rnd = np.random.default_rng(2)
    hist = np.bincount(np.minimum(rnd.exponential(350, 60_000).astype(int) + 1, 1024), minlength=1025)
    found = p.plan(hist)
    sequences = sum(t for _, t in found)
    tokens = int((hist * np.arange(1025)).sum())
    assert tokens / (sequences * 1024) > 0.99


def test_frame(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "dé"]) for _ in range(rnd.choice([0, 1, 30, 300, 2500])))) for i in range(60)]
    rows += [(7, None), (None, "x y"), (5, "same"), (5, "same"), (6, "z" * 5000)]
    df = spark.createDataFrame([(*r, 0, "w") for r in rows], "doc_id long, text string, length int, rank string")
    t = Tokenizer.from_file(BPE)
    ids = defaultdict(list)
    for i, x in rows:
        ids[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    got = p.pack(df, BPE).collect()
    seqs = defaultdict(list)
    for r in got:
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.asarray(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    # brute force: the pieces of each document, packed by the plan of their lengths, rank by rank
    pieces = sorted((x[a : a + 1024] for v in ids.values() for x in v for a in range(0, len(x), 1024)), key=len)
    hist = np.bincount([len(x) for x in pieces], minlength=1025)
    want = sorted(sorted(lengths) for lengths, times in p.plan(hist) for _ in range(times))
    assert sorted(sorted(n for _, n in s) for s in seqs.values()) == want and sorted(seqs) == list(range(len(want)))
    tokens = sum(map(len, pieces))
    assert len(seqs) <= -(-tokens // 1024) + 2
    small = p.pack(df, BPE, salted=3).collect()
    assert sorted((r.doc_id or -1, r.start, r.ids_crc32) for r in small) == sorted((r.doc_id or -1, r.start, r.ids_crc32) for r in got)
    assert len({(r.sequence_id, r.offset) for r in small}) == len(small) and {r.sequence_id for r in small} == set(seqs)
    assert p.pack(df.limit(0), BPE).count() == 0
