import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quercus.llm import bpe, registry

BPE = public_tokenizers.path("byte_bpe_50k.json")


def ids(c, text):
    return np.frombuffer(c.encode(text), "<u4").tolist()


def ref(c, text):
    return c.own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("long", [16, 64, bpe.LONG])
def test_equals_the_library(long):
    c, rnd = bpe.Codec(BPE, long), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\n ", "é", "1", "<|endoftext|>", "'s", "!!", "\t", "a.", "b**", "c.\n", "ß", "日", "the", "ing ", " ", " ", "\x1c"]
    for _ in range(1500):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert ids(c, s) == ref(c, s), repr(s)
        assert c.decode(c.encode(s)) == c.own.decode(ref(c, s), skip_special_tokens=False) == s
    for k in range(200):
        s = "".join(rnd.choice("aeéthing" if k % 2 else "ab") for _ in range(rnd.randint(0, 600)))
        assert ids(c, s) == ref(c, s), repr(s)


def test_plain_characters_have_the_same_classes():
    c = bpe.Codec(BPE)
    for x in map(chr, range(0x250)):
        for s in (f"a{x}b", f"a {x}", f"{x}{x}1{x}", f"a  {x} {x}a", f"x'{x}"):
            assert ids(c, s) == ref(c, s), repr(s)


def test_long_unsplit_text():
    c, rnd = bpe.Codec(BPE), random.Random(2)
    for alphabet in ("a", "ab", "thequickbrown"):
        s = "".join(rnd.choice(alphabet) for _ in range(60_000))
        assert ids(c, s) == ref(c, s)


def test_frame(spark):
    rows = [(1, "The cat sat.\nOn <|endoftext|> it"), (1, "The cat sat.\nOn <|endoftext|> it"), (None, None), (2, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    enc = bpe.encode(df, BPE)
    back = bpe.decode(enc, BPE).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    got = bpe.digests(df, BPE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, len(enc.where("doc_id = 1").first().ids)), (1, got[0].n_tokens), (2, 0)]
    assert bpe.digests(df.limit(0), BPE).count() == 0
    t = Tokenizer.from_file(BPE)
    want = []
    for i, x in rows:
        own = t.encode(x or "", add_special_tokens=False).ids
        want.append((i or 0, len(own), hashlib.sha256(np.asarray(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, *r[1:]) for r in got) == sorted(want)
    odd = spark.createDataFrame([(1, [7, 10**6, None, -3, 8]), (2, None)], "doc_id long, ids array<int>")
    assert dict(map(tuple, bpe.decode(odd, BPE).collect())) == {1: t.decode([7, 8], skip_special_tokens=False), 2: ""}


def test_whole_query_equals_the_library(spark, tmp_path):
    """Every column of the query against the library, on texts with long unsplit parts."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abé 日\n") for _ in range(n)) for n in (0, 1, 50, 3000)] + ["x" * 30_000, None, "a <|endoftext|>b " * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in registry.QUERIES["op10_bpe"](spark, str(tmp_path)).collect()}
    for i, x in enumerate(texts):
        own = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(own) and got[i].ids_sha256 == hashlib.sha256(np.asarray(own, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_the_encoder_without_shortcuts():
    c, rnd = bpe.Codec(BPE), random.Random(3)
    for _ in range(200):
        piece = "".join(rnd.choice("aeéthing日") for _ in range(rnd.randint(1, 30))).encode()
        assert c._piece(piece) == list(c.piece(piece))
