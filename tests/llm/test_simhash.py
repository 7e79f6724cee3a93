import random

import numpy as np
import xxhash

from quercus.llm import simhash as s


def test_xxh64_equals_the_library():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(5000))
    spans = [(rnd.randrange(0, 4000), n) for n in [*range(0, 140), *(rnd.randrange(0, 900) for _ in range(200))]]
    got = s.xxh64(np.frombuffer(data, np.uint8), np.array([a for a, _ in spans]), np.array([n for _, n in spans]))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], seed=42) for a, n in spans]


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rnd = random.Random(2)
    texts = [None, "", "  ", "One", "Two Words", "ÉA É x", "a\x1cb c d e f"]
    texts += [" ".join(rnd.choice(["The", "cat", "w" * 40, "é", "sat"]) + str(rnd.randrange(9)) for _ in range(rnd.randrange(60))) for _ in range(80)]
    assert s.simhashes(texts).tolist() == [brute_fp(t) for t in texts]


def test_masks_cover_every_pair():
    rnd = random.Random(4)
    for bits in (list(range(64)), list(range(1, 61, 2)), list(range(14))):
        masks = s.covering(bits, 3)
        for _ in range(3000):
            d = sum(1 << b for b in rnd.sample(bits, rnd.randint(1, 3)))
            assert any(not d & m for m in masks)


def brute_components(ids, fps):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in root]


def test_components_from_fingerprints(spark):
    rnd = random.Random(5)
    fps = {0}
    while len(fps) < 250:  # chains and crowded balls
        x = rnd.choice(sorted(fps)[:40]) if rnd.random() < 0.8 else rnd.getrandbits(64)
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(signed, fps)
    for crowded in (256, 4):
        got = dict(map(tuple, s.components(s.links(nodes, 3, crowded)).collect()))
        assert [got.get(x, x) for x in signed] == want


def test_frame(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base + " end"), (7, None), (8, " "), (2, "other words here"), (None, "lonely text row"), (5, base)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(map(tuple, s.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components([r[0] if r[0] is not None else 10**9 for r in rows], fps)
    assert got == sorted([(r[0], f"{f:016x}", None if c == 10**9 else c) for r, f, c in zip(rows, fps, comp, strict=True)], key=str)
    assert s.near_duplicates(df.limit(0)).count() == 0
