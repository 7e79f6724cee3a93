import hashlib
import random
import zlib
from collections import defaultdict

from quercus.llm import sharding as s


def optimum(sizes, n):
    low, high = max(sizes, default=1), max(1, sum(sizes))
    low = max(low, 1)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for x in sizes:
            if at + x > mid:
                used, at = used + 1, 0
            at += x
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


def test_minimax_equals_plain_search():
    rnd = random.Random(1)
    for case in range(60):
        groups = {f"{rnd.getrandbits(16):04x}": rnd.choice([1, 3, 50, 2000 if case % 3 == 0 else 7]) for _ in range(rnd.randint(1, 400))}

        def sums(length, names=None, groups=groups):
            out = defaultdict(lambda: [0, 0])
            for k, b in groups.items():
                if names is None or k[: length - 1] in names:
                    out[k[:length]][0] += b
                    out[k[:length]][1] += 1
            return [(k, *v) for k, v in out.items()]

        def split(names, sums=sums):
            return [r for n in {len(x) for x in names} for r in sums(n + 1, {x for x in names if len(x) == n})]

        for n in (1, 2, 8):
            capacity, starts = s.minimax(sums(1), split, n)
            sizes = [groups[k] for k in sorted(groups)]
            assert capacity == optimum(sizes, n)
            shards = defaultdict(int)
            for k, b in groups.items():
                shards[sum(k >= x for x in starts)] += b
            assert max(shards.values()) <= capacity and len(starts) < n


def test_frame(spark):
    rnd = random.Random(2)
    texts = [None, "", "null text", "é" * 40, "hot " * 30] + [f"text {i} " * rnd.randint(1, 9) for i in range(80)]
    rows = [(i, texts[4] if i % 3 == 0 else rnd.choice(texts)) for i in range(400)] + [(None, None), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, size int, key string")
    got = s.shard(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    where, slots, size = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        where[(r.text_crc32, r.size)].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(len(v) <= (2 if k == (0, 1) else 1) for k, v in where.items())
    groups = defaultdict(int)
    for _, t in rows:
        groups[s.NULL if t is None else hashlib.sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 1
    assert max(size.values()) == optimum([groups[k] for k in sorted(groups)], 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) <= 7
    assert s.shard(df.limit(0)).count() == 0
