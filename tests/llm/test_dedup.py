import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from quercus.llm import line_dedup as ld
from quercus.llm import substring_dedup as sd


def brute_chunks(t):
    """(start, end, following start) with a plain loop."""
    b = t.encode()
    word = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    out, first, hs = [], None, []
    for _, e in word:
        h = 0
        for x in b[max(0, e - 8) : e]:
            h = ((h << 1) + int(sd._GEAR[x])) & 0xFFFFFFFF
        hs.append(h >> 8)
    mixed = [h * 0x9E3779B1 & 0xFFFFFFFF for h in hs]
    for k, (a, e) in enumerate(word):
        first = a if first is None else first
        least = all(mixed[k] < x for x in mixed[max(0, k - sd.AROUND) : k]) and all(mixed[k] <= x for x in mixed[k + 1 : k + 1 + sd.AROUND])
        if hs[k] % sd.EVERY == 0 or least or k == len(word) - 1:
            nxt = word[k + 1][0] if k + 1 < len(word) else len(b)
            out.append((first, e, nxt))
            first = None
    return out


def brute_runs(t, least):
    """(first chunk, last chunk, bytes) of the run from each chunk on that first has ``least`` bytes."""
    c, b = brute_chunks(t), t.encode()
    out = []
    for i in range(len(c)):
        j = next((j for j in range(i, len(c)) if c[j][1] - c[i][0] >= least), None)
        if j is not None:
            out.append((i, j, b[c[i][0] : c[j][1]]))
    return out


def brute_dedup(rows, least):
    by = [(i, t, brute_chunks(t or ""), brute_runs(t or "", least)) for i, t in rows]
    owner = {}
    for i, _, _, runs in by:
        for *_, x in runs:
            if i is not None:
                owner[x] = min(owner.get(x, i), i)
    out = []
    for i, t, c, runs in by:
        if t is None:
            out.append((i, t))
            continue
        seen, gone = set(), set()
        for a, z, x in runs:
            if x in seen or (i is not None and owner[x] < i):
                gone.update(range(a, z + 1))
            seen.add(x)
        b, kept, at, k = t.encode(), b"", 0, 0
        while k < len(c):
            j = k
            while j < len(c) and j in gone:
                j += 1
            if j > k:
                kept += b[at : c[k][0]]
                at = c[j - 1][2]
            k = max(j, k + 1)
        out.append((i, (kept + b[at:]).decode()))
    return out


def passage(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def test_chunks_equal_the_plain_loop():
    rnd = random.Random(1)
    texts = ["", " ", "a", " a\n b ", *(rnd.choice(["", " "]) + passage(rnd, rnd.randint(0, 60)).replace(" ", rnd.choice([" ", "\n", "  "])) for _ in range(60))]
    o, a, e, f, i, j, d, c = sd.chunks([t.encode() for t in texts])
    assert list(zip(o.tolist(), a.tolist(), e.tolist(), f.tolist(), strict=True)) == [(k, *c) for k, t in enumerate(texts) for c in brute_chunks(t)]
    first = np.searchsorted(o, np.arange(len(texts)))
    want = [(k, x, y, xxhash.xxh64_intdigest(z, seed=7), xxhash.xxh64_intdigest(z, seed=11) & 0xFFFFFFFF) for k, t in enumerate(texts) for x, y, z in brute_runs(t, sd.LEAST)]
    assert [(k, x - first[k], y - first[k], z, w) for k, x, y, z, w in zip(o[i].tolist(), i.tolist(), j.tolist(), d.tolist(), c.tolist(), strict=True)] == want


def test_long_text_without_white_space():
    rnd = random.Random(2)
    t = "".join(rnd.choice("日本語éab") for _ in range(4000))
    _, a, e, *_ = sd.chunks([t.encode()])
    assert len(a) > 20 and (a[1:] == e[:-1]).all()
    for x, y in zip(a, e, strict=True):
        t.encode()[x:y].decode()
    found = sd.strip([t, "xy" + t[1:]], [None, np.unique(sd.chunks([t.encode()])[6])])
    assert len(found[1][0]) < 400


def test_phrases_alone_are_no_repeats():
    """Texts put together of phrases that other texts have too, in another order: nothing is removed."""
    rnd = random.Random(11)
    phrases = [passage(rnd, 5) for _ in range(40)]
    texts = [" ".join(rnd.sample(phrases, 12)) for _ in range(12)]
    known = np.unique(np.concatenate([sd.chunks([t.encode()])[6] for t in texts[:11]]))
    assert sd.strip([texts[11]], [known])[0][0] == texts[11]


def test_planted_passages(spark):
    rnd = random.Random(3)
    shared = [passage(rnd, 60) for _ in range(5)]
    rows = [(i, " ".join([passage(rnd, 80), shared[i % 5], passage(rnd, 80)])) for i in range(25)]
    rows += [(100 + i, passage(rnd, 150)) for i in range(10)] + [(200, rows[3][1]), (201, None), (None, rows[3][1]), (202, ""), (200, rows[3][1]), (203, (shared[0] + "\n") * 3)]
    df = spark.createDataFrame([(i, "x", t, 1) for i, t in rows], "doc_id long, dup string, text string, n_chunks int")
    got = sd.dedup(df)
    assert got.columns == ["doc_id", "dup", "text", "n_chunks", "n_chunks_", "removed_chunks", "removed_bytes"]
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert got == sorted(brute_dedup(rows, sd.LEAST), key=str)
    text = dict(got)
    for i in range(5, 25):  # the middle of each planted passage stays in one document only
        assert " ".join(shared[i % 5].split()[20:40]) not in text[i]
    assert all(text[100 + i] == rows[25 + i][1] for i in range(10)) and text[200] == ""
    assert sd.dedup(df.limit(0)).count() == 0


def brute_lines(rows, min_docs):
    def toks(line):
        w = line.translate(str.maketrans("\t\r\x0b\x0c", "    ")).strip(" ").split(" ")
        digit = [bool(re.search("[0-9]", x)) for x in w]
        if len(w) < ld.MIN_TOKENS and all(d or not x for x, d in zip(w, digit, strict=True)):
            return w
        return [ld.ANY if d else x for x, d in zip(w, digit, strict=True)]

    def enough(common, n):
        return common >= ld.STAY * n and 2 * (common - ld.DEPTH) >= n - ld.DEPTH

    lines = [(i, p, tuple(toks(x))) for i, t in rows if t is not None and i is not None for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    leaf = {t: (len(t), t[: ld.DEPTH]) if len(t) >= ld.MIN_TOKENS else t for *_, t in lines}
    tmpl = {}
    for depth in range(2):
        groups = defaultdict(set)
        for t, k in leaf.items():
            groups[k].add(t)
        for k, v in groups.items():
            if len(v) < 3:
                continue
            count = Counter((j, w) for t in v for j, w in enumerate(t))
            kinds = Counter(j for j, _ in count)
            place = min(((n, j) for j, n in kinds.items() if j >= ld.DEPTH and n > 1), default=(0, None))[1]
            for t in v:
                g = tuple((j, w) for j, w in enumerate(t) if 2 * count[j, w] >= len(v))
                if enough(len(g), len(t)):
                    tmpl[t] = (k, g)
                    del leaf[t]
                else:
                    leaf[t] = (k, place, t[place])
    docs, first = defaultdict(set), {}
    for i, p, t in lines:
        g = tmpl.get(t, t)
        docs[g].add(i)
        first[g] = min(first.get(g, (i, p)), (i, p))
    gone = {(i, p) for i, p, t in lines if len(docs[tmpl.get(t, t)]) >= min_docs and first[tmpl.get(t, t)] != (i, p)}
    return [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in rows]


def test_line_dedup(spark):
    rnd = random.Random(4)
    fixed = ["All rights are reserved by us", "Posted on 2024-01-{} by the user{}", "Read more about {} in our shop today", "Too short line", "x y z a b c d"]
    rows = []
    for i in range(60):
        own = [passage(rnd, rnd.randint(1, 12)) for _ in range(rnd.randint(0, 4))]
        own += [rnd.choice(fixed).format(rnd.randrange(10, 30), rnd.choice(["1", "anna", "bob"])) + rnd.choice(["", " ", "\t"]) for _ in range(rnd.randint(0, 4))]
        own += [" ".join(["same", "head", "here", *(rnd.choice("pq") for _ in range(3))]) for _ in range(rnd.randint(0, 2))]
        rnd.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(70, None), (None, rows[2][1]), (71, ""), (5, rows[5][1]), (72, rows[5][1] + "\n" + rows[6][1])]
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in rows], "doc_id long, text string, drop string, n_lines int")
    for least in (2, 3, 8):
        got = ld.dedup(df, least)
        assert got.columns == ["doc_id", "text", "drop", "n_lines", "n_lines_", "dropped_lines"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute_lines(rows, least), key=str)
    assert ld.dedup(df.limit(0)).count() == 0


def test_several_templates_in_a_leaf(spark):
    """Three families of one head and length, none of them half of the leaf, next to lines that share the head alone."""
    rnd = random.Random(6)
    kinds = ["see also our page {} for more news today", "see also our shop {} with all new things", "see also our team {} and its old friends"]
    rows = []
    for i in range(24):
        own = [k.format("".join(rnd.choice("abcdefgh") for _ in range(6))) for k in kinds]
        rows.append((i, "\n".join([*own, "see also our " + passage(rnd, 6)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ld.dedup(df).select("doc_id", "text").collect()))
    assert got == sorted(brute_lines(rows, 3))
    assert all(len(t.split("\n")) == (4 if i == 0 else 1) for i, t in got)


def test_recall_of_passages_of_51_words():
    rnd = random.Random(7)
    bare = share = 0
    for _ in range(400):
        shared = passage(rnd, 51)
        one, two = (" ".join([passage(rnd, 40), shared, passage(rnd, 40)]) for _ in range(2))
        dup = np.unique(sd.chunks([one.encode()])[6])
        left = sd.strip([two], [dup])[0][0]
        lost = (len(two) - len(left)) / len(shared)
        bare += lost == 0
        share += lost
    assert bare == 0 and share / 400 > 0.85
