import random

import corpus_pipeline
from quercus.llm import near_copies as nc
from quercus.llm import simhash

from .test_dedup import passage
from .test_simhash import brute_components, brute_fp


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows, ordered=False):
    root = list(range(len(rows)))
    sets = [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    if ordered:
        return root
    return {(i, least[r]) for (i, _), r in zip(rows, root, strict=True)}


def corpus():
    rnd = random.Random(12)
    rows = []
    for k in range(12):
        base = passage(rnd, 100).split()
        for j in range(12):  # from close to under the similarity
            new = list(base)
            for _ in range(j % 5):
                new[rnd.randrange(100)] = passage(rnd, 1) + "x"
            rows.append((100 * k + j, " ".join(new)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "two words"), (3004, "two  words"), (3005, "Ünique words")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, c in want}) > 14  # some copies stay apart
    for crowded in (32, 2):
        assert {tuple(r) for r in nc.near_copies(df, crowded=crowded).collect()} == want


def test_the_stage_drops_near_copies(spark):
    """Two changed words of 120: similarity over 0.8, and more than three bits of a fingerprint apart."""
    rnd = random.Random(13)
    rows = []
    for k in range(6):
        base = passage(rnd, 120).split()
        rows += [(k, " ".join(base)), (100 + k, " ".join([*base[:40], "new", *base[41:80], "other", *base[81:]]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, df, "").collect()} == set(range(6))


def test_the_stage_drops_what_fingerprints_link(spark):
    """Op9 links these at three bits or fewer, though their similarity is under 0.8; the others it leaves apart."""
    rnd = random.Random(16)
    rows, want = [], set()
    for k in range(4):
        base = passage(rnd, 100).split()
        near = []
        while len(near) < 2:
            new = list(base)
            for at in rnd.sample(range(100), 3):
                new[at] = passage(rnd, 1) + "x"
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(new))
            if 5 * len(a & b) < 4 * len(a | b) and (brute_fp(" ".join(base)) ^ brute_fp(" ".join(new))).bit_count() <= 3:
                near.append(" ".join(new))
        close = near[0].split()  # similar to a text that only its fingerprint links
        close[50] = "close"
        rows += [(10 * k + 3, " ".join(base)), (10 * k + 1, near[0]), (10 * k + 2, near[1]), (10 * k + 4, " ".join(close)), (10 * k + 5, passage(rnd, 100))]
        want |= {10 * k + 1, 10 * k + 5}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in simhash.near_duplicates(df.where("doc_id % 10 < 4")).collect()} == {i for i in want if i % 10 == 1}
    assert {r.doc_id for r in nc.keep_one(df).collect()} > want  # by similarity alone they stay
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, df, "").collect()} == want


def test_links_of_both_kinds_equal_brute_force(spark):
    rows = corpus()
    least = {}
    pairs = sorted(brute(rows)) + list(zip([i for i, _ in rows], brute_components([i for i, _ in rows], [brute_fp(t) for _, t in rows]), strict=True))
    for i, c in pairs:  # union of the two partitions
        a, b = least.setdefault(i, i), least.setdefault(c, c)
        least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (32, 2):
        assert {tuple(r) for r in nc.near_copies(df, crowded=crowded, radius=3).collect()} == set(least.items())


def test_repeated_ids_with_unlike_texts(spark):
    """A row goes only for its own text: what another row of its id says does not count."""
    rnd = random.Random(14)
    x, u, a, b = (passage(rnd, 80) for _ in range(4))
    rows = [(1, x, "p"), (2, x, "p"), (2, u, "p"), (7, a, "p"), (7, b, "p"), (7, b, "o"), (None, x, "p"), (None, "alone", "q"), (None, "alone", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    want = sorted([(1, x, "p"), (2, u, "p"), (7, a, "p"), (7, b, "o"), (None, "alone", "p")], key=str)
    for keep in (nc.keep_one, simhash.keep_one):
        got = keep(df)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == want
        assert keep(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.distinct(spark, docs, "").collect()), key=str) == want


def test_a_hot_text_and_a_hot_near_copy(spark):
    rnd = random.Random(15)
    hot = passage(rnd, 60)
    rows = [(i, hot) for i in range(3000)] + [(5000 + i, " ".join([*hot.split()[:59], f"v{i}"])) for i in range(300)] + [(9000 + i, passage(rnd, 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nc.keep_one(df).collect()) == [0, *range(9000, 9040)]
