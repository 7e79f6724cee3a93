import random
import re
import subprocess
import sys
import tracemalloc

from quercus.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text, rules):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    tri = [tuple(w[i : i + 3]) for i in range(n - 2)]
    cov = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    best = [max((k for j in range(n) if j != i for k in [next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), 0)]), default=0) for i in range(n)]
    span = {i + k for i, b in enumerate(best) if b >= rules.min_span for k in range(b)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = n < 50 or 100 * len(cov) > 50 * n
    kept = not failed and len(span) / n <= rules.max_fraction and max(best, default=0) <= rules.max_longest
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cov), failed, kept


def check(texts, rules=q.RepetitionRules(), **more):
    m = q.measure(texts, rules, **more)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for i, t in enumerate(texts):
        assert tuple(m[k][i] for k in names) == brute(t, rules), repr(t)


def test_brute_force():
    rnd = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a a a a a", "x\x1cy z \x0bq", "é ü\né ü\n \né ü"]
    for k in range(150):
        vocab = ["a", "b", "c*", "<d>", "é"][: rnd.randint(1, 5)] + [f"w{j}" for j in range(rnd.choice([0, 3, 80]))]
        texts.append(rnd.choice(["", "\n"]).join(rnd.choice(vocab) + rnd.choice([" ", "  ", "\n", "\t"]) for _ in range(rnd.randint(0, 90))))
    check(texts)
    texts += ["averyverylongword shortone averyverylongword\x00 a\x00 a a\x00\x00", "abcdefg abcdefgh abcdefg abcdefgh abcdefg"]
    check(texts, q.RepetitionRules(3, 0.6, 8))
    check(texts, levels_up_to=0)  # the walk over the text in place of kept levels


def test_rejects_what_repeats():
    clean = " ".join(f"w{i}" for i in range(200))
    part = " ".join(f"v{i}" for i in range(40))
    spaced = " ".join(f"{part} u{k}a u{k}b u{k}c" for k in range(2))
    m = q.measure([clean, part + " " + clean, spaced], q.RepetitionRules())
    assert m["kept"].tolist() == [True, True, False]


def test_frame(spark):
    rows = [(1, "a " * 60, "x"), (1, "a " * 60, "x"), (None, None, None), (2, " ".join(f"w{i}" for i in range(70)), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = q.quality_rules(df).select("doc_id", "n_words", "kept").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 60, False), (1, 60, False), (2, 70, True), (None, 0, False)]
    good = q.keep_good(df)
    assert good.schema == df.schema and [r.doc_id for r in good.collect()] == [2]
    assert q.quality_rules(df.limit(0)).count() == 0


def test_very_long_text_and_many_repeats():
    """Rows that repeat a word pair (2 MB), and one text of 20 MB of repeats: memory stays in proportion to the text."""
    rows = ["ab cd " * 200] * (q.PART // 1200)
    tracemalloc.start()
    m = q.measure(rows, q.RepetitionRules())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(m["longest_repeat"].tolist()) == {398} and peak < 100e6
    code = """if True:
        import resource
        from quercus.llm import quality_rules as q
        text = "ab cd ef gh " * (20_000_000 // 12)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        m = q.measure([text], q.RepetitionRules())
        print(m["n_words"][0], m["n_repeat_words"][0], m["longest_repeat"][0], m["kept"][0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    n = 20_000_000 // 12 * 4
    assert out[:4] == [str(n), str(n), str(n - 4), "False"] and int(out[4]) < 900


def test_keep_good_judges_rows(spark):
    clean = " ".join(f"w{i}" for i in range(70))
    rows = [(1, clean, "a"), (1, "few", "b"), (None, clean, "c"), (2, None, "d"), (2, "", "e"), (1, clean, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert sorted((r.doc_id or 0, r.kept) for r in q.keep_good(df).collect()) == [(0, "c"), (1, "a"), (1, "a")]
    assert q.keep_good(df.limit(0)).count() == 0
