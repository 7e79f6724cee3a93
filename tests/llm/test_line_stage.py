import corpus_pipeline


def lines_of(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return [r.text for r in corpus_pipeline.lines(spark, df, "").orderBy("doc_id").collect()]


def test_short_lines_take_part(spark):
    cjk = "日本語の文が空白なしで続く"
    texts = [f"Body {w}\nAll rights reserved.\n\n{cjk}\nPage {k} of 9\n{k}{k}\n{cjk}{k}" for k, w in enumerate(["one", "two", "three", "four"])]
    want = [f"Body {w}\n\n{k}{k}\n{cjk}{k}" for k, w in enumerate(["one", "two", "three", "four"])]
    assert lines_of(spark, texts) == [texts[0], *want[1:]]
    assert lines_of(spark, texts[:2]) == texts[:2]


def test_a_shared_head_makes_no_template(spark):
    heads = [f"This is a {x}" for x in ("red barn.", "cold night.", "long road.", "small boat.")]
    posts = [f"Posted on the {k} by {x} in the shop" for k, x in enumerate(("anna", "bob", "carl", "dora"))]
    texts = [f"{a}\n{b}" for a, b in zip(heads, posts, strict=True)]
    assert lines_of(spark, texts) == [texts[0], *heads[1:]]
