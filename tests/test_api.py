"""The workspace, and counts kept over a stream."""

from quercus.api import Workspace
from quercus.plans import corpus
from quercus.streaming.state import repeated_statements


def content(w, module):
    return w.files.where(f"module = '{module}'").first().content


def test_workspace(spark, tmp_path):
    w = Workspace.of(spark, corpus.FILES)
    w.rename_function("counter", "add", 2, "plus")
    assert "plus(A, B)" in content(w, "counter") and "counter:plus(X, 1)" in content(w, "ledger") and w.refused.count() == 0
    assert {r.caller for r in w.callers("counter", "plus", 2).where("sure").collect()} == {"ledger:same/1", "router:dispatch/3"}
    w.rename_function("table", "log", 2, "insert")  # forbidden: nothing changes
    assert [r.error for r in w.refused.collect()] == ["the name is in scope"] and "log(What, Key)" in content(w, "table")
    w.rename_module("table", "store")
    assert w.files.where("path = 'src/store.erl' and module = 'store'").count() == 1 and "store:lookup(Node)" in content(w, "router")
    w.copy_module("store", "depot")
    assert w.files.count() == 6 and "-module(depot)" in content(w, "depot")
    assert {(r.path, r.status) for r in w.changed_since(1).collect() if r.status != "unchanged"} == {("src/depot.erl", "new")}
    assert [w.undo() for _ in range(5)] == ["copy module", "rename module", "rename function", "rename function", None]
    assert {r.path: r.content for r in w.files.collect()} == corpus.FILES
    w.migrate("dict to maps")
    w.save(f"{tmp_path}/out")
    saved = {r.path: r.content for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert "maps:put(key, 1, D)" in saved["src/router.erl"]


def test_counts_over_a_stream(spark, tmp_path):
    rows = [[("a", "x"), ("b", "y")], [("a", "w"), ("c", "z")], [("a", "x"), ("b", "v")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "hash string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    stream = spark.readStream.schema("hash string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = repeated_statements(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((h, n, fresh) for h, n, _, fresh in seen) == [("a", 2, True), ("a", 3, False), ("b", 2, True)]
