"""Similar and duplicated code: repeated statement sequences, anti-unified and scored.

Statements are generalised and hashed when a file is parsed. Repeats are grown one statement at
a time: a longer window can recur only where both windows one shorter do, so each round joins
what the round before left. Members of a class meet its first member only, one row each; no
class is ever gathered in one task as whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.operators.cloneparts import pair_runs
from quercus.plans.staging import staged
from quercus.sources.parser import ParseError
from quercus.sources.stages import Stages
from quercus.sources.tokenizer import LexError, scan
from quercus.trees.match import anti_unify, anti_unify_seq, consistent, generalise, node_score, parse_annotated, token_score
from quercus.trees.match import new_vars as count_new
from quercus.trees.render import render


@dataclass(frozen=True)
class CloneParams:
    """At least ``min_len`` statements, ``min_toks`` tokens a member and ``min_freq`` members; at most
    ``max_new_vars`` parameters for differing expressions; ``score`` similarity on both sides."""

    min_len: int = 5
    min_toks: int = 40
    min_freq: int = 2
    max_new_vars: int = 4
    score: float = 0.8


SEQ = ["file_id", "m", "f", "a", "seq_id"]


def repeats(seqs: DataFrame, params: CloneParams = CloneParams(), key: str = "hash") -> DataFrame:
    """``class, len, file_id, m, f, a, seq_id, idx``: members of maximal repeated windows of statements.

    A class is left out if each of its members lies in a class of one statement more.
    """
    w = Window.partitionBy(*SEQ).orderBy("idx").rowsBetween(Window.currentRow, params.min_len - 1)
    win = seqs.withColumn("hs", F.collect_list(key).over(w)).where(F.size("hs") == params.min_len)
    now = win.select(*SEQ, "idx", F.xxhash64("hs").alias("class"))
    out, length = None, params.min_len
    while True:
        several = now.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_freq).select("class")
        now = staged(now.join(several, "class").select(*SEQ, "idx", "class"), "repeats")
        if out is not None:  # what the longer ones cover goes
            inside = now.select(*SEQ, F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("idx")).distinct()
            open_ = last.join(inside, [*SEQ, "idx"], "left_anti").select("class").distinct()
            out[-1] = last.join(open_, "class", "left_semi").withColumn("len", F.lit(length - 1))
        if now.isEmpty():
            break
        out = [*(out or []), now.withColumn("len", F.lit(length))]
        last = now
        nxt = now.select(*SEQ, (F.col("idx") - 1).alias("idx"), F.col("class").alias("tail"))
        now = now.join(nxt, [*SEQ, "idx"]).select(*SEQ, "idx", F.xxhash64("class", "tail").alias("class"))
        length += 1
    if not out:
        return now.withColumn("len", F.lit(0))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return staged(found, "maximal")


def no_overlap(members: DataFrame) -> DataFrame:
    """In order, a member stays if it does not overlap the last of its class and sequence that stayed."""
    own = members.groupBy("class", "len", *SEQ).agg(F.array_sort(F.collect_list("idx")).alias("xs"))
    keep = F.aggregate("xs", F.array().cast("array<int>"), lambda s, x: F.when((F.size(s) == 0) | (x >= F.element_at(s, -1) + F.col("len")), F.concat(s, F.array(x))).otherwise(s))
    return own.select("class", "len", *SEQ, F.explode(keep).alias("idx"))


def texts_of(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """The members with the source, lines and number of tokens of their statements."""
    s = seqs.select(*SEQ, F.col("idx").alias("i"), "text", "ntoks", "start_line", "end_line")
    part = members.withColumn("i", F.explode(F.sequence("idx", F.col("idx") + F.col("len") - 1))).join(s, [*SEQ, "i"])
    return part.groupBy("class", "len", *SEQ, "idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), ", ").alias("text"),
        F.sum("ntoks").alias("ntoks"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
    )


PAIR = "class long, len int, k long, lo int, hi int, whole boolean, m string, f string, a int, start_line int, end_line int, rep string, text string, diffs array<string>, new_vars int"
WHERE = ["m", "f", "a", "start_line", "end_line"]


@lru_cache(maxsize=1 << 14)
def _runs_of(rep: str, text: str, ntoks: int, params: CloneParams) -> tuple[tuple[int, int, tuple[str, ...], int], ...]:
    """Statement runs (from, to, expressions of ``rep`` that differ, new variables) in which two members can be one function.

    The whole, if it passes; else the longest parts that do. Equal pairs are compared once by a worker.
    """
    try:
        a, b = parse_annotated(rep), parse_annotated(text)
    except (LexError, ParseError):
        return ()
    found = anti_unify_seq(a, b)
    if found is not None:
        own = [(render(x), render(y)) for x, y in found]
        if count_new(found) <= params.max_new_vars and min(token_score(ntoks, own, 0), token_score(ntoks, own, 1)) >= params.score:
            diffs = sorted({x for (x, _), (n, o) in zip(own, found, strict=True) if not n.type == o.type == "variable"})
            return ((0, len(a), tuple(diffs), count_new(found)),)
    if len(a) != len(b):
        return ()
    return tuple((r.start, r.end, tuple(sorted({x for d in r.diffs for x, _ in d})), r.new_vars) for r in pair_runs(a, b, params.min_len, params.max_new_vars, params.score) if r.end - r.start < len(a))


def compared(pairs: DataFrame, params: CloneParams = CloneParams()) -> DataFrame:
    """Rows of ``rep`` and ``text`` with the runs of statements in which they unify; pairs without any go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                for lo, hi, diffs, new in _runs_of(r.rep, r.text, int(r.ntoks), params):
                    rows.append((r.cls, r.len, r.k, lo, hi, lo == 0 and hi == r.len, *(getattr(r, c) for c in WHERE), r.rep, r.text, list(diffs), new))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in PAIR.split(", ")])

    return pairs.withColumnRenamed("class", "cls").mapInPandas(run, PAIR)


def similar_code(s: Stages, params: CloneParams = CloneParams()) -> DataFrame:
    """``len, freq, au, n_pars, n_new_vars, members``: clone classes, most frequent and longest first.

    In each class the first member is compared with the others: those that unify with it form a class, those that
    unify in part form classes of that part. It and those that unify as a whole are set aside, and the rest is
    examined alike until fewer than ``min_freq`` remain. ``au`` is the function that generalises a class; classes with
    one generalisation are combined.
    """
    seqs = staged(s.expr_seqs, "seqs")
    members = texts_of(no_overlap(repeats(seqs, params)), seqs).where(F.col("ntoks") >= params.min_toks)
    order = Window.partitionBy("class").orderBy("m", "f", "a", "seq_id", "idx")
    left = staged(members.withColumn("k", F.row_number().over(order).cast("long")), "members")
    found = None
    while True:
        rep = left.groupBy("class").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.min_by("text", "k").alias("rep")).where(F.col("n") >= params.min_freq).drop("n")
        now = staged(left.join(rep, "class").select("class", "len", "k", "first", *WHERE, "ntoks", "rep", "text"), "examined")
        if now.isEmpty():
            break
        near = staged(compared(now.drop("first"), params), "near")
        found = near.withColumn("first", F.lit(None).cast("long")) if found is None else found.unionByName(near.withColumn("first", F.lit(None).cast("long")))
        done = near.where("whole").select("class", "k").union(now.where("k = first").select("class", "k")).distinct()
        left = staged(now.drop("first", "rep").join(done, ["class", "k"], "left_anti"), "members")
    schema = "len int, freq long, au string, n_pars int, n_new_vars int, members array<struct<m:string,f:string,a:int,start_line:int,end_line:int>>"
    if found is None:
        return seqs.sparkSession.createDataFrame([], schema)
    part = F.struct(*WHERE)
    classes = found.groupBy("class", "rep", "lo", "hi").agg(F.countDistinct("k").alias("freq"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("diffs")))).alias("diffs"), F.array_sort(F.collect_set(part)).alias("members"))
    classes = classes.withColumn("len", F.col("hi") - F.col("lo")).where((F.col("freq") >= params.min_freq) & (F.size("diffs") <= params.max_new_vars))
    classes = _generalised(classes)
    same = classes.groupBy("au", "n_pars", "n_new_vars", "len").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    return same.select("len", F.size("members").alias("freq"), "au", "n_pars", "n_new_vars", "members").orderBy(F.desc("freq"), F.desc("len"), "au")


def _generalised(classes: DataFrame) -> DataFrame:
    schema = "len int, freq long, au string, n_pars int, n_new_vars int, members array<struct<m:string,f:string,a:int,start_line:int,end_line:int>>"

    @F.udf("au string, n_pars int, n_new_vars int")
    def make(rep: str, lo: int, hi: int, diffs: list[str]):  # one call per class
        body = parse_annotated(rep)[lo:hi]
        own = {x.lo: x for n in body for x in n.walk() if render(x) in set(diffs)}
        return generalise(body, [[(x, x) for x in own.values()]])

    return classes.withColumn("g", make("rep", "lo", "hi", "diffs")).select("len", "freq", "g.au", "g.n_pars", "g.n_new_vars", "members").to(_schema(schema))


def _schema(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


def identical_expressions(s: Stages, least: int = 2, min_toks: int = 5) -> DataFrame:
    """Statements equal but for names and literals, with equal binding structure."""
    e = s.expr_seqs.where(F.col("ntoks") >= min_toks)
    return e.groupBy("hash", "binding").agg(F.count("*").alias("freq"), F.min("text").alias("example")).where(F.col("freq") >= least).select("hash", "freq", "example")


def similar_expressions(s: Stages, code: str, score: float = 0.8) -> DataFrame:
    """Statements that anti-unify with the given one, with the node-based score on both sides."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (want,) = parse_annotated(code)
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    found = parse_annotated(r.text)
                except (LexError, ParseError):
                    continue
                pairs = anti_unify(want, found[0]) if len(found) == 1 and found[0].type == want.type else None
                if pairs is not None and consistent(pairs):
                    rows.append((r.m, r.f, r.a, r.start_line, r.text, min(node_score([want], pairs, 0), node_score(found, pairs, 1))))
            yield pd.DataFrame(rows, columns=["m", "f", "a", "line", "text", "score"])

    return s.expr_seqs.select("m", "f", "a", "start_line", "text").mapInPandas(run, "m string, f string, a int, line int, text string, score double").where(F.col("score") >= score)


CLASSES = {"variable": "V", "var": "V", "atom": "A", "integer": "I", "float": "F", "string": "S", "char": "C"}


def _levels(toks: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``file_id, seq, line, col, h0 .. hk``: hashes of 1, 2, 4 and so on abstracted tokens from each place, up to ``most``."""
    letter = F.lit(None).cast("string")
    for k, v in CLASSES.items():
        letter = F.when(F.col("kind") == k, v).otherwise(letter)
    by = Window.partitionBy("file_id").orderBy("seq")
    t = toks.select("file_id", "seq", "line", "col", F.xxhash64(F.coalesce(letter, "value")).alias("h0"))
    k = 0
    while 1 << (k + 1) <= most:
        nxt = F.lead(f"h{k}", 1 << k).over(by)
        t = t.withColumn(f"h{k + 1}", F.when(nxt.isNotNull(), F.xxhash64(f"h{k}", nxt)))
        k += 1
    return staged(t, "token-hashes"), k


def duplicated_code(toks: DataFrame, min_toks: int = 40, min_freq: int = 2) -> DataFrame:
    """``class, len, file_id, first, last, line``: members of maximal repeats of at least ``min_toks`` abstracted tokens (class letters).

    How far each place repeats is found bit by bit, the longest first: the longest window there that another place has
    too. A place that goes on leaves its shadow among those that do not, as it shares their windows still. A place
    begins a clone if the place before it does not repeat one token further; its class is all places, shadows
    included, that have its window. Rounds: one for each bit of the longest file.
    """
    longest = toks.groupBy("file_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    t, top = _levels(toks, max(1, longest))
    now = t.select("file_id", "seq", F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("real"))
    for k in range(top, -1, -1):
        part = t.where(F.col(f"h{k}").isNotNull()).select("file_id", F.col("seq").alias("at"), F.col(f"h{k}").alias("more"))
        can = now.withColumn("at", F.col("seq") + F.col("len")).join(part, ["file_id", "at"], "left").withColumn("to", F.when(F.col("more").isNotNull(), F.xxhash64("h", "more")))
        often = can.where("to is not null").groupBy("len", "to").agg(F.count("*").alias("n"), F.bool_or("real").alias("any")).where((F.col("n") >= min_freq) & F.col("any"))
        can = staged(can.join(often.select("len", "to", F.lit(True).alias("ok")), ["len", "to"], "left"), "token-steps")
        on = can.where("ok").select("file_id", "seq", (F.col("len") + (1 << k)).alias("len"), F.col("to").alias("h"), "real")
        here = can.select("file_id", "seq", "len", "h", (F.col("real") & F.col("ok").isNull()).alias("real"))
        alive = here.where("real").select("len", "h").distinct()
        now = staged(on.union(here.join(alive, ["len", "h"], "left_semi").select(on.columns)), "token-repeats")
    own = now.where(F.col("len") >= min_toks)
    before = own.where("real").select("file_id", (F.col("seq") + 1).alias("seq"), (F.col("len") - 1).alias("was"))
    start = own.where("real").join(before, ["file_id", "seq"], "left").where("was is null or was < len")
    named = own.join(start.select("len", "h").distinct(), ["len", "h"], "left_semi").join(t.select("file_id", "seq", "line"), ["file_id", "seq"])
    return named.select(F.col("h").alias("class"), "len", "file_id", F.col("seq").alias("first"), (F.col("seq") + F.col("len") - 1).alias("last"), "line")


def trimmed_clones(members: DataFrame, toks: DataFrame, nodes: DataFrame, min_freq: int = 2) -> DataFrame:
    """``class, part, file_id, start_line, end_line, text``: token clones cut down to whole expressions and functions.

    The outermost such nodes that lie inside a member's tokens; a part is a member's k-th one, and stays if enough
    members of the class have it with the same type.
    """
    at = toks.select("file_id", "seq", "line", "col")
    span = members.join(at.select("file_id", F.col("seq").alias("first"), F.struct("line", "col").alias("lo")), ["file_id", "first"])
    span = span.join(at.select("file_id", F.col("seq").alias("last"), F.struct("line", "col").alias("hi")), ["file_id", "last"])
    unit = nodes.where("category = 'expression' or type = 'function'").select("file_id", "pre", "post", "type", "text", "start_line", "end_line", F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("col")).alias("a"), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col")).alias("z"))
    # the end of a node must lie before the token after the last one: compare with the last token's own start
    inside = span.join(unit, "file_id").where("a >= lo and struct(z.line, z.col) >= struct(a.line, a.col) and a <= hi").where("z.line < hi.line or (z.line = hi.line and z.col <= hi.col + 200)")
    last = at.select("file_id", F.col("seq").alias("after"), F.struct("line", "col").alias("next"))
    inside = inside.withColumn("after", F.col("last") + 1).join(last, ["file_id", "after"], "left").where("next is null or struct(z.line, z.col) < next")
    by = Window.partitionBy("class", "file_id", "first").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    outer = inside.withColumn("reach", F.max("post").over(by)).where("reach is null or pre > reach")
    part = F.row_number().over(Window.partitionBy("class", "file_id", "first").orderBy("pre"))
    cut = outer.withColumn("part", part).select("class", "part", "type", "file_id", "start_line", "end_line", "text")
    often = cut.groupBy("class", "part", "type").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq).drop("n")
    return cut.join(often, ["class", "part", "type"]).select("class", "part", "file_id", "start_line", "end_line", "text")


def generalised_parts(parts: DataFrame, max_pars: int = 5) -> DataFrame:
    """``class, part, file_id, start_line, n_pars``: parts that anti-unify with the class's first, and the parameters that takes; more than ``max_pars`` go."""
    rep = parts.groupBy("class", "part").agg(F.min_by("text", F.struct("file_id", "start_line")).alias("rep"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    found = anti_unify_seq(parse_annotated(r.rep), parse_annotated(r.text))
                except (LexError, ParseError):
                    continue
                if found is not None:
                    rows.append((r.cls, r.part, r.file_id, r.start_line, len({render(x) for x, y in found if not x.type == y.type == "variable"})))
            yield pd.DataFrame(rows, columns=["class", "part", "file_id", "start_line", "n_pars"])

    out = parts.join(rep, ["class", "part"]).withColumnRenamed("class", "cls").mapInPandas(run, "class long, part int, file_id long, start_line int, n_pars int")
    kept = staged(out.where(F.col("n_pars") <= max_pars), "parts")
    several = kept.groupBy("class", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return kept.join(several, ["class", "part"])


def duplicates_report(toks: DataFrame, min_toks: int = 40, min_freq: int = 2, least_toks: int = 10) -> DataFrame:
    """As :func:`duplicated_code` for the command line: too small a length falls back to 40 tokens, a frequency below 2 to 2."""
    return duplicated_code(toks, min_toks if min_toks > least_toks else 40, max(2, min_freq))


def evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """``au, status``: classes of two revisions by their generalisation: new, vanished, unchanged, changed+ / changed- / changed+-.

    Members are compared by function, as lines move.
    """
    where = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.concat(x["m"], F.lit(":"), x["f"], F.lit("/"), x["a"].cast("string")))))
    a, b = before.select("au", where("members").alias("was")), after.select("au", where("members").alias("now"))
    gone, came = F.size(F.array_except("was", "now")), F.size(F.array_except("now", "was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "vanished").when((gone == 0) & (came == 0), "unchanged")
    status = status.when(gone == 0, "changed+").when(came == 0, "changed-").otherwise("changed+-")
    return a.join(b, "au", "full").select("au", status.alias("status"))


def report(classes: DataFrame) -> DataFrame:
    """One line per class; order by ``freq`` or ``len`` as wanted."""
    return classes.select("freq", "len", F.format_string("%d times: %d statements, %d parameters, %d new: %s", "freq", "len", "n_pars", "n_new_vars", "au").alias("line"))
