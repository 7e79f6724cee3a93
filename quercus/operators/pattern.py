"""Declarative tree queries and conditional rewrites over a code base.

``collect`` runs collectors (template, condition, projection) over all files
with a full or stopping top-down traversal; ``transform`` applies rules with a
full top-down, stopping top-down or bottom-up strategy and splices the changed
spans into the source. Names that a template demands are first looked for in
the text, on the JVM side, so that only files that can match are parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.operators.edits import Refused
from quercus.sources.parser import Node, parse_forms
from quercus.sources.tokenizer import LexError
from quercus.trees.annotate import Module, annotate, calls_in, name_of
from quercus.trees.match import Binding, first_match, is_meta, match, match_list, substitute, template
from quercus.trees.render import render, splice


@dataclass(frozen=True)
class Context:
    """What a condition or projection may look at beside its binding."""

    module: Module
    form: Node
    node: Node
    text: str
    exports: frozenset = frozenset()

    def source(self, n: Node) -> str:
        return self.text[n.lo : n.hi]


Condition = Callable[[Binding, Context], bool]


def _words(trees: list[Node]) -> list[str]:
    return sorted({n.value for t in trees for n in t.walk() if n.type == "atom" and not is_meta(n) and n.value.isidentifier()})


@dataclass(frozen=True)
class Collector:
    """Matches ``code`` where ``cond`` holds and emits ``emit`` (by default the source of the match)."""

    code: str
    emit: Callable[[Binding, Context], str] | None = None
    cond: Condition | None = None
    name: str = ""

    def trees(self) -> list[Node]:
        found = template(self.code)
        if len(found) == 1 and is_meta(found[0]) and self.cond is None:
            raise ValueError("a template that matches everything needs a condition")
        return found


@dataclass(frozen=True)
class FunApply:
    """Any application of m:f/a: direct, qualified, through apply, spawned, or as an implicit fun."""

    m: str
    f: str
    a: int
    name: str = ""


@dataclass(frozen=True)
class Rule:
    """Rewrites matches of ``before`` to ``after`` (code with the same meta-variables, or a function) where ``cond`` holds."""

    before: str
    after: str | Callable[[Binding, Context], str | None]
    cond: Condition | None = None

    def rewrite(self, trees: list[Node], n: Node, ctx: Context) -> str | None:
        if len(trees) != 1:
            return None
        for b in match(trees[0], n):
            if self.cond is None or self.cond(b, ctx):
                if callable(self.after):
                    return self.after(b, ctx)
                return ", ".join(render(substitute(t, b)) for t in template(self.after))
        return None


def _modules(pdf: pd.DataFrame) -> Iterator[tuple]:
    for path, text in zip(pdf.path, pdf.content, strict=True):
        try:
            forms, _ = parse_forms(text or "")
        except LexError:
            continue
        yield path, text, annotate(forms)


def _prefilter(files: DataFrame, words: list[list[str]]) -> DataFrame:
    """Files that hold all the names of at least one of the templates."""
    some: Column = F.lit(False)
    for own in words:
        every: Column = F.lit(True)
        for w in own:
            every &= F.col("content").contains(w)
        some |= every
    return files.where(some)


HITS = "path string, rule string, f string, a int, start_line int, start_col int, end_line int, end_col int, value string"


def collect(files: DataFrame, collectors: list, stop: bool = False) -> DataFrame:
    """``path, rule, f, a, start.., end.., value`` of every match.

    Per node the first collector that matches counts. With ``stop`` nothing below a match is looked at.
    A template of several expressions slides over every statement list, one place at a time.
    """
    words = [_words(c.trees()) if isinstance(c, Collector) else [c.f] for c in collectors]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [(c, c.trees() if isinstance(c, Collector) else None, c.name or str(i)) for i, c in enumerate(collectors)]
        for pdf in frames:
            rows = []
            for path, text, mod in _modules(pdf):
                exports = frozenset(mod.exports)
                for form in mod.forms:
                    own = (name_of(form.groups[0][0]) or form.value, form.info["arity"]) if form.type == "function" else (None, None)
                    calls = {id(c["node"]): (c["m"], c["f"], c["a"]) for c in reversed(calls_in(form, mod)) if c["f"]} if form.type == "function" else {}
                    also = {(id(c["node"]), c["m"], c["f"], c["a"]) for c in calls_in(form, mod)} if form.type == "function" else set()

                    def add(nodes: list[Node], name: str, value: str, path=path, own=own) -> None:
                        rows.append((path, name, *own, *nodes[0].start, *nodes[-1].end, value))

                    def visit(n: Node, form=form, mod=mod, text=text, calls=calls, also=also, exports=exports) -> None:
                        hit = False
                        ctx = Context(mod, form, n, text, exports)
                        for c, trees, name in ready:
                            if isinstance(c, FunApply):
                                if (id(n), c.m, c.f, c.a) in also:
                                    add([n], name, ctx.source(n))
                                    hit = True
                                    break
                            elif len(trees) == 1:
                                b = first_match(trees[0], n, None if c.cond is None else lambda b, c=c, ctx=ctx: c.cond(b, ctx))
                                if b is not None:
                                    add([n], name, c.emit(b, ctx) if c.emit else ctx.source(n))
                                    hit = True
                                    break
                        if hit and stop:
                            return
                        for gi, g in enumerate(n.groups):
                            statements = (n.type == "clause" and gi == 2) or n.type == "block_expr" or (n.type == "try_expr" and gi in (0, 3))
                            inside: set[int] = set()
                            if statements:
                                for c, trees, name in ready:
                                    if isinstance(c, FunApply) or len(trees) < 2:
                                        continue
                                    for i in range(len(g)):
                                        for k in ([len(trees)] if not any(t.value.endswith("@@") for t in trees) else range(len(g) - i, 0, -1)):
                                            part = g[i : i + k]
                                            b = next((b for b in match_list(trees, part, {}) if c.cond is None or c.cond(b, ctx)), None) if len(part) == k else None
                                            if b is not None and not (stop and i in inside):
                                                add(part, name, c.emit(b, ctx) if c.emit else text[part[0].lo : part[-1].hi])
                                                inside.update(range(i, i + k))
                                                break
                            for i, x in enumerate(g):
                                if not (stop and i in inside):
                                    visit(x)

                    visit(form)
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in HITS.split(", ")])

    return _prefilter(files, words).select("path", "content").mapInPandas(run, HITS)


def collect_loc(files: DataFrame, collectors: list, stop: bool = False) -> DataFrame:
    """Places of the matches only."""
    return collect(files, collectors, stop).select("path", "start_line", "start_col", "end_line", "end_col")


def rewrite_text(text: str, rules: list[Rule], strategy: str = "full_td", ctx_extra=None) -> str:
    """The text of one file after the rules; a file that cannot be scanned stays as it is.

    ``stop_td``: outermost matches once. ``full_td``: the new text of a match is looked at again, from the
    top (up to 50 times). ``full_bu``: innermost matches first, then around them.
    """
    ready = [(r, template(r.before)) for r in rules]
    for _ in range(1 if strategy == "stop_td" else 50):
        try:
            forms, _errors = parse_forms(text)
        except LexError:
            return text
        mod = annotate(forms)
        edits = []

        def attempt(n: Node, form: Node, mod=mod, text=text) -> str | None:
            ctx = Context(mod, form, n, text, frozenset(mod.exports))
            for r, trees in ready:
                new = r.rewrite(trees, n, ctx)
                if new is not None and new != text[n.lo : n.hi]:
                    return new
            return None

        def down(n: Node, form: Node, edits=edits) -> None:
            new = attempt(n, form)
            if new is not None:
                edits.append((n.lo, n.hi, new))
                return
            for c in n.children:
                down(c, form)

        def up(n: Node, form: Node, edits=edits) -> bool:
            below = [up(c, form) for c in n.children]
            if any(below):
                return True
            new = attempt(n, form)
            if new is not None:
                edits.append((n.lo, n.hi, new))
            return new is not None

        for form in forms:
            (up if strategy == "full_bu" else down)(form, form)
        if not edits:
            break
        text = splice(text, edits)
    return text


CHANGES = "path string, old_content string, new_content string, error string"


def transform(files: DataFrame, rules: list[Rule], strategy: str = "full_td") -> DataFrame:
    """``path, old_content, new_content, error`` of the files that the rules change; nothing is written."""
    words = [_words(template(r.before)) for r in rules]
    return rewrite_files(_prefilter(files, words), lambda text: rewrite_text(text, rules, strategy))


def rewrite_files(files: DataFrame, edit: Callable[[str], str]) -> DataFrame:
    """The files that ``edit`` (text to text) changes; a file that it refuses has a row with the error and no new text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, old in zip(pdf.path, pdf.content, strict=True):
                old = old or ""
                try:
                    new = edit(old)
                except (Refused, LexError, RecursionError) as e:
                    rows.append((path, old, None, str(e) or type(e).__name__))
                    continue
                if new != old:
                    rows.append((path, old, new, None))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in CHANGES.split(", ")], dtype=object)

    return files.select("path", "content").mapInPandas(run, CHANGES)


def changed_lines(changes: DataFrame) -> DataFrame:
    """``path, kind, line, text``: lines of the new text that the old one has not (+), and the other way round (-)."""
    cut = lambda c: changes.where("error is null").select("path", F.posexplode(F.split(c, "\n")).alias("at", "text"))
    old, new = cut("old_content"), cut("new_content")
    row = lambda df, other, kind: df.join(other.select("path", "text").distinct(), ["path", "text"], "left_anti").select("path", F.lit(kind).alias("kind"), (F.col("at") + 1).alias("line"), "text")
    return row(new, old, "+").union(row(old, new, "-"))


def candidates(changes: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """``key, path, old_content, new_content``: the proposed edits by a key of file and content, without rejected keys."""
    own = changes.where("error is null").select(F.md5(F.concat_ws("\n", "path", "old_content", "new_content")).alias("key"), "path", "old_content", "new_content")
    return own if rejected is None else own.join(rejected.select("key").distinct(), "key", "left_anti")


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The code base after the changes: a new DataFrame, so going back is keeping the old one."""
    from quercus.sources.files import _complete

    new = files.select("path", "content").join(changes.select("path", "new_content"), "path", "left")
    return _complete(new.select("path", F.coalesce("new_content", "content").alias("content")))
