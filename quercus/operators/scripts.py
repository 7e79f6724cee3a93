"""Composite refactorings: scripts of edits over a whole code base, with names followed through renamings.

A code base is a dict of path to text here (as large as one script's files); ``over_files`` runs a script on a
DataFrame of files where each file can be edited on its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quercus.operators import refactor, statem
from quercus.operators.edits import Refused, module_of, need
from quercus.operators.pattern import rewrite_files
from quercus.trees.annotate import name_of

Files = dict[str, str]


@dataclass
class Names:
    """What modules and functions are called now, by what they were called when the script began."""

    modules: dict[str, str] = field(default_factory=dict)
    functions: dict[tuple[str, str, int], tuple[str, str, int]] = field(default_factory=dict)

    def current(self, entity):
        """A module name, or (m, f, a), as it is called now."""
        if isinstance(entity, str):
            return self.modules.get(entity, entity)
        return self.functions.get(entity, (self.current(entity[0]), *entity[1:]))

    def renamed_module(self, old: str, new: str) -> None:
        first = next((k for k, v in self.modules.items() if v == old), old)
        self.modules[first] = new
        self.functions = {k: (new if m == old else m, f, a) for k, (m, f, a) in self.functions.items()}

    def renamed_function(self, old: tuple[str, str, int], new: tuple[str, str, int]) -> None:
        first = next((k for k, v in self.functions.items() if v == old), None)
        if first is None:
            back = {v: k for k, v in self.modules.items()}
            first = (back.get(old[0], old[0]), *old[1:])
        self.functions[first] = new


def each(files: Files, edit: Callable[[str], str], mentions: str = "") -> Files:
    """The edit on every file that mentions the word."""
    return {p: edit(t) if mentions in t else t for p, t in files.items()}


@dataclass
class Script:
    """Steps on a code base. ``run`` gives the files after all steps, or as they were if one is refused (``atomic``)."""

    steps: list[Callable[[Files, Names], Files]]
    atomic: bool = True

    def run(self, files: Files, names: Names | None = None) -> Files:
        names, now = names or Names(), dict(files)
        for step in self.steps:
            try:
                now = step(now, names)
            except Refused:
                if self.atomic:
                    return dict(files)
        return now


def rename_function(m: str, f: str, a: int, new: str) -> Callable[[Files, Names], Files]:
    def step(files: Files, names: Names) -> Files:
        m1, f1, a1 = names.current((m, f, a))
        out = each(files, lambda t: refactor.rename_function(t, m1, f1, a1, new), f1)
        names.renamed_function((m1, f1, a1), (m1, new, a1))
        return out

    return step


def rename_module(old: str, new: str) -> Callable[[Files, Names], Files]:
    def step(files: Files, names: Names) -> Files:
        now = names.current(old)
        need(not any(re.search(rf"-module\({re.escape(new)}\)", t) for t in files.values()), f"{new} is in use")
        out = each(files, lambda t: refactor.rename_module(t, now, new), now)
        names.renamed_module(now, new)
        return {re.sub(rf"(^|/){re.escape(now)}(\.[a-z]+)$", rf"\g<1>{new}\2", p): t for p, t in out.items()}

    return step


def prefix_modules(prefix: str, pick: Callable[[str], bool] = lambda _: True) -> Callable[[Files, Names], Files]:
    """Every module (that ``pick`` takes) gets the prefix, unless it has it."""

    def step(files: Files, names: Names) -> Files:
        own = sorted({module_of(t).name for t in files.values()} - {None})
        for m in own:
            if pick(m) and not m.startswith(prefix):
                files = rename_module(m, prefix + m)(files, names)
        return files

    return step


def inline_all(text: str, pick: Callable[[str], bool] = lambda _: True) -> str:
    """Inlines every binding ``V = E`` of a variable that ``pick`` takes, where that is allowed."""

    def one(t: str) -> str:
        mod = module_of(t)
        for form in mod.forms:
            for n in form.walk() if form.type == "function" else ():
                if n.type == "match_expr" and n.groups[0][0].type == "variable" and pick(n.groups[0][0].value):
                    try:
                        return refactor.inline_variable(t, n.start[0])
                    except Refused:
                        continue
        raise Refused("nothing to inline")

    return refactor.repeat(text, one)


def eliminate_clones(path: str, au: str, name: str, order: list[int] | None = None) -> Callable[[Files, Names], Files]:
    """Pastes the generalised function of a clone class into a file under a name, gives its new parameters an order, and folds the class's members against it."""

    def step(files: Files, names: Names) -> Files:
        text = files[path].rstrip() + "\n\n" + au.rstrip() + ("" if au.rstrip().endswith(".") else ".") + "\n"
        mod = module_of(text)
        own = mod.forms[-1]
        f, a = name_of(own.groups[0][0]), own.info["arity"]
        text = refactor.rename_function(text, mod.name, f, a, name)
        if order:
            need(sorted(order) == list(range(1, a + 1)), "no order of the parameters")
            at = list(range(1, a + 1))
            for i, want in enumerate(order):
                j = at.index(want)
                if j != i:
                    text = refactor.swap_arguments(text, mod.name, name, a, i + 1, j + 1)
                    at[i], at[j] = at[j], at[i]
        out = dict(files)
        out[path] = refactor.fold_against(text, name, a)
        names.renamed_function((mod.name, f, a), (mod.name, name, a))
        return out

    return step


def rename_operation_argument(op: str, at: int, name: str) -> Callable[[Files, Names], Files]:
    """A new name for an argument of a test operation in every file that has the operation."""

    def step(files: Files, names: Names) -> Files:
        hit = {p for p, t in files.items() if op in t and op in dict(statem.operations(t))}
        need(bool(hit), f"no operation {op}")
        return {p: statem.rename_argument(t, op, at, name) if p in hit else t for p, t in files.items()}

    return step


def over_files(files: DataFrame, edit: Callable[[str], str]) -> DataFrame:
    """A script of single-file edits on a table of files."""
    return rewrite_files(files, edit)
