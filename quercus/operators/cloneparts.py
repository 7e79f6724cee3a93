"""Parts of clone examination: pairs of statement runs that can be one function, within a budget of parameters."""

from __future__ import annotations

from dataclasses import dataclass

from quercus.sources.parser import Node
from quercus.trees.match import anti_unify, consistent
from quercus.trees.render import render

Pairs = list[tuple[Node, Node]]


@dataclass(frozen=True)
class Run:
    """Statements ``start`` to ``end`` (exclusive) of two sequences, and the differing expressions of each."""

    start: int
    end: int
    diffs: tuple[tuple[tuple[str, str], ...], ...]

    @property
    def new_vars(self) -> int:
        """Different pairs of expressions that would become parameters."""
        return len({p for d in self.diffs for p in d})


def statement_diffs(a: Node, b: Node) -> tuple[tuple[str, str], ...] | None:
    """The pairs of expressions (not variable for variable) in which two statements differ; null if they do not unify."""
    found = anti_unify(a, b)
    if found is None:
        return None
    return tuple((render(x), render(y)) for x, y in found if not x.type == y.type == "variable")


def split_by_conflict(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Maximal runs in which the statements unify and no variable of one stands for two expressions of the other, left to right."""
    out, start, held = [], 0, []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        found = anti_unify(x, y)
        if found is None:
            if i > start:
                out.append((start, i))
            start, held = i + 1, []
        elif consistent(held + found):
            held = held + found
        else:
            if i > start:
                out.append((start, i))
            start, held = i, list(found)
    if len(a) > start:
        out.append((start, len(a)))
    return out


def split_by_new_vars(diffs: list[tuple[tuple[str, str], ...]], most: int) -> list[tuple[int, int]]:
    """Maximal windows with at most ``most`` different new variables; the start slides on just as far as it must."""
    out: list[tuple[int, int]] = []
    start = 0
    for end in range(1, len(diffs) + 1):
        moved = start
        while moved < end and len({p for d in diffs[moved:end] for p in d}) > most:
            moved += 1
        if moved > start and end - 1 > start and (not out or out[-1][1] < end - 1):
            out.append((start, end - 1))
        start = moved
    if start < len(diffs) and (not out or out[-1][1] < len(diffs)):
        out.append((start, len(diffs)))
    return out


def split_by_similarity(scores: list[float], least: float, min_len: int) -> list[tuple[int, int]]:
    """Runs whose mean score is at least ``least``: the worst statement is dropped and both sides are looked at again."""
    out = []
    todo = [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        if b - a < min_len:
            continue
        if sum(scores[a:b]) / (b - a) >= least:
            out.append((a, b))
            continue
        worst = min(range(a, b), key=lambda i: (scores[i], i))
        todo += [(a, worst), (worst + 1, b)]
    return sorted(out)


def statement_score(n: Node, diffs: tuple[tuple[str, str], ...], side: int) -> float:
    """The share of the statement that stays as it is: one less the share of the characters of its differing expressions."""
    size = len(render(n))
    return 1 - min(size, sum(len(d[side]) for d in diffs)) / max(1, size)


def pair_runs(a: list[Node], b: list[Node], min_len: int, most_new: int, least: float) -> list[Run]:
    """Runs of two aligned sequences that pass all three tests, longest first."""
    out = []
    for s, e in split_by_conflict(a, b):
        diffs = [statement_diffs(x, y) for x, y in zip(a[s:e], b[s:e], strict=True)]
        for s2, e2 in split_by_new_vars(diffs, most_new):
            scores = [min(statement_score(a[s + i], diffs[i], 0), statement_score(b[s + i], diffs[i], 1)) for i in range(s2, e2)]
            out += [Run(s + s2 + x, s + s2 + y, tuple(diffs[s2 + x : s2 + y])) for x, y in split_by_similarity(scores, least, min_len)]
    return sorted(out, key=lambda r: (r.start - r.end, r.start))


def pack_under_budget(runs: list[Run], most_new: int) -> list[Run]:
    """Members of one range, in the order of their new variables, while the expressions that differ in any of them stay within the budget."""
    out, held = [], set()
    for r in sorted(runs, key=lambda r: (r.new_vars, r.start)):
        more = held | {p[0] for d in r.diffs for p in d}
        if len(more) <= most_new:
            out.append(r)
            held = more
    return out
