"""Behaviour extraction: map the equal parts of two modules and split them into what is common and what is their own."""

from __future__ import annotations

from quercus.sources.parser import Node, parse_forms
from quercus.trees.annotate import Module, annotate, calls_in
from quercus.trees.render import render


def size(n: Node) -> int:
    return sum(1 for _ in n.walk())


def pairs(a: list[Node], b: list[Node], least: int = 3) -> list[tuple[Node, Node]]:
    """Equal subtrees, the largest first; parts of a pair are in no other pair."""
    by: dict[str, list[Node]] = {}
    for form in b:
        for n in form.walk():
            by.setdefault(n.type + " " + _text(n), []).append(n)
    left = sorted((n for form in a for n in form.walk() if size(n) >= least), key=lambda n: (-size(n), n.lo))
    used_a: list[tuple[int, int]] = []
    used_b: list[tuple[int, int]] = []
    out = []
    for n in left:
        if any(lo <= n.lo and n.hi <= hi for lo, hi in used_a):
            continue
        other = next((m for m in by.get(n.type + " " + _text(n), ()) if not any(lo <= m.lo and m.hi <= hi for lo, hi in used_b)), None)
        if other is not None:
            out.append((n, other))
            used_a.append((n.lo, n.hi))
            used_b.append((other.lo, other.hi))
    return out


def _text(n: Node) -> str:
    try:
        return render(n)
    except ValueError:
        return f"{n.type}:{n.lo}"


def _forms(text: str) -> list[Node]:
    forms, _ = parse_forms(text)
    return forms


def mapping(left: str, right: str) -> list[tuple[str, int, int, int]]:
    """(type, line on the left, line on the right, nodes) of each pair."""
    functions = lambda t: [f for f in _forms(t) if f.type == "function"]
    return [(a.type, a.start[0], b.start[0], size(a)) for a, b in pairs(functions(left), functions(right))]


def infer_behaviour(left: str, right: str, name: str) -> tuple[str, str, str]:
    """A behaviour module with the functions that both modules define alike, and both modules as its instances.

    Functions of one name and arity that differ, and that a common function calls, become callbacks.
    """
    one, two = annotate(_forms(left)), annotate(_forms(right))
    both = sorted(set(one.functions) & set(two.functions))
    alike = [k for k in both if _text(one.functions[k]) == _text(two.functions[k])]
    wanted = {(c["f"], c["a"]) for k in alike for c in calls_in(one.functions[k], one) if c["shape"] == "direct"}
    callbacks = sorted(k for k in both if k not in alike and k in wanted) or sorted(k for k in both if k not in alike)
    callback = "".join(f"-callback {f}({', '.join(['term()'] * a)}) -> term().\n" for f, a in callbacks)
    names = ", ".join(f"{f}/{a}" for f, a in alike)
    own = "\n\n".join(left[one.functions[k].lo : one.functions[k].hi] for k in alike)
    head = f"-module({name}).\n-export([{names}]).\n{callback}\n{own}\n"
    return head, _instance(left, one, alike, name), _instance(right, two, alike, name)


def _instance(text: str, mod: Module, alike: list[tuple[str, int]], name: str) -> str:
    gone = [(mod.functions[k].lo, mod.functions[k].hi) for k in alike]
    at = next((f.hi for f in mod.forms if f.type == "attribute" and f.value == "module"), 0)
    out, last = [], 0
    for lo, hi, new in sorted([(at, at, f"\n-behaviour({name})."), *((lo, hi, "") for lo, hi in gone)]):
        out += [text[last:lo], new]
        last = hi
    return "".join(out) + text[last:]



