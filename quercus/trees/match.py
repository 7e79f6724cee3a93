"""Templates: code strings with meta-variables, matched against trees with backtracking.

``X@`` stands for one node, ``Xs@@`` for a list of siblings, ``f@`` for any atom.
A meta-variable met again must stand for equal source with the same binding
structure. ``anti_unify`` goes the other way: the least general template of two
trees and what its variables stand for in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from quercus.sources.parser import Node, parse_any
from quercus.trees.annotate import bindings, categories, structure
from quercus.trees.render import render

Binding = dict[str, "Node | list[Node]"]
LEAVES = ("atom", "variable", "integer", "float", "string", "char", "underscore")


def template(code: str) -> list[Node]:
    """Trees of a code string with meta-variables; an empty one is an error."""
    if not code.strip():
        raise ValueError("empty template")
    return parse_any(code)


def is_meta(n: Node) -> bool:
    return n.type in ("variable", "atom") and n.value.endswith("@")


def is_list_meta(n: Node) -> bool:
    return n.type == "variable" and n.value.endswith("@@")


def same(a: Node | list[Node], b: Node | list[Node]) -> bool:
    """Equal but for layout, and equal in which variables are bound where."""
    xs, ys = (a if isinstance(a, list) else [a]), (b if isinstance(b, list) else [b])
    if len(xs) == len(ys) == 1 and xs[0].type == ys[0].type == "variable" and xs[0].value == ys[0].value:
        # where it is bound and where it is used are one variable
        own = [set(n.info.get("def") or ()) | ({n.start} if n.info.get("role") == "bind" else set()) for n in (xs[0], ys[0])]
        return bool(own[0] & own[1]) or not (own[0] and own[1])
    return [shape(x) for x in xs] == [shape(y) for y in ys] and structure(xs) == structure(ys)


def shape(n: Node):
    while n.type == "parentheses":
        n = n.groups[0][0]
    return (n.type, n.value, tuple(tuple(map(shape, g)) for g in n.groups))


def _put(b: Binding, name: str, value) -> Binding | None:
    if name in b:
        return b if same(b[name], value) else None
    return b | {name: value}


def match(t: Node, n: Node, b: Binding | None = None) -> Iterator[Binding]:
    """All ways in which ``t`` matches ``n``, the shortest lists first."""
    b = b or {}
    if is_meta(t) and not is_list_meta(t):
        if t.type == "atom" and n.type != "atom":
            return
        if (new := _put(b, t.value, n)) is not None:
            yield new
        return
    if t.type != "parentheses":
        while n.type == "parentheses":
            n = n.groups[0][0]
    elif n.type != "parentheses":
        yield from match(t.groups[0][0], n, b)
        return
    if t.type != n.type or len(t.groups) != len(n.groups):
        return
    if t.value != n.value and not (t.value.endswith("@") and t.type in ("record_expr", "macro", "function")):
        return
    if t.type == "clause" and "name" in t.info and "name" in n.info:
        for new in match(t.info["name"], n.info["name"], b):
            yield from _groups(t.groups, n.groups, new)
        return
    yield from _groups(t.groups, n.groups, b)


def _groups(ts: list[list[Node]], ns: list[list[Node]], b: Binding) -> Iterator[Binding]:
    if not ts:
        yield b
        return
    for new in match_list(ts[0], ns[0], b):
        yield from _groups(ts[1:], ns[1:], new)


def match_list(ts: list[Node], ns: list[Node], b: Binding) -> Iterator[Binding]:
    """Lists against lists; each list meta-variable tries every split."""
    if not ts:
        if not ns:
            yield b
        return
    if is_list_meta(ts[0]) or (ts[0].type == "clause" and len(ts[0].groups[2]) == 1 and _all_meta(ts[0])):
        name = ts[0].value if is_list_meta(ts[0]) else ts[0].groups[2][0].value
        for k in range(len(ns) - _least(ts[1:]) + 1):
            if (new := _put(b, name, ns[:k])) is not None:
                yield from match_list(ts[1:], ns[k:], new)
        return
    if not ns or len(ns) < _least(ts):
        return
    for new in match(ts[0], ns[0], b):
        yield from match_list(ts[1:], ns[1:], new)


def _all_meta(c: Node) -> bool:
    """A clause ``Ps@@@ when Gs@@@ -> Bs@@@`` stands for any number of clauses."""
    metas = [x for g in c.groups for x in g if x.type == "variable" and x.value.endswith("@@@")]
    return len(metas) == len([x for g in c.groups for x in g]) and bool(metas)


def _least(ts: list[Node]) -> int:
    return sum(not (is_list_meta(t) or (t.type == "clause" and _all_meta(t))) for t in ts)


def match_any_order(ts: list[Node], ns: list[Node], b: Binding) -> Iterator[Binding]:
    """Clauses of a template against clauses in any order."""
    if not ts:
        yield b
        return
    for i, n in enumerate(ns):
        for new in match(ts[0], n, b):
            yield from match_any_order(ts[1:], ns[:i] + ns[i + 1 :], new)


def first_match(t: Node, n: Node, cond: Callable[[Binding], bool] | None = None) -> Binding | None:
    return next((b for b in match(t, n) if cond is None or cond(b)), None)


def substitute(t: Node, b: Binding) -> Node:
    """The template with its meta-variables replaced."""

    def many(nodes: list[Node]) -> list[Node]:
        out = []
        for n in nodes:
            v = b.get(n.value) if is_meta(n) else None
            if isinstance(v, list):
                out += [x.copy() for x in v]
            else:
                out.append(substitute(n, b))
        return out

    if is_meta(t) and isinstance(b.get(t.value), Node):
        return b[t.value].copy()
    new = Node(t.type, t.value, [many(g) for g in t.groups], t.start, t.end, t.lo, t.hi, dict(t.info))
    if t.type == "function" and t.value.endswith("@") and t.value in b:
        new.value = b[t.value].value
    if "name" in new.info:
        new.info["name"] = substitute(t.info["name"], b)
    return new


# -- unification and generalisation -------------------------------------------------------


def unify(p: Node, e: Node) -> dict[str, str] | None:
    """One-way: variables of ``p`` may stand for expressions of ``e``, one text each."""
    out: dict[str, str] = {}

    def go(a: Node, b: Node) -> bool:
        if a.type == "variable":
            return out.setdefault(a.value, render(b)) == render(b)
        if a.type != b.type or a.value != b.value or [len(g) for g in a.groups] != [len(g) for g in b.groups]:
            return False
        return all(go(x, y) for x, y in zip(a.children, b.children, strict=True))

    return out if go(p, e) else None


def generalisable(n: Node) -> bool:
    """Whether a sub-expression may become a parameter: an expression (no pattern, operator or bound name)."""
    return n.info.get("category") in ("expression", "guard_expression") and n.type not in ("match_expr", "generator", "clause", "record_field", "map_field_assoc", "map_field_exact", "binary_field", "conjunction", "disjunction") and not any(v.info.get("role") == "bind" for v in n.walk())


def anti_unify(a: Node, b: Node) -> list[tuple[Node, Node]] | None:
    """Pairs of differing sub-expressions of the least general generalisation, or None."""
    if a.type == b.type and a.value == b.value and [len(g) for g in a.groups] == [len(g) for g in b.groups]:
        out: list[tuple[Node, Node]] = []
        for x, y in zip(a.children, b.children, strict=True):
            inner = anti_unify(x, y)
            if inner is None:
                break
            out += inner
        else:
            return out
    if a.type == b.type == "variable" and a.info.get("role") == b.info.get("role") == "bind":
        return [(a, b)]
    return [(a, b)] if generalisable(a) and generalisable(b) else None


def consistent(pairs: list[tuple[Node, Node]]) -> bool:
    """Each variable of one side stands for one expression of the other."""
    one: dict[str, str] = {}
    return all(one.setdefault(a.value, render(b)) == render(b) for a, b in pairs if a.type == "variable")


def new_vars(pairs: list[tuple[Node, Node]]) -> int:
    """Different pairs that are no renaming of a variable."""
    return len({(render(a), render(b)) for a, b in pairs if not (a.type == b.type == "variable")})


def leaves(nodes: list[Node]) -> int:
    return sum(not n.children for x in nodes for n in x.walk())


def node_score(a: list[Node], pairs: list[tuple[Node, Node]], side: int) -> float:
    """Share of leaves outside the substitution, less a triangular penalty for new variables."""
    total = max(1, leaves(a))
    gone = sum(leaves([p[side]]) - 1 for p in pairs)
    k = new_vars(pairs)
    return 1 - (gone + k * (k + 1) / 2) / total


def token_score(ntoks: int, pairs: list[tuple[str, str]], side: int) -> float:
    """1 - (tokens in the substitution - its size) / tokens of the range."""
    from quercus.sources.tokenizer import scan

    gone = sum(len(scan(p[side])) for p in pairs)
    return 1 - (gone - len(pairs)) / max(1, ntoks)


def anti_unify_seq(a: list[Node], b: list[Node]) -> list[tuple[Node, Node]] | None:
    if len(a) != len(b):
        return None
    out = []
    for x, y in zip(a, b, strict=True):
        if (p := anti_unify(x, y)) is None:
            return None
        out += p
    return out if consistent(out) and consistent([(y, x) for x, y in out]) else None


def generalise(body: list[Node], pairs: list[list[tuple[Node, Node]]], name: str = "new_fun") -> tuple[str, int, int]:
    """A function whose parameters are the sub-expressions that differ and the free variables; (text, parameters, new variables)."""
    from quercus.trees.annotate import free

    params: dict[str, str] = {}
    differing = {id(a): a for ps in pairs for a, _ in ps if a.type != "variable"}
    copies = []
    for n in body:
        def swap(x: Node) -> Node:
            if id(x) in differing:
                key = render(x)
                params.setdefault(key, f"NewVar_{len(params) + 1}")
                return Node("variable", params[key])
            return Node(x.type, x.value, [[swap(c) for c in g] for g in x.groups], x.start, x.end, x.lo, x.hi, dict(x.info))

        copies.append(swap(n))
    text = ",\n    ".join(render(n) for n in copies)
    own = [v for v in free(body) if any(x.type == "variable" and x.value == v for c in copies for x in c.walk())]
    args = [*own, *params.values()]
    return f"{name}({', '.join(args)}) ->\n    {text}.", len(args), len(params)


def parse_annotated(code: str) -> list[Node]:
    """Expressions of a code string with categories and bindings; those of a sequence share their variables."""
    from quercus.sources.parser import parse_forms
    from quercus.trees.annotate import annotate

    forms, errors = parse_forms(f"q_main() ->\n{code}\n.")
    if not errors and len(forms) == 1 and forms[0].type == "function" and len(forms[0].groups[1]) == 1:
        annotate(forms)
        return forms[0].groups[1][0].groups[2]
    nodes = template(code)
    for n in nodes:
        categories(n)
        if n.type != "function":
            n.info["category"] = "expression"
            for x in n.walk():
                if x.info.get("category") == "function":
                    x.info["category"] = "expression"
        bindings(n)
    return nodes
