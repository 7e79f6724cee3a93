"""Source text of trees: made anew, or the old text with edits spliced in so that all other layout stays."""

from __future__ import annotations

from quercus.sources.parser import BINARY, Node

Edit = tuple[int, int, str]


def _list(nodes: list[Node]) -> str:
    return ", ".join(map(render, nodes))


def _clause(c: Node, paren: bool, head: str = "") -> str:
    pats = f"{head}({_list(c.groups[0])})" if paren else _list(c.groups[0])
    guard = f"{'' if not pats else ' '}when {render(c.groups[1][0])}" if c.groups[1] and pats else (render(c.groups[1][0]) if c.groups[1] else "")
    return f"{pats}{guard} -> {_list(c.groups[2])}"


def _clauses(cs: list[Node], paren: bool = False, head: str = "") -> str:
    return "; ".join(_clause(c, paren, head) for c in cs)


def _arg(n: Node, op: str, right: bool) -> str:
    text = render(n)
    if n.type in ("infix_expr", "match_expr"):
        mine, its = BINARY[op], BINARY[n.value]
        if its[0] < mine[0] or (its[0] == mine[0] and (mine[1] == 0 or right != (mine[1] == 1))):
            return f"({text})"
    return f"({text})" if n.type == "catch_expr" else text


def render(n: Node) -> str:
    """One line of source that parses to the same tree."""
    t, g = n.type, n.groups
    if t in ("variable", "atom", "integer", "float", "string", "char", "underscore"):
        return n.value
    if t == "nil":
        return "[]"
    if t in ("infix_expr", "match_expr"):
        return f"{_arg(g[0][0], n.value, False)} {n.value} {_arg(g[1][0], n.value, True)}"
    if t == "prefix_expr":
        inner = render(g[0][0])
        inner = f"({inner})" if g[0][0].type in ("infix_expr", "match_expr") else inner
        return f"{n.value} {inner}" if n.value.isalpha() else n.value + inner
    if t == "parentheses":
        return f"({render(g[0][0])})"
    if t == "catch_expr":
        return f"catch {render(g[0][0])}"
    if t == "application":
        op = render(g[0][0])
        return f"({op})({_list(g[1])})" if g[0][0].type == "fun_expr" else f"{op}({_list(g[1])})"
    if t == "module_qualifier":
        return f"{render(g[0][0])}:{render(g[1][0])}"
    if t == "class_qualifier":
        return ":".join(render(x[0]) for x in g)
    if t == "tuple":
        return "{" + _list(g[0]) + "}"
    if t == "list":
        return "[" + _list(g[0]) + (f" | {render(g[1][0])}" if g[1] else "") + "]"
    if t == "list_comp":
        return f"[{_list(g[0])} || {_list(g[1])}]"
    if t == "binary_comp":
        return f"<<{_list(g[0])} || {_list(g[1])}>>"
    if t in ("generator", "binary_generator"):
        return f"{render(g[0][0])} {n.value} {render(g[1][0])}"
    if t == "binary":
        return f"<<{_list(g[0])}>>"
    if t == "binary_field":
        return render(g[0][0]) + (f":{render(g[1][0])}" if g[1] else "") + (f"/{n.value}" if n.value else "")
    if t == "map_expr":
        return "".join(map(render, g[0])) + "#{" + _list(g[1]) + "}"
    if t in ("map_field_assoc", "map_field_exact"):
        return f"{render(g[0][0])} {n.value} {render(g[1][0])}"
    if t == "record_expr":
        return "".join(map(render, g[0])) + f"#{n.value}" + "{" + _list(g[1]) + "}"
    if t == "record_field":
        return render(g[0][0]) + (f" = {render(g[1][0])}" if g[1] else "")
    if t in ("record_access", "record_index_expr"):
        return "".join(map(render, g[0])) + f"#{n.value}.{render(g[1][0])}"
    if t == "macro":
        return f"?{n.value}" + (f"({_list(g[0])})" if g else "")
    if t == "implicit_fun":
        parts = list(map(render, g[0]))
        return "fun " + (f"{parts[0]}:{parts[1]}/{parts[2]}" if len(parts) == 3 else "/".join(parts))
    if t == "fun_expr":
        return f"fun {_clauses(g[0], True, n.value)} end"
    if t == "block_expr":
        return f"begin {_list(g[0])} end"
    if t == "if_expr":
        return f"if {_clauses(g[0])} end"
    if t == "case_expr":
        return f"case {render(g[0][0])} of {_clauses(g[1])} end"
    if t == "receive_expr":
        after = f" after {render(g[1][0])} -> {_list(g[2])}" if g[1] else ""
        return f"receive {_clauses(g[0])}{after} end"
    if t == "try_expr":
        of = f" of {_clauses(g[1])}" if g[1] else ""
        catch = f" catch {_clauses(g[2])}" if g[2] else ""
        after = f" after {_list(g[3])}" if g[3] else ""
        return f"try {_list(g[0])}{of}{catch}{after} end"
    if t == "conjunction":
        return ", ".join(map(render, g[0]))
    if t == "disjunction":
        return "; ".join(map(render, g[0]))
    if t == "clause":
        return _clause(n, "name" in n.info, render(n.info["name"]) if "name" in n.info else "")
    if t == "function":
        name = render(g[0][0])
        return ";\n".join(_clause(c, True, name) for c in g[1]) + "."
    if t == "attribute":
        return f"-{n.value} {n.info['text']}." if "text" in n.info else f"-{n.value}({_list(g[0])})."
    raise ValueError(f"no rendering for {t}")


def splice(text: str, edits: list[Edit]) -> str:
    """``text`` with the spans replaced; of nested spans the outer one counts."""
    out, at = [], 0
    for lo, hi, new in sorted(set(edits), key=lambda e: (e[0], -e[1])):
        if lo < at:
            continue
        out += [text[at:lo], new]
        at = hi
    return "".join(out) + text[at:]
