"""Refactorings towards and of properties: generators, properties from test cases, states as records."""

from __future__ import annotations

from quercus.operators.edits import legal_atom, legal_variable, module_of, need, source, variables
from quercus.operators.pattern import Context, Rule, rewrite_text
from quercus.sources.parser import Node
from quercus.trees.annotate import name_of
from quercus.trees.match import generalisable
from quercus.trees.render import render, splice


def new_let(text: str, line: int, code: str, name: str) -> str:
    """A generator inside a larger expression on the line is bound by ``?LET``: ``g(E)`` becomes ``?LET(Name, E, g(Name))``."""
    mod = module_of(text)
    need(legal_variable(name), "no variable name")
    for form in mod.forms:
        if form.type != "function":
            continue
        tops = [n for c in form.groups[1] for n in c.groups[2] if n.start[0] <= line <= n.end[0]]
        for top in tops:
            hits = [n for n in top.walk() if source(text, n) == code and n is not top and n.start[0] == line and generalisable(n)]
            if hits:
                need(all(name not in variables(c) for c in form.groups[1]), f"{name} is used")
                body = splice(source(text, top), [(hits[0].lo - top.lo, hits[0].hi - top.lo, name)])
                return splice(text, [(top.lo, top.hi, f"?LET({name}, {code}, {body})")])
    need(False, "no such generator inside an expression")
    raise AssertionError


def _merge(kind: str) -> Rule:
    def join(b, ctx: Context) -> str | None:
        inner = b["E@"]
        if inner.type != "macro" or inner.value != kind or len(inner.groups[0]) != 3:
            return None
        p2, g2, e2 = inner.groups[0]
        outer = variables(b["P@"])
        if variables(g2) & outer:  # the second generator depends on the first
            return None
        flat = lambda n: [*map(render, n.groups[0])] if n.type == "tuple" else [render(n)]
        both = b["P@"].type == "tuple" and b["G@"].type == "tuple" and len(b["P@"].groups[0]) == len(b["G@"].groups[0])
        ps, gs = (flat(b["P@"]), flat(b["G@"])) if both else ([render(b["P@"])], [render(b["G@"])])
        return f"?{kind}({{{', '.join([*ps, render(p2)])}}}, {{{', '.join([*gs, render(g2)])}}}, {render(e2)})"

    return Rule(f"?{kind}(P@, G@, E@)", join)


def merge_let(text: str) -> str:
    """Nested ``?LET`` of independent generators become one over a tuple."""
    return rewrite_text(text, [_merge("LET")], "full_td")


def merge_forall(text: str) -> str:
    """Nested ``?FORALL`` of independent generators become one over a tuple."""
    return rewrite_text(text, [_merge("FORALL")], "full_td")


def _closed(n: Node) -> bool:
    return not any(x.type in ("variable", "application", "macro", "fun_expr", "receive_expr") for x in n.walk())


def test_inputs(text: str, f: str, a: int) -> list[list[str]]:
    """For each argument of f/a the closed expressions that tests (functions that end in ``_test`` or ``_test_``) call it with."""
    mod = module_of(text)
    out: list[list[str]] = [[] for _ in range(a)]
    for form in mod.forms:
        if form.type != "function" or not (name_of(form.groups[0][0]) or "").rstrip("_").endswith("_test"):
            continue
        for n in form.walk():
            op = n.groups[0][0] if n.type == "application" else None
            name = op and (op.groups[1][0] if op.type == "module_qualifier" else op)
            if name is not None and name_of(name) == f and len(n.groups[1]) == a and all(map(_closed, n.groups[1])):
                for k, x in enumerate(n.groups[1]):
                    if (r := render(x)) not in out[k]:
                        out[k].append(r)
    return out


def tests_to_property(text: str, f: str, a: int) -> str:
    """A property over the inputs that the tests use, one generator an argument."""
    need(a > 0, "the function takes no input")
    own = test_inputs(text, f, a)
    need(all(own), "no test data")
    mod = module_of(text)
    need((f"prop_{f}", 0) not in mod.functions, f"prop_{f} is defined already")
    names = [f"Arg{i + 1}" for i in range(a)]
    gens = [f"oneof([{', '.join(x)}])" for x in own]
    pat, gen = (names[0], gens[0]) if a == 1 else ("{" + ", ".join(names) + "}", "{" + ", ".join(gens) + "}")
    end = mod.forms[-1].hi
    return splice(text, [(end, end, f"\n\nprop_{f}() ->\n    ?FORALL({pat}, {gen}, begin {f}({', '.join(names)}), true end).")])


def state_to_record(text: str, record: str, fields: list[str], places: dict[tuple[str, int], int], results: list[tuple[str, int]]) -> str:
    """The state of a state machine, a tuple, becomes a record.

    ``places``: which argument (from 1) of each callback is the state; ``results``: callbacks of which the value is one.
    """
    need(legal_atom(record) and all(map(legal_atom, fields)) and len(set(fields)) == len(fields), "no record or field name")
    mod = module_of(text)
    need(record not in dict(mod.records), f"{record} is declared already")
    edits = []

    def put(n: Node) -> None:
        if n.type == "tuple" and len(n.groups[0]) == len(fields):
            own = [(k, x) for k, x in zip(fields, n.groups[0], strict=True) if x.type != "underscore"]
            edits.append((n.lo, n.hi, f"#{record}{{{', '.join(f'{k} = {source(text, x)}' for k, x in own)}}}"))
        elif n.type == "match_expr":
            put(n.groups[0][0])
            put(n.groups[1][0])

    def values(n: Node) -> list[Node]:
        if n.type in ("case_expr", "if_expr"):
            return [v for g in n.groups for c in g if c.type == "clause" for v in values(c.groups[2][-1])]
        return values(n.groups[0][-1]) if n.type == "block_expr" else [n]

    for key, at in places.items():
        for c in mod.functions[key].groups[1] if key in mod.functions else ():
            put(c.groups[0][at - 1])
    for key in results:
        for c in mod.functions[key].groups[1] if key in mod.functions else ():
            for v in values(c.groups[2][-1]):
                put(v)
    need(bool(edits), "no state of that size")
    first = min(x.lo for x in mod.forms if x.type == "function")
    return splice(text, [(first, first, f"-record({record}, {{{', '.join(fields)}}}).\n\n"), *edits])


def statem_to_record(text: str, record: str, fields: list[str]) -> str:
    """For state-machine tests: the state in ``command``, ``precondition``, ``next_state``, ``postcondition`` and ``initial_state``."""
    places = {("command", 1): 1, ("precondition", 2): 1, ("next_state", 3): 1, ("postcondition", 3): 1, ("invariant", 1): 1}
    return state_to_record(text, record, fields, places, [("initial_state", 0), ("next_state", 3)])


def fsm_to_record(text: str, record: str, fields: list[str]) -> str:
    """For test machines with named states: the data in ``precondition/4``, ``next_state_data/5``, ``postcondition/5`` and ``initial_state_data``."""
    places = {("precondition", 4): 3, ("next_state_data", 5): 3, ("postcondition", 5): 3, ("weight", 3): 3}
    return state_to_record(text, record, fields, places, [("initial_state_data", 0), ("next_state_data", 5)])
