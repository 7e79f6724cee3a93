"""Refactorings of state-machine test modules: their operations, the arguments of these, and conditions for known bugs.

An operation ``op`` is a symbolic call ``{call, M, op, Args}`` in the generators and callbacks, and mostly a
wrapper function ``op`` that calls the system under test.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quercus.operators.edits import Refused, drop_clauses, drop_form, drop_items, export_edit, legal_atom, legal_variable, module_of, need, source, unexport_edits, variables
from quercus.operators.pattern import Rule, rewrite_text
from quercus.operators.symbolic import RULE_SETS
from quercus.sources.parser import Node
from quercus.trees.annotate import Module, name_of
from quercus.trees.render import splice

CALLBACKS = ("precondition", "next_state", "postcondition")


def calls_of(mod: Module, op: str) -> list[Node]:
    """The symbolic calls of an operation."""
    return [n for form in mod.forms if form.type == "function" for n in form.walk() if n.type == "tuple" and len(n.groups[0]) == 4 and name_of(n.groups[0][0]) == "call" and name_of(n.groups[0][2]) == op]


def operations(text: str) -> list[tuple[str, int]]:
    """Operations and the number of their arguments, where these are a list."""
    mod = module_of(text)
    own = {n for form in mod.forms if form.type == "function" for n in (name_of(t.groups[0][2]) for t in form.walk() if t.type == "tuple" and len(t.groups[0]) == 4 and name_of(t.groups[0][0]) == "call") if n}
    return sorted({(op, len(c.groups[0][3].groups[0])) for op in own for c in calls_of(mod, op) if c.groups[0][3].type == "list"})


def _wrapper(mod: Module, op: str) -> Node | None:
    return next((form for (f, _), form in mod.functions.items() if f == op), None)


def _tupled(form: Node) -> bool:
    """Wrappers take their arguments one by one, or in one tuple."""
    return all(len(c.groups[0]) == 1 and c.groups[0][0].type == "tuple" for c in form.groups[1])


def _arguments(text: str, op: str, change: Callable[[list[str], str], list[str]]) -> str:
    """Changes the arguments of the operation; ``change`` gets the sources and where they stand: call, wrapper or sut."""
    mod = module_of(text)
    edits: list[tuple[int, int, str]] = []

    def put(nodes: list[Node], lo: int, hi: int, where: str) -> None:
        edits.append((nodes[0].lo if nodes else lo, nodes[-1].hi if nodes else hi, ", ".join(change([source(text, x) for x in nodes], where))))

    calls = calls_of(mod, op)
    need(bool(calls), f"no operation {op}")
    for c in calls:
        args = c.groups[0][3]
        if args.type == "list" and not any(args.groups[1:]):
            put(args.groups[0], args.lo + 1, args.hi - 1, "pattern" if args.info.get("category") == "pattern" else "call")
    form = _wrapper(mod, op)
    if form is not None:
        tupled = _tupled(form)
        for c in form.groups[1]:
            own = c.groups[0][0].groups[0] if tupled else c.groups[0]
            at = (c.groups[0][0].lo if tupled else text.index("(", c.lo)) + 1
            put(own, at, at, "wrapper")
            for n in (x for b in c.groups[2] for x in b.walk()):
                if n.type == "application" and n.groups[0][0].type == "module_qualifier" and name_of(n.groups[0][0].groups[1][0]) == op:
                    own = n.groups[1][0].groups[0] if tupled and len(n.groups[1]) == 1 and n.groups[1][0].type == "tuple" else n.groups[1]
                    at = text.index("(", n.groups[0][0].hi) + 1
                    put(own, at, at, "sut")
        count = len(change([f"X{i}" for i in range(len(form.groups[1][0].groups[0]))], "wrapper"))
        a = len(form.groups[1][0].groups[0])
        if not tupled and count != a:
            for x in mod.forms:
                if x.type == "attribute" and x.value == "export" and x.groups[0] and x.groups[0][0].type == "list":
                    edits += [(y.groups[1][0].lo, y.groups[1][0].hi, str(count)) for y in x.groups[0][0].groups[0] if y.type == "infix_expr" and name_of(y.groups[0][0]) == op and y.groups[1][0].value == str(a)]
    return splice(text, edits)


def _arity(text: str, op: str) -> int:
    own = dict(operations(text))
    need(op in own, f"no operation {op}")
    return own[op]


def swap_arguments(text: str, op: str, order: list[int]) -> str:
    """The arguments of the operation in a new order (numbers from 1)."""
    need(sorted(order) == list(range(1, _arity(text, op) + 1)), "no order of the arguments")
    return _arguments(text, op, lambda xs, _: [xs[i - 1] for i in order] if len(xs) == len(order) else xs)


def add_argument(text: str, op: str, at: int, name: str, generator: str) -> str:
    """A new argument at a place (from 1): a variable in patterns and wrapper, ``generator`` where calls are generated."""
    n = _arity(text, op)
    need(legal_variable(name) and 1 <= at <= n + 1, "no variable name or place")
    mod = module_of(text)
    for form in mod.forms:
        if form.type == "function":
            for c in form.groups[1]:
                here = any(x is y for x in calls_of(mod, op) for y in c.walk()) or form is _wrapper(mod, op)
                need(not here or name not in variables(c), f"{name} is used in a clause")
    return _arguments(text, op, lambda xs, where: [*xs[: at - 1], generator if where == "call" else name if where != "pattern" else "_" + name, *xs[at - 1 :]])


def remove_argument(text: str, op: str, at: int) -> str:
    """Drops an argument that no callback uses."""
    need(1 <= at <= _arity(text, op), "no such argument")
    mod = module_of(text)
    for c in calls_of(mod, op):
        x = c.groups[0][3].groups[0][at - 1]
        if x.info.get("category") == "pattern" and x.type == "variable":
            clause = next(k for form in mod.forms if form.type == "function" for k in form.groups[1] if any(y is x for y in k.walk()))
            need(sum(v.type == "variable" and v.value == x.value for v in clause.walk()) == 1, f"{x.value} is used")
    return _arguments(text, op, lambda xs, _: [*xs[: at - 1], *xs[at:]])


def rename_argument(text: str, op: str, at: int, name: str) -> str:
    """A new name for the variable of an argument, in the wrapper and in the clauses of the callbacks."""
    need(legal_variable(name), "no variable name")
    mod = module_of(text)
    edits = []
    form = _wrapper(mod, op)
    places = [(c, (c.groups[0][0].groups[0] if _tupled(form) else c.groups[0])[at - 1]) for c in form.groups[1]] if form else []
    for call in calls_of(mod, op):
        x = call.groups[0][3].groups[0][at - 1] if call.groups[0][3].type == "list" and len(call.groups[0][3].groups[0]) >= at else None
        if x is not None and x.info.get("category") == "pattern":
            places.append((next(k for f in mod.forms if f.type == "function" for k in f.groups[1] if any(y is x for y in k.walk())), x))
    for clause, x in places:
        if x.type == "variable":
            need(name not in variables(clause), f"{name} is used in a clause")
            edits += [(v.lo, v.hi, name) for v in clause.walk() if v.type == "variable" and v.value == x.value]
    need(bool(edits), "no variable there")
    return splice(text, edits)


def remove_operation(text: str, op: str) -> str:
    """Drops the operation: its clauses in the callbacks, its generated calls, its wrapper and the wrapper's export."""
    mod = module_of(text)
    calls = calls_of(mod, op)
    need(bool(calls), f"no operation {op}")
    edits, done = [], set()
    for form in mod.forms:
        if form.type != "function" or name_of(form.groups[0][0]) not in CALLBACKS:
            continue
        gone = [c for c in form.groups[1] if any(x is y for x in calls for p in c.groups[0] for y in p.walk())]
        done |= {id(y) for c in gone for y in c.walk()}
        edits += drop_clauses(text, form, gone) if gone else []
    for form in mod.forms:
        for n in form.walk() if form.type == "function" else ():
            if n.type == "list":
                # a generated call may be weighed: {Weight, {call, ..}}
                gone = [x for x in n.groups[0] if any(x is c or (x.type == "tuple" and any(y is c for y in x.groups[0])) for c in calls if id(c) not in done)]
                edits += drop_items(text, n.groups[0], gone)
    form = _wrapper(mod, op)
    if form is not None:
        edits += [drop_form(text, form), *unexport_edits(text, mod, op, form.info["arity"])]
    return splice(text, edits)


def add_operation(text: str, op: str, generators: list[str], sut: str = "?SUT") -> str:
    """A new operation: a generated call in the last list of calls, callback clauses that allow all, and a wrapper."""
    need(legal_atom(op), "no function name")
    mod = module_of(text)
    need(not calls_of(mod, op) and _wrapper(mod, op) is None, f"{op} is there already")
    made = {id(n) for form in mod.forms if form.type == "function" for n in form.walk() if n.type == "tuple" and n.groups[0] and name_of(n.groups[0][0]) == "call" and n.info.get("category") == "expression"}
    holds = lambda x: id(x) in made or (x.type == "tuple" and any(id(y) in made for y in x.groups[0]))
    lists = [n for form in mod.forms if form.type == "function" for n in form.walk() if n.type == "list" and any(map(holds, n.groups[0]))]
    need(bool(lists), "no list of generated calls")
    args = [f"Arg{i + 1}" for i in range(len(generators))]
    edits = [(lists[-1].groups[0][-1].hi, lists[-1].groups[0][-1].hi, f", {{call, ?MODULE, {op}, [{', '.join(generators)}]}}")]
    call = f"{{call, _, {op}, [{', '.join('_' + a for a in args)}]}}"
    heads = {("precondition", 2): f"precondition(_S, {call}) ->\n    true;\n", ("next_state", 3): f"next_state(S, _V, {call}) ->\n    S;\n", ("postcondition", 3): f"postcondition(_S, {call}, _R) ->\n    true;\n"}
    edits += [(mod.functions[k].lo, mod.functions[k].lo, v) for k, v in heads.items() if k in mod.functions]
    end = mod.forms[-1].hi
    edits.append((end, end, f"\n\n{op}({', '.join(args)}) ->\n    {sut}:{op}({', '.join(args)})."))
    return splice(text, [*edits, *export_edit(text, mod, op, len(args))])


BUG = "[a-z]+_bug_[0-9]+"


def bug_conditions(text: str, name: str = BUG) -> str:
    """Macros that stand for conditions of known bugs become false, and what follows from that is folded."""
    is_bug = lambda b, _: b["E@"].type == "macro" and re.fullmatch(name, b["E@"].value) is not None
    rules = [
        Rule("E@", "false", is_bug),
        *RULE_SETS["booleans"],
        Rule("[E@ || Es@@, true]", lambda b, c: f"[{c.source(b['E@'])} || {', '.join(map(c.source, b['Es@@']))}]" if b["Es@@"] else f"[{c.source(b['E@'])}]"),
        Rule("[E@ || Es@@, false]", "[]"),
        Rule("E@ ++ []", "E@"),
        Rule("[] ++ E@", "E@"),
        Rule("?IMPL(false, E@)", "true"),
        *RULE_SETS["if"],
        *RULE_SETS["case"],
    ]
    try:
        text = rewrite_text(text, rules, "full_bu")
        mod = module_of(text)
    except Refused:
        return text
    edits: list[tuple[int, int, str]] = []
    for form in mod.forms:
        if form.type != "function":
            continue
        gone = []
        for c in form.groups[1]:
            guard = c.groups[1][0] if len(c.groups[1]) == 1 else None
            tests = guard.groups[0] if guard is not None and guard.type == "conjunction" else []
            if any(name_of(t) == "false" for t in tests):
                gone.append(c)
            elif sure := [t for t in tests if name_of(t) == "true"]:
                if len(sure) == len(tests):
                    at = text.rindex("when", c.lo, guard.lo)
                    edits.append((at, guard.hi + (text[guard.hi : guard.hi + 1] == " "), ""))
                else:
                    edits += drop_items(text, tests, sure)
        if gone and len(gone) < len(form.groups[1]):
            edits += drop_clauses(text, form, gone)
    return splice(text, edits)
