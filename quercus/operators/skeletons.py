"""Parallel skeletons: maps over lists become farms, chunked maps and pipes of the ``skel`` library.

Each edit takes the line of the expression (null: everywhere), as one would select it.
"""

from __future__ import annotations

from quercus.operators.edits import legal_atom, module_of, need, new_name, source, variables
from quercus.operators.pattern import Context, Rule, rewrite_text
from quercus.sources.parser import Node
from quercus.trees.annotate import name_of
from quercus.trees.render import render


def _at(line: int | None, more=None):
    return lambda b, ctx: (line is None or ctx.node.start[0] == line) and (more is None or more(b, ctx))


def _same_variable(b, _: Context) -> bool:
    return b["I@"].type == b["J@"].type == "variable" and b["I@"].value == b["J@"].value


def farm(text: str, workers: int, line: int | None = None) -> str:
    """A worker ``{seq, F}``, a map or a comprehension becomes a farm of ``workers``."""
    need(workers > 0, "no worker")
    return rewrite_text(
        text,
        [
            Rule("{seq, E@}", f"{{farm, [{{seq, E@}}], {workers}}}", _at(line, lambda b, c: not _inside(c, "farm"))),
            Rule("lists:map(fun ?MODULE:f@/1, L@)", f"skel:run([{{farm, [{{seq, fun ?MODULE:f@/1}}], {workers}}}], L@)", _at(line)),
            Rule("[f@(I@) || J@ <- Is@]", f"skel:run([{{farm, [{{seq, fun ?MODULE:f@/1}}], {workers}}}], Is@)", _at(line, _same_variable)),
        ],
        "stop_td",
    )


def _inside(ctx: Context, name: str) -> bool:
    return any(n.type == "tuple" and n.groups[0] and name_of(n.groups[0][0]) == name and n.lo < ctx.node.lo and ctx.node.hi < n.hi for n in ctx.form.walk())


def chunk(text: str, size: int, line: int | None = None) -> str:
    """A comprehension or a farm becomes a map over chunks of the input."""
    need(size > 0, "no chunk size")
    after = "skel:run([{map, [{seq, fun %s:f@/1}], fun skel:partition/1, fun skel:combine/1}], skel:chunk(Is@, " + str(size) + "))"
    return rewrite_text(
        text,
        [
            Rule("[f@(I@) || J@ <- Is@]", after % "?MODULE", _at(line, _same_variable)),
            Rule("skel:run([{farm, [{seq, fun m@:f@/1}], N@}], Is@)", after % "m@", _at(line)),
            Rule("skel:run([{farm, [{seq, fun ?MODULE:f@/1}], N@}], Is@)", after % "?MODULE", _at(line)),
        ],
        "stop_td",
    )


def parallel_map(text: str, worker: str, decompose: str, compose: str, line: int | None = None) -> str:
    """A worker or a comprehension becomes a map with functions of the module that take the input apart and put the output together."""
    need(all(map(legal_atom, (worker, decompose, compose))), "no function name")
    inner = f"{{map, [{{seq, fun ?MODULE:{worker}/1}}], fun ?MODULE:{decompose}/1, fun ?MODULE:{compose}/1}}"
    return rewrite_text(
        text,
        [
            Rule("{seq, E@}", inner, _at(line, lambda b, c: not _inside(c, "map"))),
            Rule("[f@(I@) || J@ <- Is@]", f"skel:run([{inner}], Is@)", _at(line, _same_variable)),
        ],
        "stop_td",
    )


def _stages(e: Node, var: str) -> list[str] | None:
    """The functions of nested calls, innermost first; null if it is no chain over the variable."""
    out: list[str] = []
    while e.type == "application" and len(e.groups[1]) == 1:
        op = e.groups[0][0]
        if op.type == "atom":
            out.append(f"fun ?MODULE:{op.value}/1")
        elif op.type == "module_qualifier":
            out.append(f"fun {render(op)}/1")
        else:
            return None
        e = e.groups[1][0]
    return out[::-1] if e.type == "variable" and e.value == var and out else None


def pipe(text: str, line: int | None = None) -> str:
    """A chain of calls over each element becomes a pipe of workers."""

    def make(wrap: str):
        def after(b, _: Context) -> str | None:
            own = _stages(b["E@"], b["X@"].value) if b["X@"].type == "variable" else None
            if own is None or len(own) < 2:
                return None
            inner = "{pipe, [" + ", ".join(f"{{seq, {f}}}" for f in own) + "]}"
            return inner if not wrap else wrap.replace("INNER", inner).replace("INPUT", render(b["Xs@"]))

        return after

    return rewrite_text(
        text,
        [
            Rule("[E@ || X@ <- Xs@]", make("skel:run([INNER], INPUT)"), _at(line)),
            Rule("lists:map(fun(X@) -> E@ end, Xs@)", make("skel:run([INNER], INPUT)"), _at(line)),
            Rule("{seq, fun(X@) -> E@ end}", make(""), _at(line)),
        ],
        "stop_td",
    )


def parallel_accumulator(text: str, f: str, a: int) -> str:
    """The functions that would compute an accumulating tail recursion in parallel; the module itself stays as it is.

    The recursion has two clauses: one for ``[]`` that gives the accumulator, and one for ``[X | Xs]`` that goes on with
    ``Xs`` and with the accumulator combined with a value that depends on ``X`` alone (and on parameters that stay). A
    dispatcher starts a worker for each item, workers compute the values, and a collector combines them in order.
    """
    mod = module_of(text)
    need((f, a) in mod.functions, f"{f}/{a} is not defined here")
    form = mod.functions[f, a]
    need(len(form.groups[1]) == 2 and not any(c.groups[1] for c in form.groups[1]), "not two clauses without guards")
    clauses = form.groups[1]
    end = next((c for c in clauses if any(p.type in ("nil", "list") and not p.children for p in c.groups[0])), None)
    need(end is not None, "no clause for the empty list")
    step = clauses[1] if clauses[0] is end else clauses[0]
    at = next(i for i, p in enumerate(end.groups[0]) if p.type in ("nil", "list") and not p.children)
    result = end.groups[2][-1]
    accs = [i for i, p in enumerate(end.groups[0]) if p.type == "variable" and result.type == "variable" and p.value == result.value]
    need(len(end.groups[2]) == 1 and len(accs) == 1, "the empty list does not give the accumulator")
    acc = accs[0]
    items, call = step.groups[0][at], step.groups[2][-1]
    need(items.type == "list" and len(items.groups) > 1 and len(items.groups[0]) == 1 and items.groups[0][0].type == "variable" and items.groups[1] and items.groups[1][0].type == "variable", "no clause for [X | Xs]")
    need(call.type == "application" and name_of(call.groups[0][0]) == f and len(call.groups[1]) == a and len(step.groups[2]) == 1, "not one recursive call")
    x, xs = items.groups[0][0].value, items.groups[1][0].value
    args = call.groups[1]
    need(args[at].type == "variable" and args[at].value == xs, "the recursion does not go on with the rest")
    name = step.groups[0][acc].value
    new = args[acc]
    need(new.type == "infix_expr" and any(s.type == "variable" and s.value == name for s in (new.groups[0][0], new.groups[1][0])), "the accumulator is not combined by an operator")
    left = new.groups[0][0].type == "variable" and new.groups[0][0].value == name
    value = new.groups[1][0] if left else new.groups[0][0]
    stay = [p.value for i, p in enumerate(step.groups[0]) if i not in (at, acc)]
    need(all(args[i].type == "variable" and args[i].value == step.groups[0][i].value for i in range(a) if i not in (at, acc)), "other parameters change")
    need(variables(value) <= {x, *stay}, "the value depends on more than the item")
    used = {g for g, _ in mod.functions}
    dispatch, work, gather = (new_name(f"{f}_{n}", used) for n in ("dispatch", "worker", "collect"))
    extra = "".join(", " + v for v in stay)
    combine = f"Acc {new.value} Value" if left else f"Value {new.value} Acc"
    head = ", ".join("Items" if i == at else "Acc" if i == acc else step.groups[0][i].value for i in range(a))
    return (
        f"{f}({head}) ->\n    Parent = self(),\n    Pids = {dispatch}(Items, Parent{extra}),\n    {gather}(Pids, Acc).\n\n"
        f"{dispatch}(Items, Parent{extra}) ->\n    [spawn(fun() -> {work}(Item, Parent{extra}) end) || Item <- Items].\n\n"
        f"{work}({x}, Parent{extra}) ->\n    Parent ! {{self(), {source(text, value)}}}.\n\n"
        f"{gather}([], Acc) ->\n    Acc;\n{gather}([Pid | Pids], Acc) ->\n    receive\n        {{Pid, Value}} ->\n            {gather}(Pids, {combine})\n    end.\n"
    )
