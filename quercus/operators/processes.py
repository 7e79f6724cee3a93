"""Refactorings of processes: functions that become servers, names for processes, tags on messages."""

from __future__ import annotations

from quercus.operators.edits import legal_atom, module_of, need, new_name, source, variables
from quercus.sources.parser import Node
from quercus.trees.annotate import SPAWN, Module, calls_in, name_of, sequences
from quercus.trees.render import splice


def _atoms(mod: Module) -> set[str]:
    return {n.value for form in mod.forms if form.type == "function" for n in form.walk() if n.type == "atom"}


def registered(mod: Module) -> set[str]:
    """Names that the module registers or sends to."""
    out = set()
    for form in mod.forms:
        for n in form.walk() if form.type == "function" else ():
            if n.type == "application" and name_of(n.groups[0][0]) in ("register", "whereis", "unregister") and n.groups[1]:
                out.add(name_of(n.groups[1][0]))
            elif n.type == "infix_expr" and n.value == "!":
                out.add(name_of(n.groups[0][0]))
    return out - {None}


def function_to_process(text: str, f: str, a: int, name: str) -> str:
    """A function that does not call itself becomes a server registered as ``name``; its calls ask that server."""
    mod = module_of(text)
    need(legal_atom(name), "no process name")
    need((f, a) in mod.functions, f"{f}/{a} is not defined here")
    need(name not in registered(mod), f"{name} is in use")
    form = mod.functions[f, a]
    own = [c for c in calls_in(form, mod) if (c["m"], c["f"], c["a"]) == (mod.name, f, a)]
    need(not own, f"{f}/{a} is recursive")
    ask = new_name(f"{f}_rpc", {g for g, _ in mod.functions})
    need((f, 0) not in mod.functions or a == 0, f"{f}/0 is defined already")
    used = {v for c in form.groups[1] for v in variables(c)}
    sender = new_name("From", used)
    edits = []
    for x in mod.forms:
        for c in calls_in(x, mod) if x.type == "function" else ():
            if (c["m"], c["f"], c["a"]) == (mod.name, f, a) and c["shape"] in ("direct", "qualified"):
                n = c["node"]
                edits.append((n.lo, n.hi, f"{ask}({name}, {{{', '.join(source(text, y) for y in n.groups[1])}}})"))
            else:
                need((c["m"], c["f"], c["a"]) != (mod.name, f, a), f"{f}/{a} is used as a value")
    parts = []
    for c in form.groups[1]:
        args = ", ".join(source(text, p) for p in c.groups[0])
        guard = f" when {text[c.groups[1][0].lo : c.groups[1][-1].hi]}" if c.groups[1] else ""
        body = text[c.groups[2][0].lo : c.groups[2][-1].lo]
        last = source(text, c.groups[2][-1])
        inner = f"{body}{sender} ! {{{name}, {last}}}"
        parts.append(f"        {{{sender}, {{{args}}}}}{guard} ->\n            {inner},\n            {f}()")
    server = f"{f}() ->\n    receive\n" + ";\n".join(parts) + "\n    end."
    edits.append((form.lo, form.hi, server))
    for x in mod.forms:  # the function is a server without arguments now
        if x.type == "attribute" and x.value == "export" and x.groups[0] and x.groups[0][0].type == "list":
            edits += [(y.lo, y.hi, f"{f}/0") for y in x.groups[0][0].groups[0] if y.type == "infix_expr" and name_of(y.groups[0][0]) == f and y.groups[1][0].value == str(a)]
    end = mod.forms[-1].hi
    helper = (
        f"\n\n{ask}(Name, Request) ->\n    case whereis(Name) of\n        undefined ->\n            register(Name, spawn(fun {f}/0));\n        _ ->\n            ok\n    end,\n"
        f"    Name ! {{self(), Request}},\n    receive\n        {{Name, Result}} ->\n            Result\n    end."
    )
    return splice(text, [*edits, (end, end, helper)])


def _spawn_at(mod: Module, line: int) -> tuple[Node, Node, list[Node]]:
    """The function, the statement ``Pid = spawn(..)`` on the line, and the statements that it stands in."""
    for form in mod.forms:
        if form.type == "function":
            for seq in sequences(form):
                for n in seq:
                    if n.start[0] == line and n.type == "match_expr" and n.groups[0][0].type == "variable" and n.groups[1][0].type == "application" and name_of(n.groups[1][0].groups[0][0]) in SPAWN:
                        return form, n, seq
    need(False, "no process is spawned and named there")
    raise AssertionError


def register_process(text: str, line: int, name: str) -> str:
    """Registers the process that is spawned on the line, and sends to the name in place of its identifier."""
    mod = module_of(text)
    need(legal_atom(name), "no process name")
    need(name not in registered(mod) and name not in _atoms(mod), f"{name} is in use")
    form, n, _ = _spawn_at(mod, line)
    f, a = name_of(form.groups[0][0]), form.info["arity"]
    need(not any((c["m"], c["f"], c["a"]) == (mod.name, f, a) for c in calls_in(form, mod)), "the spawning function is recursive")
    need(not any(x.type in ("receive_expr", "list_comp") and x.lo <= n.lo and n.hi <= x.hi for x in form.walk()), "spawned inside a receive or a comprehension")
    v = n.groups[0][0]
    sends = [x.groups[0][0] for x in form.walk() if x.type == "infix_expr" and x.value == "!" and x.groups[0][0].type == "variable" and v.start in x.groups[0][0].info["def"]]
    known = [x for x in form.walk() if x.type == "application" and name_of(x.groups[0][0]) == "register" and any(y.type == "variable" and v.start in y.info["def"] for y in x.groups[1])]
    need(not known, "the process is registered already")
    return splice(text, [(n.hi, n.hi, f",\n    register({name}, {v.value})"), *((x.lo, x.hi, name) for x in sends)])


def add_tag(text: str, f: str, a: int, tag: str) -> str:
    """Tags the messages of the server f/a: the patterns of its receives, and what is sent to processes spawned to run it."""
    mod = module_of(text)
    need(legal_atom(tag), "no tag")
    need((f, a) in mod.functions, f"{f}/{a} is not defined here")
    server = mod.functions[f, a]
    receives = [n for n in server.walk() if n.type == "receive_expr"]
    need(bool(receives), "no receive there")
    patterns = [c.groups[0][0] for n in receives for g in n.groups for c in g if c.type == "clause"]
    edits = [(p.lo, p.hi, f"{{{tag}, {source(text, p)}}}") for p in patterns if p.type != "underscore"]
    found, known = False, set()
    for form in mod.forms:
        if form.type != "function":
            continue
        spawned = {id(c["node"]) for c in calls_in(form, mod) if c["shape"] == "spawn" and (c["m"], c["f"], c["a"]) == (mod.name, f, a)}
        found |= bool(spawned)
        starts = {n.groups[0][0].start for n in form.walk() if n.type == "match_expr" and n.groups[0][0].type == "variable" and id(n.groups[1][0]) in spawned}
        # names under which the process is registered in this function
        names = {name_of(n.groups[1][0]) for n in form.walk() if n.type == "application" and name_of(n.groups[0][0]) == "register" and len(n.groups[1]) == 2 and (id(n.groups[1][1]) in spawned or (n.groups[1][1].type == "variable" and set(n.groups[1][1].info["def"]) & starts))}
        known |= names
        for n in form.walk():
            to = n.groups[0][0] if n.type == "infix_expr" and n.value == "!" else None
            if to is not None and to.type == "variable" and set(to.info["def"]) & starts:
                m = n.groups[1][0]
                edits.append((m.lo, m.hi, f"{{{tag}, {source(text, m)}}}"))
    need(found, "no process is spawned to run it here")
    for form in mod.forms:
        for n in form.walk() if form.type == "function" else ():
            if n.type == "infix_expr" and n.value == "!" and name_of(n.groups[0][0]) in known:
                m = n.groups[1][0]
                edits.append((m.lo, m.hi, f"{{{tag}, {source(text, m)}}}"))
    return splice(text, edits)

