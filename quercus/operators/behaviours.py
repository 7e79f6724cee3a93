"""Refactorings of behaviour modules: callback declarations, instances, and calls to reflected modules."""

from __future__ import annotations

from quercus.operators.edits import drop_form, export_edit, insert_attribute, legal_atom, module_of, need, source, unexport_edits
from quercus.operators.pattern import Context, Rule, rewrite_text
from quercus.sources.parser import Node
from quercus.trees.annotate import Module, name_of
from quercus.trees.render import splice

INFO = ("behaviour_info", 1)


def _list(mod: Module) -> Node | None:
    """The list of callbacks that ``behaviour_info(callbacks)`` gives."""
    form = mod.functions.get(INFO)
    for c in form.groups[1] if form else ():
        if name_of(c.groups[0][0]) == "callbacks" and c.groups[2][-1].type == "list":
            return c.groups[2][-1]
    return None


def callbacks(text: str) -> list[tuple[str, int]]:
    """The declared callbacks: of ``behaviour_info`` and of ``-callback`` attributes."""
    mod = module_of(text)
    own = _list(mod)
    out = [(name_of(t.groups[0][0]), int(t.groups[0][1].value)) for t in own.groups[0] if t.type == "tuple"] if own else []
    for form in mod.forms:
        if form.type == "attribute" and form.value == "callback":
            toks, depth, commas, some = [v for _, v in form.info["tokens"]], 0, 0, False
            for v in toks[1:]:
                depth += (v in "([{") - (v in ")]}")
                if depth == 0:
                    break
                some |= v != "("
                commas += v == "," and depth == 1
            out.append((toks[0].strip("'"), commas + 1 if some else 0))
    return out


def _declare(text: str, new: list[tuple[str, int]]) -> str:
    mod = module_of(text)
    known = set(callbacks(text))
    new = [x for x in new if x not in known]
    need(bool(new), "all are declared already")
    items = ", ".join(f"{{{f}, {a}}}" for f, a in new)
    own = _list(mod)
    if own is not None:
        at = own.groups[0][0].lo if own.groups[0] else own.lo + 1
        return splice(text, [(at, at, items + (", " if own.groups[0] else ""))])
    edits = export_edit(text, mod, *INFO)
    end = mod.forms[-1].hi
    edits.append((end, end, f"\n\nbehaviour_info(callbacks) ->\n    [{items}];\nbehaviour_info(_Other) ->\n    undefined."))
    return splice(text, edits)


def add_callback(text: str, f: str, a: int) -> str:
    """Declares the callback f/a, in ``behaviour_info`` or a new one."""
    need(legal_atom(f) and a >= 0, "no function name or arity")
    return _declare(text, [(f, a)])


def add_callbacks(text: str, f: str) -> str:
    """Declares a callback for each arity in which the module defines f."""
    own = sorted(a for name, a in module_of(text).functions if name == f)
    need(bool(own), f"{f} is not defined here")
    return _declare(text, [(f, a) for a in own])


def remove_declaration(text: str) -> str:
    """Drops ``behaviour_info`` and its export."""
    mod = module_of(text)
    need(INFO in mod.functions, "no declaration")
    return splice(text, [drop_form(text, mod.functions[INFO]), *unexport_edits(text, mod, *INFO)])


def create_instance(behaviour: str, name: str, text: str | None = None) -> str:
    """The module ``name`` as an instance of the behaviour: ``text`` with the declaration, or a new module."""
    need(legal_atom(name) and name != behaviour, "no module name")
    if text is None:
        return f"-module({name}).\n-behaviour({behaviour}).\n"
    mod = module_of(text)
    own = [x for x in mod.forms if x.type == "attribute" and x.value in ("behaviour", "behavior") and name_of(x.groups[0][0]) == behaviour]
    return text if own else insert_attribute(text, mod, f"-behaviour({behaviour}).")


def instantiate_calls(text: str, module: str) -> str:
    """Calls of declared callbacks in a module that is no fixed name go to ``module``."""
    own = set(callbacks(text))
    need(bool(own), "no callbacks are declared")

    def known(b, _: Context) -> bool:
        return b["Mod@"].type != "atom" and (b["f@"].value, len(b["Args@@"])) in own

    return rewrite_text(text, [Rule("Mod@:f@(Args@@)", f"{module}:f@(Args@@)", known)], "stop_td")


def expression_to_instance(text: str, line: int, callback: str, module: str, instance: str) -> tuple[str, str]:
    """The first call on the line goes through a callback of the behaviour; the instance gets a function that makes it."""
    mod = module_of(text)
    hits = [n for form in mod.forms if form.type == "function" for n in form.walk() if n.type == "application" and n.start[0] == line]
    need(bool(hits) and legal_atom(callback), "no call there")
    n = hits[0]
    args = sorted({v.value for v in n.walk() if v.type == "variable"})
    text2 = splice(text, [(n.lo, n.hi, f"{instance}:{callback}({', '.join(args)})")])
    out = add_callback(text2, callback, len(args))
    made = create_instance(mod.name, instance)
    body = source(text, n)
    if n.groups[0][0].type == "atom" and (n.groups[0][0].value, len(n.groups[1])) in mod.functions:
        body = f"{module}:{body}"
    return out, made + f"-export([{callback}/{len(args)}]).\n\n{callback}({', '.join(args)}) ->\n    {body}.\n"


def function_to_instance(text: str, f: str, a: int, instance: str) -> tuple[str, str]:
    """f/a moves into an instance of the module as its callback; calls go to the instance."""
    mod = module_of(text)
    need((f, a) in mod.functions, f"{f}/{a} is not defined here")
    form = mod.functions[f, a]
    calls = [n for x in mod.forms if x.type == "function" and x is not form for n in x.walk() if n.type == "application" and name_of(n.groups[0][0]) == f and len(n.groups[1]) == a and n.groups[0][0].type == "atom"]
    edits = [(n.lo, n.lo, f"{instance}:") for n in calls]
    left = splice(text, [*edits, drop_form(text, form), *unexport_edits(text, mod, f, a)])
    return add_callback(left, f, a), create_instance(mod.name, instance) + f"-export([{f}/{a}]).\n\n{source(text, form)}\n"


def unfold_instance(text: str, instance: str, module: str) -> str:
    """The functions of an instance come back into the module; calls to the instance become local."""
    own, two = module_of(text), module_of(instance)
    clash = set(own.functions) & set(two.functions)
    need(not clash, f"defined in both: {sorted(clash)}")
    calls = [n.groups[0][0] for x in own.forms if x.type == "function" for n in x.walk() if n.type == "application" and n.groups[0][0].type == "module_qualifier" and name_of(n.groups[0][0].groups[0][0]) == two.name]
    text = splice(text, [(q.lo, q.groups[1][0].lo, "") for q in calls])
    back = [n.groups[0][0] for x in two.forms if x.type == "function" for n in x.walk() if n.type == "application" and n.groups[0][0].type == "module_qualifier" and name_of(n.groups[0][0].groups[0][0]) == module]
    body = splice(instance, [(q.lo, q.groups[1][0].lo, "") for q in back])
    forms = "\n\n".join(source(body, x) for x in module_of(body).forms if x.type == "function")
    return text.rstrip() + "\n\n" + forms + "\n"
