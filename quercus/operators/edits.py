"""Shared pieces of text-to-text edits: parsing with refusal, clause removal, names that are not used yet."""

from __future__ import annotations

import re

from quercus.sources.parser import Node, parse_forms
from quercus.trees.annotate import Module, annotate, name_of
from quercus.trees.render import splice


class Refused(ValueError):
    """A precondition does not hold."""


def module_of(text: str) -> Module:
    forms, errors = parse_forms(text)
    if errors:
        raise Refused("the file does not parse: " + errors[0])
    return annotate(forms)


def need(ok: bool, why: str) -> None:
    if not ok:
        raise Refused(why)


def legal_atom(name: str) -> bool:
    return bool(re.fullmatch("[a-z][A-Za-z0-9_@]*", name))


def legal_variable(name: str) -> bool:
    return bool(re.fullmatch("[A-Z_][A-Za-z0-9_@]*", name))


def new_name(base: str, used: set[str]) -> str:
    """``base``, with ``_1`` appended as often as it takes to be no used name."""
    while base in used:
        base += "_1"
    return base


def numbered(used: set[str], base: str = "NewVar_"):
    """``NewVar_1``, ``NewVar_2`` and so on, used names left out."""
    k = 0
    while True:
        k += 1
        if f"{base}{k}" not in used:
            yield f"{base}{k}"


def variables(n: Node) -> set[str]:
    return {v.value for v in n.walk() if v.type == "variable"}


def source(text: str, n: Node) -> str:
    return text[n.lo : n.hi]


def drop_items(text: str, all_: list[Node], gone: list[Node]) -> list[tuple[int, int, str]]:
    """Edits that take ``gone`` out of the separated siblings ``all_``, each with one separator."""
    out = []
    left = [n for n in all_ if not any(n is g for g in gone)]
    for g in gone:
        k = next(i for i, n in enumerate(all_) if n is g)
        before = [n for n in left if n.lo < g.lo]
        if before or not left:
            lo = all_[k - 1].hi if k else g.lo
            out.append((lo, g.hi, ""))
        else:
            hi = all_[k + 1].lo if k + 1 < len(all_) else g.hi
            out.append((g.lo, hi, ""))
    return out


def drop_form(text: str, form: Node) -> tuple[int, int, str]:
    """An edit that takes a form out with the blank lines after it."""
    tail = re.match(r"[ \t]*\n*", text[form.hi :])
    return form.lo, form.hi + tail.end(), ""


def drop_clauses(text: str, form: Node, gone: list[Node]) -> list[tuple[int, int, str]]:
    """Edits that take clauses out of a function; all of them: the function goes."""
    if len(gone) == len(form.groups[1]):
        return [drop_form(text, form)]
    return drop_items(text, form.groups[1], gone)


def function_named(mod: Module, f: str, a: int | None = None) -> Node:
    for (name, arity), form in mod.functions.items():
        if name == f and a in (None, arity):
            return form
    raise Refused(f"{f} is not defined here")


def export_edit(text: str, mod: Module, f: str, a: int) -> list[tuple[int, int, str]]:
    """Edits that export f/a, none if it is exported."""
    if mod.is_exported(f, a):
        return []
    for form in mod.forms:
        if form.type == "attribute" and form.value == "export" and form.groups[0] and form.groups[0][0].type == "list" and form.groups[0][0].groups[0]:
            at = form.groups[0][0].groups[0][-1].hi
            return [(at, at, f", {f}/{a}")]
    at = next((x.hi for x in mod.forms if x.type == "attribute" and x.value == "module"), 0)
    return [(at, at, f"\n-export([{f}/{a}]).")]


def unexport_edits(text: str, mod: Module, f: str, a: int) -> list[tuple[int, int, str]]:
    """Edits that take f/a out of the export lists."""
    out = []
    for form in mod.forms:
        if form.type == "attribute" and form.value == "export" and form.groups[0] and form.groups[0][0].type == "list":
            own = form.groups[0][0].groups[0]
            gone = [x for x in own if x.type == "infix_expr" and name_of(x.groups[0][0]) == f and x.groups[1][0].value == str(a)]
            out += drop_items(text, own, gone)
    return out


def insert_attribute(text: str, mod: Module, line: str) -> str:
    """The text with a new attribute after the module's."""
    at = next((x.hi for x in mod.forms if x.type == "attribute" and x.value == "module"), None)
    return line + "\n" + text if at is None else splice(text, [(at, at, "\n" + line)])
