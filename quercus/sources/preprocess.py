"""Macros and included files: source text with its macros expanded, and what it defines and uses.

Headers travel with the files that include them (however far down), so a file is
expanded where it is, and no table of headers is sent to all executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.sources.tokenizer import LexError, Token, concat, scan

DIRECTIVES = ("define", "undef", "ifdef", "ifndef", "else", "endif", "include", "include_lib")
PREDEFINED = {"LINE": "0", "FILE": '""', "MACHINE": "'BEAM'", "FUNCTION_NAME": "undefined", "FUNCTION_ARITY": "0"}


class MacroError(ValueError):
    pass


@dataclass
class Expanded:
    """The expanded text, the macros defined (name, parameters or null, body), those used, and headers that are not there."""

    text: str = ""
    defined: list[tuple[str, list[str] | None, str]] = field(default_factory=list)
    used: list[tuple[str, int]] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _forms(toks: list[Token]) -> Iterator[list[Token]]:
    form: list[Token] = []
    for t in toks:
        form.append(t)
        if t.kind == "dot":
            yield form
            form = []
    if any(t.kind not in ("white", "comment") for t in form):
        yield form


def _arguments(toks: list[Token], at: int) -> tuple[list[list[Token]], int] | None:
    """The arguments in parentheses from ``at`` on and the place after them; null where none follow."""
    if at >= len(toks) or toks[at].value != "(":
        return None
    depth, out, now = 0, [], []
    for k in range(at, len(toks)):
        v = toks[k].value
        if v in ("(", "[", "{", "<<"):
            depth += 1
        elif v in (")", "]", "}", ">>"):
            depth -= 1
        if depth == 0:
            if now or out:
                out.append(now)
            return out, k + 1
        if v == "," and depth == 1:
            out.append(now)
            now = []
        elif k > at:
            now.append(toks[k])
    raise MacroError("arguments of a macro do not end")


def _name(t: Token) -> str:
    return t.value.strip("'")


class Macros:
    """Definitions by name and number of arguments (null: without parentheses)."""

    def __init__(self, module: str = ""):
        self.known: dict[tuple[str, int | None], tuple[list[str], list[Token]]] = {}
        for k, v in {**PREDEFINED, "MODULE": module or "undefined", "MODULE_STRING": f'"{module}"'}.items():
            self.known[k, None] = ([], scan(v))

    def define(self, toks: list[Token]) -> tuple[str, list[str] | None, str]:
        """From the tokens between ``-define(`` and ``).``"""
        name, rest = _name(toks[0]), toks[1:]
        args, names = (_arguments(rest, 0) if rest and rest[0].value == "(" else None), None
        if args is not None:
            names = [a[0].value for a in args[0] if a]
            rest = rest[args[1] :]
        if not rest or rest[0].value != ",":
            raise MacroError(f"the definition of {name} has no body")
        self.known[name, None if names is None else len(names)] = (names or [], rest[1:])
        return name, names, concat(rest[1:])

    def undefine(self, name: str) -> None:
        for k in [k for k in self.known if k[0] == name]:
            del self.known[k]

    def has(self, name: str) -> bool:
        return any(k[0] == name for k in self.known)

    def expand(self, toks: list[Token], used: list[tuple[str, int]], inside: tuple = ()) -> list[Token]:
        out, at = [], 0
        while at < len(toks):
            t = toks[at]
            if t.value != "?" or at + 1 >= len(toks):
                out.append(t)
                at += 1
                continue
            if toks[at + 1].value == "?":  # ??Arg stays: only bodies of macros may have it
                out += toks[at : at + 3]
                at += 3
                continue
            name, line = _name(toks[at + 1]), t.line
            args = _arguments(toks, at + 2)
            key = (name, len(args[0])) if args is not None and (name, len(args[0])) in self.known else (name, None)
            if key not in self.known:
                raise MacroError(f"{line}: no macro {name}" + (f"/{len(args[0])}" if args is not None else ""))
            if key in inside:
                raise MacroError(f"{line}: the macro {name} uses itself")
            used.append((name, line))
            params, body = self.known[key]
            at = args[1] if key[1] is not None else at + 2
            given = dict(zip(params, args[0] if key[1] is not None else (), strict=True))
            filled: list[Token] = []
            k = 0
            while k < len(body):
                b = body[k]
                if b.value == "?" and k + 2 < len(body) and body[k + 1].value == "?" and body[k + 2].value in given:
                    text = '"' + concat(given[body[k + 2].value]).replace("\\", "\\\\").replace('"', '\\"') + '"'
                    filled.append(Token("string", text, line, t.col, 0, 0))
                    k += 3
                    continue
                filled += given[b.value] if b.kind == "var" and b.value in given else [b]
                k += 1
            if key == ("LINE", None):
                filled = [Token("integer", str(line), line, t.col, 0, 0)]
            out += self.expand(filled, used, (*inside, key))
        return out


def expand(text: str, headers: dict[str, str] | None = None, module: str = "", defines: dict[str, str] | None = None) -> Expanded:
    """``text`` with macros expanded and headers (by their path, or the end of it) put in."""
    out, macros, headers = Expanded(), Macros(module), headers or {}
    for k, v in (defines or {}).items():
        macros.known[k, None] = ([], scan(v))
    parts: list[str] = []

    def header(path: str) -> str | None:
        end = path.rpartition("/")[2]
        hits = sorted(p for p in headers if p == path or p.endswith("/" + path)) or sorted(p for p in headers if p.rpartition("/")[2] == end)
        return hits[0] if hits else None

    def run(source: str, open_: tuple[str, ...]) -> None:
        skip: list[bool] = []  # for each open condition whether its part is left out
        try:
            toks = scan(source)
        except LexError as e:
            out.errors.append(str(e))
            return
        for form in _forms(toks):
            word = form[1].value if len(form) > 2 and form[0].value == "-" else ""
            inner = form[3:-2] if len(form) > 4 else []
            if word in ("ifdef", "ifndef") and inner:
                skip.append(any(skip) or macros.has(_name(inner[0])) == (word == "ifndef"))
            elif word == "else" and skip:
                skip[-1] = not skip[-1] or any(skip[:-1])
            elif word == "endif" and skip:
                skip.pop()
            elif any(skip):
                continue
            else:
                try:
                    if word == "define" and inner:
                        out.defined.append(macros.define(inner))
                    elif word == "undef" and inner:
                        macros.undefine(_name(inner[0]))
                    elif word in ("include", "include_lib") and inner:
                        path = inner[0].value.strip('"')
                        found = header(path)
                        if found is None:
                            out.missing.append(path)
                        elif found not in open_:
                            run(headers[found], (*open_, found))
                    else:
                        if word == "module" and inner:
                            macros.known["MODULE", None] = ([], [inner[0]])
                            macros.known["MODULE_STRING", None] = ([], scan(f'"{_name(inner[0])}"'))
                        parts.append(concat([t for t in macros.expand(form[:-1], out.used)]) + ".")
                except MacroError as e:
                    out.errors.append(str(e))
        if skip:
            out.errors.append("a condition does not end")

    run(text, ())
    out.text = "\n".join(parts) + ("\n" if parts else "")
    return out


EXPANDED = "path string, content string, defined array<struct<name:string,arity:int,body:string>>, used array<struct<name:string,line:int>>, missing array<string>, errors array<string>"
INCLUDE = r'(?m)^\s*-\s*include(?:_lib)?\s*\(\s*"([^"]*)"'


def include_edges(files: DataFrame, headers: DataFrame) -> DataFrame:
    """``src, dst``: paths of files or headers and of the headers they include, by the name at the end of the path."""
    all_ = files.select("path", "content").union(headers.select("path", "content"))
    want = all_.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(1))).alias("name"))
    want = want.select("src", F.substring_index("name", "/", -1).alias("name")).distinct()
    have = headers.select(F.col("path").alias("dst"), F.substring_index("path", "/", -1).alias("name"))
    return want.join(have, "name").select("src", "dst")


def expanded(files: DataFrame, headers: DataFrame) -> DataFrame:
    """``path, content`` (expanded), ``defined, used, missing, errors`` of each file (``path, content``); ``headers`` likewise.

    A file meets the headers it reaches by includes, and no others.
    """
    from quercus.operators.graph import reachable
    from quercus.plans.staging import staged

    edges = staged(include_edges(files, headers), "includes")
    seeds = files.select(F.col("path").alias("node")).join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    near = reachable(edges, seeds).where("seed <> node").join(headers.select(F.col("path").alias("node"), F.col("content").alias("text")), "node")
    own = near.groupBy(F.col("seed").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("node", "text"))).alias("headers"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content, found in zip(pdf.path, pdf.content, pdf.headers, strict=True):
                e = expand(content or "", dict(found) if found is not None else {}, path.rpartition("/")[2].rpartition(".")[0])
                defined = [{"name": n, "arity": None if a is None else len(a), "body": b} for n, a, b in e.defined]
                rows.append((path, e.text, defined, [{"name": n, "line": k} for n, k in e.used], e.missing, e.errors))
            yield pd.DataFrame(rows, columns=["path", "content", "defined", "used", "missing", "errors"])

    return files.select("path", "content").join(own, "path", "left").mapInPandas(run, EXPANDED)


def macros_used(text: str) -> list[str]:
    """Names of the macros that a text uses, in order, once each."""
    return list(dict.fromkeys(re.findall(r"(?<!\?)\?\s*([A-Za-z_][A-Za-z0-9_@]*)", "".join(t.value for t in scan(text) if t.kind not in ("string", "char")))))
