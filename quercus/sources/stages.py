"""Stage tables of a code base: each file is parsed once, everything after is DataFrame work.

A table per kind of fact; files that fail to parse in part have rows in
``errors`` and their other forms are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quercus.sources.parser import Node, parse_forms
from quercus.sources.tokenizer import LexError, scan
from quercus.trees.annotate import Module, annotate, calls_in, name_of, sequences, structure

SCHEMAS = {
    "ast_nodes": "node_id int, parent_id int, group_idx int, child_idx int, pre int, post int, depth int, type string, value string, category string, ctx string,"
    " start_line int, start_col int, end_line int, end_col int, f string, a int, text string, is_leaf boolean",
    "bindings": "node_id int, role string, var string, line int, col int, f string, a int, defs array<struct<line:int,col:int>>",
    "functions": "m string, f string, a int, exported boolean, start_line int, end_line int, code_lines int, clauses int, text string",
    "exports": "f string, a int",
    "imports": "m string, f string, a int",
    "attributes": "name string, value string",
    "records": "name string, fields array<string>",
    "includes": "include string",
    "calls": "m string, f string, a int, callee_m string, callee_f string, callee_a int, shape string, sure boolean, node_id int, line int, col int",
    "expr_seqs": "m string, f string, a int, seq_id int, idx int, hash string, ntoks int, text string, gen_text string, binding string, start_line int, end_line int",
    "errors": "message string",
}


def generalised(text: str) -> tuple[str, int]:
    """The statement with variables and literals as class letters, and its number of tokens."""
    letters = {"var": "V", "integer": "I", "float": "F", "string": "S", "char": "C"}
    toks = scan(text)
    return " ".join(letters.get(t.kind, t.value) for t in toks), len(toks)


def code_lines(text: str) -> int:
    """Lines that carry a token; blank and comment lines never count."""
    out = set()
    for t in scan(text):
        out.update(range(t.line, t.line + t.value.count("\n") + 1))
    return len(out)


def analyse(text: str, path_module: str = "") -> dict[str, list[tuple]]:
    """Rows of all stage tables for one file."""
    forms, errors = parse_forms(text)
    mod: Module = annotate(forms)
    own = mod.name or path_module
    mod.name = own
    out: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    out["errors"] = [(e,) for e in errors]
    out["exports"], out["imports"], out["attributes"] = mod.exports, mod.imports, mod.attributes
    out["records"], out["includes"] = mod.records, [(i,) for i in mod.includes]
    counter = 0
    for form in forms:
        fa = (name_of(form.groups[0][0]) or form.value, form.info["arity"]) if form.type == "function" else (None, None)
        ids: dict[int, int] = {}

        def visit(n: Node, parent: int | None, gi: int, ci: int, depth: int, fa=fa, ids=ids) -> None:
            nonlocal counter
            me = counter
            counter += 1
            ids[id(n)] = me
            at = len(out["ast_nodes"])
            out["ast_nodes"].append(())
            for i, g in enumerate(n.groups):
                for j, c in enumerate(g):
                    visit(c, me, i, j, depth + 1)
            out["ast_nodes"][at] = (me, parent, gi, ci, me, counter - 1, depth, n.type, n.value, n.info.get("category"), n.info.get("ctx"), *n.start, *n.end, *fa, text[n.lo : n.hi], not n.children)

        visit(form, None, 0, 0, 0)
        for v in form.walk():
            if "role" in v.info:
                role = "free" if v.info["role"] == "use" and not v.info["def"] else v.info["role"]
                out["bindings"].append((ids[id(v)], role, v.value, *v.start, *fa, [{"line": a, "col": b} for a, b in v.info["def"]]))
        if form.type != "function":
            continue
        source = text[form.lo : form.hi]
        out["functions"].append((own, *fa, mod.is_exported(*fa), form.start[0], form.end[0], code_lines(source), len(form.groups[1]), source))
        for c in calls_in(form, mod):
            out["calls"].append((own, *fa, c["m"], c["f"], c["a"], c["shape"], c["sure"], ids[id(c["node"])], *c["node"].start))
        for k, seq in enumerate(sequences(form)):
            for i, s in enumerate(seq):
                gen, n = generalised(text[s.lo : s.hi])
                out["expr_seqs"].append((own, *fa, k, i, hashlib.md5(gen.encode()).hexdigest(), n, text[s.lo : s.hi], gen, str(structure([s])), s.start[0], s.end[0]))
    return out


class Stages:
    """The stage tables of ``files``, as attributes. ``persist`` keeps the parsed rows for several queries."""

    def __init__(self, files: DataFrame, persist: bool = True):
        self.files = files
        types = {k: _parse_datatype_string(v) for k, v in SCHEMAS.items()}
        schema = _parse_datatype_string("file_id long, " + ", ".join(f"{k} array<struct<{', '.join(f'{x.name}:{x.dataType.simpleString()}' for x in t.fields)}>>" for k, t in types.items()))
        arrow = to_arrow_schema(schema)
        names = {k: t.names for k, t in types.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [analyse_safely(t or "", m or "") for t, m in zip(b.column("content").to_pylist(), b.column("module").to_pylist(), strict=True)]
                cols = [b.column("file_id")] + [pa.array([[dict(zip(names[k], x, strict=True)) for x in r[k]] for r in rows], arrow.field(k).type) for k in SCHEMAS]
                yield pa.RecordBatch.from_arrays(cols, names=arrow.names)

        self.parsed = files.select("file_id", "module", "content").mapInArrow(run, schema)
        if persist:
            self.parsed = self.parsed.persist()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.parsed.select("file_id", F.inline(name))

    @property
    def module_edges(self) -> DataFrame:
        """``src, dst, f, a``: certain calls from one module of the code base to another."""
        known = self.functions.select("m").distinct()
        calls = self.calls.where("sure and m <> callee_m").select(F.col("m").alias("src"), F.col("callee_m").alias("dst"), F.col("callee_f").alias("f"), F.col("callee_a").alias("a")).distinct()
        return calls.join(known, F.col("dst") == known["m"], "left_semi")

    @property
    def call_edges(self) -> DataFrame:
        """``src, dst`` as ``m:f/a`` strings: certain calls between functions of the code base."""
        own = self.functions.select(mfa("m", "f", "a").alias("dst"))
        calls = self.calls.where("sure").select(mfa("m", "f", "a").alias("src"), mfa("callee_m", "callee_f", "callee_a").alias("dst")).distinct()
        return calls.join(own, "dst", "left_semi").select("src", "dst")

    @property
    def external_calls(self) -> DataFrame:
        own = self.functions.select(mfa("m", "f", "a").alias("dst"))
        calls = self.calls.where("callee_f is not null").select(mfa("m", "f", "a").alias("src"), mfa(F.coalesce("callee_m", F.lit("?")), "callee_f", "callee_a").alias("dst")).distinct()
        return calls.join(own, "dst", "left_anti").select("src", "dst")


def mfa(m, f, a):
    return F.concat(m if not isinstance(m, str) else F.col(m), F.lit(":"), f, F.lit("/"), a)


def analyse_safely(text: str, module: str) -> dict[str, list[tuple]]:
    try:
        return analyse(text, module)
    except (LexError, RecursionError) as e:
        return {k: [] for k in SCHEMAS} | {"errors": [(str(e),)]}
