"""Derived attributes of parsed forms: categories, variable bindings, resolved calls, statement sequences."""

from __future__ import annotations

from quercus.sources.parser import Node

BUILTINS = frozenset(
    """abs/1 apply/2 apply/3 atom_to_list/1 binary_to_list/1 element/2 error/1 exit/1 exit/2 float/1 hd/1 integer_to_list/1 is_atom/1
    is_binary/1 is_boolean/1 is_float/1 is_function/1 is_integer/1 is_list/1 is_map/1 is_number/1 is_pid/1 is_tuple/1 length/1 link/1
    list_to_atom/1 list_to_binary/1 list_to_integer/1 list_to_tuple/1 make_ref/0 map_size/1 max/2 min/2 monitor/2 node/0 now/0 put/2 get/1
    register/2 round/1 self/0 send/2 setelement/3 size/1 spawn/1 spawn/2 spawn/3 spawn/4 spawn_link/1 spawn_link/3 spawn_monitor/3
    spawn_opt/4 throw/1 time/0 tl/1 trunc/1 tuple_size/1 tuple_to_list/1 unlink/1 unregister/1 whereis/1""".split()
)
SPAWN = ("spawn", "spawn_link", "spawn_monitor", "spawn_opt")


def name_of(n: Node) -> str | None:
    if n.type == "atom":
        return n.value[1:-1] if n.value[:1] == "'" else n.value
    return None


def categories(form: Node) -> None:
    """Sets ``info['category']`` and ``info['ctx']`` (the role in the parent) of every node."""

    def set_(n: Node, cat: str, ctx: str) -> None:
        n.info["category"], n.info["ctx"] = cat, ctx
        for gi, g in enumerate(n.groups):
            for c in g:
                inner, role = cat, f"{n.type}.{gi}"
                if n.type == "function":
                    inner = "function_name" if gi == 0 else "clause"
                elif n.type == "clause":
                    inner = ("pattern", "guard_expression", "expression")[gi]
                elif n.type in ("case_expr", "if_expr", "receive_expr", "try_expr", "fun_expr") and c.type == "clause":
                    inner = "clause"
                elif n.type == "match_expr":
                    inner = "pattern" if gi == 0 else cat
                elif n.type in ("generator", "binary_generator"):
                    inner = "pattern" if gi == 0 else "expression"
                elif n.type == "attribute":
                    inner = "attribute"
                elif n.type == "record_field" and gi == 0:
                    inner = "record_field"
                elif n.type == "application" and gi == 0 and c.type == "atom":
                    inner = "operator"
                elif n.type == "implicit_fun":
                    inner = "operator"
                set_(c, inner, role)

    set_(form, "attribute" if form.type == "attribute" else "function", "form")


Env = dict[str, tuple[tuple[int, int], ...]]


def bindings(form: Node) -> None:
    """Sets ``info['def']`` (defining positions, empty if free) and ``info['role']`` (bind or use) of variables."""

    def mark(v: Node, role: str, pos) -> None:
        v.info["role"], v.info["def"] = role, tuple(pos)

    def pattern(n: Node, env: Env, shadow: set | None = None) -> Env:
        for x in n.walk():
            if x.type == "variable" and x.info.get("category") != "macro_name":
                if x.value in env and (shadow is None or x.value in shadow):
                    mark(x, "use", env[x.value])
                else:
                    env = env | {x.value: (x.start,)}
                    mark(x, "bind", env[x.value])
                    if shadow is not None:
                        shadow.add(x.value)
        return env

    def merge(a: list[Env]) -> Env:
        out: Env = {}
        for e in a:
            for k, v in e.items():
                out[k] = tuple(sorted({*out.get(k, ()), *v}))
        return out

    def clause(c: Node, env: Env, own: bool) -> Env:
        shadow = set() if own else None
        for p in c.groups[0]:
            env = pattern(p, env, shadow)
        for g in c.groups[1]:
            expr(g, env)
        return seq(c.groups[2], env)

    def seq(body: list[Node], env: Env) -> Env:
        for s in body:
            env = expr(s, env)
        return env

    def expr(n: Node, env: Env) -> Env:
        if n.type == "variable":
            mark(n, "use", env.get(n.value, ()))
            return env
        if n.type == "match_expr":
            env = expr(n.groups[1][0], env)
            return pattern(n.groups[0][0], env)
        if n.type in ("list_comp", "binary_comp"):
            inner, shadow = env, set()
            for q in n.groups[1]:
                if q.type in ("generator", "binary_generator"):
                    expr(q.groups[1][0], inner)
                    inner = pattern(q.groups[0][0], inner, shadow)
                else:
                    inner = expr(q, inner)
            seq(n.groups[0], inner)
            return env
        if n.type == "fun_expr":
            inner = env | ({n.value: (n.start,)} if n.value else {})
            for c in n.groups[0]:
                clause(c, inner, True)
            return env
        if n.type == "try_expr":
            inner = seq(n.groups[0], env)
            for c in [*n.groups[1], *n.groups[2]]:
                clause(c, inner if c in n.groups[1] else env, False)
            seq(n.groups[3], env)
            return env
        for g in n.groups:
            if g and all(c.type == "clause" for c in g):
                env = merge([clause(c, env, False) for c in g])
            else:
                env = seq(g, env)
        return env

    if form.type == "function":
        for c in form.groups[1]:
            clause(c, {}, True)
    elif form.type != "attribute":
        seq([form], {})


def structure(nodes: list[Node]) -> list[tuple[int, int]]:
    """Binding structure: (place of the use, place of its definition; 0 if free) in order of the variables."""
    found = [v for n in nodes for v in n.walk() if v.type == "variable"]
    place = {v.start: i + 1 for i, v in enumerate(found)}
    return sorted((i + 1, min((place.get(d, 0) for d in v.info.get("def", ())), default=0)) for i, v in enumerate(found))


def free(nodes: list[Node]) -> list[str]:
    """Names of variables used in ``nodes`` and bound before them, in order of their first use."""
    own = {v.start for n in nodes for v in n.walk() if v.type == "variable" and v.info.get("role") == "bind"}
    return list(dict.fromkeys(v.value for n in nodes for v in n.walk() if v.type == "variable" and v.info.get("role") == "use" and not set(v.info["def"]) & own))


def bound(nodes: list[Node]) -> list[Node]:
    return [v for n in nodes for v in n.walk() if v.type == "variable" and v.info.get("role") == "bind"]


def exported(nodes: list[Node], form: Node) -> list[str]:
    """Names bound in ``nodes`` and used after them."""
    own = {v.start for v in bound(nodes)}
    last = max(n.hi for n in nodes)
    return list(dict.fromkeys(v.value for v in form.walk() if v.type == "variable" and v.lo >= last and set(v.info.get("def", ())) & own))


class Module:
    """What the forms of one file declare."""

    def __init__(self, forms: list[Node]):
        self.forms = forms
        self.name = None
        self.exports: list[tuple[str, int]] = []
        self.imports: list[tuple[str, str, int]] = []
        self.attributes: list[tuple[str, str]] = []
        self.records: list[tuple[str, list[str]]] = []
        self.includes: list[str] = []
        self.macros: list[str] = []
        self.functions = {(name_of(f.groups[0][0]) or f.value, f.info["arity"]): f for f in forms if f.type == "function"}
        for f in forms:
            if f.type != "attribute":
                continue
            args = f.groups[0] if f.groups else []
            if f.value == "module" and args:
                self.name = name_of(args[0])
            elif f.value == "export" and args:
                self.exports += self._arities(args[0])
            elif f.value == "import" and len(args) == 2:
                self.imports += [(name_of(args[0]), *x) for x in self._arities(args[1])]
            elif f.value == "record":
                self.records.append(self._record(f))
            elif f.value in ("include", "include_lib") and args:
                self.includes.append(args[0].value.strip('"'))
            elif f.value == "define":
                self.macros += [v for _, v in f.info["tokens"][1:2]]
            else:
                self.attributes.append((f.value, f.info.get("text") or ", ".join(name_of(a) or a.value or a.type for a in args)))
        self.export_all = any(n == "compile" and "export_all" in str([x.value for f in forms if f.type == "attribute" and f.value == "compile" for g in f.groups for a in g for x in a.walk()]) for n, _ in self.attributes)

    @staticmethod
    def _arities(n: Node) -> list[tuple[str, int]]:
        items = n.groups[0] if n.type == "list" else []
        return [(name_of(i.groups[0][0]), int(i.groups[1][0].value)) for i in items if i.type == "infix_expr" and i.value == "/"]

    @staticmethod
    def _record(f: Node) -> tuple[str, list[str]]:
        if f.groups:
            a = f.groups[0]
            fields = a[1].groups[0] if len(a) > 1 and a[1].type == "tuple" else []
            return name_of(a[0]) or "", [name_of(x) or name_of(x.groups[0][0]) or "" for x in fields]
        toks = f.info["tokens"]
        name = toks[1][1] if len(toks) > 1 else ""
        fields, depth = [], 0
        for (_, prev), (kind, value) in zip(toks[2:], toks[3:], strict=False):
            depth += {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}.get(prev, 0)
            if kind == "atom" and prev in ("{", ",") and depth == 1:
                fields.append(value)
        return name, fields

    def is_exported(self, name: str, arity: int) -> bool:
        return self.export_all or (name, arity) in self.exports

    def resolve(self, name: str, arity: int) -> tuple[str | None, bool]:
        """Module of an unqualified call, and whether that is certain."""
        if (name, arity) in self.functions:
            return self.name, True
        for m, f, a in self.imports:
            if (f, a) == (name, arity):
                return m, True
        if f"{name}/{arity}" in BUILTINS:
            return "erlang", True
        return None, False


def _list_len(n: Node) -> int | None:
    if n.type == "nil":
        return 0
    return len(n.groups[0]) if n.type == "list" and not n.groups[1] else None


def calls_in(node: Node, mod: Module) -> list[dict]:
    """Calls below ``node``: callee, shape, certainty and place; five shapes are told apart."""
    out = []

    def module_of(n: Node) -> str | None:
        return mod.name if n.type == "macro" and n.value == "MODULE" else name_of(n)

    def add(n: Node, m, f, a, shape: str, sure: bool = True) -> None:
        out.append({"m": m, "f": f, "a": a, "shape": shape, "sure": bool(sure and m and f and a is not None), "node": n})

    for n in node.walk():
        if n.type == "implicit_fun":
            *q, f, a = n.groups[0]
            if f.type == "atom" and a.type == "integer":
                m, sure = (module_of(q[0]), True) if q else mod.resolve(name_of(f), int(a.value))
                add(n, m, name_of(f), int(a.value), "implicit_fun", sure)
        if n.type != "application":
            continue
        op, args = n.groups[0][0], n.groups[1]
        m, f = None, name_of(op)
        if op.type == "module_qualifier":
            m, f = module_of(op.groups[0][0]), name_of(op.groups[1][0])
            add(n, m, f, len(args), "qualified", m is not None)
        elif f:
            m, sure = mod.resolve(f, len(args))
            add(n, m, f, len(args), "direct", sure)
        else:
            add(n, None, None, len(args), "dynamic", False)
        if m == "erlang" and f == "apply" and len(args) == 3:
            add(n, module_of(args[0]), name_of(args[1]), _list_len(args[2]), "apply3")
        elif m == "erlang" and f == "apply" and len(args) == 2 and args[0].type == "implicit_fun":
            pass  # the implicit fun itself is counted
        elif m == "erlang" and f in SPAWN and len(args) >= 3:
            k = {3: 0, 4: 0 if f == "spawn_opt" else 1, 5: 1}.get(len(args), 0)
            add(n, module_of(args[k]), name_of(args[k + 1]), _list_len(args[k + 2]), "spawn")
    return out


def sequences(form: Node) -> list[list[Node]]:
    """Statement lists: bodies of clauses, blocks and try expressions."""
    out = []
    for n in form.walk():
        if n.type == "clause":
            out.append(n.groups[2])
        elif n.type == "block_expr":
            out.append(n.groups[0])
        elif n.type == "try_expr":
            out.append(n.groups[0])
            if n.groups[3]:
                out.append(n.groups[3])
        elif n.type == "receive_expr" and n.groups[2]:
            out.append(n.groups[2])
    return out


def annotate(forms: list[Node]) -> Module:
    for f in forms:
        categories(f)
        bindings(f)
    return Module(forms)
