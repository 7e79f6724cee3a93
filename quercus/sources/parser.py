"""Recursive-descent parser of source forms into trees.

A tree node has a type, a value (names, operators, literals), children in
groups, and the span of source it came from. Node types follow the public
syntax-tools names of the language. Macros are not expanded, so positions stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from quercus.sources.tokenizer import LexError, Token, scan


class ParseError(ValueError):
    pass


@dataclass(eq=False)
class Node:
    type: str
    value: str = ""
    groups: list[list[Node]] = field(default_factory=list)
    start: tuple[int, int] = (0, 0)
    end: tuple[int, int] = (0, 0)
    lo: int = 0  # offsets in the text
    hi: int = 0
    info: dict = field(default_factory=dict)

    @property
    def children(self) -> list[Node]:
        return [x for g in self.groups for x in g]

    def walk(self):
        """All nodes, a node before its children."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def copy(self) -> Node:
        return Node(self.type, self.value, [[x.copy() for x in g] for g in self.groups], self.start, self.end, self.lo, self.hi, dict(self.info))


BINARY = {"=": (100, 1), "!": (100, 1), "orelse": (150, 1), "andalso": (160, 1)}
BINARY |= dict.fromkeys(("==", "/=", "=<", "<", ">=", ">", "=:=", "=/="), (200, 0))
BINARY |= dict.fromkeys(("++", "--"), (300, 1))
BINARY |= dict.fromkeys(("+", "-", "bor", "bxor", "bsl", "bsr", "or", "xor"), (400, -1))
BINARY |= dict.fromkeys(("*", "/", "div", "rem", "band", "and"), (500, -1))
PREFIX = ("+", "-", "bnot", "not")


class Parser:
    def __init__(self, text: str, tab: int = 8):
        self.toks: list[Token] = scan(text, tab=tab)
        self.at = 0

    # -- tokens ---------------------------------------------------------------
    def peek(self, k: int = 0) -> str | None:
        t = self.toks[self.at + k] if self.at + k < len(self.toks) else None
        return t and (t.value if t.kind in ("punct", "keyword", "dot") else None)

    def kind(self, k: int = 0) -> str | None:
        return self.toks[self.at + k].kind if self.at + k < len(self.toks) else None

    def take(self, want: str | None = None) -> Token:
        if self.at >= len(self.toks):
            raise ParseError("unexpected end")
        t = self.toks[self.at]
        if want is not None and self.peek() != want:
            raise ParseError(f"{t.line}:{t.col}: {want} expected before {t.value}")
        self.at += 1
        return t

    def has(self, want: str) -> bool:
        if self.peek() == want:
            self.at += 1
            return True
        return False

    def node(self, first: int, type_: str, value: str = "", *groups: list[Node], **info) -> Node:
        a, b = self.toks[first], self.toks[self.at - 1]
        return Node(type_, value, list(groups), (a.line, a.col), (b.line, b.col + b.end - b.offset - 1), a.offset, b.end, info)

    def several(self, item, close: str, sep: str = ",") -> list[Node]:
        out = []
        if self.has(close):
            return out
        while True:
            out.append(item())
            if self.has(close):
                return out
            self.take(sep)

    # -- forms ----------------------------------------------------------------
    def form(self) -> Node:
        i = self.at
        if self.peek() == "-" and self.kind(1) in ("atom", "keyword"):
            return self.attribute(i)
        name = None
        clauses = []
        while True:
            j = self.at
            if self.peek() == "?":
                head = self.macro()
            elif self.kind() == "atom":
                self.take()
                head = self.node(j, "atom", self.toks[j].value)
            else:
                t = self.toks[j]
                raise ParseError(f"{t.line}:{t.col}: a form expected")
            clauses.append(self.clause(j))
            clauses[-1].info["name"] = head
            name = name or head
            if not self.has(";"):
                break
        self.take(".")
        arity = len(clauses[0].groups[0])
        return self.node(i, "function", f"{name.value}", [name], clauses, arity=arity)

    def attribute(self, i: int) -> Node:
        self.take()
        name = self.take().value
        if name in ("spec", "type", "opaque", "callback") or (name == "record" and self._typed()) or name == "define":
            depth_lo = self.at
            while self.kind() != "dot":
                self.take()
            body = self.toks[depth_lo : self.at]
            self.take()
            return self.node(i, "attribute", name, text=" ".join(t.value for t in body), tokens=[(t.kind, t.value) for t in body])
        args = []
        if self.has("("):
            args = self.several(self.name_or_expr, ")")
        self.take(".")
        return self.node(i, "attribute", name, args)

    def _typed(self) -> bool:
        k = 0
        while self.kind(k) not in ("dot", None):
            if self.peek(k) == "::":
                return True
            k += 1
        return False

    def name_or_expr(self) -> Node:
        """An expression in which name/arity is an arity qualifier."""
        return self.expr()

    def clause(self, i: int, open_: bool = True) -> Node:
        pats: list[Node] = []
        if open_:
            self.take("(")
            pats = self.several(self.expr, ")")
        guard = self.guard()
        self.take("->")
        return self.node_after(i, "clause", "", pats, guard, self.body())

    def node_after(self, i, type_, value, *groups):
        return self.node(i, type_, value, *groups)

    def guard(self) -> list[Node]:
        if not self.has("when"):
            return []
        return self.guards()

    def guards(self) -> list[Node]:
        out, i = [], self.at
        while True:
            j = self.at
            one = [self.expr()]
            while self.has(","):
                one.append(self.expr())
            out.append(self.node(j, "conjunction", "", one))
            if not self.has(";"):
                break
        return [out[0]] if len(out) == 1 else [self.node(i, "disjunction", "", out)]

    def body(self) -> list[Node]:
        out = [self.expr()]
        while self.has(","):
            out.append(self.expr())
        return out

    # -- expressions ----------------------------------------------------------
    def expr(self, least: int = 0) -> Node:
        i = self.at
        if self.has("catch"):
            return self.node(i, "catch_expr", "", [self.expr()])
        if self.peek() in PREFIX:
            op = self.take().value
            left = self.node(i, "prefix_expr", op, [self.expr(600)])
        else:
            left = self.postfix()
        while (op := self.peek()) in BINARY:
            prec, assoc = BINARY[op]
            if prec < least:
                break
            self.take()
            right = self.expr(prec if assoc == 1 else prec + 1)
            left = self.node(i, "match_expr" if op == "=" else "infix_expr", op, [left], [right])
            if assoc == 0:
                least = max(least, 0)
        return left

    def postfix(self) -> Node:
        i = self.at
        left = self.primary()
        while True:
            p = self.peek()
            if p == "(" and left.type not in ("integer", "string", "float", "char"):
                self.take()
                left = self.node(i, "application", "", [left], self.several(self.expr, ")"))
            elif p == ":" and self.peek(1) != ":":
                self.take()
                left = self.node(i, "module_qualifier", "", [left], [self.primary()])
            elif p == "#" and self.kind(1) in ("atom", "punct"):
                left = self.record_or_map(i, left)
            else:
                return left

    def record_or_map(self, i: int, base: Node | None) -> Node:
        self.take("#")
        pre = [base] if base else []
        if self.has("{"):
            return self.node_last(i, "map_expr", "", pre, self.several(self.map_field, "}"))
        name = self.macro() if self.peek() == "?" else None
        word = name.value if name else self.take().value
        if self.has("."):
            f = self.at
            self.take()
            return self.node_last(i, "record_access" if base else "record_index_expr", word, pre, [self.node(f, "atom", self.toks[f].value)])
        self.take("{")
        return self.node_last(i, "record_expr", word, pre, self.several(self.record_field, "}"))

    node_last = node

    def map_field(self) -> Node:
        i = self.at
        key = self.expr(101)
        op = self.take().value
        if op not in ("=>", ":="):
            raise ParseError("map field expected")
        return self.node(i, "map_field_assoc" if op == "=>" else "map_field_exact", op, [key], [self.expr()])

    def record_field(self) -> Node:
        i = self.at
        name = self.primary()
        value = [self.expr()] if self.has("=") else []
        return self.node(i, "record_field", name.value, [name], value)

    def macro(self) -> Node:
        i = self.at
        self.take("?")
        self.has("?")
        name = self.take().value
        args = [self.several(self.expr, ")")] if self.peek() == "(" and name.isupper() and self._macro_call() else []
        return self.node(i, "macro", name, *args)

    def _macro_call(self) -> bool:
        return self.has("(")

    def primary(self) -> Node:
        i, k, p = self.at, self.kind(), self.peek()
        if k == "string":
            value = self.take().value
            while self.kind() == "string":
                value = value[:-1] + self.take().value[1:]
            return self.node(i, "string", value)
        if k in ("integer", "float", "char", "atom"):
            return self._leaf(k)
        if k == "var":
            return self._leaf("underscore" if self.toks[i].value == "_" else "variable")
        if p == "?":
            return self.macro()
        if p == "#":
            return self.record_or_map(i, None)
        if p == "(":
            self.take()
            inner = self.expr()
            self.take(")")
            return self.node(i, "parentheses", "", [inner])
        if p == "{":
            self.take()
            return self.node_last(i, "tuple", "", self.several(self.expr, "}"))
        if p == "[":
            return self.list_(i)
        if p == "<<":
            return self.binary(i)
        if p == "fun":
            return self.fun(i)
        if p == "begin":
            self.take()
            body = self.body()
            self.take("end")
            return self.node(i, "block_expr", "", body)
        if p == "if":
            self.take()
            cs = [self.if_clause()]
            while self.has(";"):
                cs.append(self.if_clause())
            self.take("end")
            return self.node(i, "if_expr", "", cs)
        if p == "case":
            self.take()
            arg = self.expr()
            self.take("of")
            cs = self.clauses()
            self.take("end")
            return self.node(i, "case_expr", "", [arg], cs)
        if p == "receive":
            self.take()
            cs = [] if self.peek() == "after" else self.clauses()
            after, act = [], []
            if self.has("after"):
                after = [self.expr()]
                self.take("->")
                act = self.body()
            self.take("end")
            return self.node(i, "receive_expr", "", cs, after, act)
        if p == "try":
            return self.try_(i)
        if p in PREFIX:
            return self.expr(600)
        t = self.toks[self.at] if self.at < len(self.toks) else None
        raise ParseError(f"{t.line}:{t.col}: unexpected {t.value}" if t else "unexpected end")

    def _leaf(self, type_: str) -> Node:
        i = self.at
        value = self.take().value
        return self.node(i, type_, value)

    def clauses(self) -> list[Node]:
        out = [self.case_clause()]
        while self.has(";"):
            out.append(self.case_clause())
        return out

    def case_clause(self) -> Node:
        i = self.at
        pat = self.expr()
        guard = self.guard()
        self.take("->")
        return self.node_after(i, "clause", "", [pat], guard, self.body())

    def if_clause(self) -> Node:
        i = self.at
        guard = self.guards()
        self.take("->")
        return self.node_after(i, "clause", "", [], guard, self.body())

    def try_(self, i: int) -> Node:
        self.take()
        body, of, catch, after = self.body(), [], [], []
        if self.has("of"):
            of = self.clauses()
        if self.has("catch"):
            catch = [self.catch_clause()]
            while self.has(";"):
                catch.append(self.catch_clause())
        if self.has("after"):
            after = self.body()
        self.take("end")
        return self.node(i, "try_expr", "", body, of, catch, after)

    def catch_clause(self) -> Node:
        i = self.at
        pat = self.postfix_class()
        guard = self.guard()
        self.take("->")
        return self.node_after(i, "clause", "", [pat], guard, self.body())

    def postfix_class(self) -> Node:
        i = self.at
        pat = self.expr()
        if self.has(":"):
            pat = self.node(i, "class_qualifier", "", [pat], [self.expr()])
        elif pat.type == "module_qualifier":
            if self.has(":"):
                pat = self.node(i, "class_qualifier", "", pat.groups[0], pat.groups[1], [self.primary()])
            else:
                pat = Node("class_qualifier", "", pat.groups, pat.start, pat.end, pat.lo, pat.hi)
        return pat

    def list_(self, i: int) -> Node:
        self.take()
        if self.has("]"):
            return self.node(i, "nil")
        items = [self.expr()]
        if self.has("||"):
            quals = self.several(self.qualifier, "]")
            return self.node(i, "list_comp", "", items, quals)
        while self.has(","):
            items.append(self.expr())
        tail = [self.expr()] if self.has("|") else []
        self.take("]")
        return self.node(i, "list", "", items, tail)

    def qualifier(self) -> Node:
        i = self.at
        left = self.expr()
        if self.peek() in ("<-", "<="):
            op = self.take().value
            return self.node(i, "generator" if op == "<-" else "binary_generator", op, [left], [self.expr()])
        return left

    def binary(self, i: int) -> Node:
        self.take()
        if self.has(">>"):
            return self.node(i, "binary", "", [])
        fields = [self.binary_field()]
        if self.has("||"):
            quals = self.several(self.qualifier, ">>")
            return self.node(i, "binary_comp", "", fields, quals)
        while self.has(","):
            fields.append(self.binary_field())
        self.take(">>")
        return self.node(i, "binary", "", fields)

    def binary_field(self) -> Node:
        i = self.at
        value = self.expr(600) if self.peek() in PREFIX else self.primary()
        size = [self.primary()] if self.has(":") else []
        types = ""
        if self.has("/"):
            types = self.take().value
            while self.peek() in ("-", ":"):
                types += self.take().value + self.take().value
        return self.node(i, "binary_field", types, [value], size)

    def fun(self, i: int) -> Node:
        self.take()
        if self.peek() != "(" and not (self.kind() == "var" and self.peek(1) == "("):
            a = self.primary()
            if self.has(":"):
                b = self.primary()
                self.take("/")
                n = self.primary()
                return self.node(i, "implicit_fun", "", [a, b, n])
            self.take("/")
            return self.node(i, "implicit_fun", "", [a, self.primary()])
        name = ""
        cs = []
        while True:
            j = self.at
            if self.kind() == "var":
                name = self.take().value
            cs.append(self.clause(j))
            if not self.has(";"):
                break
        self.take("end")
        return self.node(i, "fun_expr", name, cs)


def parse_forms(text: str, tab: int = 8) -> tuple[list[Node], list[str]]:
    """Forms that parse, and the messages of those that don't (their source is passed over up to the next dot)."""
    try:
        p = Parser(text, tab)
    except LexError as e:
        return [], [str(e)]
    forms, errors = [], []
    while p.at < len(p.toks):
        first = p.at
        try:
            forms.append(p.form())
        except (ParseError, IndexError) as e:
            errors.append(str(e))
            p.at = max(first, p.at - 1)
            while p.at < len(p.toks) and p.toks[p.at].kind != "dot":
                p.at += 1
            p.at += 1
    return forms, errors


def parse_exprs(text: str) -> list[Node]:
    """The expressions of a code string, separated by commas; a trailing dot is allowed."""
    p = Parser(text)
    out = p.body()
    p.has(".")
    if p.at < len(p.toks):
        t = p.toks[p.at]
        raise ParseError(f"{t.line}:{t.col}: unexpected {t.value}")
    return out


def parse_any(text: str) -> list[Node]:
    """Expressions, or a clause list, or a form: what the code string is."""
    try:
        return parse_exprs(text)
    except ParseError:
        p = Parser(text if text.rstrip().endswith(".") else text + " .")
        return [p.form()]
