"""Tokens of source text: plain, with layout, and comments alone.

The lexical rules are those of the public Erlang language manual. Positions are
(line, column), both from 1; a tab moves to the next multiple of ``tab`` plus one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

KEYWORDS = frozenset(
    "after and andalso band begin bnot bor bsl bsr bxor case catch cond div end fun if let maybe not of or orelse receive rem try when xor else".split()
) - {"cond", "let", "maybe", "else"}

_TOKEN = re.compile(
    r"""(?P<white>[\s\x00-\x20\x80-\xa0]+)
  | (?P<comment>%[^\n]*)
  | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)
  | (?P<integer>\d+\#[0-9a-zA-Z]+|\d+)
  | (?P<var>[A-Z_À-ÖØ-Þ][\w@]*)
  | (?P<atom>[a-zß-öø-ÿ][\w@]*|'(?:[^'\\]|\\.)*')
  | (?P<string>"(?:[^"\\]|\\.)*")
  | (?P<char>\$(?:\\(?:\^.|[0-7]{1,3}|x\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.)|.))
  | (?P<punct><<|>>|->|<-|<=|=>|:=|=<|>=|=:=|=/=|==|/=|\+\+|--|\|\||::|\.\.\.|\.\.|[-()\[\]{}|,;.!?+*/=:\#<>&^@~])
""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    line: int
    col: int
    offset: int
    end: int


class LexError(ValueError):
    pass


def scan(text: str, layout: bool = False, tab: int = 8) -> list[Token]:
    """All tokens of ``text``; white space and comments only if ``layout``. Illegal characters raise LexError.

    A dot before white space, a comment or the end ends a form and has kind ``dot``.
    """
    out, at, line, col = [], 0, 1, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise LexError(f"illegal character at {line}:{col}")
        kind, value = m.lastgroup, m.group()
        if kind == "atom" and value in KEYWORDS:
            kind = "keyword"
        elif kind == "punct" and value == "." and (m.end() == len(text) or text[m.end()].isspace() or text[m.end()] == "%"):
            kind = "dot"
        if layout or kind not in ("white", "comment"):
            out.append(Token(kind, value, line, col, at, m.end()))
        for c in value:
            if c == "\n":
                line, col = line + 1, 1
            elif c == "\t":
                col = (col - 1) // tab * tab + tab + 1
            else:
                col += 1
        at = m.end()
    return out


def comments(text: str, tab: int = 8) -> list[tuple[int, int, int, str]]:
    """(line, column, indentation, text) of each comment; the indentation is -1 after other tokens of its line."""
    out, seen = [], -1
    for t in scan(text, True, tab):
        if t.kind == "comment":
            out.append((t.line, t.col, -1 if seen == t.line else t.col - 1, t.value))
        elif t.kind != "white":
            seen = t.line
    return out


def concat(tokens: list[Token]) -> str:
    """Token texts put together again, with one blank where two would run into each other."""
    out = ""
    for t in tokens:
        if out and t.kind != "white" and (out[-1].isalnum() or out[-1] in "_@'\"") and (t.value[0].isalnum() or t.value[0] in "_@'\""):
            out += " "
        out += t.value
    return out


TOKENS = "file_id long, seq int, kind string, value string, line int, col int"


def tokens(files: DataFrame, layout: bool = False, tab: int = 8) -> DataFrame:
    """``tokens`` stage table of ``files`` (file_id, content); a file that cannot be read has one row of kind ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, text in zip(pdf.file_id, pdf.content, strict=True):
                try:
                    rows += [(i, k, t.kind, t.value, t.line, t.col) for k, t in enumerate(scan(text or "", layout, tab))]
                except LexError as e:
                    rows.append((i, 0, "error", str(e), 0, 0))
            yield pd.DataFrame(rows, columns=["file_id", "seq", "kind", "value", "line", "col"])

    return files.select("file_id", "content").mapInPandas(run, TOKENS)
