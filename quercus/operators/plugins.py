"""Refactorings and inspections of users: what they ask for, check and do, registered by name and run over files."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quercus.operators.edits import Refused, need
from quercus.operators.pattern import Rule, rewrite_files, rewrite_text
from quercus.operators.scripts import Files, Names
from quercus.sources.stages import Stages


@dataclass(frozen=True)
class Args:
    """What a refactoring works on: the inputs it asked for, and the selected line (both ends) if any."""

    inputs: tuple[str, ...] = ()
    lines: tuple[int, int] | None = None


@dataclass(frozen=True)
class Refactoring:
    """One edit of a file. Either ``transform`` makes the new text, or ``rules`` are applied with ``strategy``."""

    name: str
    prompts: tuple[str, ...] = ()
    check: Callable[[str, Args], str | None] = lambda text, args: None
    transform: Callable[[str, Args], str] | None = None
    rules: Callable[[Args], list[Rule]] | None = None
    strategy: str = "full_td"

    def __post_init__(self) -> None:
        if (self.transform is None) == (self.rules is None):
            raise ValueError("a refactoring has a transform or rules")

    def apply(self, text: str, args: Args = Args()) -> str:
        need(len(args.inputs) == len(self.prompts), f"{self.name} asks for {len(self.prompts)} inputs")
        why = self.check(text, args)
        need(why is None, why or "")
        return self.transform(text, args) if self.transform else rewrite_text(text, self.rules(args), self.strategy)


@dataclass(frozen=True)
class Composite:
    """A script of edits of a code base, made from its inputs."""

    name: str
    steps: Callable[[Args], list[Callable[[Files, Names], Files]]]
    prompts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Inspector:
    """A query of the stage tables."""

    name: str
    query: Callable[..., DataFrame]
    prompts: tuple[str, ...] = ()


Plugin = Refactoring | Composite | Inspector


@dataclass
class Plugins:
    """Plug-ins by name."""

    known: dict[str, Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> Plugin:
        if plugin.name in self.known:
            raise ValueError(f"{plugin.name} is registered already")
        self.known[plugin.name] = plugin
        return plugin

    def remove(self, name: str) -> None:
        if name not in self.known:
            raise KeyError(name)
        del self.known[name]

    def discover(self, modules: list[str]) -> list[str]:
        """Registers the plug-ins that the named modules hold; the names found."""
        found = []
        for m in modules:
            for _, x in sorted(inspect.getmembers(importlib.import_module(m))):
                if isinstance(x, Refactoring | Composite | Inspector) and x.name not in self.known:
                    self.add(x)
                    found.append(x.name)
        return found

    def prompts(self, name: str) -> tuple[str, ...]:
        return self.known[name].prompts

    def run(self, name: str, files: DataFrame, args: Args = Args()) -> DataFrame:
        """``path, old_content, new_content, error`` of a refactoring over a table of files."""
        p = self.known[name]
        if not isinstance(p, Refactoring):
            raise TypeError(f"{name} is no refactoring of single files")
        return rewrite_files(files, lambda t: p.apply(t, args))

    def inspect(self, name: str, stages: Stages, *args) -> DataFrame:
        p = self.known[name]
        if not isinstance(p, Inspector):
            raise TypeError(f"{name} is no inspection")
        if len(args) != len(p.prompts):
            raise ValueError(f"{name} asks for {len(p.prompts)} inputs")
        return p.query(stages, *args)

    def script(self, name: str, files: Files, args: Args = Args()) -> Files:
        """The code base after a composite: all of its steps, or none."""
        p = self.known[name]
        if not isinstance(p, Composite):
            raise TypeError(f"{name} is no composite")
        now, names = dict(files), Names()
        try:
            for step in p.steps(args):
                now = step(now, names)
        except Refused:
            return dict(files)
        return now


def difference(before: str, after: str) -> list[tuple[str, str]]:
    """What a refactoring did, line by line: (-, old) and (+, new)."""
    import difflib

    return [(x[0], x[1:]) for x in difflib.unified_diff(before.split("\n"), after.split("\n"), n=0, lineterm="") if x[:1] in "+-" and x[:3] not in ("+++", "---")]
