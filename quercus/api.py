"""One object for a session of work on a code base: edits with a history, inspections, clones, and writing back.

The code base is a table of files. Every edit makes a new table and keeps the old one, so going back costs nothing; a
file that an edit refuses stays as it is, and ``refused`` says why. Nothing is written until ``save``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.operators import clones, inspections, pattern, refactor
from quercus.operators.edits import need
from quercus.operators.plugins import Args, Plugins
from quercus.plans.staging import staged
from quercus.sources.files import from_strings, read_files
from quercus.sources.stages import Stages


class Workspace:
    def __init__(self, files: DataFrame):
        self.files = files
        self.history: list[tuple[str, DataFrame]] = []
        self.refused: DataFrame | None = None
        self.plugins = Plugins()
        self._stages: Stages | None = None

    @classmethod
    def open(cls, spark: SparkSession, paths: str | list[str]) -> Workspace:
        return cls(read_files(spark, paths))

    @classmethod
    def of(cls, spark: SparkSession, files: dict[str, str]) -> Workspace:
        return cls(from_strings(spark, files))

    @property
    def stages(self) -> Stages:
        """The stage tables of the files as they are now, parsed once."""
        if self._stages is None:
            self._stages = Stages(self.files, persist=False)
            self._stages.parsed = staged(self._stages.parsed, "parsed")
        return self._stages

    def _set(self, files: DataFrame) -> None:
        self.files, self._stages = files, None

    def change(self, name: str, changes: DataFrame) -> DataFrame:
        """Takes a table of changes over, and gives it back written."""
        changes = staged(changes, "changes")
        self.history.append((name, self.files))
        self.refused = changes.where("error is not null").select("path", "error")
        self._set(staged(pattern.apply_changes(self.files, changes.where("error is null")), "files"))
        return changes

    def edit(self, name: str, edit: Callable[[str], str], mentions: str | None = None) -> DataFrame:
        return self.change(name, refactor.everywhere(self.files, edit, mentions))

    def undo(self) -> str | None:
        """Back to the files before the last change; its name, or null if there was none."""
        if not self.history:
            return None
        name, files = self.history.pop()
        self._set(files)
        return name

    # -- edits of the whole code base --------------------------------------------------------
    def rename_function(self, m: str, f: str, a: int, new: str) -> DataFrame:
        return self.change("rename function", refactor.rename_everywhere(self.stages, m, f, a, new))

    def rename_module(self, old: str, new: str) -> DataFrame:
        need(self.files.where(F.col("module") == new).isEmpty(), f"{new} is in use")
        changes = self.edit("rename module", lambda t: refactor.rename_module(t, old, new), old)
        moved = F.when(F.col("module") == old, F.regexp_replace("path", rf"{old}(\.[a-z]+)$", f"{new}$1")).otherwise(F.col("path"))
        self._set(self.files.withColumn("path", moved).withColumn("module", F.when(F.col("module") == old, F.lit(new)).otherwise(F.col("module"))))
        return changes

    def copy_module(self, old: str, new: str) -> DataFrame:
        need(self.files.where(F.col("module") == new).isEmpty(), f"{new} is in use")
        copy = staged(refactor.copy_module(self.files, old, new), "copy")
        self.history.append(("copy module", self.files))
        both = self.files.select("path", "content").unionByName(copy.select("path", "content"))
        self._set(pattern.apply_changes(both, copy.sparkSession.createDataFrame([], "path string, new_content string")))
        return copy

    def swap_arguments(self, m: str, f: str, a: int, i: int, j: int) -> DataFrame:
        return self.edit("swap arguments", lambda t: refactor.swap_arguments(t, m, f, a, i, j), f)

    def migrate(self, name: str) -> DataFrame:
        return self.edit(f"migrate {name}", lambda t: refactor.migrate(t, name))

    def run(self, plugin: str, args: Args = Args()) -> DataFrame:
        return self.change(plugin, self.plugins.run(plugin, self.files, args))

    # -- questions -----------------------------------------------------------------------------
    def similar_code(self, **params) -> DataFrame:
        return clones.similar_code(self.stages, clones.CloneParams(**params))

    def callers(self, m: str, f: str, a: int) -> DataFrame:
        return inspections.callers(self.stages, m, f, a)

    def changed_since(self, steps: int = 1) -> DataFrame:
        """``path, status`` of the files against those ``steps`` changes ago."""
        from quercus.sources.files import changed

        return changed(self.history[-steps][1], self.files)

    def save(self, path: str) -> None:
        """Writes the files as a table (``path, content``); on a shared folder or store."""
        self.files.select("path", "content").write.mode("errorifexists").parquet(path)
