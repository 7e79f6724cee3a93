"""Clone candidates over a stream of files: how often each statement was seen, kept as state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "hash string, n long, first string, fresh boolean"


def repeated_statements(stream: DataFrame, min_freq: int = 2) -> DataFrame:
    """``hash, n, first, fresh`` from a stream of statements (``hash, text``): a row whenever a statement's count grows at or
    beyond ``min_freq``; ``fresh`` when it gets there. The state of a statement is its count and its first text."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, first = state.get if state.exists else (0, None)
        more = 0
        for pdf in frames:
            more += len(pdf)
            least = pdf.text.min()
            first = least if first is None else first
        state.update((before + more, first))
        if before + more >= min_freq:
            yield pd.DataFrame([(key[0], before + more, first, before < min_freq)], columns=["hash", "n", "first", "fresh"])

    return stream.groupBy("hash").applyInPandasWithState(step, OUT, "n long, first string", "update", "NoTimeout")


def statements(stages) -> DataFrame:
    return stages.expr_seqs.select("hash", F.col("gen_text").alias("text"))
