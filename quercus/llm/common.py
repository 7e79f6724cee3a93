"""Shared pieces: the scratch folder, written tables, slices of Arrow batches, joins of skewed keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "[^\\x20\\x09-\\x0D]+"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quercus-")
    return _OWN["dir"]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._q_path = path
    return out


_SCOPES: list[list[tuple[SparkSession, str]]] = []


def disposable(f: Callable) -> Callable:
    """``f``, of which the results are written tables: the tables that it wrote on the way go when it returns."""

    @functools.wraps(f)
    def run(*args, **named):
        _SCOPES.append([])
        try:
            out = f(*args, **named)
        finally:
            made = _SCOPES.pop()
        keep = {x._q_path for x in (out if isinstance(out, tuple) else (out,))}
        for spark, path in made:
            if path not in keep:
                _remove(spark, path)
            elif _SCOPES:
                _SCOPES[-1].append((spark, path))
        return out

    return run


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`written` once nothing reads it any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, f)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``most`` bytes in ``column``; a longer row comes alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(size, dtype=np.int64) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, Arrow batches have ``most`` rows at most: for jobs whose rows are large blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, was)


BATCH_BYTES = 1 << 22


def bounded(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch to ``BATCH_BYTES`` for this session, as batches of long texts would be large.

    The only session setting that this subpackage leaves changed: batches are made when a result is used.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` alone, with Arrow batches of a bounded size."""
    bounded(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving memory back at its end: workers stay for later tasks."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        with contextlib.suppress(Exception):
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return whole


HOT = 1 << 12


def hot_keys(counts: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """``key`` of the rows of ``counts`` that hold more than one row in ``HOT`` of all: fewer than ``HOT`` keys, whatever the input."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > total // HOT).select(*key)


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str = "n", left: bool = False) -> DataFrame:
    """Join of ``rows`` with the one row a key of ``keyed``, which has in column ``n`` (not returned) how many rows it meets.

    Keys with many rows (fewer than ``HOT`` of them, so their broadcast has a proven bound) are joined where
    their rows are; all others are dealt by key. A row of ``rows`` is read once. With ``left``, rows without a
    partner stay, with nulls.
    """
    key = [key] if isinstance(key, str) else key
    keyed = written(keyed, "keyed")
    hot = written(hot_keys(keyed, key, n), "hot-keys")
    other = [c for c in keyed.columns if c not in (*key, n)]
    one = F.struct(*other, F.lit(1).alias("q_one"))
    few = keyed.join(F.broadcast(hot), key).select(*key, one.alias("q_hot"))
    at = rows.join(F.broadcast(few), key, "left")
    # rows that are done are dealt by salt and meet nothing more
    at = at.withColumn("q_salt", F.when(F.col("q_hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))))
    cold = keyed.join(F.broadcast(hot), key, "left_anti").select(*key, one.alias("q_cold"), F.lit(0).cast("long").alias("q_salt"))
    met = at.join(cold.hint("merge"), [*key, "q_salt"], "left").withColumn("q_found", F.coalesce("q_hot", "q_cold"))
    return (met if left else met.where("q_found is not null")).select(*rows.columns, *(F.col("q_found")[c].alias(c) for c in other))


MAYBE = "q_maybe"
BITMAP_WORDS = 1 << 17  # rows of a bitmap at the very most, whatever the input: a proven bound for its broadcast


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key, F.lit(7))
    return F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS)).cast("int"), h.bitwiseAND(63).cast("int")


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """A bit for each hashed key: ``q_word, q_bits`` with at most ``BITMAP_WORDS`` rows."""
    word, bit = _place(F.col(column))
    return keys.groupBy(word.alias("q_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("q_bits"))


def may_hold(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """``df`` with column ``MAYBE``: false only for keys that are surely not in the bitmap. A filter before an exact join."""
    word, bit = _place(F.col(column))
    with_word = df.withColumn("q_word", word).join(F.broadcast(bits), "q_word", "left")
    hit = F.call_function("shiftright", F.col("q_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return with_word.withColumn(MAYBE, F.coalesce(hit, F.lit(False))).drop("q_word", "q_bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
