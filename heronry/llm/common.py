"""Shared helpers: reading tables, mapping Python kernels over rows, and tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by the path convention of the drivers; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a kernel gets at once, and the characters of text after which it gets no more.
BLOCK_ROWS, BLOCK_CHARS = 256, 1_000_000


def block_map(df: DataFrame, columns: list[str], schema: str, factory: Callable[[], Callable[..., Iterable[tuple]]], rows_out: int = 2048) -> DataFrame:
    """Runs a Python kernel over blocks of rows by Arrow batches.

    ``factory`` is called once a task; it returns a function from lists of column values to output rows, or that
    and another function that gives the rows left at the end of the task. Only ``columns`` reach Python, so extra
    columns of the input cannot clash. Memory is bounded by one Arrow batch, one block and ``rows_out`` rows.
    """
    out_type = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out_type)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def blocks(batches):
        for batch in batches:
            held, size = [], 0
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                held += zip(*(c.to_pylist() for c in part.columns))
                size += sum(len(v) for row in held[-part.num_rows :] for v in row if isinstance(v, (str, bytes)))
                if size > BLOCK_CHARS or len(held) >= BLOCK_ROWS:
                    yield held
                    held, size = [], 0
            if held:
                yield held

    def task(batches):
        made = factory()
        kernel, rest = made if isinstance(made, tuple) else (made, None)
        out: list[tuple] = []
        for held in blocks(batches):
            for row in kernel(*map(list, zip(*held))):
                out.append(row)
                if len(out) >= rows_out:
                    yield pack(out)
                    out = []
        for row in rest() if rest else ():
            out.append(row)
            if len(out) >= rows_out:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return df.select(*columns).mapInArrow(released(task), out_type)


def flat_map(df: DataFrame, columns: list[str], schema: str, factory: Callable, rows_out: int = 2048) -> DataFrame:
    """``block_map`` with a kernel that takes one row's values."""

    def by_block():
        made = factory()
        kernel, rest = made if isinstance(made, tuple) else (made, None)

        def block(*columns):
            for row in zip(*columns):
                yield from kernel(*row)

        return (block, rest) if rest else block

    return block_map(df, columns, schema, by_block, rows_out)


def released(task: Callable) -> Callable:
    """A task for Arrow batches that gives the memory it used back to the system at its end.

    Workers outlive their tasks; without this each keeps the most that any task of theirs ever held.
    """

    def run(batches):
        yield from task(batches)
        trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library: nothing to give back
        ctypes.CDLL(None).malloc_trim(0)


def new_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in itertools.count() if (n := f"_{name}{k or ''}") not in taken)


def held_out(key: Column, modulus: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``modulus``; null keys are never held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)) == fold, F.lit(False))


_OWN: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one if Spark runs in one process, as in
    tests; on a cluster executors would not share it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="heronry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Whether Spark deletes an action's shuffle files at its end, and not when the driver's memory happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and rereads it: lineage ends there, and lost executors cost no recomputation.

    What was shuffled to make it is deleted from the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heronry-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _OWN[path] = (spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._heronry_path = path
    return back


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later step reads."""
    for df in frames:
        path = getattr(df, "_heronry_path", None)
        if path and _OWN.pop(path, None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def most_frequent(df: DataFrame, count: str, size: int) -> DataFrame:
    """The rows of the highest counts: exactly ``size``, or all if there are no more.

    ``df`` is a table made by ``stored`` whose rows differ. Whole classes of equal counts are taken from the top down;
    of the class that no longer fits, the rows of the smallest hashes. Only the histogram of counts is sorted, and
    the cut among the hashes is narrowed by counting, so no task and not the driver gets more; the result is a filter.
    """
    levels = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, 0)
    so_far = df.groupBy(count).agg(F.count(F.lit(1)).alias("rows")).select(count, "rows", F.sum("rows").over(levels).alias("so_far"))
    last = so_far.where(F.col("so_far") > size).orderBy(F.desc(count)).limit(1).collect()
    if not last:
        return df
    level, before = last[0][count], last[0]["so_far"] - last[0]["rows"]
    tied = df.where(F.col(count) == F.lit(level))
    h = row_hash(df)
    cut = hash_cut(tied.select(h.alias("h")), size - before)
    return df.where((F.col(count) > F.lit(level)) | ((F.col(count) == F.lit(level)) & (h <= F.lit(cut))))


def row_hash(df: DataFrame, *columns: str) -> Column:
    """A hash of the row, or of some columns, spread over all 64-bit integers."""
    plain = [F.to_json(F.struct(F.col(c))) if not isinstance(df.schema[c].dataType, T.AtomicType) else F.col(c) for c in columns or df.columns]
    return F.xxhash64(*plain, F.lit(20))


def hash_cut(hashes: DataFrame, size: int) -> int:
    """The largest value up to which at most ``size`` of the hashes (a column h) lie; equal ones are in or out together.

    Found by histograms of ever longer leading bits: the driver gets 4,096 counts a round, six rounds at most.
    """
    outer = prefix = None
    for shift in (52, 40, 28, 16, 4, 0):
        part = F.shiftright("h", shift)
        inside = hashes if prefix is None else hashes.where(F.shiftright("h", outer) == F.lit(prefix))
        full = None
        for value, n in sorted(map(tuple, inside.groupBy(part).count().collect())):
            if n > size:
                full = value
                break
            size -= n
        if full is None:  # all of them fit
            return (1 << 63) - 1 if prefix is None else (prefix + 1 << outer) - 1
        outer, prefix = shift, full
        if not size:
            break
    return max((prefix << outer) - 1, -(1 << 63))


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_OWN.values()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; the folder's owner cleans it
            return
