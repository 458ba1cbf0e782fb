"""What the operators of this subpackage share: scratch tables in the shared folder, and what Python workers hold."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.scratch import Scratch, shared_dir  # noqa: F401  (for the operators)
from lithos.session import ship

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict = {}


def held(key, build):
    """The object of this key, built once in a Python worker. A worker holds one at a time: workers are used by one operator
    after another, and what each keeps would add up."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = build()
    return _held[key]


#: Allocations from so many bytes on are pages of their own, which go back to the system when they are freed; and so many
#: arenas are used (mallopt's M_MMAP_THRESHOLD, M_TRIM_THRESHOLD and M_ARENA_MAX of the GNU C library).
ALLOCATOR = ((-3, 1 << 20), (-1, 1 << 20), (-8, 2))


def trimmed(run):
    """A function over Arrow batches whose worker keeps nothing when its partition ends: an executor may have several idle
    workers."""

    @functools.wraps(run)
    def each(batches):
        with contextlib.suppress(AttributeError, OSError):
            for option in ALLOCATOR:
                ctypes.CDLL(None).mallopt(*option)
        yield from run(batches)
        _held.clear()
        release()

    return each


def release() -> None:
    """Give freed memory of this process back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def for_python(spark: SparkSession, rows: int = 512) -> None:
    """Before Python runs on executors: this package is there, and Arrow batches of this session have at most `rows`
    rows, so that a batch of very long texts fits a worker's memory."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for an operator's own columns, made of those wanted, that `df` hasn't got, whatever the case of its names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def by_batches(df: DataFrame, carried: list[str], inputs: list[Column], fields: list, run) -> DataFrame:
    """The columns `carried` of `df` and the fields `fields`, whose arrays run(arrays of `inputs`) gives for each Arrow batch.
    Columns go to Python by number, because names may hold anything and may be those of `fields` and `inputs`."""
    rows = df.select(*(F.col(quoted(c)) for c in carried), *inputs).toDF(*map(str, range(len(carried) + len(inputs))))
    schema = T.StructType([*rows.schema.fields[: len(carried)], *(T.StructField(f"f{k}", f.dataType) for k, f in enumerate(fields))])
    names = schema.names

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *run(*batch.columns[len(carried) :])], names=names)

    return rows.mapInArrow(trimmed(each), schema).toDF(*carried, *(f.name for f in fields))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
