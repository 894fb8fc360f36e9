"""What the operators share: word rules, shared storage, small Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import discard, shared_dir  # noqa: F401

#: White space between words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of a batch of rows that goes to Python and of one that comes back, about: texts may be long.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back, with batches to Python bounded by bytes from here on."""
    spark = df.sparkSession
    if not 0 < size_of(spark.conf.get(BATCH)) <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return scratch.materialize(df, label)


def size_of(text: str) -> int:
    """Bytes of a size as Spark's settings have it, like "64m"; 0 for what has none, which is no bound."""
    found = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0


def give_back() -> None:
    """Memory that is freed but kept goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work on the batches of a task, which gives memory back to the system before the task begins and when it ends.

    Workers serve one task after another, of this stage and others, functions of groups among them; what a task freed
    but kept would add up.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one in so many of all rows is hot; there are at most so many such keys.
HOT = 1000


def join_sized(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join with a table that has a row a key and how many of ``total`` rows it has.

    Hot keys, HOT at most, are broadcast, so that no key makes a task of its own; all others meet in a shuffle.
    """
    hot = F.col(size) * HOT > total
    first = left.join(F.broadcast(right.where(hot).withColumn("_hot", F.lit(True))), key, "left")
    rest = first.where("_hot IS NULL").select(*left.columns).join(right.where(~hot), key, "left")
    return first.where("_hot").drop("_hot").unionByName(rest)
