"""What the operators share: Arrow maps, scratch tables, word splitting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Rounds

#: Bytes of text that a Python worker holds as one slice of an Arrow batch.
SLICE_BYTES = 4 << 20


class Scratch(Rounds):
    """A run's tables in the shared folder, packed by zstd."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name, "zstd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `size` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    begin, held = 0, 0
    for i in range(n):
        held += lengths[i]
        if held >= size:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < n:
        yield batch.slice(begin)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size; make() runs once a task and returns the function of a slice. Where that has a `close`, it is called at the task's end:
    workers live on between stages, and what they keep adds up with what the next stage needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for batch in batches:
                for piece in slices(batch, column, size):
                    out = f(piece)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            getattr(f, "close", lambda: None)()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: 64-bit words of a bitmap of hashes: 8 MB, whatever the number of keys.
BITMAP_WORDS = 1 << 20


def bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """Bits of the low end of each key (a long): BITMAP_WORDS words at most reach the driver, whatever the number of keys."""
    word = F.shiftright(col, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    rows = keys.select(word.cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({col} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def there(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    u = np.uint64
    return (bits[((keys >> u(6)) & u(len(bits) - 1)).astype(np.int64)] >> (keys & u(63))) & u(1) == 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes."""
    return column(batch, name).cast(pa.binary()).to_pylist()


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text, A-Z lower-cased: bytes.split() parts at just these six bytes."""
    return text.lower().split()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; Spark's file server carries it."""
    sc = spark.sparkContext
    if getattr(sc, "_cyclespan_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    made = os.path.join(tempfile.mkdtemp(prefix="cyclespan-"), "cyclespan.zip")
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    sc.addPyFile(made)
    sc._cyclespan_shipped = True
