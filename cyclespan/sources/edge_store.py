"""A stored table of logical edges: prepared once, read by every detection run.

One row for each ordered pair, as operators.edges makes them, in PARTS parts by a hash of the source, so a pair is always in the same part. A preparation works on a batch of
parts at a time, each in a folder of its own, and a manifest that is written last makes the batches a version (versions.py): a run that stops
anywhere leaves the version before as it was, and the next one starts anew. Transfers are dealt out by part once, and a batch reads its own parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..plans.scratch import Rounds
from .versions import Versions

#: Parts of the table. Fixed, since stored tables depend on it.
PARTS = 64


def _part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("src"), F.lit(PARTS)).cast("int"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a whole version."""
    return bool(Versions(spark, path).numbers())


def _read(spark: SparkSession, versions: Versions, manifest: dict, first: int = 0, last: int = PARTS - 1) -> DataFrame:
    """The parts from first to last: only folders that hold some of them are read, and of these the row groups."""
    own = [versions.at(b["folder"]) for b in manifest["batches"] if b["first"] <= last and b["last"] >= first]
    return spark.read.schema(manifest["schema"]).parquet(*own).where(F.col("part").between(first, last))


def load(spark: SparkSession, path: str) -> DataFrame:
    versions = Versions(spark, path)
    manifest = versions.read()
    if manifest is None:
        raise FileNotFoundError(f"no edge table at {path}")
    return _read(spark, versions, manifest).drop("part")


def prepare(transfers: DataFrame, path: str, rebuild: bool = True, parts_at_once: int = PARTS, after_batch: Callable[[int], None] = lambda at: None) -> int:
    """Write the transfers' edges to the table at path as a new version; the number of pairs that come from the transfers.

    rebuild: pairs that the transfers lack are gone. Otherwise new values replace those of the same pair, and pairs that the transfers lack stay as they were.
    parts_at_once bounds what one pass aggregates and writes; after_batch is told each batch's first part.
    """
    if parts_at_once < 1:
        raise ValueError("batch size must be positive")
    spark, written, batches = transfers.sparkSession, 0, []
    versions, scratch = Versions(spark, path), Rounds(transfers.sparkSession, "edges")
    before = None if rebuild else versions.read()
    rows = _part(transfers)
    if parts_at_once < PARTS:
        # Each part is written by a few tasks, so a hot source is not one task's.
        rows = scratch.keep_parted(rows.repartition("part", F.pmod(F.xxhash64("dst"), F.lit(4))), "part")
    for first in range(0, PARTS, parts_at_once):
        last = min(first + parts_at_once, PARTS) - 1
        own = F.col("part").between(first, last)
        new = E.edges(rows.where(own).drop("part"))
        folder = versions.folder("edges")
        if before is not None:
            # Made once: it is counted, and joined to what was there.
            new = scratch.keep(new)
            written += new.count()
            out = E.upsert(_read(spark, versions, before, first, last).drop("part"), new, rebuild=False)
        else:
            out = new
        _part(out).repartitionByRange("part", "src").sortWithinPartitions("part").write.parquet(versions.at(folder))
        if before is not None:
            scratch.drop(new)
        else:
            written += spark.read.parquet(versions.at(folder)).count()
        batches.append({"folder": folder, "first": first, "last": last})
        schema = ", ".join(f"{n} {t}" for n, t in _part(out).dtypes)
        after_batch(first)
    scratch.drop(rows)
    versions.commit({"folders": [b["folder"] for b in batches], "batches": batches, "schema": schema})
    return written
