"""Rings of several runs as a stored table: each run adds its partial aggregates, and no record that came before is read again.

A run's records become one row of sums and greatest values for each set of accounts (operators.rings.partials). Readers put the runs' rows together and number the rings, with
the result of one run over all records. A manifest that is written last makes an append a version (versions.py). All runs have the same columns and reading of group-level records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import rings as R
from .versions import Versions


def append(records: DataFrame, path: str, strict: bool = False) -> int:
    """Add a run's records; the new version's number. Another reading (strict) than that of the runs before is an error."""
    versions = Versions(records.sparkSession, path)
    old = versions.read() or {"folders": [], "strict": strict}
    if old["strict"] != strict:
        raise ValueError("the table's other runs read group-level records in another way")
    made, folder = R.partials(records, strict), versions.folder("rings")
    made.write.parquet(versions.at(folder))
    return versions.commit({"folders": [*old["folders"], folder], "strict": strict, "schema": ", ".join(f"{n} {t}" for n, t in made.dtypes)})


def _read(spark: SparkSession, path: str) -> tuple[Versions, dict, DataFrame]:
    versions = Versions(spark, path)
    manifest = versions.read()
    if manifest is None:
        raise FileNotFoundError(f"no ring table at {path}")
    return versions, manifest, R.combined(spark.read.schema(manifest["schema"]).parquet(*map(versions.at, manifest["folders"])))


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite all runs as one."""
    versions, manifest, rows = _read(spark, path)
    folder = versions.folder("rings")
    rows.write.parquet(versions.at(folder))
    return versions.commit(manifest | {"folders": [folder]})


def rings(spark: SparkSession, path: str, **options) -> DataFrame:
    """As operators.rings.rings gives it for the records of all runs; options: prefix, fraud_only, min_fraud_score, source_approach."""
    return R.listed(R.finished(_read(spark, path)[2]), **options)
