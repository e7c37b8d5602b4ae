"""Results into files: partitioned appends, upserts without MERGE, and small texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a workbook for a rating. Fixed values.
STATUS = {"full": "Evidenced", "partial": "Partially evidenced", "none": "Not evidenced"}


def append_results(results: DataFrame, path: str, run_at: str) -> None:
    results.withColumn("run_at", F.lit(run_at)).withColumn("run_date", F.lit(run_at[:10])).write.mode("append").partitionBy("run_date").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append-only log as JSON lines."""
    rows.write.mode("append").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows that new replaces, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_back(controls: DataFrame, decisions: DataFrame) -> DataFrame:
    """Controls with columns of their decisions; declared artefacts stay as they are."""
    status = F.coalesce(*(F.when(F.col("sufficiency") == k, F.lit(v)) for k, v in STATUS.items()))
    own = decisions.select("control_id", status.alias("decision_status"), F.col("maturity").alias("decision_maturity"), F.col("reviewer").alias("decision_reviewer"))
    return controls.join(own, "control_id", "left")


def new_versions(history: DataFrame, version: DataFrame) -> DataFrame:
    """The version rows that the history doesn't have."""
    return version.join(history.select("version").distinct(), "version", "left_anti")


def scenario(key: str) -> Column:
    """full, partial or none for a key, fixed by its sha256: six, three and one of ten."""
    n = F.conv(F.substring(F.sha2(F.col(key), 256), 1, 2), 16, 10).cast("int") % 10
    return F.when(n < 6, "full").when(n < 9, "partial").otherwise("none")


def gap_table(gaps: DataFrame, limit: int = 500) -> str:
    """Markdown of a gap list: a report, at most `limit` lines."""
    rows = gaps.select("control_id", "status", "priority").orderBy("priority", "control_id").limit(limit).collect()
    return "\n".join(["| control | status | priority |", "| --- | --- | --- |", *(f"| {r.control_id} | {r.status} | {r.priority} |" for r in rows)])


def write_bundle(bundle: dict, folder: str) -> str:
    """One JSON file that is never written over."""
    path = Path(folder) / f"bundle_{bundle['run_at'].replace(':', '-')}_{bundle['sha256'][:8]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x", encoding="utf-8") as file:
        json.dump(bundle, file, sort_keys=True, indent=1, default=str)
    return str(path)
