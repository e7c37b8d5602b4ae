"""An audit from end to end: run a workspace's controls, store the bundle, list what is stored, sign, and look back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import bundles, history
from attestra.plans import runner
from attestra.plans.catalog import Catalog
from attestra.plans.shared import exists
from attestra.sources import sinks

ENTRY = "bundle_id string, control_id string, at string, reviewer string, disposition string, rationale string, exception_ref string, withdrawn boolean"


def run_audit(catalog: Catalog, packs: str, policy: dict, as_of: str, store: str, trigger: str = "manual") -> tuple[dict, str]:
    """The bundle of a run over a catalog and where it was stored: one JSON file below `store`/bundles."""
    controls, sha = runner.load_controls(packs)
    results = runner.run_controls(catalog, controls, policy, as_of, trigger)
    header = {"bundle_id": uuid.uuid4().hex, "run_at": as_of, "trigger": trigger, "pack_sha256": sha, "n_controls": len(controls), "policy_version": str(policy.get("version", ""))}
    made = runner.bundle(results, header)
    return made, sinks.write_bundle(made, f"{store}/bundles")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All stored bundles, a row each, as verified() and signed() take them."""
    kind = "control_id string, severity string, frequency string, check_name string, verdict string, detail string, examined long, in_scope long, n_findings long, floor long"
    schema = f"bundle_id string, run_at string, trigger string, pack_sha256 string, n_controls long, policy_version string, results array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in kind.split(', '))}>>, sha256 string"
    if not exists(spark, f"{store}/bundles"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(f"{store}/bundles")


def listed(spark: SparkSession, store: str) -> DataFrame:
    """Stored bundles, the newest first, with counts of verdicts, results without a signature, and whether each is as it was."""
    held = stored(spark, store)
    open_ = signed(spark, store).where("verdict <> 'PASS' AND reviewer IS NULL").groupBy("bundle_id").agg(F.count("*").alias("unsigned"))
    rows = bundles.summarised(held).drop("unsigned").join(open_, "bundle_id", "left").withColumn("unsigned", F.coalesce("unsigned", F.lit(0)))
    return rows.orderBy(F.desc("run_at"), "bundle_id")


def entries(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(ENTRY).json(f"{store}/signatures") if exists(spark, f"{store}/signatures") else spark.createDataFrame([], ENTRY)


def sign(spark: SparkSession, store: str, rows: list[tuple]) -> DataFrame:
    """Append entries (as ENTRY names them) to the register, if all can count; those that can't are returned and nothing is written."""
    new = spark.createDataFrame(rows, ENTRY)
    wrong = bundles.refused(new, stored(spark, store)).where("size(refusals) > 0")
    if wrong.isEmpty():
        sinks.append_rows(new, f"{store}/signatures")
    return wrong


def signed(spark: SparkSession, store: str) -> DataFrame:
    return bundles.signed(stored(spark, store), entries(spark, store))


def _results(spark: SparkSession, store: str) -> DataFrame:
    runs = stored(spark, store).select("bundle_id", "run_at")
    return signed(spark, store).join(runs, "bundle_id")


def open_items(spark: SparkSession, store: str) -> DataFrame:
    """Results of the newest run that aren't PASS and have no signature."""
    return history.open_items(_results(spark, store).withColumn("signed", F.col("reviewer")))


def control_history(spark: SparkSession, store: str) -> DataFrame:
    """control_id, n, streak (failures since the last success) and warn over all stored runs."""
    return history.fail_streaks(_results(spark, store), "control_id", ["run_at", "bundle_id"], F.col("verdict") == "FAIL")
