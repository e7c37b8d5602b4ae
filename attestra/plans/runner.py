"""Packs of declared controls: policy binding, evidence floors, verdict rows, bundles and gates."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.exprs import SEVERITY_RANK
from attestra.operators.checks import CHECKS, fixed, fused
from attestra.plans.catalog import Catalog

FREQUENCIES = ("on_commit", "on_deploy", "daily", "weekly", "monthly", "quarterly")
RUNS = {"on_commit": {"on_commit"}, "on_deploy": {"on_commit", "on_deploy"}, "scheduled": {"daily", "weekly", "monthly", "quarterly"}, "manual": set(FREQUENCIES)}
ROOTS = ("", "golden_state.")


def load_controls(folder: str) -> tuple[list[dict], str]:
    """Controls of all packs in a folder, and the sha256 of the packs' text."""
    texts = [p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.yaml"))]
    controls = [c for t in texts for c in (yaml.safe_load(t) or [])]
    for c in controls:
        lacking = [k for k in ("id", "check", "params", "frequency") if k not in c]
        if lacking:
            raise ValueError(f"control {c.get('id', '?')} lacks {', '.join(lacking)}")
    return controls, hashlib.sha256("".join(texts).encode()).hexdigest()


def resolve(policy: dict, path: str) -> object:
    """A value by its dotted path, as it is or below golden_state; None if there is none."""
    for root in ROOTS:
        at: object = policy
        for part in (root + path).split("."):
            if isinstance(at, list) and part.isdigit() and int(part) < len(at):
                at = at[int(part)]
            else:
                at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def bind(params: object, policy: dict) -> object:
    """Params with each {policy: path} replaced by its value."""
    if isinstance(params, dict):
        if set(params) == {"policy"}:
            found = resolve(policy, params["policy"])
            if found is None:
                raise KeyError(f"policy has no {params['policy']}")
            return found
        return {k: bind(v, policy) for k, v in params.items()}
    return [bind(v, policy) for v in params] if isinstance(params, list) else params


def floor_of(control: dict, policy: dict) -> int:
    floors = policy.get("evidence_floor") or {}
    if control["id"] in (floors.get("overrides") or {}):
        return int(floors["overrides"][control["id"]])
    return int((floors.get("by_severity") or {}).get(control.get("severity", "medium"), 1))


def due(controls: list[dict], trigger: str) -> list[dict]:
    return [c for c in controls if c["frequency"] in RUNS[trigger]]


def _named(control: dict, floor: int) -> list[Column]:
    return [F.lit(control["id"]).alias("control_id"), F.lit(control.get("severity", "medium")).alias("severity"), F.lit(control["frequency"]).alias("frequency"), F.lit(control["check"]).alias("check_name"), F.lit(floor).alias("floor")]


def run_controls(catalog: Catalog, controls: list[dict], policy: dict, as_of: str, trigger: str = "manual") -> DataFrame:
    """A row for each control that is due: all of them are one plan, in which controls of one source are one aggregate.

    A PASS over a smaller population than its floor becomes NOT_TESTABLE; a FAIL stays. A control
    that can't be planned is NOT_TESTABLE and stops no other. A control may have an as_of of its own.
    """
    together: dict[str, list] = {}
    alone = []
    for i, c in enumerate(due(controls, trigger)):
        named = _named(c, floor_of(c, policy))
        try:
            found = CHECKS[c["check"]](catalog, bind(c["params"], policy), c.get("as_of", as_of), f"_{i}")
            found.result.schema  # noqa: B018  analysis happens here, before it is put together with others
            if found.part is not None:
                together.setdefault(found.part.source, []).append((found.part, named))
            else:
                alone.append(found.result.select(*named, "*"))
        except Exception as e:  # noqa: BLE001
            alone.append(fixed(catalog.spark, "NOT_TESTABLE", f"{type(e).__name__}: {str(e)[:160]}").select(*named, "*"))
    rows = [fused(catalog, parts) for parts in together.values()] + alone
    if not rows:
        return catalog.spark.createDataFrame([], "control_id string, severity string, frequency string, check_name string, verdict string, detail string, examined long, in_scope long, n_findings long, floor int")
    results = reduce(DataFrame.unionByName, rows)
    low = (F.col("verdict") == "PASS") & (F.col("in_scope") < F.col("floor"))
    detail = F.when(low, F.format_string("only %d were in scope, the floor is %d; %s", "in_scope", "floor", "detail")).otherwise(F.col("detail"))
    return results.select("control_id", "severity", "frequency", "check_name", F.when(low, "NOT_TESTABLE").otherwise(F.col("verdict")).alias("verdict"), detail.alias("detail"), "examined", "in_scope", "n_findings", "floor")


def excepted(exceptions: DataFrame, controls: list[dict], policy: dict, today: str) -> DataFrame:
    """control_id of open exceptions that have not expired; one for a control of a severity that can't be waived is an error row."""
    fixed_ = set(resolve(policy, "gates.non_waivable") or [])
    barred = [c["id"] for c in controls if c.get("severity", "medium") in fixed_]
    live = exceptions.where((F.lower(F.trim("status")) == "open") & (F.col("expires_on") >= today) & F.col("control_id").isNotNull())
    return live.select("control_id", F.col("control_id").isin(barred or [""]).alias("barred")).distinct()


def gate(results: DataFrame, policy: dict, trigger: str, waived: DataFrame | None = None) -> DataFrame:
    """One row: whether the trigger's gate is passed, and how many results stand against it."""
    rules = (policy.get("gates") or {}).get(trigger) or {}
    level = lambda key: SEVERITY_RANK.get(str(rules.get(key, "none")), 99)
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(n)) for s, n in SEVERITY_RANK.items()), F.lit(1))
    rows = results.withColumn("_rank", rank)
    rows = rows.join(waived.where("NOT barred").select("control_id", F.lit(True).alias("_waived")).distinct(), "control_id", "left") if waived is not None else rows.withColumn("_waived", F.lit(None).cast("boolean"))
    free = F.coalesce("_waived", F.lit(False))
    failed = (F.col("verdict") == "FAIL") & (F.col("_rank") >= level("fail_on")) & ~free
    unsure = (F.col("verdict") == "NOT_TESTABLE") & (F.col("_rank") >= level("inconclusive_on")) & ~free
    needed = F.col("control_id").isin(rules.get("require_pass") or [""]) & (F.col("verdict") != "PASS")
    counts = rows.agg(*(F.count_if(c).alias(n) for c, n in ((failed, "blocking_failures"), (unsure, "blocking_inconclusive"), (needed, "required_not_passed"), (F.col("verdict") == "PASS", "passed"), (F.col("verdict") == "FAIL", "failed"), (F.col("verdict") == "NOT_TESTABLE", "not_testable"))))
    stands = F.col("blocking_failures") + F.col("blocking_inconclusive") + F.col("required_not_passed")
    return counts.withColumn("gate", F.when(stands > 0, "BLOCK").otherwise("OPEN")).select("gate", *counts.columns)


def bundle(results: DataFrame, header: dict) -> dict:
    """Results with a header and the sha256 of their canonical JSON; human verdicts don't enter the hash. Rows: one for each control."""
    rows = [r.asDict(recursive=True) for r in results.orderBy("control_id").collect()]
    body = header | {"results": [{k: v for k, v in r.items() if k != "human_verdict"} for r in rows]}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
    return header | {"results": rows, "sha256": digest}


def intact(b: dict) -> bool:
    body = {k: v for k, v in b.items() if k not in ("sha256", "results")} | {"results": [{k: v for k, v in r.items() if k != "human_verdict"} for r in b["results"]]}
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest() == b["sha256"]


def policy_of(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def as_rows(spark: SparkSession, bundles: list[dict]) -> DataFrame:
    """bundle_id, run_at and each result of bundles, for history."""
    rows = [(b.get("bundle_id"), b.get("run_at"), i, r["control_id"], r.get("severity"), r["verdict"]) for b in bundles for i, r in enumerate(b["results"])]
    return spark.createDataFrame(rows, "bundle_id string, run_at string, ordinal int, control_id string, severity string, verdict string")
