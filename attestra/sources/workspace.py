"""A catalog of the sources that declared packs name, from a workspace's folder."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import evaluation, registers
from attestra.plans import runner
from attestra.plans.catalog import Catalog
from attestra.sources import commits, readers

#: Where a workspace keeps its records, and what a program's default provider looks like. Fixed values.
RECORDS = {"ticket_export": "governance/tickets.csv", "model_registry": "governance/model_registry.csv", "exception_register": "governance/exceptions.csv", "eval_results": "governance/eval_results.json", "rollback_log": "governance/rollback_log.csv"}
POLICY, HISTORY, DEPLOYED, COMPONENTS, USE_CASES, DECISIONS = "policy/ai-lifecycle.yaml", "policy/history.csv", "deploy.yml", "governance/uc_components.csv", "governance/use_cases.json", "governance/step_decisions.jsonl"
RUNS, LOG = "governance/eval_runs.jsonl", "governance/git_log.txt"
#: Where a policy names the paths that a commit must not touch together. Fixed values.
APART = ["evaluation.promotion.assessor_input_paths", "evaluation.promotion.corpus_paths"]
PROGRAM, PROVIDER = "assessor.py", r"""ASSESSOR_PROVIDER["']?\s*,\s*["'](\w+)["']"""


def _there(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def _text(path: str) -> str:
    with open(_there(path), encoding="utf-8") as file:
        return file.read()


def matrices(spark: SparkSession, root: str) -> DataFrame:
    """control_id, requirement_sha, documents, elements of the label matrices (elements.yaml) below a corpus folder."""
    rows = []
    for path in sorted(glob.glob(os.path.join(_there(root), "*/elements.yaml"))):
        found = yaml.safe_load(_text(path)) or {}
        if found.get("control") and found.get("elements"):
            keys = [str(d).split("_")[-1] for d in found.get("documents") or []]
            text = lambda v: None if v is None else str(v)
            elements = [(text(e.get("id")), text(e.get("lane")), text(e.get("decided_by")), text(e.get("where")), {k: str(e[k]) for k in keys if k in e}) for e in found["elements"]]
            rows.append((str(found["control"]), text(found.get("requirement_sha")), [str(d) for d in found.get("documents") or []], elements))
    return spark.createDataFrame(rows, "control_id string, requirement_sha string, documents array<string>, elements array<struct<id:string,lane:string,decided_by:string,where:string,values:map<string,string>>>")


def requirement_shas(spark: SparkSession, overlay: dict) -> DataFrame:
    """control_id, sha of each control of a requirement overlay, in a form that layout doesn't change."""
    canonical = lambda spec: yaml.safe_dump(spec, sort_keys=True, default_flow_style=False)
    rows = [(str(c), hashlib.sha256(canonical(spec).encode()).hexdigest()[:12]) for c, spec in (overlay.get("controls") or {}).items() if spec]
    return spark.createDataFrame(rows, "control_id string, sha string")


def stress_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_at of the stress results in a folder; unreadable ones are left out."""
    rows = []
    for path in sorted(glob.glob(os.path.join(folder, "*.json"))):
        try:
            found = json.loads(_text(path))
            rows.append((str(found.get("run_at") or (found.get("results") or [{}])[0].get("run_at") or ""),))
        except (ValueError, AttributeError, IndexError):
            continue
    return spark.createDataFrame(rows, "run_at string")


def required_artefacts(spark: SparkSession, asked: dict) -> DataFrame:
    """artefact, scope, locations of what a policy asks of all models or of a tier, without what other checks assert."""
    everywhere = list(asked.get("all") or [])
    rows = [("all", a) for a in everywhere] + [(t, a) for t, given in asked.items() if t != "all" for a in given or [] if a not in everywhere]
    return spark.createDataFrame([(a, s, registers.LOCATIONS.get(a, [])) for s, a in rows if a not in registers.BEHAVIOURAL], "artefact string, scope string, locations array<string>")


def existing(spark: SparkSession, target: str) -> DataFrame:
    """path of those places of artefacts that are there, folders if something is in them."""
    there = lambda p: os.path.exists(p) and (not os.path.isdir(p) or bool(os.listdir(p)))
    return spark.createDataFrame([(p,) for places in registers.LOCATIONS.values() for p in places if there(os.path.join(target, p))], "path string")


def catalog(spark: SparkSession, target: str, today: str, environment: str | None = None, results: DataFrame | None = None, overlay: dict | None = None, corpus: str | None = None, installation: str | None = None) -> Catalog:
    """All sources of a workspace: what isn't there is missing, what can't be read is an error, and neither stops the rest.

    results: control_id, machine_verdict, play_refs of the latest operating tests; overlay: requirements
    by control; corpus: the folder of label matrices.
    """
    at = lambda p: os.path.join(target, p)
    out = Catalog(spark)
    held = lambda name: readers.records(spark, at(RECORDS[name]))
    for name in RECORDS:
        out.load(name, lambda n=name: held(n))
    policy = lambda: yaml.safe_load(_text(at(POLICY))) or {}
    golden = lambda: policy().get("golden_state") or {}
    deployed = lambda: readers.yaml_records(spark, _there(at(DEPLOYED)), "models")
    empty = lambda schema: spark.createDataFrame([], schema)

    def either(read, schema: str) -> DataFrame:
        try:
            return read()
        except FileNotFoundError:
            return empty(schema)

    tickets = lambda: either(lambda: held("ticket_export"), "ticket_id string, model_id string, approver string, approved_at string")
    exceptions = lambda: either(lambda: held("exception_register"), "exception_id string, control_id string, status string, expires_on string, rationale string")

    def configured() -> DataFrame:
        found = re.search(PROVIDER, _text(at(PROGRAM))) if os.path.exists(at(PROGRAM)) else None
        rows = registers.configured_providers(spark, found[1] if found else None, environment, either(deployed, "version string, provider string"))
        if rows.isEmpty():
            raise FileNotFoundError("no provider is configured")
        return rows

    def permitted() -> DataFrame:
        asked = golden().get("inference") or {}
        return registers.permitted_providers(spark, [str(p) for p in asked.get("allowed_providers") or []], [str(p.get("provider", "")) for p in asked.get("provider_exceptions") or []], exceptions(), today)

    def artefacts() -> DataFrame:
        models = held("model_registry").select("model_id", F.lower(F.trim("risk_tier")).alias("risk_tier"))
        return readers.artefact_status(models, required_artefacts(spark, golden().get("required_artefacts") or {}), existing(spark, target))

    def excepted() -> DataFrame:
        rules = policy().get("exceptions") or {}
        return readers.exception_status(held("exception_register"), list(rules.get("requires") or []), int(rules.get("max_days", 180)), today)

    def obliged() -> DataFrame:
        models = held("model_registry")
        versions = either(deployed, "name string, version string")
        return registers.obligations(models, golden().get("tier_obligations") or {}, tickets(), either(lambda: held("eval_results"), "version string"), versions, stress_runs(spark, at("stress/results")), today)

    def in_force() -> DataFrame:
        text = _text(at(POLICY))
        found = yaml.safe_load(text) or {}
        return registers.policy_history(readers.records(spark, at(HISTORY)), tickets(), str(found.get("version", "")), hashlib.sha256(text.encode()).hexdigest(), str(found.get("approved_by") or ""))

    def cases() -> DataFrame:
        return readers.records(spark, at(USE_CASES)).select(F.col("id").cast("string").alias("use_case"))

    def parts() -> DataFrame:
        rows = readers.records(spark, at(COMPONENTS)).withColumn("ordinal", F.monotonically_increasing_id())
        return registers.components(rows, either(cases, "use_case string"))

    def covered() -> DataFrame:
        register = either(parts, "use_case string, has_errors boolean")
        return registers.case_coverage(cases(), register)

    def overseen() -> DataFrame:
        raw = readers.records(spark, at(DECISIONS))
        has = lambda path: F.col(path) if path.split(".")[0] in raw.columns else F.lit(None).cast("string")
        log = raw.select("use_case", "step", has("reason").alias("reason"), has("reviewer").alias("reviewer"), has("decision").alias("decision"), has("proposal.source").alias("source"), F.when(has("blind").isNotNull(), "given").alias("blind"))
        return registers.step_oversight(parts(), log)

    def tested() -> DataFrame:
        if results is None or results.isEmpty():
            raise FileNotFoundError("no operating test has run")
        return registers.step_tests(parts(), results)

    def labelled() -> DataFrame:
        return registers.matrix_cells(matrices(spark, corpus or at("eval/corpus")))

    def compared() -> DataFrame:
        rows = spark.read.schema("run_id string, run_at string, corpus_sha string, case_id string, run_index int, want string, got string").json(_there(at(RUNS)))
        return evaluation.compared_runs(rows)

    def committed() -> DataFrame:
        found = runner.resolve(policy(), "golden_state") or {}
        rules = found.get("governed_paths") or []
        return commits.git_log(spark, _there(at(LOG)), [str(p) for p in rules])

    def ranged() -> DataFrame:
        first, second = ([str(p) for p in runner.resolve(policy(), path) or []] for path in APART)
        return commits.commit_range(committed(), None, None, first, second)

    for name, read in {
        "eval_runs": compared,
        "git_log": committed,
        "commit_range": ranged,
        "deploy_manifest": deployed,
        "lock_file": lambda: readers.lock_file(spark, _there(at("requirements.txt"))),
        "runtime_config": configured,
        "policy_providers": permitted,
        "artefact_status": artefacts,
        "exception_status": excepted,
        "tier_obligations": obliged,
        "policy_history": in_force,
        "uc_components": parts,
        "uc_case_coverage": covered,
        "caid_step_oversight": overseen,
        "oaid_step_coverage": tested,
        "corpus_elements": labelled,
        "corpus_cases": lambda: registers.matrix_cases(labelled(), requirement_shas(spark, overlay or {})),
        "environment_scan": lambda: readers.signals(readers.files(spark, target, installation)),
    }.items():
        out.load(name, read)
    return out
