"""Registers of use cases, models, tickets and policies: rows with all that a check then only counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators import text as X
from attestra.operators.history import NOBODY, decision_quality

#: Columns of the component register, those of yes and no, domains. Fixed values.
COMPONENT = ["use_case", "component_id", "component_name", "description", "spec_sha", "outcome_defined", "correctness_verifiable", "errors_recoverable", "human_between_steps", "judgement_required", "override_human_evaluates", "declared_domain", "evidencing_steps", "rationale", "classified_by", "classified_on"]
ANSWERS = ["outcome_defined", "correctness_verifiable", "errors_recoverable", "human_between_steps", "judgement_required", "override_human_evaluates"]
HUMAN, MACHINE = "CAID", "OAID"
#: Verdicts that are no result; words that stand for an approver. Fixed values.
INCONCLUSIVE = ["NOT_TESTABLE", "ERROR", ""]
UNNAMED = ["", "tbd", "reviewer name", "unnamed", "n/a", "none"]
#: Artefacts that other checks assert, and where the others may be. Fixed values.
BEHAVIOURAL = ["independent_validation"]
LOCATIONS = {
    "model_card": ["MODEL_CARD.md", "model_card.md", "docs/MODEL_CARD.md"],
    "registry_entry": ["governance/model_registry.csv"],
    "change_ticket": ["governance/tickets.csv"],
    "impact_assessment": ["governance/assessments.csv", "governance/impact_assessment.md", "governance/impact_assessments/"],
    "stress_test_pre_release": ["stress/results"],
    "eval_before_deploy": ["governance/eval_results.json"],
}


def _said(rows: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(E.field(rows, name).cast("string"), F.lit("")))


def _listed(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))


def spec_sha(name: Column, description: Column) -> Column:
    """sha256 of what a classifier read: name and description, line by line without blanks at their ends."""
    lines = F.split(F.regexp_replace(F.concat(F.trim(name), F.lit("\n"), F.trim(description)), "\r\n", "\n"), "\n", -1)
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), 256)


def components(register: DataFrame, use_cases: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """All rows of a component register with what is wrong with them (errors), staleness, breaches and advice.

    use_cases: use_case. Of rows of equal use case and component, all but the first by `ordinal` are duplicates.
    """
    rows = register.select(ordinal, *(_said(register, c).alias(c) for c in COMPONENT))
    known = use_cases.select(F.col("use_case"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, "use_case", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("use_case", "component_id").orderBy(ordinal)))
    yes = lambda c: F.lower(c) == "yes"
    domain = F.col("declared_domain")
    rules = [
        *((f"missing:{c}", F.col(c) == "") for c in COMPONENT),
        *((f"not_yes_no:{c}", (F.col(c) != "") & ~F.lower(c).isin("yes", "no")) for c in ANSWERS),
        ("domain_not_permitted", (domain != "") & ~domain.isin(HUMAN, MACHINE)),
        ("use_case_not_found", F.col("_known").isNull()),
        ("classifier_not_a_person", F.lower("classified_by").isin(NOBODY)),
        ("rationale_hollow", X.reason_error(F.col("rationale"), domain).isNotNull()),
        *((f"template_placeholder:{c}", X.is_template(F.col(c))) for c in ("component_name", "description")),
        ("duplicate_component", F.col("_nth") > 1),
    ]
    advice = [
        ("caid_without_human_between_steps", (domain == HUMAN) & ~yes("human_between_steps")),
        ("oaid_with_human_judgement", (domain == MACHINE) & yes("judgement_required") & yes("override_human_evaluates")),
        ("oaid_without_defined_outcome", (domain == MACHINE) & ~yes("outcome_defined")),
        ("oaid_without_verifiable_correctness", (domain == MACHINE) & ~yes("correctness_verifiable")),
        ("oaid_unrecoverable_check_exception_path", (domain == MACHINE) & ~yes("errors_recoverable")),
    ]
    steps = F.filter(F.transform(F.split("evidencing_steps", ";"), lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.withColumns({"errors": _listed(rules), "advisory_flags": _listed(advice), "current_spec_sha": spec_sha(F.col("component_name"), F.col("description")), "evidencing_step_ids": steps})
    return rows.withColumns({
        "stale": (F.col("spec_sha") != "") & (F.col("spec_sha") != F.col("current_spec_sha")),
        "has_errors": F.size("errors") > 0,
        "override_breach": (F.lower("override_human_evaluates") == "no") & (domain == HUMAN),
        "advisory_flag_count": F.size("advisory_flags"),
    }).drop("_known", "_nth")


def case_coverage(use_cases: DataFrame, parts: DataFrame) -> DataFrame:
    """Each use case, classified or not, with its components and those without errors."""
    counts = parts.groupBy("use_case").agg(F.count("*").alias("components"), F.count_if(~F.col("has_errors")).alias("components_usable"))
    rows = use_cases.select("use_case").distinct().join(counts, "use_case", "left").na.fill(0, ["components", "components_usable"])
    return rows.withColumn("no_components", F.col("components") == 0).withColumn("no_usable_components", F.col("components_usable") == 0)


def _steps_of(parts: DataFrame, domain: str) -> DataFrame:
    """use_case, component_id, step of the sound and current components of a domain."""
    sound = parts.where((F.col("declared_domain") == domain) & ~F.col("stale") & ~F.col("has_errors"))
    return sound.select("use_case", "component_id", F.explode("evidencing_step_ids").alias("step"))


def step_oversight(parts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each step of a human domain's components with the decisions on it; unevidenced if there is none with a reason. blind_absent is told apart."""
    quality = decision_quality(decisions).select("use_case", "step", F.col("n").alias("decisions_n"), F.col("substantive").alias("substantive_n"), F.col("blind").alias("blind_n"), F.col("rubber_stamps").alias("rubber_stamp_n"))
    rows = _steps_of(parts, HUMAN).join(quality, ["use_case", "step"], "left").withColumn("no_decision", F.col("decisions_n").isNull())
    rows = rows.na.fill(0, ["decisions_n", "substantive_n", "blind_n", "rubber_stamp_n"])
    return rows.withColumn("blind_absent", F.col("blind_n") == 0).withColumn("unevidenced", F.col("substantive_n") == 0)


def tests_by_step(tests: DataFrame) -> DataFrame:
    """step, control_ids, real_verdict_control_ids from results (control_id, machine_verdict, play_refs: array of steps)."""
    real = F.when(~F.coalesce("machine_verdict", F.lit("")).isin(INCONCLUSIVE), F.col("control_id"))
    rows = tests.select("control_id", real.alias("_real"), F.explode("play_refs").alias("step"))
    return rows.groupBy("step").agg(F.array_sort(F.collect_list("control_id")).alias("control_ids"), F.array_sort(F.collect_list("_real")).alias("real_verdict_control_ids"))


def step_tests(parts: DataFrame, tests: DataFrame) -> DataFrame:
    """Each step of a machine domain's components with the controls on it; uncovered if none has a real verdict."""
    cover = tests_by_step(tests).select("step", F.size("control_ids").alias("controls"), F.size("real_verdict_control_ids").alias("controls_with_real_verdict"))
    rows = _steps_of(parts, MACHINE).join(cover, "step", "left").withColumn("no_control", F.col("controls").isNull())
    rows = rows.na.fill(0, ["controls", "controls_with_real_verdict"])
    return rows.withColumn("uncovered", F.col("controls_with_real_verdict") == 0)


def open_exceptions(register: DataFrame, today: str) -> DataFrame:
    """Exceptions that are open and whose expires_on, as text, isn't before today."""
    return register.where((F.lower(_said(register, "status")) == "open") & (F.coalesce(E.field(register, "expires_on").cast("string"), F.lit("")) >= today[:10]))


def configured_providers(spark: SparkSession, default: str | None, environment: str | None, deployed: DataFrame | None) -> DataFrame:
    """provider, source: what a program's default, its environment and the deploy manifest (version, provider) name."""
    said = [(x.lower(), source) for x, source in ((default, "program default"), (environment, "environment")) if x]
    rows = spark.createDataFrame(said, "provider string, source string")
    if deployed is not None and "provider" in deployed.columns:
        named = deployed.where(F.coalesce(F.col("provider").cast("string"), F.lit("")) != "")
        rows = rows.unionByName(named.select(F.lower("provider").alias("provider"), F.concat(F.lit("deployed "), E.field(named, "version").cast("string")).alias("source")))
    return rows


def permitted_providers(spark: SparkSession, allowed: list[str], excepted: list[str], exceptions: DataFrame, today: str, control: str = "GOV-01") -> DataFrame:
    """provider, basis: those that the policy allows, and those it names as exceptions for which one is open whose rationale names them: the first by id."""
    rows = spark.createDataFrame([(p.lower(), "policy") for p in allowed], "provider string, basis string")
    live = open_exceptions(exceptions, today)
    live = live.where(_said(live, "control_id") == control).select("exception_id", F.lower(_said(live, "rationale")).alias("_why"))
    names = spark.createDataFrame([(p.lower(),) for p in excepted], "provider string")  # as many as the policy names
    found = live.join(F.broadcast(names), F.col("_why").contains(F.col("provider"))).groupBy("provider").agg(F.concat(F.lit("exception "), F.min("exception_id")).alias("basis"))
    return rows.unionByName(found)


def obligations(models: DataFrame, policy: dict[str, dict], tickets: DataFrame, evaluated: DataFrame, deployed: DataFrame, stress_runs: DataFrame, today: str) -> DataFrame:
    """model_id, risk_tier, obligation, met: what the policy asks of each model's tier.

    policy: of each tier, review_cycle_days, eval_before_deploy, independent_validation,
    stress_test_within_days, approval_level. models: model_id, risk_tier, owner; tickets: model_id,
    approver, approved_at; evaluated: version; deployed: name, version; stress_runs: run_at.
    """
    spark = models.sparkSession
    kinds = ["review_cycle_days", "eval_before_deploy", "independent_validation", "stress_test_within_days", "approval_level"]
    asked = [(tier, k, int(given[k]) if k.endswith("_days") else 1) for tier, given in policy.items() for k in kinds if k in given and (k.endswith("_days") or given[k])]
    asked = spark.createDataFrame(asked, "risk_tier string, obligation string, most int")
    day = lambda c: F.try_to_timestamp(F.when(F.substring(c, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(c, 1, 10))).cast("date")
    age = lambda c: F.datediff(F.lit(today[:10]).cast("date"), day(c))
    rows = models.select(F.col("model_id").cast("string").alias("model_id"), F.lower(_said(models, "risk_tier")).alias("risk_tier"), F.lower(_said(models, "owner")).alias("_owner"))
    approved = tickets.select(F.col("model_id").cast("string").alias("model_id"), _said(tickets, "approved_at").alias("_at"), F.lower(_said(tickets, "approver")).alias("_by")).where("_at <> ''")
    latest = approved.groupBy("model_id").agg(F.max(F.struct("_at", "_by")).alias("_last"))
    versions = deployed.select(E.field(deployed, "name").cast("string").alias("_name"), F.col("version").cast("string").alias("_v"))
    versions = versions.join(evaluated.select(F.col("version").cast("string").alias("_v"), F.lit(True).alias("_done")).distinct(), "_v", "left")
    count = lambda df: df.agg(F.count("*").alias("_n"), F.count_if(F.col("_done").isNull()).alias("_lacks"))
    unnamed, named, every = count(versions.where("_name IS NULL")), count(versions.where("_name IS NOT NULL").groupBy(F.col("_name").alias("model_id"))), count(versions)
    one = lambda df, end: F.broadcast(df.select(*(F.col(c).alias(f"{c}{end}") for c in df.columns)))  # noqa: E731  a row each
    own = rows.join(latest, "model_id", "left").join(named, "model_id", "left").crossJoin(one(unnamed, "_u")).crossJoin(one(every, "_e"))
    own = own.crossJoin(F.broadcast(stress_runs.agg(F.min(age(F.col("run_at").cast("string"))).alias("_stress"))))
    mine = F.coalesce("_n", F.lit(0)) + F.col("_n_u")
    n = F.when(mine > 0, mine).otherwise(F.col("_n_e"))
    lacks = F.when(mine > 0, F.coalesce("_lacks", F.lit(0)) + F.col("_lacks_u")).otherwise(F.col("_lacks_e"))
    by = F.coalesce("_last._by", F.lit(""))
    met = E.one_of([
        (F.col("obligation") == "review_cycle_days", F.coalesce(age(F.col("_last._at")) <= F.col("most"), F.lit(False))),
        (F.col("obligation") == "eval_before_deploy", (n > 0) & (lacks == 0)),
        (F.col("obligation") == "independent_validation", (by != "") & (by != F.col("_owner"))),
        (F.col("obligation") == "stress_test_within_days", F.coalesce(F.col("_stress") <= F.col("most"), F.lit(False))),
    ], F.lit(True))
    name = F.when(F.col("obligation") == "approval_level", "approval_level_recorded").otherwise(F.col("obligation"))
    return own.join(F.broadcast(asked), "risk_tier").select("model_id", "risk_tier", name.alias("obligation"), met.alias("met"))


def policy_history(history: DataFrame, tickets: DataFrame, version: str, sha256: str, approved_by: str = "") -> DataFrame:
    """Rows of a policy's history against the policy in force; if that one has no row, one more that says so."""
    spark, version = history.sparkSession, version.strip()
    rows = history.select(*(_said(history, c).alias(c) for c in ("version", "sha256", "approved_by", "approved_on", "ticket_id")))
    known = tickets.select(_said(tickets, "ticket_id").alias("ticket_id"), F.lit(True).alias("_known")).distinct()
    here = history.agg(F.coalesce(F.bool_or(_said(history, "version") == version), F.lit(False)).alias("_here"))
    none = spark.createDataFrame([(version, sha256, "", "", "")], "version string, sha256 string, approved_by string, approved_on string, ticket_id string")
    synthetic = none.crossJoin(F.broadcast(here)).where("NOT _here").drop("_here")  # a row each
    rows = rows.withColumn("_told", F.lit(True)).unionByName(synthetic.withColumn("_told", F.lit(False))).join(known, "ticket_id", "left")
    told, current = F.col("_told"), F.col("version") == version
    rows = rows.withColumns({
        "is_current": current,
        "hash_matches": F.when(current, told & (F.col("sha256") == sha256)),
        "ticket_exists": told & F.coalesce("_known", F.lit(False)),
        "approver_named": told & ~F.lower("approved_by").isin(UNNAMED),
        "approver_matches_policy": F.when(~told, False).otherwise((F.lower("approved_by") == approved_by.strip().lower()) if approved_by.strip() else F.lit(None).cast("boolean")),
    })
    rows = rows.withColumn("complete", F.col("approver_named") & F.col("ticket_exists") & (F.col("approved_on") != ""))
    approved = F.coalesce(F.col("is_current") & F.col("complete") & F.col("hash_matches"), F.lit(False))
    return rows.withColumn("in_force_and_approved", approved).withColumn("current_unapproved", F.col("is_current") & ~approved).drop("_told", "_known")


def overlay_candidates(spark: SparkSession, present: list[str], loaded: str | None) -> DataFrame:
    """path, is_loaded of overlay files, in order of precedence."""
    return spark.createDataFrame([(p, p == loaded) for p in present], "path string, is_loaded boolean")


def overlay_coverage(controls: DataFrame, library: str, overlay: DataFrame) -> DataFrame:
    """library, control_id, has_requirement of a library's controls (library, control_id); overlay: control_id."""
    named = overlay.select("control_id", F.lit(True).alias("_has")).distinct()
    rows = controls.where(F.col("library") == library).join(named, "control_id", "left")
    return rows.select("library", "control_id", F.coalesce("_has", F.lit(False)).alias("has_requirement"))


def matrix_cells(matrices: DataFrame) -> DataFrame:
    """control_id, case_id, element_id, value, lane_b, decided_by, undecided, has_citation, requirement_sha: a row for each document and element.

    matrices: control_id, requirement_sha, documents (array), elements (array of id, lane, decided_by,
    where, values: a map by document key). A document's key is what follows its last `_`.
    """
    rows = matrices.select("control_id", "requirement_sha", F.explode("documents").alias("case_id"), "elements").withColumn("e", F.explode("elements"))
    key = F.element_at(F.split("case_id", "_"), -1)
    value = F.lower(F.trim(F.coalesce(F.try_element_at("e.values", key), F.lit("?"))))
    person = F.coalesce(F.nullif(F.col("e.decided_by"), F.lit("")), F.lit("unattributed"))
    cells = rows.select("control_id", "requirement_sha", "case_id", F.coalesce("e.id", F.lit("")).alias("element_id"), value.alias("value"), F.coalesce(F.lower("e.lane") == "b", F.lit(False)).alias("lane_b"), person.alias("decided_by"), (F.trim(F.coalesce("e.where", F.lit(""))) != "").alias("has_citation"))
    return cells.withColumn("undecided", F.col("value") == "?")


def matrix_cases(cells: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each case of matrix_cells() with its label, whether its control's set lacks a level, and whether its requirement is another by now.

    requirements: control_id, sha, of the requirements as they are. A case without a recorded sha is
    bound to none: binding_broken, but not a mismatch.
    """
    v = F.col("value")
    counts = cells.groupBy("control_id", "case_id").agg(F.max("requirement_sha").alias("requirement_sha"), *(F.count_if(~F.col("lane_b") & c).alias(n) for n, c in (("elements_applicable", ~v.isin("n/a", "na")), ("elements_yes", v == "y"), ("elements_undecided", v == "?"))))
    n, yes = F.col("elements_applicable"), F.col("elements_yes")
    rows = counts.withColumn("level", F.when(n == 0, F.lit(None).cast("string")).when(yes == n, "full").when(yes == 0, "none").otherwise("partial"))
    covered = rows.groupBy("control_id").agg(F.array_sort(F.collect_set("level")).alias("levels_covered"))
    rows = rows.join(covered, "control_id").join(requirements.select("control_id", F.col("sha").alias("requirement_sha_live")), "control_id", "left")
    bound = F.coalesce(F.col("requirement_sha") != "", F.lit(False))
    differs = ~F.col("requirement_sha").eqNullSafe(F.col("requirement_sha_live"))
    return rows.withColumns({
        "incomplete_set": F.size("levels_covered") < 3,
        "label_unsound": (F.col("elements_undecided") > 0) | (n == 0),
        "requirement_sha_mismatch": bound & differs,
        "requirement_binding_broken": ~bound | differs,
    })
