"""Queries over registers made from the given tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import registers
from attestra.registry import _DECISIONS_SQL, decisions, query, table

#: A component register, in expressions that both engines read alike but for the digest.
_PART = "concat('part ', o_orderkey % 300)"
_REGISTER = {
    "ordinal": "o_orderkey",
    "use_case": "concat('UC-', o_custkey % 40)",
    "component_id": "concat('C', o_orderkey % 70)",
    "component_name": f"CASE WHEN o_orderkey % 29 = 0 THEN '<name_here>' ELSE {_PART} END",
    "description": "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE o_orderpriority END",
    "spec_sha": f"CASE o_orderkey % 4 WHEN 0 THEN 'old' WHEN 1 THEN '' ELSE SHA(concat({_PART}, chr(10), o_orderpriority)) END",
    "outcome_defined": "CASE WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'yes' END",
    "correctness_verifiable": "CASE WHEN o_orderkey % 6 = 0 THEN 'maybe' ELSE ' yes' END",
    "errors_recoverable": "'yes'",
    "human_between_steps": "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END",
    "judgement_required": "'YES'",
    "override_human_evaluates": "CASE WHEN o_orderkey % 5 = 0 THEN 'no' ELSE 'yes' END",
    "declared_domain": "CASE o_orderkey % 7 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'OAID' WHEN 2 THEN 'OAID' ELSE 'CAID' END",
    "evidencing_steps": "concat('P', o_orderkey % 7, '.', o_orderkey % 3, '; P', o_custkey % 7, '.1;')",
    "rationale": "CASE WHEN o_orderkey % 17 = 0 THEN 'CAID' ELSE 'a person decides each time and signs for it' END",
    "classified_by": "CASE WHEN o_orderkey % 19 = 0 THEN 'System' ELSE 'ann' END",
    "classified_on": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE '2026-01-01' END",
}


def _cells(row: dict[str, str], sha: str) -> list[str]:
    return [f"{e.replace('SHA(', sha + '(')} AS {c}" for c, e in row.items()]


def _register(spark: SparkSession, d: str) -> DataFrame:
    exprs = [e.replace("SHA(concat(", "sha2(concat(").replace("o_orderpriority)) END", "o_orderpriority), 256) END") if "SHA(" in e else e for e in _REGISTER.values()]
    return table(spark, d, "orders").selectExpr(*(f"{e} AS {c}" for c, e in zip(_REGISTER, exprs, strict=True)))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("UC-"), F.col("c_custkey") % 33).alias("use_case")).distinct()


def _components(spark: SparkSession, d: str) -> DataFrame:
    return registers.components(_register(spark, d), _cases(spark, d))


_YES = "lower(trim({})) = 'yes'"
_MISSING = ", ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'missing:{c}' END" for c in registers.COMPONENT)
_NOT_YES_NO = ", ".join(f"CASE WHEN lower(trim({c})) NOT IN ('yes', 'no') THEN 'not_yes_no:{c}' END" for c in registers.ANSWERS)
_PARTS_SQL = f"""(WITH r AS (SELECT {", ".join(_cells(_REGISTER, "sha256"))} FROM orders), u AS (SELECT DISTINCT concat('UC-', c_custkey % 33) use_case FROM customer),
n AS (SELECT r.*, row_number() OVER (PARTITION BY use_case, component_id ORDER BY ordinal) nth, use_case IN (SELECT use_case FROM u) known FROM r)
SELECT *, concat_ws(',', {_MISSING}, {_NOT_YES_NO}, CASE WHEN declared_domain = 'OTHER' THEN 'domain_not_permitted' END, CASE WHEN NOT known THEN 'use_case_not_found' END, CASE WHEN classified_by = 'System' THEN 'classifier_not_a_person' END, CASE WHEN rationale = 'CAID' THEN 'rationale_hollow' END, CASE WHEN component_name LIKE '<%' THEN 'template_placeholder:component_name' END, CASE WHEN nth > 1 THEN 'duplicate_component' END) errors,
concat_ws(',', CASE WHEN declared_domain = 'CAID' AND human_between_steps = 'no' THEN 'caid_without_human_between_steps' END, CASE WHEN declared_domain = 'OAID' AND override_human_evaluates = 'yes' THEN 'oaid_with_human_judgement' END, CASE WHEN declared_domain = 'OAID' AND outcome_defined = 'No' THEN 'oaid_without_defined_outcome' END, CASE WHEN declared_domain = 'OAID' AND correctness_verifiable = 'maybe' THEN 'oaid_without_verifiable_correctness' END) flags,
spec_sha <> '' AND spec_sha <> sha256(concat(component_name, chr(10), description)) stale, declared_domain = 'CAID' AND override_human_evaluates = 'no' breach FROM n)"""


@query(f"SELECT ordinal, use_case, component_id, errors, flags AS advisory_flags, stale, errors <> '' AS has_errors, breach AS override_breach FROM {_PARTS_SQL}")
def uc_components(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _components(spark, d).select("ordinal", "use_case", "component_id", joined("errors"), joined("advisory_flags"), "stale", "has_errors", "override_breach")


@query(f"WITH u AS (SELECT DISTINCT concat('UC-', c_custkey % 33) use_case FROM customer), c AS (SELECT use_case, count(*) n, count(*) FILTER (WHERE errors = '') k FROM {_PARTS_SQL} GROUP BY 1) SELECT use_case, CAST(coalesce(n, 0) AS BIGINT) AS components, CAST(coalesce(k, 0) AS BIGINT) AS components_usable, n IS NULL AS no_components, coalesce(k, 0) = 0 AS no_usable_components FROM u LEFT JOIN c USING (use_case)")
def uc_case_coverage(spark: SparkSession, d: str) -> DataFrame:
    return registers.case_coverage(_cases(spark, d), _components(spark, d))


def _step_rows(domain: str) -> str:
    return f"(SELECT use_case, component_id, unnest(list_filter(list_transform(string_split(evidencing_steps, ';'), lambda x: trim(x)), lambda x: x <> '')) step FROM {_PARTS_SQL} WHERE declared_domain = '{domain}' AND NOT stale AND errors = '')"


def _case_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).withColumn("use_case", F.concat(F.lit("UC-"), F.col("doc_id") % 40))


@query(f"WITH q AS (SELECT concat('UC-', doc_id % 40) use_case, step, count(*) n, count(*) FILTER (WHERE NOT hollow) s, count(blind) b, count(*) FILTER (WHERE accepted AND hollow AND lane_b AND blind IS NULL) t FROM {_DECISIONS_SQL} GROUP BY 1, 2) SELECT use_case, component_id, step, CAST(coalesce(n, 0) AS BIGINT) AS decisions_n, CAST(coalesce(s, 0) AS BIGINT) AS substantive_n, CAST(coalesce(b, 0) AS BIGINT) AS blind_n, CAST(coalesce(t, 0) AS BIGINT) AS rubber_stamp_n, n IS NULL AS no_decision, coalesce(b, 0) = 0 AS blind_absent, coalesce(s, 0) = 0 AS unevidenced FROM {_step_rows('CAID')} LEFT JOIN q USING (use_case, step)")
def caid_step_oversight(spark: SparkSession, d: str) -> DataFrame:
    return registers.step_oversight(_components(spark, d), _case_decisions(spark, d))


@query(f"WITH t AS (SELECT step, count(*) n, count(*) FILTER (WHERE v NOT IN ('NOT_TESTABLE', 'ERROR', '')) k FROM (SELECT unnest(['P' || (user_id % 6) || '.1', 'P' || (user_id % 5) || '.2']) step, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'NOT_TESTABLE' WHEN 'click' THEN '' ELSE 'PASS' END v FROM events WHERE user_id % 10 < 3) GROUP BY 1) SELECT use_case, component_id, step, CAST(coalesce(n, 0) AS INT) AS controls, CAST(coalesce(k, 0) AS INT) AS controls_with_real_verdict, n IS NULL AS no_control, coalesce(k, 0) = 0 AS uncovered FROM {_step_rows('OAID')} LEFT JOIN t USING (step)")
def oaid_step_coverage(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "NOT_TESTABLE").when(F.col("event_type") == "click", "").otherwise("PASS")
    steps = F.array(F.concat(F.lit("P"), F.col("user_id") % 6, F.lit(".1")), F.concat(F.lit("P"), F.col("user_id") % 5, F.lit(".2")))
    tests = table(spark, d, "events").where("user_id % 10 < 3").select(F.col("event_id").alias("control_id"), verdict.alias("machine_verdict"), steps.alias("play_refs"))
    return registers.step_tests(_components(spark, d), tests)


_TIERS = {"high": {"review_cycle_days": 30, "eval_before_deploy": True, "independent_validation": True, "stress_test_within_days": 40, "approval_level": "board"}, "medium": {"review_cycle_days": 200, "independent_validation": True, "eval_before_deploy": False}, "low": {}}
_TODAY = "2001-12-01"


@query(
    """WITH m AS (SELECT CAST(s_suppkey AS VARCHAR) model_id, list_extract(['high', 'medium', 'low'], CAST(s_suppkey % 3 + 1 AS INT)) risk_tier, 'clerk' || (s_suppkey % 4) own FROM supplier),
t AS (SELECT CAST(o_custkey AS VARCHAR) model_id, max((strftime(o_orderdate, '%Y-%m-%d'), 'clerk' || (o_orderkey % 4))) l FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1),
v AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 50 AS VARCHAR) END nm, p_partkey % 11 = 3 lacks FROM part WHERE p_partkey % 40 < 8 AND p_partkey % 5 <> 0),
d AS (SELECT model_id, count(nm) n, count(*) FILTER (WHERE lacks) k FROM m LEFT JOIN v ON nm = model_id GROUP BY 1),
e AS (SELECT count(*) n, count(*) FILTER (WHERE lacks) k FROM v),
s AS (SELECT date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2001-12-01') age FROM lineitem WHERE l_linenumber = 7 AND l_shipdate < TIMESTAMP '2001-11-01'),
a AS (SELECT m.*, l[1] dt, l[2] ap, CASE WHEN d.n > 0 THEN d.n ELSE e.n END n, CASE WHEN d.n > 0 THEN d.k ELSE e.k END k, age FROM m LEFT JOIN t USING (model_id) JOIN d USING (model_id), e, s)
SELECT model_id, risk_tier, 'review_cycle_days' AS obligation, coalesce(date_diff('day', CAST(dt AS DATE), DATE '2001-12-01') <= CASE risk_tier WHEN 'high' THEN 30 ELSE 200 END, false) AS met FROM a WHERE risk_tier <> 'low'
UNION ALL SELECT model_id, risk_tier, 'independent_validation', coalesce(ap <> own, false) FROM a WHERE risk_tier <> 'low'
UNION ALL SELECT model_id, risk_tier, 'eval_before_deploy', n > 0 AND k = 0 FROM a WHERE risk_tier = 'high'
UNION ALL SELECT model_id, risk_tier, 'stress_test_within_days', coalesce(age <= 40, false) FROM a WHERE risk_tier = 'high'
UNION ALL SELECT model_id, risk_tier, 'approval_level_recorded', true FROM a WHERE risk_tier = 'high'"""
)
def tier_obligations(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "supplier").selectExpr("s_suppkey AS model_id", "element_at(array('High', ' medium', 'low'), cast(s_suppkey % 3 + 1 AS int)) AS risk_tier", "concat('Clerk', s_suppkey % 4) AS owner")
    tickets = table(spark, d, "orders").selectExpr("o_custkey AS model_id", "concat('clerk', o_orderkey % 4) AS approver", "CASE WHEN o_orderkey % 6 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS approved_at")
    parts = table(spark, d, "part")
    deployed = parts.where("p_partkey % 40 < 8 AND p_partkey % 5 <> 0").selectExpr("cast(p_partkey % 50 AS string) AS name", "p_partkey AS version")
    runs = table(spark, d, "lineitem").where("l_linenumber = 7 AND l_shipdate < timestamp'2001-11-01'").select(F.col("l_shipdate").alias("run_at"))
    return registers.obligations(models, _TIERS, tickets, parts.where("p_partkey % 11 <> 3").selectExpr("p_partkey AS version"), deployed, runs, _TODAY)


@query("SELECT 'v' || n_nationkey AS version, n_nationkey = 7 AS is_current, CASE WHEN n_nationkey = 7 THEN false END AS hash_matches, n_nationkey IN (SELECT r_regionkey * 3 FROM region) AS ticket_exists, n_nationkey % 4 <> 0 AS approver_named, n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 AS approver_matches_policy, n_nationkey % 4 <> 0 AND n_nationkey IN (SELECT r_regionkey * 3 FROM region) AS complete, n_nationkey = 7 AS current_unapproved FROM nation UNION ALL SELECT 'v99', true, false, false, false, false, false, true WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)".replace("n_nationkey = 7", "n_nationkey = 99"))
def policy_history(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "nation").selectExpr("concat(' v', n_nationkey) AS version", "'abc' AS sha256", "CASE WHEN n_nationkey % 4 = 0 THEN 'TBD' WHEN n_nationkey % 3 = 0 THEN 'bob' ELSE 'Ann ' END AS approved_by", "'2026-01-01' AS approved_on", "cast(n_nationkey AS string) AS ticket_id")
    tickets = table(spark, d, "region").selectExpr("cast(r_regionkey * 3 AS string) AS ticket_id")
    rows = registers.policy_history(history, tickets, "v99", "abd", "ann")
    return rows.select("version", "is_current", "hash_matches", "ticket_exists", "approver_named", "approver_matches_policy", "complete", "current_unapproved")


@query("WITH e AS (SELECT 'X' || o_orderkey id, o_custkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '2001-06-01' live, ['alpha', 'beta', 'gamma'][CAST(o_orderkey % 3 + 1 AS INT)] p FROM orders) SELECT 'local' AS provider, 'policy' AS basis UNION ALL SELECT p, 'exception ' || min(id) FROM e WHERE live AND p <> 'gamma' GROUP BY 1")
def policy_providers(spark: SparkSession, d: str) -> DataFrame:
    exceptions = table(spark, d, "orders").selectExpr("concat('X', o_orderkey) AS exception_id", "CASE WHEN o_custkey % 3 = 0 THEN ' GOV-01' ELSE 'GOV-02' END AS control_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'closed' ELSE 'Open' END AS status", "date_format(o_orderdate, 'yyyy-MM-dd') AS expires_on", "concat('we use ', element_at(array('ALPHA', 'Beta', 'gamma'), cast(o_orderkey % 3 + 1 AS int)), ' for now') AS rationale")
    return registers.permitted_providers(spark, ["Local"], ["Alpha", "beta", "delta"], exceptions, "2001-06-01")


_VALUE = "list_extract(['y', 'n', 'n/a', '?', 'y', 'y'], CAST((l_partkey + {0}) % {1} + 1 AS INT))"
_CELLS_SQL = f"(SELECT l_orderkey k, l_orderkey || '_' || x case_id, l_linenumber e, CASE x WHEN 'a' THEN {_VALUE.format(0, 6)} WHEN 'b' THEN {_VALUE.format(1, 2)} ELSE '?' END v, l_linenumber = 4 b FROM lineitem, (VALUES ('a'), ('b'), ('c')) t(x))"


def _matrices(spark: SparkSession, d: str) -> DataFrame:
    value = lambda add, n: f"element_at(array(' Y', 'n', 'N/A', '?', 'y', 'y'), cast((l_partkey + {add}) % {n} + 1 AS int))"
    element = f"named_struct('id', cast(l_linenumber AS string), 'lane', CASE WHEN l_linenumber = 4 THEN 'B' END, 'decided_by', CASE WHEN l_partkey % 2 = 0 THEN 'ann' END, 'where', l_comment_, 'values', map('a', {value(0, 6)}, 'b', {value(1, 2)}))".replace("l_comment_", "CASE WHEN l_partkey % 3 = 0 THEN 'p. 1' END")
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", f"{element} AS e").groupBy("l_orderkey").agg(F.collect_list("e").alias("elements"))
    return rows.selectExpr("cast(l_orderkey AS string) AS control_id", "CASE l_orderkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN 'old' END AS requirement_sha", "transform(array('_a', '_b', '_c'), x -> concat(l_orderkey, x)) AS documents", "elements")


@query(f"WITH c AS (SELECT k, case_id, count(*) FILTER (WHERE NOT b AND v <> 'n/a') n, count(*) FILTER (WHERE NOT b AND v = 'y') y, count(*) FILTER (WHERE NOT b AND v = '?') q FROM {_CELLS_SQL} GROUP BY 1, 2), l AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN y = n THEN 'full' WHEN y = 0 THEN 'none' ELSE 'partial' END level FROM c) SELECT CAST(k AS VARCHAR) AS control_id, case_id, level, CAST(n AS BIGINT) AS elements_applicable, CAST(y AS BIGINT) AS elements_yes, CAST(q AS BIGINT) AS elements_undecided, max(level = 'none') OVER w IS DISTINCT FROM true OR max(level = 'partial') OVER w IS DISTINCT FROM true OR max(level = 'full') OVER w IS DISTINCT FROM true AS incomplete_set, q > 0 OR n = 0 AS label_unsound, k % 3 = 1 AS requirement_sha_mismatch, k % 3 <> 0 AS requirement_binding_broken FROM l WINDOW w AS (PARTITION BY k)")
def corpus_cases(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").selectExpr("cast(o_orderkey AS string) AS control_id", "'now' AS sha")
    rows = registers.matrix_cases(registers.matrix_cells(_matrices(spark, d)), live)
    return rows.select("control_id", "case_id", "level", "elements_applicable", "elements_yes", "elements_undecided", "incomplete_set", "label_unsound", "requirement_sha_mismatch", "requirement_binding_broken")


@query(f"SELECT CASE WHEN l_partkey % 2 = 0 THEN 'ann' ELSE 'unattributed' END AS decided_by, l_linenumber = 4 AS lane_b, l_partkey % 3 = 0 AS has_citation, v AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CASE x WHEN 'a' THEN {_VALUE.format(0, 6)} WHEN 'b' THEN {_VALUE.format(1, 2)} ELSE '?' END v FROM lineitem, (VALUES ('a'), ('b'), ('c')) t(x)) GROUP BY ALL")
def corpus_elements(spark: SparkSession, d: str) -> DataFrame:
    return registers.matrix_cells(_matrices(spark, d)).groupBy("decided_by", "lane_b", "has_citation", "value").agg(F.count("*").alias("n"))


@query("SELECT 'MACHINERY' AS library, CAST(c_custkey AS VARCHAR) AS control_id, c_custkey IN (SELECT o_custkey FROM orders) AS has_requirement FROM customer WHERE c_mktsegment = 'MACHINERY'")
def overlay_coverage(spark: SparkSession, d: str) -> DataFrame:
    controls = table(spark, d, "customer").select(F.col("c_mktsegment").alias("library"), F.col("c_custkey").cast("string").alias("control_id"))
    return registers.overlay_coverage(controls, "MACHINERY", table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("control_id")))
