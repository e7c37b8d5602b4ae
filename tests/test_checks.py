from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra.operators.checks import CHECKS
from attestra.plans import runner
from attestra.plans.catalog import Catalog

NOW = "2026-09-15T00:00:00Z"


def one(**more):
    """Parameters of a check that reads s alone."""
    return {"source": "s", **more}


def two(field, join=True, **roles):
    """Parameters of a check that reads a field of two sources, each in a role; joined by k."""
    given = {role: {"source": source, "field": field} for role, source in roles.items()}
    return given | ({"join": {"left_key": "k", "right_key": "k"}} if join else {})


DATED = one(field="d")
PARAMS = {
    # counts and rates
    "record_count": one(max=0),
    "rate_within": one(field="a"),
    "threshold_met": one(field="a", order_by="d", min=1),
    "within_tolerance": one(order_by="d", metrics={"a": {"max_drop": 0.02}}),
    # each record by itself
    "all_pinned": one(),
    "field_present": one(fields=["a"]),
    "date_not_passed": DATED,
    "recency_each": DATED | {"max_days": 3},
    "elapsed_within": DATED | {"max_days": 3},
    # two sources
    "values_subset": two("a", join=False, subset="s", superset="t"),
    "field_equals": two("a", left="s", right="t"),
    "identity_disjoint": two("a", left="s", right="t"),
    "timestamp_before": two("d", later="s", earlier="t"),
    "preceded_within": two("d", join=False, later="s", earlier="t") | {"max_days": 3},
}


def rows(spark, *values, schema="k string, a string, d string"):
    return spark.createDataFrame(list(values), schema)


def run(spark, name, params=None, **sources):
    catalog = Catalog(spark)
    for k, v in sources.items():
        catalog.add(k, v)
    return CHECKS[name](catalog, params or PARAMS[name], NOW)


def verdict(*args, **kwargs):
    r = run(*args, **kwargs).result.collect()
    assert len(r) == 1
    return r[0].verdict, r[0].examined, r[0].in_scope, r[0].n_findings


def test_every_check_has_params():
    assert set(PARAMS) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(PARAMS))
def test_empty_and_missing(spark, name):
    empty = rows(spark)
    assert verdict(spark, name, s=empty, t=empty)[1] == 0
    found = run(spark, name).result.first()
    assert found.verdict == "NOT_TESTABLE" and "not provided" in found.detail


def test_normal_forms(spark):
    s = rows(spark, ("1", " Yes ", None), ("2", "TRUE ", None), ("3", "no", None), ("4", None, None))
    count = lambda value: verdict(spark, "record_count", {"source": "s", "where": {"field": "a", "equals": value}, "max": 0}, s=s)[3]
    assert [count(v) for v in (True, "1", 1, False, None, "absent")] == [2, 2, 2, 1, 1, 0]
    numbers = s.withColumn("a", F.lit(1))
    assert verdict(spark, "rate_within", {"source": "s", "field": "a", "max": 0.5, "min_records": 1}, s=numbers)[0] == "PASS"
    assert verdict(spark, "all_pinned", {"source": "s"}, s=s.withColumn("pinned", F.lit(1)))[0] == "PASS"


def test_dates(spark):
    s = rows(spark, ("1", "x", "2026-09-15"), ("2", "x", "2026-09-14T23:00:00Z"), ("3", "x", "2026"), ("4", "x", ""), ("5", "x", "2026-09-15T01:00:00+00:00"))
    assert verdict(spark, "date_not_passed", s=s) == ("FAIL", 5, 5, 3)
    found = {r.k: r._reason for r in run(spark, "date_not_passed", s=s).findings.collect()}
    assert found == {"2": "expired", "3": "missing or unreadable date", "4": "missing or unreadable date"}


def test_floor_days(spark):
    later = rows(spark, ("1", "x", "2026-09-10T00:00:00Z"))
    just_after = rows(spark, ("1", "x", "2026-09-10T01:00:00Z"))
    before = rows(spark, ("1", "x", "2026-09-06T00:00:00Z"))
    assert verdict(spark, "preceded_within", s=later, t=just_after)[0] == "FAIL"
    assert verdict(spark, "preceded_within", s=later, t=before)[0] == "FAIL"
    assert verdict(spark, "preceded_within", {**PARAMS["preceded_within"], "max_days": 4}, s=later, t=before)[0] == "PASS"
    assert verdict(spark, "preceded_within", s=later, t=rows(spark)) == ("FAIL", 1, 1, 1)


def test_preceded_within_as_a_loop(spark):
    import random

    r = random.Random(1)
    times = lambda n: [f"2026-0{r.randint(1, 8)}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:00:00Z" for _ in range(n)]
    from datetime import datetime

    for days in (0, 1, 5):
        e, b = times(25), times(80)
        got = verdict(spark, "preceded_within", {**PARAMS["preceded_within"], "max_days": days}, s=rows(spark, *((str(i), "x", t) for i, t in enumerate(b))), t=rows(spark, *((str(i), "x", t) for i, t in enumerate(e))))
        at = lambda t: datetime.fromisoformat(t)
        want = sum(not any(0 <= (at(x) - at(y)).days <= days for y in e) for x in b)
        assert got[3] == want


def test_joins(spark):
    left = rows(spark, ("1", "A", None), ("2", "b", None), (None, "c", None), ("9", None, None))
    right = rows(spark, ("1", "a ", None), ("2", "x", None), (None, "c", None), ("9", None, None), ("1", "z", None))
    right = right.withColumn("_ordinal", F.monotonically_increasing_id())
    assert verdict(spark, "field_equals", s=left, t=right) == ("FAIL", 4, 4, 2)
    assert verdict(spark, "identity_disjoint", s=left, t=right) == ("FAIL", 4, 4, 2)  # two nulls conflict
    assert verdict(spark, "values_subset", s=left, t=right) == ("FAIL", 4, 4, 2)
    assert verdict(spark, "values_subset", s=left, t=right.limit(0)) == ("FAIL", 4, 4, 4)


def test_tolerance_and_threshold(spark):
    s = rows(spark, ("1", "0.90", "2026-09-01"), ("2", "0.93", "bad date"), ("3", "0.87", "2026-09-02"))
    assert verdict(spark, "within_tolerance", s=s) == ("FAIL", 3, 2, 1)
    assert verdict(spark, "within_tolerance", s=s.limit(1)) == ("NOT_TESTABLE", 1, 1, 0)
    assert verdict(spark, "within_tolerance", s=s.withColumn("a", F.lit("n/a")))[0] == "NOT_TESTABLE"
    assert verdict(spark, "threshold_met", s=s) == ("FAIL", 3, 1, 1)
    assert verdict(spark, "threshold_met", s=s.withColumn("a", F.lit("n/a")))[0] == "NOT_TESTABLE"


def test_elapsed(spark):
    s = rows(spark, ("1", "x", "2026-09-10")).withColumn("e", F.lit("2026-09-20"))
    assert verdict(spark, "elapsed_within", s=s) == ("FAIL", 1, 1, 1)
    each = {"source": "s", "start_field": "d", "end_field": "e", "max_days": 7, "mode": "each"}
    assert verdict(spark, "elapsed_within", each, s=s) == ("FAIL", 1, 1, 1)
    assert verdict(spark, "elapsed_within", each, s=s.withColumn("e", F.lit("")))[0] == "PASS"


POLICY = {"evidence_floor": {"by_severity": {"high": 1, "low": 0}, "overrides": {"B": 2}}, "cadence": {"days": 3}, "golden_state": {"band": [0.1, 0.6]}, "gates": {"on_deploy": {"fail_on": "high", "inconclusive_on": "high", "require_pass": ["B"]}, "non_waivable": ["critical"]}}


def test_runner(spark):
    catalog = Catalog(spark).add("s", rows(spark, ("1", "x", "2026-09-14")))
    controls = [
        {"id": "A", "check": "recency_each", "params": {"source": "s", "field": "d", "max_days": {"policy": "cadence.days"}}, "frequency": "on_commit", "severity": "high"},
        {"id": "B", "check": "field_present", "params": {"source": "s", "fields": ["a"]}, "frequency": "on_deploy", "severity": "low"},
        {"id": "C", "check": "field_present", "params": {"source": "s", "fields": ["a"], "where": {"field": "a", "equals": "zz"}}, "frequency": "on_deploy", "severity": "high"},
        {"id": "D", "check": "rate_within", "params": {"source": "s", "field": "a", "max": {"policy": "not.there"}}, "frequency": "on_deploy", "severity": "high"},
        {"id": "E", "check": "record_count", "params": {"source": "gone", "max": 0}, "frequency": "weekly", "severity": "high"},
        {"id": "F", "check": "rate_within", "params": {"source": "s", "field": "a", "min": {"policy": "band.0"}, "min_records": 1}, "frequency": "on_deploy", "severity": "low"},
    ]
    got = {r.control_id: r.verdict for r in runner.run_controls(catalog, controls, POLICY, NOW, "on_deploy").collect()}
    assert got == {"A": "PASS", "B": "NOT_TESTABLE", "C": "NOT_TESTABLE", "D": "NOT_TESTABLE", "F": "FAIL"}
    assert [c["id"] for c in runner.due(controls, "on_commit")] == ["A"]
    assert [c["id"] for c in runner.due(controls, "scheduled")] == ["E"]
    results = runner.run_controls(catalog, controls, POLICY, NOW, "on_deploy")
    gate = runner.gate(results, POLICY, "on_deploy").first()
    assert (gate.gate, gate.blocking_failures, gate.blocking_inconclusive, gate.required_not_passed) == ("BLOCK", 0, 2, 1)
    waived = runner.excepted(rows(spark, ("C", "open", "2026-12-01"), ("D", "open", "2026-01-01"), ("A", "closed", "2026-12-01"), schema="control_id string, status string, expires_on string"), controls, POLICY, "2026-09-15")
    assert [r.control_id for r in waived.collect()] == ["C"]
    assert runner.gate(results, POLICY, "on_deploy", waived).first().blocking_inconclusive == 1
    made = runner.bundle(results, {"run_at": NOW})
    assert runner.intact(made)
    made["results"][0]["human_verdict"] = {"disposition": "ACCEPT"}
    assert runner.intact(made)
    made["results"][0]["verdict"] = "PASS" if made["results"][0]["verdict"] != "PASS" else "FAIL"
    assert not runner.intact(made)
