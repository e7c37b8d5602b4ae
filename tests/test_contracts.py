from __future__ import annotations

import json

from pyspark.sql import functions as F

from attestra.operators import contracts, evaluation
from attestra.sources import readers


def one(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return frame.select(expression.alias("x")).first().x


def test_cells(spark):
    c = F.col("c")
    assert [tuple(s) for s in one(spark, contracts.step_list(c), c="D1. Look\n\n O2: See \nfree text")] == [("D1", "Look"), ("O2", "See"), ("s3", "free text")]
    assert [tuple(e) for e in one(spark, contracts.element_list(c), c="e4. Owner named [programme]\nplain\nE2. x")] == [("e4", "Owner named", "programme"), ("e2", "plain", "model"), ("E2", "x", "model")]
    assert one(spark, contracts.items_of(c), c="- a; b\n• c;;") == ["a", "b", "c"]
    assert one(spark, contracts.boundary_text(F.col("a"), F.col("b"), F.col("c")), a="no  owner", b=None, c="all\nnamed") == "none: no owner | full: all named"
    assert one(spark, contracts.requirement_parts(c), c="Name an owner; review it each year, and keep the record. Short.") == ["Name an owner", "review it each year", "keep the record"]
    assert one(spark, contracts.requirement_parts(c), c="Short.") == ["Short."] and one(spark, contracts.requirement_parts(c), c=None) == []
    assert one(spark, contracts.artefact_names(c), c="plan; log\n ;") == ["plan", "log"]
    assert one(spark, contracts.slug(c), c=" Risk & Register (v2)!") == "Risk---Register--v2".lower()
    assert one(spark, contracts.header_field(c, "owner"), c="PLAY 1 | Owner: Head  of\nrisk | Frequency — monthly") == "Head of risk"
    assert one(spark, contracts.bare_id(c), c=" S1.2 ★") == "S1.2"
    frame = spark.createDataFrame([("", "w " * 100, None)], "where string, why string, note string")
    place = frame.select(contracts.place_of(frame).alias("p")).first().p
    assert place.endswith("w …") and len(place) <= 152


def test_contracts(spark):
    kind = "ordinal int, framework string, control_id string, elements array<struct<id:string,text:string,lane:string,scope:string,locator:string>>, requirement string"
    rows = [(1, "MAS", "M1 ★", [("", " a\n b ", None, None, None), ("x", "c", "b", None, None), ("y", " ", None, None, None), ("z", "d", "a", "Programme", "here")], "first"), (2, "MAS", "M1", [], "second"), (3, "MGF Agentic", "M1", [], "other")]
    held = spark.createDataFrame(rows, kind)
    got = contracts.elements(held.where("ordinal = 1")).orderBy("ordinal").collect()
    assert [(r.element_id, r.text, r.scope, r.locator) for r in got] == [("e0", "a b", "model", "controls.M1 ★.elements[0]"), ("z", "d", "Programme", "here")]
    assert contracts.elements(held, ["programme"]).count() == 1
    asked = spark.createDataFrame([("M1", "MAS"), ("M1★", "MGF_Agentic"), ("M9", "MAS")], "control_id string, framework string")
    assert {(r.control_id, r.requirement) for r in contracts.contract_of(held, asked).collect()} == {("M1", "first"), ("M1★", "other"), ("M9", None)}
    controls = spark.createDataFrame([("M1★", "Owners", "Name  them"), ("M2", "Logs", "Keep them")], "control_id string, title string, requirement string")
    assert [r.control_id for r in contracts.searched(controls, " OWNER").collect()] == ["M1★"]
    assert {(r.query_id, r.text) for r in contracts.query_text(controls).collect()} == {("M1", "Owners Name them"), ("M2", "Logs Keep them")}


def test_reports(spark, tmp_path):
    (tmp_path / "new.jsonl").write_text('not json\n{"entry_type": "eval", "probe": "p", "detector": "d", "total": 5, "passed": 3}\n{"entry_type": "attempt"}\n')
    (tmp_path / "old.jsonl").write_text('{"entry_type": "attempt"}\n{"entry_type": "attempt"}\n')
    assert [tuple(r) for r in readers.probe_report(spark, str(tmp_path / "new.jsonl")).collect()] == [("p", "d", 5, 3, 2)]
    assert [tuple(r) for r in readers.probe_report(spark, str(tmp_path / "old.jsonl")).collect()] == [("all", "?", 2, None, None)]
    case = {"success": True, "testCase": {"description": "says no"}, "metadata": {"pluginId": "x"}, "gradingResult": {"reason": "r" * 200}}
    for name, found in (("nested", {"results": {"results": [case, {"id": "7"}]}}), ("flat", {"results": [case, {"id": "7"}]})):
        (tmp_path / name).write_text(json.dumps(found))
        got = [(r.id, r.plugin, r.success, len(r.reason)) for r in readers.agent_report(spark, str(tmp_path / name)).collect()]
        assert got == [("says no", "x", True, 160), ("7", None, False, 0)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.b.md").write_text("one\ntwo")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "docs")).collect()] == [("a.b", "one\ntwo")]


def test_probe_change(spark):
    frame = spark.createDataFrame([(0.5, 0.4), (0.4, 0.5), (0.4, 0.42), (None, 0.1)], "a double, b double")
    assert [r.x for r in frame.select(evaluation.rate_change(F.col("a"), F.col("b")).alias("x")).collect()] == ["better", "worse", "same", None]
