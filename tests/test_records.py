"""References, declarations, bundles, carried values, Markdown labels and embedded search, in small cases."""

from __future__ import annotations

import json

import pytest
import yaml
from pyspark.sql import functions as F

from attestra.operators import bundles, carry, declared, embedding, evaluation, sections, universes
from attestra.plans import runner
from attestra.plans.catalog import Catalog


def docs(spark, *values):
    rows = [(i, None if v is None else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, text string").select("id", F.parse_json("text").alias("doc"))


def test_key_paths_of_nested_documents(spark):
    text = "version: 1\ngolden_state:\n  gates: {on_deploy: {fail_on: high}}\n  list: [{a: 1}, 2]\n  'odd.key': x\n"
    rows = docs(spark, yaml.safe_load(text), None, [1, {"b": 2}], 3)
    paths = universes.flattened(rows, "doc", ["id"])
    assert {(r.id, r.path) for r in paths.select("id", "path").collect()} == {(0, p) for p in ("version", "golden_state", "golden_state.gates", "golden_state.gates.on_deploy", "golden_state.gates.on_deploy.fail_on", "golden_state.list", "golden_state.odd.key")}
    listed = {r.path for r in universes.flattened(rows, "doc", ["id"], lists=True).where("id = 0").select("path").collect()}
    assert {"golden_state.list.0.a", "golden_state.list.1"} <= listed
    assert {r.path for r in universes.flattened(rows, "doc", ["id"], levels=1).select("path").collect()} == {"version", "golden_state"}
    relative = {r.path for r in universes.with_relative(paths.where("id = 0").select("path"), "golden_state").collect()}
    assert {"gates.on_deploy.fail_on", "golden_state.gates.on_deploy.fail_on", "version"} <= relative and "golden_state" in relative


def test_links(spark):
    tests = spark.createDataFrame([("M1", "critical", None, ["P1.1", "P9.9"], []), ("M2", "critical", "lane_b", [], []), ("M3", "critical", "human_only", [], ["K1"]), ("M4", "odd", "other", None, ["K1", "K2"]), ("M9", "low", "lane_a", [], [])], "control_id string, severity string, assurance_mode string, play_refs array<string>, lane_b_packs array<string>")
    packs = spark.createDataFrame([("K1", ["P1.1"], ["MAS-AIRG-M4", "ISO-1"], ["a.b"]), ("K3", [""], ["MAS-AIRG-M8"], ["a.c"])], "pack_id string, play_refs array<string>, framework_refs array<string>, policy_refs array<string>")
    ids = lambda name, *x: spark.createDataFrame([(v,) for v in x], f"{name} string")
    got = {tuple(r) for r in universes.link_report(tests, ids("control_id", "M1", "M7"), packs, ids("step_id", "P1.1"), ids("control_id", "M1", "M2", "M3", "M4"), ids("path", "a", "a.b")).collect()}
    assert got == {
        ("error", "M1", "unknown play", "P9.9"), ("error", "M9", "unknown control", "M9"), ("error", "M7", "unknown control", "M7"), ("error", "K3", "unknown control", "M8"), ("error", "K3", "unknown policy", "a.c"),
        ("error", "M4", "severity", "odd"), ("error", "M4", "assurance mode", "other"), ("error", "M1", "critical without assurance mode", ""), ("error", "M2", "critical lane_b without a pack", ""), ("error", "M3", "critical human_only with packs", ""),
        ("warning", "M3", "stale packs", "-K1 +"), ("warning", "M4", "stale packs", "-K2 +"),
    }


def errors(spark, schema, *values, keys=None):
    rows = declared.checked(docs(spark, *values), "doc", schema, keys).orderBy("id").collect()
    return [sorted((e.path, e.rule) for e in r.errors) for r in rows]


def test_schema_rules(spark):
    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^[A-Z]+-[0-9]+$", "maxLength": 6}, "n": {"type": ["integer", "null"], "minimum": 2, "maximum": 4}, "x": {"type": "number"}, "on": {"type": "boolean"}, "kind": {"enum": ["a", 1, None]}, "v": {"const": 2}, "at": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["s"], "properties": {"s": {"type": "string", "minLength": 2}}}}, "set": {"uniqueItems": True}, "map": {"type": "object", "minProperties": 1}}}
    good = {"id": "AB-1", "n": 3, "x": 1.5, "on": True, "kind": "a", "v": 2, "at": [{"s": "ok"}], "set": [1, "1"], "map": {"k": 1}}
    assert errors(spark, schema, good, {"id": "AB-1", "n": None, "x": 2, "kind": None}) == [[], []]
    assert errors(spark, schema, None, [], {}, {"id": 1}) == [[("", "document")], [("", "type")], [("id", "required")], [("id", "type")]]
    bad = {"id": "ab-12345", "n": 1, "x": "1", "on": 1, "kind": "b", "v": 3, "at": [], "set": [1, 1], "map": {}, "z": 1, "y": 2}
    assert errors(spark, schema, bad) == [sorted([("id", "pattern"), ("id", "maxLength"), ("n", "minimum"), ("x", "type"), ("on", "type"), ("kind", "enum"), ("v", "const"), ("at", "minItems"), ("set", "uniqueItems"), ("map", "minProperties"), ("y", "additionalProperties"), ("z", "additionalProperties")])]
    deep = {"id": "AB-1", "n": 2.5, "at": [{"s": "x"}, {"t": 1}, 3]}
    assert errors(spark, schema, deep) == [sorted([("n", "type"), ("at", "maxItems"), ("at[0].s", "minLength"), ("at[1].s", "required"), ("at[2]", "type")])]


def test_knowledge_declarations(spark):
    memory = {"memory_id": "m1", "authority_tier": "authoritative", "statement": "s", "controls": ["A"]}
    got = errors(spark, declared.MEMORY, memory, memory, {"statement": "", "controls": [], "authority_tier": "odd"}, {**memory, "memory_id": "m2"}, keys=["memory_id"])
    assert got == [[("memory_id", "duplicate")], [("memory_id", "duplicate")], [("authority_tier", "enum"), ("controls", "minItems"), ("memory_id", "required"), ("statement", "minLength")], []]
    testing = {"control_id": "A", "framework": "F", "title": "t", "testing": {"x": 1}, "authority_tier": "example", "provenance": {"source_file": "f"}}
    assert errors(spark, declared.TESTING, testing, {**testing, "framework": "G", "provenance": {}}, keys=["framework", "control_id"]) == [[], [("provenance.source_file", "required")]]
    contract = {name: ["x"] for name in declared.SAID_OF_CONTROLS} | {"framework": "MAS", "control_id": "M1"}
    assert errors(spark, declared.CONTRACT, contract, {**contract, "control_id": "M2", "title": "", "elements": [], "boundary": {}}, keys=["framework", "control_id"]) == [[], [("boundary", "minProperties"), ("elements", "minItems"), ("title", "minLength")]]


def stored(spark, *made):
    kind = "bundle_id string, run_at string, note string, results array<struct<control_id:string,verdict:string,examined:long,ok:boolean,human_verdict:string>>, sha256 string"
    return spark.createDataFrame([(b["bundle_id"], b["run_at"], b["note"], [(r["control_id"], r["verdict"], r["examined"], r["ok"], r.get("human_verdict")) for r in b["results"]], b["sha256"]) for b in made], kind)


def test_digests_are_those_of_bundles(spark):
    results = spark.createDataFrame([("A", "FAIL", 3, True), ('B"\\', "PASS", None, None)], "control_id string, verdict string, examined long, ok boolean")
    notes = ["plain ~", 'quo"te \\ /', "é ü 日本 🙂 \x00\x1f\x7f \n\r\t\b\f", None, ""]
    made = [runner.bundle(results, {"bundle_id": f"b{i}", "run_at": "2026-01-01", "note": n}) for i, n in enumerate(notes)]
    rows = bundles.verified(stored(spark, *made)).collect()
    assert all(r.intact for r in rows) and all(runner.intact(b) for b in made)
    made[0]["results"][0]["human_verdict"] = "ann"
    made[1]["results"][0]["verdict"] = "PASS"
    made[2]["note"] += "!"
    assert [r.intact for r in bundles.verified(stored(spark, *made)).orderBy("bundle_id").collect()] == [runner.intact(b) for b in made] == [True, False, False, True, True]
    assert [tuple(r)[2:] for r in bundles.summarised(stored(spark, *made)).orderBy("bundle_id").collect()][:2] == [(2, 1, 1, 0, 0, True), (2, 2, 0, 0, 0, False)]
    with pytest.raises(TypeError):
        bundles.digest(spark.sql("SELECT 1.5D AS x, 'y' AS sha256"))


def test_signatures(spark):
    results = spark.createDataFrame([("A", "FAIL", 1, True), ("B", "PASS", 1, True)], "control_id string, verdict string, examined long, ok boolean")
    good, bad = (runner.bundle(results, {"bundle_id": b, "run_at": "r", "note": ""}) for b in ("g", "x"))
    bad["results"][0]["verdict"] = "PASS"
    entry = "bundle_id string, control_id string, at int, reviewer string, disposition string, withdrawn boolean"
    entries = spark.createDataFrame([("g", "A", 1, " ann ", "ACCEPT", None), ("g", "A", 2, "bob", "fine", None), ("g", "B", 1, "bob", "ESCALATE", None), ("g", "B", 3, None, None, True), ("g", "A", 4, " ", "ACCEPT", None), ("g", "Z", 1, "ann", "ACCEPT", None), ("x", "A", 1, "ann", "ACCEPT", None), ("y", "A", 1, "ann", "ACCEPT", None)], entry)
    held = stored(spark, good, bad)
    why = {(r.bundle_id, r.control_id, r["at"]): r.refusals for r in bundles.refused(entries, held).collect()}
    assert why == {("g", "A", 1): [], ("g", "A", 2): ["unknown disposition"], ("g", "B", 1): [], ("g", "B", 3): [], ("g", "A", 4): ["no reviewer"], ("g", "Z", 1): ["unknown control"], ("x", "A", 1): ["changed bundle"], ("y", "A", 1): ["unknown bundle"]}
    got = {(r.bundle_id, r.control_id): (r.reviewer, r.disposition, r.signed_at) for r in bundles.signed(held, entries).collect()}
    assert got == {("g", "A"): ("ann", "ACCEPT", 1), ("g", "B"): (None, None, None), ("x", "A"): (None, None, None), ("x", "B"): (None, None, None)}


def test_identities_and_drafts(spark):
    parts = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "b", None), (2, "a", "x"), (3, "a", "y"), (3, "b", None), (3, "b", None)], "run int, part string, value string")
    ids = {r.run: (r.n_parts, r.assessment_id) for r in bundles.assessment_ids(parts).collect()}
    assert ids[1] == ids[2] and ids[3][1] != ids[1][1] and ids[3][0] == 2
    live = spark.createDataFrame([("A", "1"), ("B", "2")], "control_id string, text string")
    said = spark.createDataFrame([("d", "B", "3"), ("d", "C", "4"), ("e", "A", "1"), ("e", "B", "2")], "draft_id string, control_id string, text string")
    changes = bundles.draft_changes(live, said)
    assert {r.draft_id: tuple(r)[1:] for r in changes.collect()} == {"d": (1, 1, 1, 2), "e": (0, 0, 0, 2)}
    drafts = spark.createDataFrame([("d", "draft", "t", "r", "1"), ("e", "approved", "t", "", "1"), ("f", "draft", "t", "r", None)], "draft_id string, status string, source_title string, source_reference string, base_version string")
    approvals = spark.createDataFrame([("d", "ann", "T1"), ("e", "ann", None)], "draft_id string, approved_by string, ticket string")
    got = {r.draft_id: (r.problems, r.promoted) for r in bundles.promotable(drafts, changes, approvals).collect()}
    assert got == {"d": ([], True), "e": (["not a draft", "no source_reference", "no ticket"], False), "f": (["no base_version", "no controls", "no approver", "no ticket"], False)}


@pytest.mark.parametrize("wide", [1, 7, 1000])
def test_carried_values(spark, monkeypatch, wide):
    monkeypatch.setattr(carry, "FAN", 4)
    monkeypatch.setattr(carry, "LEVELS", 5)
    import random

    r = random.Random(wide)
    values = [r.choice([None] * 12 + [str(i)]) for i in range(600)]
    order = [i for i in range(600) if r.random() < 0.7]  # blocks may be empty
    rows = spark.createDataFrame([(i, values[i]) for i in order], "i int, v string").repartition(5)
    got = {x.i: x.f for x in carry.carried(rows, ["i"], F.col("v"), F.floor(F.col("i") / wide), "f").collect()}
    want, last = {}, None
    for i in order:
        last = values[i] if values[i] is not None else last
        want[i] = last
    assert got == want
    assert carry.carried(rows.limit(0), ["i"], F.col("v"), F.col("i"), "f").count() == 0


def test_plays_are_carried_down(spark):
    from attestra.sources import readers

    rows = spark.createDataFrame([(1, "intro", "x"), (2, "PLAY 3: a", ""), (3, "Step 1", "s1"), (4, None, "s2"), (5, "play 4", ""), (6, "Step 1", "s3")], "ordinal int, head string, text string")
    assert {(r.ordinal, r.play) for r in readers.plays(rows).collect()} == {(3, "3"), (4, "3"), (6, "4")}


def test_sections_and_labels(spark):
    text = "preamble `M_a` is **full**\n# Title\n\nbody\r\n### `M_a.md` → **partial**\nsays `_b` carried **full**\n#hashtag\n### `M_b` → **FULL**\n\n## Other\n#### `M_c` → **none**\n"
    rows = spark.createDataFrame([("M", text), ("N", None), ("O", "")], "control_id string, text string")
    got = [(r.level, r.heading, r.body) for r in sections.sections(rows, ["control_id"]).orderBy("ordinal").collect()]
    assert [(a, b) for a, b, _ in got] == [(0, ""), (1, "Title"), (3, "`M_a.md` → **partial**"), (3, "`M_b` → **FULL**"), (2, "Other"), (4, "`M_c` → **none**")]
    assert got[1][2] == "body" and got[2][2] == "says `_b` carried **full**\n#hashtag"
    assert {tuple(r) for r in sections.written_labels(rows, ["control_id"]).collect()} == {("M", "a", "partial"), ("M", "b", "full")}


def test_labels_are_read_back_as_rendered(spark):
    values = {"a": "YYY", "b": "YN?", "c": "NNx", "d": "xxx"}
    full = {"Y": "Y", "N": "N", "x": "n/a", "?": "?"}
    rows = [(c, k, f"e{i}", i, full[x]) for c in ("M1", "M2") for k, v in values.items() for i, x in enumerate(v)]
    elements = spark.createDataFrame(rows, "control_id string, case_id string, element_id string, ordinal int, value string")
    texts = sections.rendered(elements)
    assert {tuple(r) for r in sections.written_labels(texts, ["control_id"]).collect()} == {(c, k, x) for c in ("M1", "M2") for k, x in (("a", "full"), ("b", "partial"), ("c", "none"))}
    assert "| `e1` | N |" in texts.where("control_id = 'M1'").first().text
    changed = texts.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"_a` → \*\*full", "_a` → **none"), "_b`", "_z`"))
    got = {(r.case_id, r.state) for r in sections.label_drift(elements, changed).where("control_id = 'M1'").collect()}
    assert got == {("a", "stale"), ("b", "missing"), ("z", "orphan"), ("c", "current"), ("d", "missing")}


def test_runs_are_compared(spark):
    line = lambda run, at, sha, case, got, i=0: (run, at, sha, case, i, "full", got)
    rows = [line("r1", "1", "s", c, "full") for c in "abcd"] + [line("r0", "0", "s", "a", "none"), line("t", "2", "other", "a", "none")]
    rows += [line("r2", "3", "s", "a", "none"), line("r2", "3", "s", "b", None), line("r2", "3", "s", "c", "full"), line("r2", "3", "s", "c", "none", 1), line("r2", "3", "s", "d", "full"), line("r2", "3", "s", "e", "none")]
    frame = spark.createDataFrame(rows, "run_id string, run_at string, corpus_sha string, case_id string, run_index int, want string, got string")
    got = {r.case_id: (r.incumbent_agree, r.challenger_agree, r.quarantined, r.regressed) for r in evaluation.compared_runs(frame).collect()}
    assert got == {"a": (True, False, False, True), "b": (True, False, False, True), "c": (True, False, True, False), "d": (True, True, False, False), "e": (None, False, False, False)}
    assert evaluation.compared_runs(frame.limit(0)).count() == 0


def test_memo_asks_once(spark, tmp_path):
    memo = embedding.Memo(spark, str(tmp_path / "memo"))
    asked = str(tmp_path / "asked")

    def embed(texts):
        with open(asked, "a") as file:
            file.writelines(f"{t}\n" for t in texts)
        return [None if t == "bad" else [float(len(t)), 1.0] for t in texts]

    provider = embedding.Provider("p", embed, 2)
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None), (5, "bad"), (6, "")], "key int, text string")
    assert tuple(memo.fill(texts.where("key < 4"), provider).first()) == (3, 2, 0, 2)
    assert tuple(memo.fill(texts, provider).first()) == (5, 4, 3, 1)  # "bad" has no vector: it isn't stored
    assert sorted(open(asked).read().split("\n")) == ["", "", "a", "bad", "bb"]
    assert tuple(memo.fill(texts, provider).first())[3] == 0
    assert sorted(open(asked).read().split("\n")).count("a") == 1
    got = {r.key: r.vector for r in memo.of(texts, provider).collect()}
    assert got == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None, 5: None, 6: [0.0, 1.0]}
    assert memo.vectors(embedding.hashing(4)).count() == 0

    def broken(texts):
        raise OSError("unavailable")

    with pytest.raises(Exception, match="unavailable"):
        memo.fill(texts.withColumn("text", F.concat("text", F.lit("!"))), embedding.Provider("p", broken))
    assert memo.vectors(provider).count() == 3


def test_hybrid_search(spark, tmp_path):
    held = {"triage.md": ["incident triage steps on call", "triage of alerts"], "risk.md": ["materiality score rationale for the model", "materiality score rationale for the model!", "materiality of risk", "rationale of a score"]}
    rows = [(i, d, t) for i, (d, t) in enumerate((d, t) for d, ts in held.items() for t in ts)]
    p = spark.createDataFrame(rows, "id int, doc_id string, text string")
    q = spark.createDataFrame([(1, "materiality score rationale")], "query_id int, text string")
    provider, memo = embedding.hashing(4096), embedding.Memo(spark, str(tmp_path / "m"))
    memo.fill(p.select(F.col("id").alias("key"), "text").unionByName(q.select((F.col("query_id") + 100).alias("key"), "text")), provider)
    found = embedding.hybrid(memo.of(p, provider), memo.of(q, provider), least_cosine=0.2).orderBy("position").collect()
    assert [r.doc_id for r in found] == ["risk.md", "risk.md"] and not {2, 3} <= {r.id for r in found}  # two of a document, near copies once
    assert found[0].found_by == ["lexical", "vector"] and "materiality" in found[0].terms and found[0].cosine > 0.5
    assert embedding.hybrid(memo.of(p, provider), memo.of(q, provider), least_cosine=0.99).count() == 0
    bare = q.withColumn("vector", F.lit(None).cast("array<double>"))
    assert {tuple(r.found_by) for r in embedding.hybrid(memo.of(p, provider), bare, least_cosine=0.9).collect()} == {("lexical",)}  # nothing to gate by
    best = spark.createDataFrame([(1, "a", 0.9), (2, "a", None), (3, "b", 0.4)], "query_id int, library string, cosine double")
    got = {(r.library, r.gate): (r.kept, r.total) for r in embedding.cosine_sweep(best, [0.0, 0.5]).collect()}
    assert got == {("a", 0.0): (2, 2), ("a", 0.5): (1, 2), ("b", 0.0): (1, 1), ("b", 0.5): (0, 1), (None, 0.0): (3, 3), (None, 0.5): (1, 3)}


def test_pack_reads_each_source_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "ann", "2026-01-01"), (2, None, "2025-01-01"), (3, "bob", None)], "id int, owner string, at string").write.parquet(path)
    catalog = Catalog(spark).add("t", spark.read.parquet(path)).add("u", spark.createDataFrame([("1", "x")], "id string, v string"))
    control = lambda i, check, **params: {"id": f"C{i}", "check": check, "params": {"source": "t", **params}, "frequency": "on_commit"}
    controls = [
        control(1, "field_present", fields=["owner"]), control(2, "date_not_passed", field="at"), control(3, "recency_each", field="at", max_days=30), control(4, "record_count", max=2), control(5, "threshold_met", field="id", order_by="at", min=1),
        control(6, "elapsed_within", field="at", max_days=10), control(7, "rate_within", field="owner", min_records=1), control(8, "field_present", fields=["owner"], where={"field": "id", "equals": 1}),
        {"id": "C9", "check": "values_subset", "params": {"subset": {"source": "t", "field": "id"}, "superset": {"source": "u", "field": "id"}}, "frequency": "on_commit"},
        control(10, "no_such_check"), control(11, "recency_each", field="at"), {"id": "C12", "check": "field_present", "params": {"source": "t"}, "frequency": "on_commit"},
    ]
    results = runner.run_controls(catalog, controls, {}, "2026-02-01")
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    alone = {c["id"]: tuple(runner.run_controls(catalog, [c], {}, "2026-02-01").first()) for c in controls}
    assert {r.control_id: tuple(r) for r in results.collect()} == alone
    assert {k: v[4] for k, v in alone.items()}["C1"] == "FAIL" and alone["C8"][4] == "PASS" and alone["C9"][4] == "FAIL" and alone["C10"][4] == alone["C12"][4] == "NOT_TESTABLE"


def test_structured_challenges(spark):
    from attestra.operators import comparison

    kind = "challenge_id string, control_id string, doc_id string, observation string, inference string, challenge string, quote string, supported string, element_id string, requirement string, risk string, resolution string, action string, severity string, confidence string, memory_ids array<string>, strength string, supports string"
    good = ("1", "M1", "d", "seen", "so it lacks an owner", "who?", "the OWNER signs", "an owner", "e1", "name an owner", "harm", "name one", "answer", "high", "low", None, "strong", "Reviewer")
    names = [c.split()[0] for c in kind.split(", ")]
    other = lambda i, **x: tuple((dict(zip(names, good)) | {"challenge_id": i} | x)[n] for n in names)
    rows = [good, other("2", requirement="a paraphrase", strength="weak"), other("3", quote="not there"), other("4", quote=None, element_id="e7", memory_ids=["m1", "m9"]), other("5", action="", severity="huge", confidence=None, observation=" "), other("6", doc_id="gone"), other("7", inference="this does not rebut it", memory_ids=["m1"])]
    found = comparison.structured(spark.createDataFrame(rows, kind), spark.createDataFrame([("d", "line\nThe owner\nsigns it")], "doc_id string, text string"), spark.createDataFrame([("M1", "e1", "Name an owner")], "control_id string, element_id string, text string"), spark.createDataFrame([("m1",)], "memory_id string"))
    got = {r.challenge_id: (r.errors, r.locator, r.repaired, r.requirement, r.strength) for r in found.collect()}
    assert got["1"] == ([], "lines:2-3", False, "Name an owner", "strong") and got["7"][4] == "weak"
    assert got["2"] == ([], "lines:2-3", True, "Name an owner", "weak")
    assert got["3"][0] == ["quote not in evidence"] == got["6"][0] and got["3"][4] is None
    assert got["4"][0] == ["unknown memory", "quote not in evidence", "unknown element"] and got["4"][3] == "name an owner"
    assert got["5"][0] == ["missing observation", "action", "severity", "confidence"]


def test_knowledge_and_reports(spark):
    from attestra.operators import reports

    kind = "id string, type string, authority_tier string, controls array<string>, topic string, statement string, tags array<string>, evidence_pattern map<string,array<string>>, challenge_prompt string"
    raw = spark.createDataFrame([("m1", "precedent", "heuristic", ["M1"], "owners", "name them", [], {"good": ["signed register"], "bad": ["draft"]}, None), ("m2", "challenge_pattern", "authoritative", ["*"], "dates", "check", ["register"], None, "who signed"), ("m3", "precedent", "authoritative", ["M9"], "other", "none", None, {}, None)], kind)
    held = raw.withColumn("text", reports.memory_text("topic", "statement", "type", "controls", "tags", "evidence_pattern", "challenge_prompt"))
    assert {r.id: r.text.replace("draft signed register", "signed register draft") for r in held.collect()} == {"m1": "owners name them precedent M1 signed register draft", "m2": "dates check challenge_pattern * register who signed", "m3": "other none precedent M9"}
    asked = spark.createDataFrame([(1, "M1", "the signed register")], "query_id int, key string, text string")
    got = lambda role: [(r.id, r.score) for r in reports.memories_for(held, asked, role).orderBy("rank").collect()]
    assert got("assessor") == [("m1", 12), ("m2", 10)] and got("challenger") == [("m2", 13), ("m1", 10)]
    tests = spark.createDataFrame([("t1", "A.6", "ISO 42001", "example", "policy review"), ("t2", "A.6", "MAS", "example", "policy review"), ("t3", "A.7", "ISO42001", "authoritative", "policy"), ("t4", "A.8", "ISO42001", "example", "nothing")], "id string, control_id string, framework string, authority_tier string, text string")
    q = spark.createDataFrame([(1, "A.6", "ISO42001", "review of policy")], "query_id int, key string, framework string, text string")
    assert [(r.id, r.score) for r in reports.tests_for(tests, q).orderBy("rank").collect()] == [("t1", 22), ("t3", 1)]
    results = spark.createDataFrame([(1, "h", "2026-01-30T10:00:00", "e", 1, 2, "Fail", "High", "a"), (2, "k", "2026-01-30T10:00:00", "e", 0, 2, "Pass", "Low", "b")], "n int, hotspot string, run_at string, engine string, failed int, cases int, result string, residual_risk string, note string")
    rows = {r.n: r for r in reports.tracker_proposals(results, spark.createDataFrame([(1, "named", 31)], "n int, hotspot string, max_days int")).collect()}
    assert (rows[1].hotspot, rows[1].next_run, rows[2].hotspot, rows[2].next_run) == ("named", "2026-03-02", "k", "2026-05-10")
    again = {r.n: r.evidence for r in reports.tracker_proposals(results.withColumn("note", F.lit("c")), results.select("n", "hotspot", F.lit(1).alias("max_days"))).collect()}
    assert again == {n: r.evidence for n, r in rows.items()} and again[1] != again[2]


def test_audit_from_end_to_end(spark, tmp_path):
    from attestra.plans import audit

    (tmp_path / "packs").mkdir()
    (tmp_path / "packs/p.yaml").write_text("- {id: A, check: field_present, params: {source: t, fields: [owner]}, frequency: on_commit, severity: high}\n- {id: B, check: record_count, params: {source: t, max: 9}, frequency: on_commit}\n- {id: C, check: record_count, params: {source: gone, max: 9}, frequency: daily}\n")
    store = str(tmp_path / "store")
    assert audit.listed(spark, store).count() == 0 and audit.signed(spark, store).count() == 0
    catalog = Catalog(spark).add("t", spark.createDataFrame([("é \"ann\"",), (None,)], "owner string"))
    first, _ = audit.run_audit(catalog, str(tmp_path / "packs"), {"version": 2}, "2026-01-01", store)
    second, path = audit.run_audit(catalog, str(tmp_path / "packs"), {"version": 2}, "2026-02-01", store)
    rows = audit.listed(spark, store).collect()
    assert [(r.bundle_id, r.passed, r.failed, r.not_testable, r.unsigned, r.intact) for r in rows] == [(b["bundle_id"], 1, 1, 1, 2, True) for b in (second, first)]
    entry = lambda c, at, who, how="ACCEPT", gone=None: (second["bundle_id"], c, at, who, how, "", None, gone)
    assert [r.refusals for r in audit.sign(spark, store, [entry("A", "1", "ann"), entry("C", "1", " ")]).collect()] == [["no reviewer"]]
    assert audit.entries(spark, store).count() == 0
    assert audit.sign(spark, store, [entry("A", "1", "ann"), entry("C", "1", "bob", "ESCALATE")]).isEmpty()
    assert audit.open_items(spark, store).count() == 0 and audit.listed(spark, store).first().unsigned == 0
    assert audit.sign(spark, store, [entry("A", "2", None, None, True)]).isEmpty()
    assert [r.control_id for r in audit.open_items(spark, store).collect()] == ["A"]
    assert {r.control_id: (r.n, r.streak) for r in audit.control_history(spark, store).collect()}["A"] == (2, 2)
    text = open(path, encoding="utf-8").read()
    with open(path, "w", encoding="utf-8") as file:
        file.write(text.replace('"FAIL"', '"PASS"'))
    assert [r.intact for r in audit.listed(spark, store).collect()] == [False, True]
