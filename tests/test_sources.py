from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.sources import readers, sinks
from attestra.streaming import logs


def test_files_and_signals(spark, tmp_path):
    for name, text in {"a/report.md": "Hello  there", "a/.git/x.md": "no", "data/y.md": "no", "b/app.env": "K=1", "b/app.env.example": "K=", "keep.bak": "no", "c/Dockerfile": "FROM x", "d/Secret_notes.txt": "s"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    listing = readers.files(spark, str(tmp_path))
    assert {r.rel for r in listing.collect()} == {"a/report.md", "b/app.env", "b/app.env.example", "c/Dockerfile", "d/Secret_notes.txt"}
    assert {(r.path, r.kind) for r in readers.signals(listing).collect()} == {("b/app.env", "secrets"), ("c/Dockerfile", "container"), ("d/Secret_notes.txt", "secrets")}
    docs = {r.doc_id: r.text for r in readers.documents(spark, str(tmp_path)).collect()}
    assert docs == {"a/report.md": "Hello  there", "d/Secret_notes.txt": "s"}
    assert [r.chunk for r in readers.document_chunks(spark, str(tmp_path)).where("doc_id = 'a/report.md'").collect()] == ["[report.md]\nHello there"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return path.read_bytes()


def test_office_files(tmp_path):
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    cell = lambda text, wide="": f"<w:tc><w:tcPr>{wide}</w:tcPr>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c', '<w:gridSpan w:val=\"2\"/>')}</w:tr></w:tbl>"
    raw = packed(tmp_path / "x.docx", **{"word/document.xml": f"<w:document {W}><w:body>{p('One', ' more')}{table}{p('Two')}</w:body></w:document>"})
    assert readers.extract("x.docx", raw) == "One more\nTwo\na | b\nc | c"
    raw = packed(tmp_path / "x.xlsx", **{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Late" r:id="rId9"/><sheet name="Early" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="u"><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c><c><v>2.5</v></c><c t="b"><v>1</v></c></row><row/><row><c s="1"><v>45292</v></c><c t="s"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/other.xml": f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>x</t></is></c><c/></row></sheetData></worksheet>',
    })
    assert readers.extract("x.xlsx", raw) == "## Sheet: Late\nx\n## Sheet: Early\nhead | 2 | 2.5 | True\n2024-01-01 00:00:00 | rich"
    assert readers.extract("x.docx", b"broken").startswith("[unreadable")


def test_own_files_are_no_evidence(spark, tmp_path):
    for name in ("evidence/a.md", "tool/readme.md", *(f"tool/{m}" for m in readers.MARKERS[:4]), *(f"evidence/copy/{m}" for m in readers.MARKERS), "evidence/copy/docs/b.md", "evidence/few/app.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    tool = str(tmp_path / "tool")
    for folder in (tool, str(tmp_path), tool + "/"):
        with pytest.raises(readers.OwnFilesError):
            readers.files(spark, folder, tool)
    (tmp_path / "tool/docs").mkdir()
    with pytest.raises(readers.OwnFilesError):
        readers.files(spark, tool + "/docs", tool)
    assert readers.refused(str(tmp_path / "evidence"), tool) is None and readers.refused(str(tmp_path / "tools"), tool) is None
    got = lambda *a: {r.rel for r in readers.files(spark, str(tmp_path / "evidence"), *a).select("rel").collect()}
    assert got(tool) == {"a.md", "few/app.py"}
    assert "copy/docs/b.md" in got()


def test_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿ticket_id , owner\n 1 , Ann \n2,\n")
    (tmp_path / "t.json").write_text(json.dumps({"records": [{"v": "1", "x": 2}, {"v": "2", "x": None}]}))
    (tmp_path / "t.yaml").write_text("models:\n- {name: m, live: true}\n")
    (tmp_path / "bad.json").write_text("")
    rows = readers.csv_records(spark, str(tmp_path / "t.csv"))
    assert rows.columns == ["ticket_id", "owner"] and {(r.ticket_id, r.owner) for r in rows.collect()} == {("1", "Ann"), ("2", None)}
    catalog = readers.catalog_of(spark, {"a": str(tmp_path / "t.csv"), "b": str(tmp_path / "t.json"), "gone": str(tmp_path / "none.csv")})
    assert {r.source: r.status for r in catalog.summary().collect()} == {"a": "ok", "b": "ok", "gone": "missing"}
    assert catalog.get("b").count() == 2
    assert readers.yaml_records(spark, str(tmp_path / "t.yaml"), "models").first().live == "true"
    (tmp_path / "req.txt").write_text("a==1.0\nb>=2 # why\nc\n# note\n-r x\n")
    got = {r.package: (r.version, r.pinned) for r in readers.lock_file(spark, str(tmp_path / "req.txt")).collect()}
    assert got == {"a": ("1.0", True), "b": ("2", False), "c": (None, False)}


def test_registers(spark):
    models = spark.createDataFrame([("m", "high")], "model_id string, risk_tier string")
    required = spark.createDataFrame([("card", "all", ["a.md", "b.md"]), ("plan", "high", ["c.md"]), ("x", "low", ["d.md"])], "artefact string, scope string, locations array<string>")
    got = {r.artefact: (r.location, r.universal_gap, r.tier_gap) for r in readers.artefact_status(models, required, spark.createDataFrame([("b.md",)], "path string")).collect()}
    assert got == {"card": ("b.md", False, False), "plan": (None, False, True)}
    exceptions = spark.createDataFrame([("1", "open", "o", "2026-03-01"), ("2", "Open", " ", "2026-03-01"), ("3", "closed", None, None), ("4", "open", "o", "2026-12-01"), ("5", "open", "o", "soon")], "exception_id string, status string, owner string, expires_on string")
    assert {r.exception_id: (r.missing_fields, r.ok) for r in readers.exception_status(exceptions, ["owner"], 180, "2026-01-01T10:00:00Z").collect()} == {"1": ([], True), "2": (["owner"], False), "4": ([], False), "5": ([], False)}
    refs = spark.createDataFrame([("LIB: A.1 (note), A.3-A.5 | NIST: MAP 1.1",)], "c string")
    assert [(r.lib, r.ref) for r in readers.control_references(refs, "c").collect()] == [("LIB", "A.1"), ("LIB", "A.3"), ("LIB", "A.4"), ("LIB", "A.5"), ("NIST", "MAP 1.1")]
    cadence = spark.createDataFrame([("Quarterly",), ("semi-annual",), ("Annual",), (None,)], "c string").select(readers.cadence_days(F.col("c")).alias("d"))
    assert [r.d for r in cadence.collect()] == [92, 183, 366, None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 1), ("v2", 2)], "version string, x int")
    assert {(r.version, r.x) for r in sinks.upserted(rows, spark.createDataFrame([("v2", 9)], "version string, x int"), ["version"]).collect()} == {("v1", 1), ("v2", 9)}
    sinks.append_results(rows, str(tmp_path / "r"), "2026-09-15T10:00:00Z")
    assert spark.read.parquet(str(tmp_path / "r")).select("run_date").distinct().count() == 1
    kinds = spark.range(300).select(F.col("id").cast("string").alias("k")).select(sinks.scenario("k").alias("s")).groupBy("s").count()
    assert {r.s for r in kinds.collect()} == {"full", "partial", "none"}


def test_stream_keeps_the_latest(spark, tmp_path):
    log, state = tmp_path / "log", tmp_path / "state"
    log.mkdir()
    line = lambda t, step, d: json.dumps({"recorded_at": t, "use_case": "u", "step": step, "decision": d, "reviewer": "r", "reason": "x"}) + "\n"
    (log / "1.json").write_text(line("2026-01-01", "P1", "accept") + line("2026-01-01", "P2", "accept"))
    for more in (None, line("2026-01-02", "P1", "reject")):
        if more:
            (log / "2.json").write_text(more)
        logs.keep_latest(logs.read_log(spark, str(log)), ["use_case", "step"], "recorded_at", str(state), str(tmp_path / "cp"), 8).awaitTermination(60)
    held = logs.KeyedState(spark, str(state), ["use_case", "step"], "recorded_at", 8)
    assert {r.step: r.decision for r in held.read().collect()} == {"P1": "reject", "P2": "accept"}
    # a new checkpoint reads the log anew, from batch 0: nothing is lost, and an older version is still there
    (log / "3.json").write_text(line("2026-01-03", "P3", "accept"))
    logs.keep_latest(logs.read_log(spark, str(log)), ["use_case", "step"], "recorded_at", str(state), str(tmp_path / "cp2"), 8).awaitTermination(60)
    assert {r.step: r.decision for r in held.read().collect()} == {"P1": "reject", "P2": "accept", "P3": "accept"}
    assert {r.step: r.decision for r in held.read(0).collect()} == {"P1": "accept", "P2": "accept"}


def test_state_copies_touched_buckets_alone(spark, tmp_path):
    held = logs.KeyedState(spark, str(tmp_path / "state"), ["k"], "at", 16)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, x string")
    assert held.read() is None and held.version() == -1
    assert held.fold(rows(*((f"k{i}", 1, "a") for i in range(40))), "s", 0)
    first = held.manifest()["buckets"]
    assert not held.fold(rows(("k1", 9, "again")), "s", 0)  # a batch that runs again
    assert held.fold(rows(("k1", 2, "b"), ("k2", 0, "late")), "s", 1)
    second = held.manifest()["buckets"]
    changed = {b for b in second if first[b] != second[b]}
    assert 1 <= len(changed) <= 2 and set(first) == set(second)
    got = {r.k: r.x for r in held.read().collect()}
    assert got["k1"] == "b" and got["k2"] == "a" and len(got) == 40
    assert held.fold(rows(("new", 1, "c")), "other", 0) and held.read().count() == 41
    assert held.fold(rows(), "other", 1) and held.read().count() == 41
    before = held.manifest()
    with __import__("pytest").raises(RuntimeError, match="there already"):
        held._commit(before)
    assert held.manifest() == before
    with __import__("pytest").raises(ValueError, match="buckets"):
        logs.KeyedState(spark, str(tmp_path / "state"), ["k"], "at", 8).read()


def test_listing_never_opens_what_is_left_out(spark, tmp_path):
    from attestra.sources import folders

    for at in ("a/b/c", "a/data/deep/er", "node_modules/x", ".git/objects", "d"):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "f.md").write_text(at)
    (tmp_path / "a/skip.bak").write_text("x")
    (tmp_path / "d/link").symlink_to(tmp_path / "a")
    for deal in (1, 3, 1000):
        rows = folders.listing(spark, str(tmp_path), readers.SKIPPED_FOLDERS, readers.SKIPPED_FILES, deal)
        got = [(r.rel, r.folder) for r in rows.collect()]
        assert sorted(r for r, folder in got if folder) == ["", "a", "a/b", "a/b/c", "d"]
        assert sorted(r for r, folder in got if not folder) == ["a/b/c/f.md", "d/f.md"]
        assert sorted(r for r, f in got if not f) == sorted(r.rel for r in readers.files(spark, str(tmp_path)).select("rel").where("rel NOT LIKE 'd/link/%'").collect())  # links aren't followed
    assert {(r.rel, bytes(r.content)) for r in folders.contents(spark, rows, 100).collect()} == {("a/b/c/f.md", b"a/b/c"), ("d/f.md", b"d")}
    with __import__("pytest").raises(Exception, match="gone"):
        folders.listing(spark, str(tmp_path / "gone"), [], []).count()


def test_adapters_by_configuration(spark, tmp_path):
    from attestra.sources import folders

    (tmp_path / "t.csv").write_text("id,owner\n1,ann\n")
    (tmp_path / "requirements.txt").write_text("a==1\n")
    (tmp_path / "my_model_card.md").write_text("x")
    config = {"tickets": {"kind": "table", "path": "t.csv"}, "locks": {"kind": "lock_file"}, "gone": {"kind": "table", "path": "no.csv"}, "odd": {"kind": "nothing"}, "signals": {"kind": "environment"}}
    made = folders.configured(spark, str(tmp_path), config)
    assert {r.source: r.status for r in made.summary().collect()} == {"tickets": "ok", "locks": "ok", "gone": "missing", "odd": "error", "signals": "ok"}
    assert made.get("tickets").first().owner == "ann" and {r.kind for r in made.get("signals").collect()} == {"model-doc", "dependencies"}


def _log(*records):
    return "".join("\x1e" + "\x1f".join((c, "Ann", "a@b.c", "2026-01-01T00:00:00Z", s)) + "\n\n" + "".join(f"{p}\n" for p in paths) for c, s, paths in records)


def test_commit_log(spark, tmp_path):
    from attestra.sources import commits

    (tmp_path / "log").write_text(_log(("c3", "Fix | both ABC-12", ["app/assess.py", "app/corpus/x.md", "other/y"]), ("c2", "Corpus, no ticket", ["app/corpus/x.md"]), ("c1", "Empty", []), ("c0", "Start \x1f odd", ["app/assess.py"])))
    rows = commits.git_log(spark, str(tmp_path / "log"), ["corpus/"], "app/").orderBy("ordinal").collect()
    assert [(r.commit, r.ticket_ref, r.paths, r.touches_governed_paths) for r in rows] == [("c3", "ABC-12", ["assess.py", "corpus/x.md"], True), ("c2", None, ["corpus/x.md"], True), ("c1", None, [], False), ("c0", None, ["assess.py"], False)]
    log = commits.git_log(spark, str(tmp_path / "log"), prefix="app/")
    got = lambda since, until: {r.commit: r.touches_both for r in commits.commit_range(log, since, until, ["assess.py"], ["corpus/"]).collect()}
    assert got(None, None) == {"c3": True, "c2": False, "c1": False, "c0": False}
    assert got("c0", "c2") == {"c2": False, "c1": False} and got("c1", None) == {"c3": True, "c2": False} and got("zz", None) == {}
    (tmp_path / "empty").write_text("")
    assert commits.git_log(spark, str(tmp_path / "empty")).count() == 0


def test_controls_of_commits_and_runs(spark, tmp_path):
    from attestra.plans import runner
    from attestra.sources import workspace

    for name in ("governance", "policy"):
        (tmp_path / name).mkdir()
    (tmp_path / "policy/ai-lifecycle.yaml").write_text("golden_state:\n  evaluation:\n    promotion: {assessor_input_paths: [assess.py], corpus_paths: [corpus/], quarantine_ceiling: 0.5}\n")
    controls, _ = runner.load_controls("attestra/packs") if (tmp_path / "attestra").exists() else runner.load_controls(str(__import__("pathlib").Path(runner.__file__).parents[1] / "packs"))
    policy = runner.policy_of(str(tmp_path / "policy/ai-lifecycle.yaml"))
    asked = [c for c in controls if c["id"] in ("EVL-07", "EVL-08", "EVL-09")]
    run = lambda: {r.control_id: (r.verdict, r.n_findings) for r in runner.run_controls(workspace.catalog(spark, str(tmp_path), "2026-09-15"), asked, policy, "2026-09-15").collect()}
    assert {v for v, _ in run().values()} == {"NOT_TESTABLE"}
    line = lambda run, case, got, i=0, want="full": json.dumps({"run_id": run, "run_at": run, "corpus_sha": "s", "case_id": case, "run_index": i, "want": want, "got": got}) + "\n"
    good = "".join(line(r, f"c{i}", "full") for r in ("r1", "r2") for i in range(8))
    (tmp_path / "governance/eval_runs.jsonl").write_text(good)
    (tmp_path / "governance/git_log.txt").write_text(_log(("c2", "Corpus", ["corpus/x"]), ("c1", "Code", ["assess.py"])))
    assert run() == {"EVL-07": ("PASS", 0), "EVL-08": ("PASS", 0), "EVL-09": ("PASS", 0)}
    (tmp_path / "governance/eval_runs.jsonl").write_text(good + "".join(line("r3", f"c{i}", "none") for i in range(2)) + "".join(line("r3", f"c{i}", g, k) for i in range(2, 8) for k, g in enumerate(("full", "none"))))
    (tmp_path / "governance/git_log.txt").write_text(_log(("c2", "Both", ["corpus/x", "assess.py"])))
    assert {k: v for k, (v, _) in run().items()} == {"EVL-07": "FAIL", "EVL-08": "FAIL", "EVL-09": "FAIL"}
