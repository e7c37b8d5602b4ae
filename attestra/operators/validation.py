"""Rules over rating proposals: each may lower a rating, none may raise one; findings add up in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators import text as X

#: Words by which a gap says that something isn't there. Fixed values.
ABSENCE = r"\b(no|not|none|never|missing|absent|lacking|without|unevidenced|undocumented|unavailable|nil)\b"
#: (word of the expected output, what citations must show, finding). Fixed values.
EXPECTED = [
    ("score", r"\b\d+(\.\d+)?\b|\b(low|medium|high|critical)\b", "no number or tier"),
    ("rationale", r"\b(because|rationale|basis|due to|given that)\b", "no reasoning language"),
    ("sign", r"\b(signed|approved by|approver|signature|sign-off)\b", "no approval"),
    ("approval", r"\b(approved|approval|approver|sign-off|signed)\b", "no approval"),
    ("minutes", r"\b(minutes|meeting|attendees|decision)\b", "no meeting record"),
    ("log", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b", "no dates"),
    ("dashboard", r"\b(threshold|drift|metric|alert)\b", "no metric or threshold"),
    ("report", r"\b(finding|result|conclusion|summary)\b", "no findings"),
    ("register", r"\b(id|entry|registered|inventory|owner)\b", "no entry fields"),
    ("inventory", r"\b(id|entry|registered|inventory|owner)\b", "no entry fields"),
    ("decision", r"\b(approved|rejected|decided|decision|go|no-go)\b", "no decision"),
]
#: Steps that need other steps decided first. Fixed values.
PREREQUISITES = {"P1.2": ["P1.1"], "P1.3": ["P1.2"], "P1.4": ["P1.3"], "P2.1": ["P1.4"]}
#: Instruction-like text in evidence. Fixed values.
INJECTION = r"(?i)(ignore (all|any|previous|prior) instructions|you are (now|an?) |as an ai|system prompt|mark (this|the) step|rate (this|the) step|sufficiency\s*[:=]\s*[\"']?full|respond with|output the following|assistant:|<\s*/?\s*(system|evidence|excerpt))"


def _flag(df: DataFrame, when: Column, text: str) -> DataFrame:
    return df.withColumn("flags", F.when(when, F.array_append("flags", F.lit(text))).otherwise(F.col("flags")))


def _step(df: DataFrame, when: Column, text: str, **changes: Column) -> DataFrame:
    """One rule: where it holds, note it and make its changes."""
    df = df.withColumn("_hit", F.coalesce(when, F.lit(False)))
    df = _flag(df, F.col("_hit"), text)
    return df.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_hit")


def _bare(c: Column) -> Column:
    return F.regexp_replace(E.plain(c), r"^(the|a|an)\s+", "")


def validated(proposals: DataFrame) -> DataFrame:
    """Proposals after the downgrade rules, in their order.

    Columns: id, evidence, excerpt, gaps, sufficiency, maturity, artefacts (array), elements (array of
    declared element ids), verdicts (array of element_id, status, excerpt). flags says what was done.
    """
    cap = lambda n: F.least("maturity", F.lit(n))
    lower = F.when(F.col("sufficiency") == "full", "partial").otherwise(F.col("sufficiency"))
    df = proposals.withColumns({
        "flags": F.array().cast("array<string>"),
        "evidence": F.coalesce("evidence", F.lit("")),
        "excerpt": F.coalesce("excerpt", F.lit("")),
        "gaps": F.filter(F.coalesce("gaps", F.array().cast("array<string>")), lambda g: F.trim(g) != ""),
        "maturity": F.coalesce(F.col("maturity").cast("int"), F.lit(1)),
        "_plain": E.plain(F.col("evidence")),
    })
    hits = F.col("evidence").rlike(X.INSTRUCTION)
    df = _step(df, hits, "evidence holds instructions", maturity=cap(2))
    quoted = E.plain(F.col("excerpt"))
    df = _step(df, (F.col("excerpt") != "") & ~F.col("_plain").contains(quoted), "excerpt not verbatim", excerpt=F.lit(""), sufficiency=lower)
    # only evidence that holds an instruction somewhere has a paragraph that does
    flagged = hits & F.exists(F.split("evidence", "\n\n", -1), lambda p: E.plain(p).contains(E.plain(F.col("excerpt"))) & p.rlike(X.INSTRUCTION))
    df = _step(df, (F.col("excerpt") != "") & flagged, "excerpt from a paragraph with instructions", excerpt=F.lit(""), sufficiency=lower, maturity=cap(2))
    df = _step(df, (F.col("sufficiency") == "full") & (F.size("gaps") > 0), "full with gaps", sufficiency=F.lit("partial"))
    df = _step(df, F.col("sufficiency").isin("partial", "none") & (F.size("gaps") == 0), "no gaps named", gaps=F.array(F.lit("(no gaps named)")), maturity=cap(2))
    gapped = lambda a: F.exists("gaps", lambda g: (_bare(g) == _bare(a)) | (_bare(g).contains(_bare(a)) & (F.length(_bare(g)) - F.length(_bare(a)) <= 24) & _bare(g).rlike(ABSENCE)))
    df = _step(df, (F.col("sufficiency") == "partial") & (F.size("artefacts") > 0) & F.forall("artefacts", gapped), "every artefact is a gap", sufficiency=F.lit("none"), excerpt=F.lit(""))
    df = _step(df, (F.col("sufficiency") == "partial") & (F.col("excerpt") == ""), "partial without an excerpt", sufficiency=F.lit("none"))
    df = _flag(df, F.trim("evidence") == "", "no evidence supplied")
    given = F.coalesce("verdicts", F.array().cast("array<struct<element_id:string,status:string,excerpt:string>>"))
    declared = F.filter(given, lambda v: F.array_contains("elements", v["element_id"]))
    df = df.withColumn("_strays", F.size(given) - F.size(F.array_distinct(F.transform(declared, lambda v: v["element_id"]))))
    df = _flag(df, (F.size("elements") > 0) & (F.col("_strays") > 0), "verdicts on undeclared elements")

    def settled(e: Column) -> Column:
        v = F.element_at(F.filter(F.concat(F.array(F.struct(e.alias("element_id"), F.lit("unset").alias("status"), F.lit("").alias("excerpt"))), declared), lambda v: v["element_id"] == e), -1)
        unproved = (v["status"] == "met") & ((F.coalesce(v["excerpt"], F.lit("")) == "") | ~F.col("_plain").contains(E.plain(v["excerpt"])))
        return F.struct(e.alias("element_id"), F.when(unproved, "not_evidenced").otherwise(v["status"]).alias("status"), F.when(unproved, "").otherwise(F.coalesce(v["excerpt"], F.lit(""))).alias("excerpt"))

    df = df.withColumn("verdicts", F.transform("elements", settled))
    lacking = F.filter("verdicts", lambda v: v["status"] == "not_evidenced")
    decided = F.filter("verdicts", lambda v: ~v["status"].isin("unset", "not_applicable"))
    df = _step(df, (F.size(decided) > 0) & (F.size(decided) == F.size(lacking)) & (F.col("sufficiency") != "none"), "no element evidenced", sufficiency=F.lit("none"))
    df = _step(df, (F.col("sufficiency") == "full") & (F.size(lacking) > 0), "full with an element not evidenced", sufficiency=F.lit("partial"))
    df = _step(df, (F.col("sufficiency") == "none") & (F.col("maturity") > 1), "maturity above none's ceiling", maturity=cap(1))
    df = _step(df, (F.col("sufficiency") == "partial") & (F.col("maturity") > 3), "maturity above partial's ceiling", maturity=cap(3))
    return df.drop("_plain", "_strays")


def findings(proposals: DataFrame) -> DataFrame:
    """Proposals with findings (array of check, ok), status and downgraded_to.

    Columns: id, sufficiency, source, cites (array of chunk_id, text), gaps, chunks (map of evidence by
    id), expected, step, decided (array of steps decided and not rejected). With a column gate_ok (null:
    the gate's check was asked for but did not run), there is a finding of it, but for operating tests.
    """
    rating, none = F.col("sufficiency"), F.array().cast("array<string>")
    gaps = F.filter(F.coalesce("gaps", none), lambda g: F.trim(g) != "")
    cites = F.coalesce("cites", F.array().cast("array<struct<chunk_id:string,text:string>>"))
    lane_b = F.coalesce(F.col("source") == "lane_b", F.lit(False))
    pool = lambda c: F.when(F.map_contains_key("chunks", c["chunk_id"]), F.array(F.try_element_at("chunks", c["chunk_id"]))).otherwise(F.map_values("chunks"))
    verbatim = F.forall(cites, lambda c: (E.plain(c["text"]) != "") & F.exists(pool(c), lambda p: E.plain(p).contains(E.plain(c["text"]))))
    said = F.array_join(F.transform(cites, lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    wanted = F.lower(F.coalesce("expected", F.lit("")))
    unmet = reduce(lambda rest, r: F.when(wanted.contains(r[0]) & ~said.rlike("(?i)" + r[1]), F.lit(r[2])).otherwise(rest), reversed(EXPECTED), F.lit(None).cast("string"))
    needs = reduce(lambda rest, x: F.when(F.col("step") == x[0], F.array(*map(F.lit, x[1]))).otherwise(rest), PREREQUISITES.items(), none)
    undone = F.size(F.array_except(needs, F.coalesce("decided", none))) > 0
    instructed = F.exists(F.map_values("chunks"), lambda p: p.rlike(INJECTION))
    full_gaps = (rating == "full") & (F.size(gaps) > 0)
    checks = [
        ("cite_exists", lane_b | verbatim),
        ("rating_vs_gaps", ~(full_gaps | (~lane_b & (rating == "none") & (F.size(cites) > 0) & (F.size(gaps) == 0)))),
        ("cites_required", lane_b | (rating == "none") | (F.size(cites) > 0)),
        ("expected_output", lane_b | ~rating.isin("full", "partial") | (F.size(cites) == 0) | unmet.isNull()),
        ("cross_step", ~((rating == "full") & undone)),
        ("injection", lane_b | ~instructed),
    ]
    checks = [(n, F.coalesce(ok, F.lit(True))) for n, ok in checks]
    if "gate_ok" in proposals.columns:
        checks.append(("gate", lane_b | F.coalesce("gate_ok", F.lit(False))))
    listed = F.array(*(F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in checks))
    df = proposals.withColumn("findings", listed)
    failed = F.exists("findings", lambda f: ~f["ok"])
    down = F.when(rating == "full", "partial").when((rating == "partial") & ~lane_b, "none")
    return df.withColumn("status", F.when(failed, "needs_review").otherwise("ok")).withColumn("downgraded_to", F.when(failed, down))


def from_tests(tests: DataFrame) -> DataFrame:
    """step, sufficiency, gaps from operating tests (step, control_id, machine_verdict, disposition): a signature goes before the machine's verdict."""
    signed = F.lower(F.coalesce("disposition", F.lit("")))
    verdict = F.when(signed.isin("accepted", "accept", "pass", "exception", "exception_raised"), "PASS").when(signed.isin("rejected", "fail", "reject_machine_verdict"), "FAIL").otherwise(F.coalesce("machine_verdict", F.lit("NOT_TESTABLE")))
    rows = tests.withColumn("_v", verdict)
    counts = rows.groupBy("step").agg(F.count("*").alias("tests"), F.count_if(F.col("_v") == "FAIL").alias("f"), F.count_if(F.col("_v") == "PASS").alias("p"), F.array_sort(F.collect_list(F.when(F.col("_v") != "PASS", F.concat_ws(" ", "control_id", "_v")))).alias("gaps"))
    return counts.select("step", "tests", F.when(F.col("f") > 0, "none").when(F.col("p") == F.col("tests"), "full").otherwise("partial").alias("sufficiency"), "gaps")
