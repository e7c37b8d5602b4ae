"""Stored bundles of results as rows: their digests, whether they are as they were, and signatures on them.

A bundle's digest is the sha256 of its canonical JSON without the digest and without human verdicts: keys in order,
`, ` and `: ` between, ASCII alone. Here that text is an expression, so that any number of bundles is
verified in one narrow pass, and nothing is collected. A bundle holds a result for each control.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators.integrity import issues

#: What doesn't enter a digest; what a signature may say. Fixed values.
LEFT_OUT, HUMAN = "sha256", "human_verdict"
DISPOSITIONS = ["ACCEPT", "EXCEPTION_RAISED", "ESCALATE", "REJECT_MACHINE_VERDICT"]
#: Characters that JSON writes with a letter. Fixed values.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escaped(x: Column) -> Column:
    """One character as ASCII JSON writes it; beyond 16 bits, two surrogates."""
    code = F.ascii(x)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    far = code - 0x10000
    pair = F.concat(unit(F.shiftright(far, 10) + 0xD800), unit(far.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(code >= 0x10000, pair).when((code > 126) | (code < 32), unit(code)).otherwise(x)
    for plain, written in ESCAPES.items():
        out = F.when(x == F.lit(plain), F.lit(written)).otherwise(out)
    return out


def quoted(c: Column) -> Column:
    """A string as JSON; most are printable ASCII and stay as they are."""
    rest = F.array_join(F.transform(F.split(c, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"^[ !#-\[\]-~]*$"), c).otherwise(rest), F.lit('"'))


def canonical(c: Column, kind: T.DataType, left_out: frozenset[str] = frozenset()) -> Column:
    """A value as canonical JSON. Floating point isn't taken: its text differs between writers."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}": '), canonical(c[f.name], f.dataType, left_out)) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in left_out]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType, left_out)), ", "), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, T.IntegralType):
        text = c.cast("string")
    elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = quoted(c.cast("string"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.coalesce(text, F.lit("null"))


def digest(bundles: DataFrame) -> Column:
    """The digest of each row of bundles, as runner.bundle() makes it; results: an array of structs in order of control_id."""
    columns = [f for f in bundles.schema.fields if f.name != LEFT_OUT]
    whole = F.struct(*(F.col(f.name) for f in columns))
    return F.sha2(canonical(whole, T.StructType(columns), frozenset({HUMAN})), 256)


def verified(bundles: DataFrame) -> DataFrame:
    """bundles with intact: whether each is what its stored digest (sha256) says."""
    return bundles.withColumn("intact", F.coalesce(F.col(LEFT_OUT) == digest(bundles), F.lit(False)))


def summarised(bundles: DataFrame) -> DataFrame:
    """bundle_id, run_at, controls, passed, failed, not_testable, unsigned (other than PASS, without a human verdict), intact."""
    n = lambda f: F.size(F.filter("results", f)).cast("long")
    of = lambda verdict: n(lambda r: r["verdict"] == verdict)
    human = HUMAN in bundles.schema["results"].dataType.elementType.names
    open_ = n(lambda r: (r["verdict"] != "PASS") & (r[HUMAN].isNull() if human else F.lit(True)))
    return verified(bundles).select("bundle_id", "run_at", F.size("results").cast("long").alias("controls"), of("PASS").alias("passed"), of("FAIL").alias("failed"), of("NOT_TESTABLE").alias("not_testable"), open_.alias("unsigned"), "intact")


def refused(entries: DataFrame, bundles: DataFrame) -> DataFrame:
    """entries with refusals: why each can't count.

    entries: bundle_id, control_id, at, reviewer, disposition, withdrawn; an append-only register of signatures
    and of their withdrawals. Joined by bundle, and by (bundle, control) with the results that are there.
    """
    state = verified(bundles).select("bundle_id", "intact")
    there = bundles.select("bundle_id", F.explode("results.control_id").alias("control_id")).distinct().withColumn("_there", F.lit(True))
    rows = entries.join(state, "bundle_id", "left").join(there, ["bundle_id", "control_id"], "left")
    signs = ~F.coalesce("withdrawn", F.lit(False))
    rules = [
        ("unknown bundle", F.col("intact").isNull()),
        ("changed bundle", signs & ~F.col("intact")),
        ("unknown control", F.col("intact").isNotNull() & F.col("_there").isNull()),
        ("no reviewer", signs & (F.trim(F.coalesce("reviewer", F.lit(""))) == "")),
        ("unknown disposition", signs & ~F.coalesce(F.col("disposition").isin(DISPOSITIONS), F.lit(False))),
    ]
    return issues(rows, rules).withColumnRenamed("issues", "refusals").drop("intact", "_there")


def signed(bundles: DataFrame, entries: DataFrame) -> DataFrame:
    """bundle_id, control_id, verdict, reviewer, disposition, signed_at of each result: the last entry that counts, unless it withdraws."""
    results = bundles.select("bundle_id", F.explode("results").alias("r")).select("bundle_id", "r.control_id", "r.verdict")
    counted = refused(entries, bundles).where("size(refusals) = 0")
    last = counted.groupBy("bundle_id", "control_id").agg(F.max_by(F.struct(F.trim("reviewer").alias("reviewer"), "disposition", F.col("at").alias("signed_at"), F.coalesce("withdrawn", F.lit(False)).alias("withdrawn")), "at").alias("s"))
    stands = last.where("NOT s.withdrawn").select("bundle_id", "control_id", "s.reviewer", "s.disposition", "s.signed_at")
    return results.join(stands, ["bundle_id", "control_id"], "left")


def assessment_ids(parts: DataFrame) -> DataFrame:
    """run, n_parts, assessment_id: the sha256 of what a run was made with.

    parts: run, part (a name), value (its version or digest; null where it was absent). Order doesn't matter.
    """
    line = F.concat(quoted(F.col("part")), F.lit(": "), F.when(F.col("value").isNull(), "null").otherwise(quoted(F.col("value"))))
    rows = parts.select("run", line.alias("line")).distinct()
    return rows.groupBy("run").agg(F.count("*").alias("n_parts"), F.sha2(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("line")), ", "), F.lit("}")), 256).alias("assessment_id"))


def draft_changes(live: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, added, removed, changed, controls of drafts of requirements against the live ones.

    live: control_id, text; drafts: draft_id, control_id, text, all that each draft says.
    """
    base = live.select("control_id", F.col("text").alias("_live"))
    said = drafts.select("draft_id", "control_id", "text").join(base, "control_id", "left")
    counts = said.groupBy("draft_id").agg(F.count_if(F.col("_live").isNull()).alias("added"), F.count_if(F.col("_live") != F.col("text")).alias("changed"), F.count("*").alias("controls"))
    # what a draft leaves out is what is live and not in it: counted, never listed for each draft
    return counts.crossJoin(F.broadcast(base.agg(F.count("*").alias("_n")))).select("draft_id", "added", (F.col("_n") - (F.col("controls") - F.col("added"))).alias("removed"), "changed", "controls")  # one row


def promotable(drafts: DataFrame, changes: DataFrame, approvals: DataFrame) -> DataFrame:
    """draft_id, problems, promoted: drafts that say where they come from, have controls, and are approved by name and ticket.

    drafts: draft_id, status, source_title, source_reference, base_version; approvals: draft_id, approved_by, ticket.
    """
    one = approvals.groupBy("draft_id").agg(F.max_by(F.struct("approved_by", "ticket"), F.struct("approved_by", "ticket")).alias("a"))
    rows = drafts.join(changes.select("draft_id", "controls"), "draft_id", "left").join(one, "draft_id", "left")
    lacks = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [("not a draft", ~F.coalesce(F.col("status") == "draft", F.lit(False))), *((f"no {c}", lacks(c)) for c in ("source_title", "source_reference", "base_version")), ("no controls", F.coalesce("controls", F.lit(0)) == 0), ("no approver", lacks("a.approved_by")), ("no ticket", lacks("a.ticket"))]
    return issues(rows, rules).select("draft_id", F.col("issues").alias("problems"), (F.size("issues") == 0).alias("promoted"))
