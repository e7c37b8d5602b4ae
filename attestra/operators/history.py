"""State and history: latest per key, streaks, gated progress, roll-ups, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators.text import reason_error


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so that no group is sorted or held."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def fail_streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """key, streak (failures since the last success), n, warn (three or more)."""
    marked = rows.withColumn("_o", F.struct(*order)).withColumn("_f", failed)
    last_ok = marked.groupBy(key).agg(F.max(F.when(~F.col("_f"), F.col("_o"))).alias("_ok"), F.count("*").alias("n"))
    since = marked.join(last_ok, key).groupBy(key).agg(F.first("n").alias("n"), F.count_if(F.col("_f") & (F.col("_ok").isNull() | (F.col("_o") > F.col("_ok")))).alias("streak"))
    return since.withColumn("warn", F.col("streak") >= 3)


def gate_progress(steps: DataFrame, group: list[str], play: str) -> DataFrame:
    """Status of each play from its steps (decision null, accept, amend or reject): locked behind any that hasn't passed."""
    d = F.col("decision")
    counts = steps.groupBy(*group, play).agg(F.count("*").alias("steps"), F.count(d).alias("decided"), F.count_if(d == "reject").alias("rejected"))
    status = F.when(F.col("decided") == 0, "not_started").when(F.col("rejected") > 0, "gate_failed").when(F.col("decided") == F.col("steps"), "gate_passed").otherwise("in_progress")
    rows = counts.withColumn("open_status", status)
    before = Window.partitionBy(*group).orderBy(play).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.min((F.col("open_status") == "gate_passed").cast("int")).over(before)
    return rows.withColumn("status", F.when(F.coalesce(passed, F.lit(1)) == 0, "locked").otherwise(F.col("open_status"))).drop("open_status")


def readiness(controls: DataFrame, by: list[str]) -> DataFrame:
    """Counts of ratings and the mean maturity, rounded half to even."""
    n = lambda w: F.count_if(F.col("sufficiency") == w).alias(w)
    return controls.groupBy(*by).agg(F.count("*").alias("controls"), F.count("sufficiency").alias("assessed"), n("full"), n("partial"), n("none"), E.half_even(F.avg("maturity"), 1).alias("avg_maturity"))


def gaps(controls: DataFrame) -> DataFrame:
    """Controls that aren't full, with status, priority and reviewed: errors that nobody has decided 0, none 0, without a proposal 1, others 2.

    Columns: sufficiency (the proposal's), error, and, if there are decisions, decided (the reviewer's rating, which goes before both).
    """
    decided = F.col("decided") if "decided" in controls.columns else F.lit(None).cast("string")
    failed = F.coalesce("error", F.lit(False)) & decided.isNull()
    rating = F.coalesce(decided, F.col("sufficiency"))
    priority = F.when(failed | F.coalesce(rating == "none", F.lit(False)), 0).when(F.col("sufficiency").isNull(), 1).otherwise(2)
    status = F.when(failed, "error").otherwise(F.coalesce(rating, F.lit("not assessed")))
    rows = controls.withColumns({"status": status, "priority": priority, "reviewed": decided.isNotNull()})
    return rows.where((F.col("status") == "error") | (F.col("status") != "full"))


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Verdict counts, and results other than PASS without a signature."""
    v = F.col("verdict")
    return results.groupBy(*by).agg(F.count_if(v == "PASS").alias("passed"), F.count_if(v == "FAIL").alias("failed"), F.count_if(v == "NOT_TESTABLE").alias("not_testable"), F.count_if((v != "PASS") & F.col("signed").isNull()).alias("unsigned"))


def open_items(results: DataFrame, run: str = "run_at") -> DataFrame:
    newest = results.agg(F.max(run).alias("_m"))
    return results.join(F.broadcast(newest), F.col(run) == F.col("_m")).drop("_m").where("verdict <> 'PASS' AND signed IS NULL")


def calibration(decisions: DataFrame, by: str = "play") -> DataFrame:
    """For each play and, with a null play, for all: decisions that agree with the proposal, rate it lower (over) or not (under); blind readings, those that agree with the proposal, and those of records that supersede another.

    decisions: play, decision, proposal, final, blind, source, supersedes. Decisions without a proposal and
    those on proposals of operating tests don't count. Unknown words rank as partial, but a blind
    reading agrees only with the very word of the proposal.
    """
    rows = decisions.where(F.col("proposal").isNotNull() & ~F.coalesce(F.col("source") == "lane_b", F.lit(False)))
    p, f = (E.rank_of(F.coalesce(c, F.lit("")), E.RATING_RANK, 1) for c in ("proposal", "final"))
    accept = F.coalesce(F.col("decision") == "accept", F.lit(False))
    has = F.col("blind").isNotNull()
    return rows.rollup(by).agg(
        F.count("*").alias("decisions"),
        F.count_if(accept).alias("agree"),
        F.count_if(~accept & (p > f)).alias("over"),
        F.count_if(~accept & (p <= f)).alias("under"),
        F.count_if(has).alias("blind"),
        F.count_if(has & (F.col("blind") == F.col("proposal"))).alias("blind_agree"),
        F.count_if(has & F.col("supersedes").isNotNull()).alias("moved"),
    )


#: Names that are no person's. Fixed values.
NOBODY = ["", "system", "assessor", "judge", "runner", "n/a", "none"]


def decision_quality(decisions: DataFrame) -> DataFrame:
    """use_case, step: how many decisions give reasons, were blind, were on tests' proposals (lane_b) and stamped those without reason or blind reading, by whom; functionally_oaid if there is no reason and no blind reading at all."""
    lane_b = F.coalesce(F.col("source") == "lane_b", F.lit(False))
    decision = F.trim(F.coalesce("decision", F.lit("")))
    rows = decisions.withColumns({"_hollow": reason_error(F.col("reason"), decision).isNotNull(), "_lane_b": lane_b})
    stamped = F.col("_lane_b") & (decision == "accept") & F.col("_hollow") & F.col("blind").isNull()
    person = F.when(~F.lower(F.trim(F.coalesce("reviewer", F.lit("")))).isin(NOBODY), F.trim("reviewer"))
    rows = rows.groupBy("use_case", "step").agg(F.count("*").alias("n"), F.count_if(~F.col("_hollow")).alias("substantive"), F.count_if("_hollow").alias("hollow"), F.count("blind").alias("blind"), F.count_if("_lane_b").alias("lane_b"), F.count_if(stamped).alias("rubber_stamps"), F.count(person).alias("named"), F.array_sort(F.collect_set(person)).alias("reviewers"))
    return rows.withColumn("functionally_oaid", (F.col("substantive") == 0) & (F.col("blind") == 0))


def distribution(labels: DataFrame, levels: list[str], least: int, most: float = 0.6) -> DataFrame:
    """One row: the count of each level, and whether all have enough and none too large a share."""
    row = labels.agg(*(F.count_if(F.col("label") == x).alias(x) for x in levels), F.count("*").alias("total"))
    enough = F.least(*(F.col(x) for x in levels)) >= least
    return row.withColumn("ready", enough & (F.greatest(*(F.col(x) for x in levels)) <= most * F.col("total")))


def lifecycle(steps: DataFrame, tests: DataFrame, bridge: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each play: its steps, operating tests by verdict, controls by decision; flagged if a design is rated full while a test fails.

    steps: play, step; tests: step, verdict; bridge: play, control_id; decisions: control_id, sufficiency.
    """
    operating = steps.join(tests, "step", "left").groupBy("play").agg(F.count_distinct("step").alias("steps"), F.count("verdict").alias("tests"), F.count_if(F.col("verdict") == "PASS").alias("op_pass"), F.count_if(F.col("verdict") == "FAIL").alias("op_fail"), F.count_if(F.col("verdict") == "NOT_TESTABLE").alias("op_unknown"))
    design = bridge.join(decisions, "control_id", "left").groupBy("play").agg(F.count("control_id").alias("controls"), *(F.count_if(F.col("sufficiency") == w).alias(f"design_{w}") for w in ("full", "partial", "none")))
    rows = operating.join(design, "play", "left")
    return rows.withColumn("flag", F.coalesce((F.col("design_full") > 0) & (F.col("op_fail") > 0), F.lit(False)))


def due(tracker: DataFrame, as_of: str) -> DataFrame:
    """Rows never run, with an unreadable date, or older than their limit."""
    when = E.moment(tracker, "last_run")
    return tracker.where(when.isNull() | F.coalesce(E.floor_days(E.at(as_of), when) > F.col("max_days").try_cast("int"), F.lit(False)))


def next_step(steps: DataFrame, keys: list[str]) -> DataFrame:
    return steps.groupBy(*keys).agg(F.min(F.when(~F.col("done"), F.col("ordinal"))).alias("next_ordinal"))
