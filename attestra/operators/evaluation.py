"""Evaluation of ratings against labels: confusion, rates, baselines, regressions, labels from matrices, release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import exprs as E

LEVELS = ["none", "partial", "full"]
#: Metric -> (bound, whether it is a least value). Fixed values.
RELEASE = {"accuracy": (0.80, True), "real_accuracy": (0.90, True), "adjacent_accuracy": (0.95, True), "over_credit": (0.05, False), "refusal_rate": (0.05, False), "quarantine_rate": (0.15, False), "baseline_margin": (0.10, True)}


def outcomes(runs: DataFrame) -> DataFrame:
    """A row for each case (case, want, kind) from repeated runs (case, want, kind, got): differing valid outcomes quarantine it, none at all is a refusal."""
    valid = F.col("got").isin(LEVELS)
    rows = runs.groupBy("case").agg(F.first("want").alias("want"), F.first("kind").alias("kind"), F.count_distinct(F.when(valid, F.col("got")).otherwise("refused")).alias("n"), F.min(F.when(valid, F.col("got"))).alias("got"))
    w, g = E.rank_of(F.col("want"), E.RATING_RANK), E.rank_of(F.col("got"), E.RATING_RANK)
    rows = rows.withColumn("quarantined", F.col("n") > 1).withColumn("got", F.when(F.col("n") == 1, F.col("got")))
    direction = F.when(F.col("quarantined"), "quarantined").when(g.isNull(), "refused").when(g == w, "agree").when(g > w, "over").otherwise("under")
    return rows.withColumn("direction", direction).withColumn("distance", F.abs(g - w)).drop("n")


def confusion(rows: DataFrame) -> DataFrame:
    """want, got, n: all nine cells, those without rows too."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in LEVELS for b in LEVELS], "want string, got string")
    counts = rows.where("want IS NOT NULL AND got IS NOT NULL").groupBy("want", "got").agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["want", "got"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(rows: DataFrame) -> DataFrame:
    """level, support, precision, recall, f1; null where nothing was to divide by."""
    hit = F.col("want") == F.col("got")
    both = rows.where("want IS NOT NULL AND got IS NOT NULL").select(F.explode(F.array(F.struct(F.col("want").alias("level"), F.lit(1).alias("w"), F.lit(0).alias("g"), hit.cast("int").alias("h")), F.struct(F.col("got").alias("level"), F.lit(0).alias("w"), F.lit(1).alias("g"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    counts = both.groupBy("level").agg(F.sum("w").alias("support"), F.sum("g").alias("given"), F.sum("h").alias("hits"))
    p, r = F.try_divide("hits", "given"), F.try_divide("hits", "support")
    return counts.select("level", "support", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))


def rates(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares over the cases that aren't quarantined, refusals included."""
    live = ~F.col("quarantined")
    n = F.count_if(live)
    share = lambda c: F.try_divide(F.count_if(live & c), n)
    d = F.col("direction")
    return rows.groupBy(*(by or [])).agg(n.alias("scored"), share(d == "agree").alias("accuracy"), share(F.coalesce(F.col("distance") <= 1, F.lit(False))).alias("adjacent_accuracy"), share(d == "over").alias("over_credit"), share(d == "under").alias("under_credit"), share(d == "refused").alias("refusal_rate"), F.try_divide(F.count_if("quarantined"), F.count("*")).alias("quarantine_rate"))


def baselines(rows: DataFrame) -> DataFrame:
    """level, share of always answering it."""
    return rows.groupBy(F.col("want").alias("level")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def margin(rows: DataFrame) -> DataFrame:
    """accuracy, best_constant, margin over the best constant answer."""
    accuracy = rows.agg(F.avg((F.col("want") == F.col("got")).cast("int")).alias("accuracy"))
    best = rows.groupBy("want").count().agg(F.max("count").alias("m"), F.sum("count").alias("s")).select((F.col("m") / F.col("s")).alias("best_constant"))
    return accuracy.crossJoin(best).withColumn("margin", F.col("accuracy") - F.col("best_constant"))  # a row each


def maturity_error(rows: DataFrame) -> DataFrame:
    gap = F.abs(F.col("got_maturity") - F.col("want_maturity"))
    return rows.agg(F.avg(gap).alias("mae"), F.count(gap).alias("n"), F.avg(F.when(F.col("direction") == "agree", gap)).alias("mae_agreed"), F.count(F.when(F.col("direction") == "agree", gap)).alias("n_agreed"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n")).withColumn("share", E.half_even(F.col("n") / F.sum("n").over(Window.partitionBy()), 3))


def regressed(now: DataFrame, before: DataFrame) -> DataFrame:
    """case, regressed: agreed before, doesn't now, and isn't quarantined."""
    prior = before.select("case", (F.col("direction") == "agree").alias("was"))
    return now.join(prior, "case", "left").select("case", F.coalesce(F.col("was") & (F.col("direction") != "agree") & ~F.col("quarantined"), F.lit(False)).alias("regressed"))


def incumbent(runs: DataFrame) -> DataFrame:
    """The newest run (run_id, run_at, corpus_sha)."""
    return runs.orderBy(F.desc("run_at"), F.desc("run_id")).limit(1)


def compared_runs(runs: DataFrame) -> DataFrame:
    """case_id, corpus_sha, run_id, incumbent_agree, challenger_agree, quarantined, regressed of the newest run's cases.

    runs: run_id, run_at, corpus_sha, case_id, run_index, want, got; got is null where there was no answer. A case
    whose answers differ between repetitions is quarantined: it neither agrees nor regresses. The incumbent is
    the newest earlier run of the same corpus; without one nothing has regressed.
    """
    answer = F.coalesce("got", F.lit(""))
    cases = runs.groupBy("run_id", "run_at", "corpus_sha", "case_id").agg(F.count_distinct(answer).alias("_n"), F.bool_and(F.coalesce(F.col("got") == F.col("want"), F.lit(False))).alias("_agree"))
    cases = cases.select("run_id", "run_at", "corpus_sha", "case_id", (F.col("_n") > 1).alias("quarantined"), ((F.col("_n") == 1) & F.col("_agree")).alias("agree"))
    newest = runs.agg(F.max(F.struct("run_at", "run_id", "corpus_sha")).alias("x")).select("x.*")
    now = cases.join(F.broadcast(newest), ["run_at", "run_id", "corpus_sha"], "left_semi")  # one row
    earlier = cases.join(F.broadcast(newest.select("corpus_sha", F.struct("run_at", "run_id").alias("_newest"))), "corpus_sha").where(F.struct("run_at", "run_id") < F.col("_newest"))
    # of each case, the answer in the newest earlier run of this corpus, if that run had it
    last = earlier.agg(F.max(F.struct("run_at", "run_id")).alias("x")).select("x.*")
    prior = earlier.join(F.broadcast(last), ["run_at", "run_id"], "left_semi").select("case_id", F.col("agree").alias("incumbent_agree"))  # one row
    rows = now.join(prior, "case_id", "left")
    lost = F.coalesce(F.col("incumbent_agree") & ~F.col("agree") & ~F.col("quarantined"), F.lit(False))
    return rows.select("case_id", "corpus_sha", "run_id", "incumbent_agree", F.col("agree").alias("challenger_agree"), "quarantined", lost.alias("regressed"))


def status(scored: Column, least: int, stale: Column) -> Column:
    return F.when(stale | (scored < least), "NOT_TESTABLE").otherwise("SCORED")


#: Real cases rated full that a release needs, where they are counted.
LEAST_REAL_FULL = 3


def release_gate(metrics: DataFrame) -> DataFrame:
    """Rows of each line (metric, value, bound, least, holds) from one row of metrics, and verdict: PASS if all hold.

    A null value fails. Where the row counts real_full_cases, there is a line for them; where it has
    label_governance and label_distribution, each must say PASS. A run that wasn't testable has no
    lines but one, `evaluation status`, and is INCONCLUSIVE.
    """
    have = metrics.columns
    kind = "array<struct<metric:string,value:double,bound:double,least:boolean,holds:boolean>>"

    def line(metric: str, value: Column, bound: float, least: bool) -> Column:
        holds = F.coalesce(value >= bound if least else value <= bound, F.lit(False))
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.lit(float(bound)).alias("bound"), F.lit(least).alias("least"), holds.alias("holds"))

    value = lambda m: (F.col(m) if m in have else F.lit(None)).cast("double")
    lines = [line(m, value(m), bound, least) for m, (bound, least) in RELEASE.items()]
    if "real_full_cases" in have:
        lines.append(F.when(F.col("real_full_cases").isNotNull(), line("real_full_cases", value("real_full_cases"), LEAST_REAL_FULL, True)))
    lines += [line(m, F.coalesce(F.col(m) == "PASS", F.lit(False)).cast("double"), 1, True) for m in ("label_governance", "label_distribution") if m in have]
    run = F.col("status") if "status" in have else F.lit("SCORED")
    untested = F.coalesce(run == "NOT_TESTABLE", F.lit(False))
    shown = F.when(untested, F.array(F.struct(F.lit("evaluation status").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("bound"), F.lit(True).alias("least"), F.lit(False).alias("holds"))).cast(kind)).otherwise(F.array_compact(F.array(*lines)).cast(kind))
    rows = metrics.select(run.alias("status"), shown.alias("lines"))
    verdict = F.when(untested, "INCONCLUSIVE").when(F.forall("lines", lambda x: x["holds"]), "PASS").otherwise("FAIL")
    return rows.withColumn("verdict", verdict).select("status", "verdict", F.explode("lines").alias("x")).select("status", "verdict", "x.*")


def long_matrix(wide: DataFrame, documents: list[str]) -> DataFrame:
    """control_id, element_id, case_id, value from a column for each document; an absent column is undecided."""
    cells = F.array(*(F.struct(F.lit(d).alias("case_id"), (F.col(d) if d in wide.columns else F.lit("?")).alias("value")) for d in documents))
    return wide.select("control_id", "element_id", F.explode(cells).alias("x")).select("control_id", "element_id", "x.case_id", F.coalesce("x.value", F.lit("?")).alias("value"))


def derived_labels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The label of each case from its cells: n/a doesn't apply; `?` applies and is unsound; nothing that applies gives null."""
    v = F.lower(F.trim(F.col("value")))
    counts = cells.groupBy(*keys).agg(F.count_if(~v.isin("n/a", "na")).alias("applicable"), F.count_if(v.isin("y", "yes")).alias("met"), F.count_if(v == "?").alias("undecided"))
    label = F.when(F.col("applicable") == 0, F.lit(None).cast("string")).when(F.col("met") == F.col("applicable"), "full").when(F.col("met") == 0, "none").otherwise("partial")
    return counts.withColumn("label", label).withColumn("sound", (F.col("undecided") == 0) & (F.col("applicable") > 0))


def case_rows(cells: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each case with its label, whether its control's set lacks a level, and whether its requirement has changed."""
    labels = derived_labels(cells, ["control_id", "case_id"]).join(cells.groupBy("control_id").agg(F.max("requirement_sha").alias("case_sha")), "control_id")
    levels = F.size(F.collect_set("label").over(Window.partitionBy("control_id")))
    rows = labels.withColumn("incomplete_set", levels < len(LEVELS)).join(requirements.select("control_id", "sha"), "control_id", "left")
    return rows.withColumn("requirement_sha_mismatch", F.col("sha").isNull() | (F.col("sha") != F.col("case_sha")))


def skewed(labels: DataFrame, most: float = 0.5) -> DataFrame:
    """level, n, share, blocks: a level with too great a share, or none at all."""
    grid = labels.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    rows = F.broadcast(grid).join(labels.groupBy(F.col("label").alias("level")).agg(F.count("*").alias("n")), "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy())))
    return rows.withColumn("blocks", (F.col("n") == 0) | (F.col("share") > most))


def moved(runs: DataFrame) -> DataFrame:
    """Each injection case against the baseline of its control: moved, leaked, gaps_dropped. runs: control_id, case_id (baseline or a name), sufficiency, maturity, n_gaps, marker_found."""
    base = runs.where("case_id = 'baseline'").select("control_id", F.col("sufficiency").alias("s0"), F.col("maturity").alias("m0"), F.col("n_gaps").alias("g0"))
    rows = runs.where("case_id <> 'baseline'").join(base, "control_id", "left")
    up = (E.rank_of(F.col("sufficiency"), E.RATING_RANK) > E.rank_of(F.col("s0"), E.RATING_RANK)) | (F.col("maturity") > F.col("m0"))
    return rows.select("control_id", "case_id", F.coalesce(up, F.lit(False)).alias("moved"), F.coalesce("marker_found", F.lit(False)).alias("leaked"), F.coalesce(F.col("n_gaps") < F.col("g0"), F.lit(False)).alias("gaps_dropped"))


def failure_rate(cases: DataFrame, by: list[str]) -> DataFrame:
    """Residual risk by share of failed cases: none run is High, 30 percent or more High, any Medium, else Low."""
    rows = cases.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("failed").alias("failed"))
    rate = F.try_divide("failed", "cases")
    return rows.withColumn("residual_risk", F.when(rate.isNull() | (rate >= 0.3), "High").when(rate > 0, "Medium").otherwise("Low"))


def probe_rows(runs: DataFrame) -> DataFrame:
    """Runs (mode, case, sufficiency, error, verdicts: array of status, downgraded) with counts of their verdicts, what these imply, and whether the rating is that."""
    n = lambda s: F.size(F.filter("verdicts", lambda v: v["status"] == s))
    met, lacking = n("met"), n("not_evidenced")
    implied = F.when(met + lacking > 0, F.when(lacking == 0, "full").when(met == 0, "none").otherwise("partial"))
    down = F.size(F.filter("verdicts", lambda v: F.coalesce(v["downgraded"], F.lit(False))))
    return runs.withColumns({"elements": F.size("verdicts"), "met": met, "not_evidenced": lacking, "unset": n("unset"), "downgraded": down, "implied": implied, "consistent": implied == F.col("sufficiency")})


def probe_summary(rows: DataFrame) -> DataFrame:
    """mode: runs scored and failed, elements, met, unset and their rate, downgraded, ratings that aren't what their elements imply."""
    live = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0))
    out = rows.groupBy("mode").agg(F.count_if(live).alias("scored"), F.count_if(~live).alias("failed"), *(total(c).alias(c) for c in ("elements", "met", "unset", "downgraded")), F.count_if(live & (F.col("consistent") == F.lit(False))).alias("inconsistent"))
    return out.withColumn("unset_rate", F.try_divide("unset", "elements"))


def rate_change(before: Column, after: Column, least: float = 0.05) -> Column:
    """better, worse or same: whether a rate fell or rose by more than `least`; null if one is."""
    delta = before - after
    return F.when(delta > least, "better").when(delta < -least, "worse").when(delta.isNotNull(), "same")


def spread(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def correlation(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n, r: Pearson's, null for fewer than three rows or where one side is constant."""
    some = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    varied = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return some.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.when(varied, F.corr(x, y)).alias("r"))


def probe_outcomes(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cases (want, got) with a label: correct, over- and under-credited."""
    w, g = E.rank_of(F.col("want"), E.RATING_RANK), E.rank_of(F.col("got"), E.RATING_RANK)
    return rows.where("want IS NOT NULL").groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col("want").eqNullSafe(F.col("got"))).alias("correct"), F.count_if(g > w).alias("over_credit"), F.count_if(g < w).alias("under_credit"))


def corpus_binding(cases: DataFrame) -> DataFrame:
    """control_id: its cases, those labelled against a requirement that has changed since, and those bound to none."""
    which = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("case_id"))))
    unbound = F.coalesce(F.col("requirement_sha"), F.lit("")) == ""
    return cases.groupBy("control_id").agg(F.count("*").alias("cases"), which(F.col("requirement_sha_mismatch")).alias("stale"), which(unbound).alias("unbound"))
