"""Declarative checks over record sets: a verdict with its populations, and the offending records.

A check takes (catalog, params, as_of) and returns Checked. A source that isn't there makes it
NOT_TESTABLE; one that is there and empty is a population of zero. Each check aggregates its source
once; findings are a lazy DataFrame of the offending records, whatever their number.

Most checks say what they need as a Part: columns to add to their source's records, aggregates over them,
and the verdict as expressions over those. Parts of one source can be put into one aggregate (fused()), so
that a pack of checks reads each source once, however many ask about it. A tag keeps their columns apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.plans.catalog import Catalog

RESULT = "verdict string, detail string, examined long, in_scope long, n_findings long"


#: From a name of a total to its column.
Total = Callable[[str], Column]


@dataclass
class Part:
    """A check of one source's records, as expressions."""

    source: str
    totals: dict[str, Column]  # aggregates over the widened records
    judge: Callable[[Total], list[Column]]  # the columns of RESULT from the totals
    widen: Callable[[DataFrame], DataFrame] = lambda records: records  # adds columns, keeps the rows
    findings: Callable[[DataFrame], DataFrame] | None = None  # of the widened records


@dataclass
class Checked:
    result: DataFrame  # one row: RESULT
    findings: DataFrame | None = None
    part: Part | None = None


Check = Callable[..., Checked]
CHECKS: dict[str, Check] = {}


def check(f: Check) -> Check:
    CHECKS[f.__name__] = f
    return f


def fixed(spark: SparkSession, verdict: str, detail: str, examined: int = 0, in_scope: int = 0) -> DataFrame:
    return spark.createDataFrame([(verdict, detail, examined, in_scope, 0)], RESULT)


def _absent(catalog: Catalog, *names: str) -> Checked | None:
    gone = [n for n in names if catalog.get(n) is None]
    return Checked(fixed(catalog.spark, "NOT_TESTABLE", f"not provided: {', '.join(gone)}")) if gone else None


def _verdict(c: Total, good: Column, bad: Column, verdict: Column | None = None) -> list[Column]:
    """The columns of RESULT from totals that hold examined, in_scope and n_findings."""
    verdict = F.when(c("n_findings") > 0, "FAIL").otherwise("PASS") if verdict is None else verdict
    return [verdict.alias("verdict"), F.when(verdict == "FAIL", bad).otherwise(good).alias("detail"), *(c(n).cast("long").alias(n) for n in ("examined", "in_scope", "n_findings"))]


def _alone(catalog: Catalog, part: Part) -> Checked:
    records = part.widen(catalog.get(part.source))
    one = records.agg(*(x.alias(n) for n, x in part.totals.items()))
    return Checked(one.select(*part.judge(F.col)), part.findings(records) if part.findings else None, part)


def fused(catalog: Catalog, parts: list[tuple[Part, list[Column]]]) -> DataFrame:
    """RESULT of parts of one source, with further columns for each, from a single aggregate over its records."""
    records = catalog.get(parts[0][0].source)
    for part, _ in parts:
        records = part.widen(records)
    one = records.agg(*(x.alias(f"p{i}_{n}") for i, (part, _) in enumerate(parts) for n, x in part.totals.items()))
    rows = [F.struct(*more, *part.judge(lambda n, i=i: F.col(f"p{i}_{n}"))) for i, (part, more) in enumerate(parts)]
    return one.select(F.inline(F.array(*rows)))


def _each(catalog: Catalog, source: str, scope: Column, reason: Column, good: str, bad: str, widen: Callable[[DataFrame], DataFrame] = lambda r: r) -> Checked:
    """A check of single records: `reason` is null for those in order."""
    totals = {"examined": F.count("*"), "in_scope": F.count_if(scope), "n_findings": F.count_if(scope & reason.isNotNull())}
    judge = lambda c: _verdict(c, F.format_string(good, c("in_scope"), c("examined")), F.format_string(bad, c("n_findings"), c("in_scope")))
    found = lambda records: records.withColumn("_reason", F.when(scope, reason)).where("_reason IS NOT NULL")
    return _alone(catalog, Part(source, totals, judge, widen, found))


def _ordinal(records: DataFrame) -> Column:
    return F.col("_ordinal") if "_ordinal" in records.columns else F.monotonically_increasing_id()


def _latest(records: DataFrame, order_by: str) -> tuple[DataFrame, list[Column]]:
    """Records with their order: latest first; unreadable times are earliest; of equal times, the later in _ordinal."""
    ordered = records.withColumn("_at", E.moment(records, order_by)).withColumn("_place", _ordinal(records))
    return ordered, [F.desc_nulls_last("_at"), F.desc("_place")]


@check
def field_present(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    reason = F.lit(None).cast("string")
    for name in reversed(params["fields"]):
        reason = F.when(E.empty(E.field(r, name)), F.lit(f"missing {name}")).otherwise(reason)
    return _each(catalog, params["source"], E.matches(r, params.get("where")), reason, "%d of %d records in scope, all complete", "%d of %d in-scope records incomplete")


@check
def date_not_passed(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    when = E.moment(r, params["field"])
    cases = [(when.isNull(), "missing or unreadable date"), (when < E.at(as_of), "expired")]
    cases += [(E.empty(E.field(r, f)), f"missing {f}") for f in params.get("require_fields", [])]
    return _each(catalog, params["source"], E.matches(r, params.get("where")), E.one_of(cases), "%d of %d records in scope, all current", "%d of %d in-scope records expired or incomplete")


@check
def all_pinned(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    key = E.field_key(r, "pinned")
    loose = key.isNull() | key.isin("false", "")
    return _each(catalog, params["source"], F.lit(True), F.when(loose, "not pinned"), "%d of %d records pinned", "%d of %d records not pinned")


@check
def recency_each(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    limit = E.field(r, params["max_days_field"]).try_cast("int") if params.get("max_days_field") else F.lit(params.get("max_days")).cast("int")
    when = E.moment(r, params["field"])
    age = E.floor_days(E.at(as_of), when)
    reason = E.one_of([(limit.isNull(), "no cadence limit"), (when.isNull(), "no date"), (age > limit, F.format_string("%d days old, limit %d", age, limit))])
    return _each(catalog, params["source"], E.matches(r, params.get("where")), reason, "%d of %d records in scope, all within cadence", "%d of %d in-scope records overdue")


@check
def elapsed_within(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r, limit = catalog.get(params["source"]), int(params["max_days"])
    if params.get("mode", "most_recent") == "most_recent":
        when = E.moment(r, params["field"])
        age = lambda newest: F.greatest(F.lit(0), E.floor_days(E.at(as_of), newest))
        late = F.max(when)
        totals = {"examined": F.count("*"), "in_scope": F.count(when), "newest": late, "n_findings": F.when(age(late) > limit, 1).otherwise(0)}

        def judge(c: Total) -> list[Column]:
            none = c("newest").isNull()
            text = F.when(none, F.format_string("no readable date in %d records", c("examined"))).otherwise(F.format_string("newest of %d is %d days old", c("in_scope"), age(c("newest"))))
            return _verdict(c, text, text, F.when(none, "NOT_TESTABLE").when(c("n_findings") > 0, "FAIL").otherwise("PASS"))

        found = lambda records: records.agg(late.alias("newest")).where(age(F.col("newest")) > limit).select(F.col("newest").cast("string").alias("most_recent"))
        return _alone(catalog, Part(params["source"], totals, judge, findings=found))
    start, end = E.moment(r, params["start_field"]), E.moment(r, params["end_field"])
    took = E.floor_days(end, start)
    reason = E.one_of([(start.isNull(), "missing start"), (end.isNull() & (E.floor_days(E.at(as_of), start) > limit), "still open past limit"), (took > limit, F.format_string("took %d days", took))])
    return _each(catalog, params["source"], E.matches(r, params.get("where")), reason, "%d of %d records in scope, all within the limit", "%d of %d in-scope records over the limit")


@check
def record_count(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    """Here `where` selects findings: the population is the whole source."""
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    hit = E.matches(r, params.get("where"))
    above = lambda n: n > params["max"] if params.get("max") is not None else F.lit(False)
    below = lambda n: n < params["min"] if params.get("min") is not None else F.lit(False)
    hits = F.count_if(hit)
    totals = {"examined": F.count("*"), "in_scope": F.count("*"), "hits": hits, "n_findings": F.when(above(hits), hits).otherwise(0)}

    def judge(c: Total) -> list[Column]:
        text = F.format_string("%d of %d records matched", c("hits"), c("examined"))
        return _verdict(c, text, text, F.when(above(c("hits")) | below(c("hits")), "FAIL").otherwise("PASS"))

    return _alone(catalog, Part(params["source"], totals, judge, findings=lambda records: records.where(hit)))


@check
def threshold_met(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    when, place = E.moment(r, params["order_by"]), _ordinal(r)
    value = E.number(E.field(r, params["field"]))
    newest = F.max_by(F.struct(value.alias("x")), F.struct(F.coalesce(F.unix_micros(when), F.lit(-(1 << 62))).alias("t"), F.col(f"_place{tag}").alias("place")))["x"]

    def wrong(x: Column) -> Column:
        out = F.lit(False)
        if params.get("min") is not None:
            out |= x < params["min"]
        if params.get("max") is not None:
            out |= x > params["max"]
        return out

    totals = {"examined": F.count("*"), "in_scope": F.least(F.lit(1), F.count("*")), "x": newest, "n_findings": F.when(wrong(newest), 1).otherwise(0)}

    def judge(c: Total) -> list[Column]:
        text = F.concat(F.lit(f"{params['field']} = "), F.coalesce(c("x").cast("string"), F.lit("no number")))
        return _verdict(c, text, text, F.when(c("examined") == 0, "PASS").when(c("x").isNull(), "NOT_TESTABLE").when(c("n_findings") > 0, "FAIL").otherwise("PASS"))

    return _alone(catalog, Part(params["source"], totals, judge, widen=lambda records: records.withColumn(f"_place{tag}", place)))


@check
def rate_within(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    """Only true itself counts: the number 1 doesn't."""
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    scope = F.lit(True)
    if params.get("since_days"):
        scope = F.coalesce(F.unix_micros(E.moment(r, params["date_field"])) >= F.unix_micros(E.at(as_of)) - params["since_days"] * E.DAY, F.lit(False))
    numeric = E.kind_of(r, params["field"]).typeName() not in ("boolean", "string", "void")
    true = F.lit(False) if numeric else F.coalesce(E.field_key(r, params["field"]) == "true", F.lit(False))
    low, high = params.get("min"), params.get("max")
    rate = lambda k, n: F.try_divide(k, n)
    few = lambda n: n < params.get("min_records", 5)
    out = lambda x: (x < (0 if low is None else low)) | (x > (1 if high is None else high))
    n, k = F.count_if(scope), F.count_if(scope & true)
    totals = {"examined": F.count("*"), "in_scope": n, "k": k, "n_findings": F.when(~few(n) & out(rate(k, n)), 1).otherwise(0)}

    def judge(c: Total) -> list[Column]:
        text = F.format_string("%d of %d in the window of %d records", c("k"), c("in_scope"), c("examined"))
        unknown = few(c("in_scope")) | rate(c("k"), c("in_scope")).isNull()
        return _verdict(c, text, text, F.when(unknown, "NOT_TESTABLE").when(c("n_findings") > 0, "FAIL").otherwise("PASS"))

    return _alone(catalog, Part(params["source"], totals, judge))


@check
def within_tolerance(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    if gone := _absent(catalog, params["source"]):
        return gone
    r = catalog.get(params["source"])
    ordered, order = _latest(r, params["order_by"])
    # the last two of a total order: kept while aggregating, so that nothing is sorted whole
    last = ordered.orderBy(*order).limit(2).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    value = lambda m, n: F.max(F.when(F.col("_n") == n, E.number(E.field(ordered, m))))
    metrics = params["metrics"]
    pairs = last.agg(*(value(m, n).alias(f"{m}_{n}") for m in metrics for n in (1, 2)))
    wide = r.agg(F.count("*").alias("examined")).crossJoin(pairs)  # a row each
    stacked = wide.select("examined", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_2").alias("prev"), F.col(f"{m}_1").alias("cur"), F.lit(t.get("max_drop")).cast("double").alias("max_drop"), F.lit(t.get("max_rise")).cast("double").alias("max_rise")) for m, t in metrics.items()))).alias("x")).select("examined", "x.*")
    broken = F.coalesce(F.col("prev") - F.col("cur") > F.col("max_drop"), F.lit(False)).cast("int") + F.coalesce(F.col("cur") - F.col("prev") > F.col("max_rise"), F.lit(False)).cast("int")
    counts = stacked.groupBy("examined").agg(F.sum(broken).alias("n_findings"), F.count_if(F.col("prev").isNull() | F.col("cur").isNull()).alias("unread")).withColumn("in_scope", F.least(F.lit(2), "examined"))
    counts = counts.withColumn("n_findings", F.when(F.col("examined") < 2, 0).otherwise(F.col("n_findings")))
    verdict = F.when(F.col("examined") < 2, "NOT_TESTABLE").when(F.col("n_findings") > 0, "FAIL").when(F.col("unread") > 0, "NOT_TESTABLE").otherwise("PASS")
    text = F.format_string(f"%d of {len(metrics)} metrics out of tolerance, %d unreadable, in the last two of %d records", "n_findings", "unread", "examined")
    return Checked(counts.select(*_verdict(F.col, text, text, verdict)), stacked.where(broken > 0).drop("examined"))


@check
def field_equals(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    """The first right record of a key counts: by _ordinal if there is one, else by the least value."""
    left, right, keys = params["left"], params["right"], params["join"]
    if gone := _absent(catalog, left["source"], right["source"]):
        return gone
    a, b = catalog.get(left["source"]), catalog.get(right["source"])
    value = E.field_key(b, right["field"])
    order = F.col("_ordinal") if "_ordinal" in b.columns else value
    first = b.select(E.field_key(b, keys["right_key"]).alias("_key"), value.alias("_value"), order.alias("_order")).where("_key IS NOT NULL").groupBy("_key").agg(F.min_by(F.struct("_value"), F.struct("_order")).alias(f"_first{tag}")).withColumnRenamed("_key", f"_key{tag}")
    widen = lambda records: records.withColumn(f"_key{tag}", E.field_key(a, keys["left_key"])).join(first, f"_key{tag}", "left")
    own, found = E.field_key(a, left["field"]), F.col(f"_first{tag}")
    reason = E.one_of([(found.isNull(), "no matching record"), (~own.eqNullSafe(found["_value"]), F.concat(F.lit("expected "), F.coalesce(found["_value"], F.lit("nothing"))))])
    return _each(catalog, left["source"], F.lit(True), reason, "%d of %d records match", "%d of %d records mismatch", widen)


@check
def values_subset(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    part, whole = params["subset"], params["superset"]
    if gone := _absent(catalog, part["source"], whole["source"]):
        return gone
    a, b = catalog.get(part["source"]), catalog.get(whole["source"])
    have = b.select(E.field_key(b, whole["field"]).alias(f"_key{tag}")).where(f"_key{tag} IS NOT NULL").distinct().withColumn(f"_have{tag}", F.lit(True))
    widen = lambda records: records.withColumn(f"_key{tag}", E.field_key(a, part["field"])).join(have, f"_key{tag}", "left")
    return _each(catalog, part["source"], F.lit(True), F.when(F.col(f"_have{tag}").isNull(), "no counterpart"), "%d of %d values have a counterpart", "%d of %d values have no counterpart", widen)


@check
def timestamp_before(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    early, late, keys = params["earlier"], params["later"], params["join"]
    if gone := _absent(catalog, early["source"], late["source"]):
        return gone
    a, b = catalog.get(early["source"]), catalog.get(late["source"])
    least = a.select(E.field_key(a, keys["left_key"]).alias(f"_key{tag}"), E.moment(a, early["field"]).alias("_t")).where(f"_key{tag} IS NOT NULL").groupBy(f"_key{tag}").agg(F.min("_t").alias(f"_least{tag}"))
    widen = lambda records: records.withColumn(f"_key{tag}", E.field_key(b, keys["right_key"])).join(least, f"_key{tag}", "left")
    later, first = E.moment(b, late["field"]), F.col(f"_least{tag}")
    reason = E.one_of([(later.isNull(), "unreadable later time"), (first.isNull(), "no earlier record"), (first >= later, "earlier record not before later")])
    return _each(catalog, late["source"], F.lit(True), reason, "%d of %d records have prior evidence", "%d of %d records lack prior evidence", widen)


@check
def identity_disjoint(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    """Two nulls are a conflict."""
    left, right, keys = params["left"], params["right"], params["join"]
    if gone := _absent(catalog, left["source"], right["source"]):
        return gone
    a, b = catalog.get(left["source"]), catalog.get(right["source"])
    # pairs are counted from counts of each (key, identity), never made
    x = a.select(E.field_key(a, keys["left_key"]).alias("k"), E.field_key(a, left["field"]).alias("who")).groupBy("k", "who").agg(F.count("*").alias("n"))
    y = b.select(E.field_key(b, keys["right_key"]).alias("k2"), E.field_key(b, right["field"]).alias("who2")).groupBy("k2", "who2").agg(F.count("*").alias("m"))
    totals = y.groupBy("k2").agg(F.sum("m").alias("all"))
    pairs = x.join(totals, x["k"] == totals["k2"]).agg(F.coalesce(F.sum(F.col("n") * F.col("all")), F.lit(0)).alias("in_scope"))
    same = x.join(y, (x["k"] == y["k2"]) & x["who"].eqNullSafe(y["who2"]))
    found = same.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_findings"))
    counts = a.agg(F.count("*").alias("examined")).crossJoin(pairs).crossJoin(found)  # a row each
    result = counts.select(*_verdict(F.col, F.format_string("%d pairs from %d records, none shares an identity", "in_scope", "examined"), F.format_string("%d of %d pairs share an identity", "n_findings", "in_scope")))
    return Checked(result, same.select(F.col("k").alias("key"), F.col("who").alias("identity"), (F.col("n") * F.col("m")).alias("pairs")))


@check
def preceded_within(catalog: Catalog, params: dict, as_of: str, tag: str = "") -> Checked:
    """Both sides are cut into blocks of max_days + 1 days: an earlier record that counts is in the same or the last block."""
    early, late, days = params["earlier"], params["later"], int(params["max_days"])
    if gone := _absent(catalog, early["source"], late["source"]):
        return gone
    a, b = catalog.get(early["source"]), catalog.get(late["source"])
    width = (days + 1) * E.DAY
    block = lambda t: F.floor(F.unix_micros(t) / width)
    # within a block, only its least and greatest times can matter beside those of the same block, which are ordered
    times = a.select(E.moment(a, early["field"]).alias("_t")).where("_t IS NOT NULL").withColumn("_b", block(F.col("_t")))
    later = E.moment(b, late["field"])
    every = b.select(later.alias("_t"), F.lit(1).alias("_kind")).where("_t IS NOT NULL").distinct().withColumn("_b", block(F.col("_t"))).unionByName(times.distinct().select("_t", F.lit(0).alias("_kind"), "_b"))
    # the newest earlier time up to each later one: of its block by a running maximum, else of the block before
    upto = F.max(F.when(F.col("_kind") == 0, F.col("_t"))).over(Window.partitionBy("_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    newest = times.groupBy("_b").agg(F.max("_t").alias("_last")).select((F.col("_b") + 1).alias("_b"), "_last")
    near = every.withColumn("_upto", upto).where("_kind = 1").join(newest, "_b", "left").select(F.col("_t").alias(f"_later{tag}"), F.coalesce("_upto", "_last").alias(f"_before{tag}"))
    widen = lambda records: records.withColumn(f"_later{tag}", later).join(near, f"_later{tag}", "left")
    gap = E.floor_days(F.col(f"_later{tag}"), F.col(f"_before{tag}"))
    reason = E.one_of([(F.col(f"_later{tag}").isNull(), "unreadable date"), (gap.isNull() | (gap > days), f"no {early['source']} record in the {days} days before")])
    return _each(catalog, late["source"], F.lit(True), reason, "%d of %d records preceded by a run", "%d of %d records not preceded by a run", widen)
