"""References between registers: dangling ones, duplicates, drift and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import exprs as E


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of a column, single or array, that the known keys lack; null is none."""
    c = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    used = rows.select(c.alias("ref")).where("ref IS NOT NULL").groupBy("ref").agg(F.count("*").alias("uses"))
    return used.join(known.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differences(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed, changed or same."""
    a = before.select(F.col(key), F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(F.col(key), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def set_drift(stated: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """key, drifted, missing, extra: what two tables of (key, item) list for each key."""
    a = stated.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("_a"))
    b = found.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("_b"))
    none = F.array().cast(f"array<{stated.schema[item].dataType.simpleString()}>")
    x, y = F.coalesce("_a", none), F.coalesce("_b", none)
    return a.join(b, key, "full_outer").select(key, (x != y).alias("drifted"), F.array_sort(F.array_except(x, y)).alias("missing"), F.array_sort(F.array_except(y, x)).alias("extra"))


def issues(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with issues, the names of the rules that each breaks."""
    listed = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules))
    return rows.withColumn("issues", F.array_compact(listed))


def register_issues(tickets: DataFrame, pattern: str, required: list[str], dates: tuple[str, str]) -> DataFrame:
    """Tickets with what is wrong: id, required fields, dates out of order, an id used twice; historical rows only warn."""
    start, end = E.moment(tickets, dates[0]), E.moment(tickets, dates[1])
    rules = [("bad id", ~F.coalesce(F.col("ticket_id"), F.lit("")).rlike(pattern)), *((f"missing {f}", E.empty(E.field(tickets, f))) for f in required), ("approved before opened", end < start)]
    rows = issues(tickets, rules).join(duplicates(tickets, ["ticket_id"]).select("ticket_id", F.lit(True).alias("_twice")), "ticket_id", "left")
    rows = rows.withColumn("issues", F.when(F.col("_twice"), F.array_append("issues", F.lit("duplicate id"))).otherwise(F.col("issues"))).drop("_twice")
    historical = F.lower(F.coalesce(E.field(tickets, "record_status"), F.lit(""))) == "historical"
    return rows.withColumn("level", F.when(F.size("issues") == 0, "ok").when(historical, "warning").otherwise("error"))


def required_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    return issues(rows, [(f"missing {f}", E.empty(E.field(rows, f))) for f in fields])


def coverage(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """rows with covered: whether the known keys have theirs."""
    return rows.join(known.select(F.col(key), F.lit(True).alias("_k")).distinct(), key, "left").withColumn("covered", F.coalesce("_k", F.lit(False))).drop("_k")


def update_from(rows: DataFrame, overlay: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with the overlay's values where it names them and they aren't TODO, and the overlay's keys that match nothing."""
    new = overlay.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    joined = rows.join(new, key, "left")
    value = lambda f: F.when(~F.upper(F.trim(F.col(f"_new_{f}"))).startswith("TODO"), F.col(f"_new_{f}"))
    changed = joined.withColumns({f: F.coalesce(value(f), F.col(f)) for f in fields}).drop(*(f"_new_{f}" for f in fields))
    return changed, overlay.select(key).join(rows.select(key), key, "left_anti")


def signals_for(controls: DataFrame, signals: DataFrame) -> DataFrame:
    """control_id, path, kind: signals that name a control, its family, or something it is a part of: three equi-joins."""
    named = signals.select("path", "kind", F.explode("controls").alias("c"))
    parts = F.split("control_id", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    family = F.regexp_extract("control_id", r"^[A-Z]+", 0)
    keys = controls.select("control_id", F.explode(F.array_distinct(F.concat(prefixes, F.array(family)))).alias("c")).where("c <> ''")
    return reduce(DataFrame.unionByName, [keys.join(named, "c").select("control_id", "path", "kind")]).distinct()
