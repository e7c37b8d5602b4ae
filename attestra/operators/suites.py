"""Executable suites: a design test over artefacts and an operating test over records, each with a verdict."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators.checks import fixed
from attestra.plans.catalog import Catalog


@dataclass
class Spec:
    control_id: str
    terms: list[str]
    sources: list[str]
    required: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    ordering: list[tuple[str, str]] = field(default_factory=list)
    min_records: int = 1
    min_hits: int = 1


def load_specs(path: str) -> list[Spec]:
    """Specs from YAML: a list of mappings with the fields of Spec."""
    with open(path, encoding="utf-8") as file:
        return [Spec(**(row | {"ordering": [tuple(p) for p in row.get("ordering", [])]})) for row in yaml.safe_load(file) or []]


def flat(c: Column) -> Column:
    """Lower case, anything but letters and digits a single blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def needed(spec: Spec) -> int:
    return max(spec.min_hits, math.ceil(0.6 * len(spec.terms)))


def design(artefacts: DataFrame, spec: Spec) -> DataFrame:
    """One row: verdict, hits (terms that any artefact's text holds), needed. No artefact: NOT_TESTABLE.

    Each artefact is looked at for itself, so no text is gathered anywhere.
    """
    text = flat(F.concat_ws(" ", *[c for c in ("name", "text") if c in artefacts.columns]))
    held = [F.max(text.contains(" ".join(t.lower().replace("-", " ").replace("/", " ").split())).cast("int")).alias(f"t{i}") for i, t in enumerate(spec.terms)]
    row = artefacts.agg(F.count("*").alias("n"), *held)
    hits = reduce(lambda a, b: a + b, (F.coalesce(f"t{i}", F.lit(0)) for i in range(len(spec.terms))), F.lit(0))
    return row.select(F.lit(spec.control_id).alias("control_id"), F.when(F.col("n") == 0, "NOT_TESTABLE").when(hits >= needed(spec), "PASS").otherwise("FAIL").alias("verdict"), hits.cast("long").alias("hits"), F.lit(needed(spec)).alias("needed"))


def operating(catalog: Catalog, spec: Spec) -> DataFrame:
    """One row: verdict, detail, examined, in_scope, n_findings; the first stage that finds something decides."""
    there = [s for s in spec.sources if catalog.get(s) is not None]
    if not there:
        return fixed(catalog.spark, "NOT_TESTABLE", f"no source of {', '.join(spec.sources)}")
    names = sorted({*spec.required, *spec.unique, *(x for p in spec.ordering for x in p)})
    rows = reduce(DataFrame.unionByName, (catalog.get(s).select(F.lit(s).alias("_source"), *(E.field(catalog.get(s), n).cast("string").alias(n) for n in names)) for s in there))
    lacking = reduce(lambda a, n: a | E.empty(F.col(n)), spec.required, F.lit(False))
    late = reduce(lambda a, p: a | F.coalesce(E.moment(rows, p[0]) >= E.moment(rows, p[1]), F.lit(False)), spec.ordering, F.lit(False))
    base = rows.agg(F.count("*").alias("n"), F.count_if(lacking).alias("lacking"), F.count_if(late).alias("late"))
    twice = F.lit(0)
    for i, name in enumerate(spec.unique):
        again = rows.where(F.col(name).isNotNull()).groupBy(name).count().where("count > 1").agg(F.count("*").alias(f"u{i}"))
        base = base.crossJoin(again)  # a row each
        twice = twice + F.col(f"u{i}")
    row = base.withColumn("twice", twice)
    few = F.col("n") < spec.min_records
    verdict = F.when(few, "NOT_TESTABLE").when((F.col("lacking") > 0) | (F.col("twice") > 0) | (F.col("late") > 0), "FAIL").otherwise("PASS")
    found = F.when(few, 0).when(F.col("lacking") > 0, F.col("lacking")).when(F.col("twice") > 0, F.col("twice")).otherwise(F.col("late"))
    detail = F.when(few, "too few records").when(F.col("lacking") > 0, "required fields missing").when(F.col("twice") > 0, "duplicate keys").when(F.col("late") > 0, "out of order").otherwise("in order")
    return row.select(verdict.alias("verdict"), detail.alias("detail"), F.col("n").alias("examined"), F.col("n").alias("in_scope"), found.cast("long").alias("n_findings"))


def run_suite(catalog: Catalog, artefacts: DataFrame, specs: list[Spec]) -> DataFrame:
    """control_id, kind, verdict of both tests of all specs, as one plan."""
    rows = [design(artefacts, s).select("control_id", F.lit("design").alias("kind"), "verdict") for s in specs]
    rows += [operating(catalog, s).select(F.lit(s.control_id).alias("control_id"), F.lit("operating").alias("kind"), "verdict") for s in specs]
    return reduce(DataFrame.unionByName, rows)
