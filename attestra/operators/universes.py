"""What references may name, and references that name nothing.

Universes are tables of (kind, ref): steps of plays, controls of a library, and every key path of nested
documents, which flattened() lists level by level from Variant values, in one pass and without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.integrity import set_drift

#: Severities, ways of assurance, and how a library's controls are written in references. Fixed values.
SEVERITIES = ["critical", "high", "medium", "low"]
ASSURANCE = ["lane_a", "lane_b", "hybrid", "human_only"]
LIBRARY_REF = r"^MAS-AIRG-([MF][\d.]+)$"
#: Levels of nesting that are looked into.
LEVELS = 8


def flattened(rows: DataFrame, document: str, keys: list[str], levels: int = LEVELS, lists: bool = False) -> DataFrame:
    """keys, path, value (Variant) of every key in nested documents, inner keys after outer ones divided by dots.

    document: a Variant column. A null or one that is no object has no paths; with lists, items of lists count
    as keys by their number from 0. What lies deeper than `levels` stays in the value of the last level.
    """
    at = rows.select(*keys, F.lit(None).cast("string").alias("path"), F.col(document).alias("value"), F.lit(True).alias("open"))
    for _ in range(levels):
        inner = "transform(map_entries(try_cast(value AS map<string, variant>)), e -> named_struct('path', concat_ws('.', path, e.key), 'value', e.value, 'open', true))"
        if lists:
            items = "transform(try_cast(value AS array<variant>), (x, i) -> named_struct('path', concat_ws('.', path, CAST(i AS string)), 'value', x, 'open', true))"
            inner = f"coalesce({inner}, {items})"
        own = "array(named_struct('path', path, 'value', value, 'open', false))"
        at = at.select(*keys, F.explode(F.expr(f"if(open, concat({own}, coalesce({inner}, array())), {own})")).alias("x")).select(*keys, "x.*")
    return at.where("path IS NOT NULL").drop("open")


def with_relative(paths: DataFrame, root: str) -> DataFrame:
    """paths, and those below a root once more as they are written from there."""
    below = paths.where(F.col("path").startswith(f"{root}.")).withColumn("path", F.substring("path", len(root) + 2, 1 << 20))
    return paths.unionByName(below).distinct()


def universe(kind: str, rows: DataFrame, column: str) -> DataFrame:
    """kind, ref of the distinct values of a column."""
    return rows.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("ref")).where("ref IS NOT NULL").distinct()


def references(kind: str, rows: DataFrame, owner: str, column: str) -> DataFrame:
    """owner, kind, ref of each value of a column, single or array; empty ones refer to nothing."""
    c = F.explode(F.col(column).cast("array<string>")) if rows.schema[column].dataType.typeName() == "array" else F.col(column).cast("string")
    return rows.select(F.col(owner).cast("string").alias("owner"), F.lit(kind).alias("kind"), c.alias("ref")).where("ref IS NOT NULL AND ref <> ''")


def unresolved(asked: DataFrame, known: DataFrame) -> DataFrame:
    """References (owner, kind, ref) that their kind's universe lacks: all kinds in one join."""
    return asked.join(known, ["kind", "ref"], "left_anti").select("owner", "kind", "ref")


def library_ids(c: Column) -> Column:
    """The controls that framework references name."""
    named = F.transform(c, lambda x: F.regexp_extract(x, LIBRARY_REF, 1))
    return F.filter(named, lambda x: x != "")


def _rule(rows: DataFrame, level: str, rule: str, wrong: Column, about: Column | str = "") -> DataFrame:
    about = F.lit(about) if isinstance(about, str) else about
    return rows.where(F.coalesce(wrong, F.lit(False))).select(F.lit(level).alias("level"), F.col("control_id").alias("owner"), F.lit(rule).alias("rule"), F.coalesce(about, F.lit("")).alias("about"))


def coverage_drift(tests: DataFrame, packs: DataFrame) -> DataFrame:
    """control_id, drifted, missing, extra: packs that tests declare against those that refer to the control."""
    stated = tests.select("control_id", F.explode("lane_b_packs").alias("pack"))
    found = packs.select(F.explode(library_ids(F.col("framework_refs"))).alias("control_id"), F.col("pack_id").alias("pack"))
    return set_drift(stated, found.join(tests.select("control_id"), "control_id", "left_semi"), "control_id", "pack")


def link_report(tests: DataFrame, requirements: DataFrame, packs: DataFrame, steps: DataFrame, controls: DataFrame, policy: DataFrame) -> DataFrame:
    """level, owner, rule, about: everything that references between requirements, packs, plays and policy get wrong.

    tests: control_id, severity, assurance_mode, play_refs, lane_b_packs; requirements: control_id; packs:
    pack_id, play_refs, framework_refs, policy_refs; steps: step_id; controls: control_id of the library; policy: path.
    """
    known = reduce(DataFrame.unionByName, [universe("play", steps, "step_id"), universe("control", controls, "control_id"), universe("policy", policy, "path")])
    named = packs.withColumn("_library", library_ids(F.col("framework_refs")))
    asked = [references("play", tests, "control_id", "play_refs"), references("control", tests, "control_id", "control_id"), references("control", requirements, "control_id", "control_id")]
    asked += [references("play", packs, "pack_id", "play_refs"), references("control", named, "pack_id", "_library"), references("policy", packs, "pack_id", "policy_refs")]
    lost = unresolved(reduce(DataFrame.unionByName, asked), known).distinct()
    out = [lost.select(F.lit("error").alias("level"), "owner", F.concat(F.lit("unknown "), "kind").alias("rule"), F.col("ref").alias("about"))]
    mode, critical, covered = F.col("assurance_mode"), F.col("severity") == "critical", F.size(F.coalesce("lane_b_packs", F.array())) > 0
    out.append(_rule(tests, "error", "severity", ~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), F.col("severity")))
    out.append(_rule(tests, "error", "assurance mode", mode.isNotNull() & ~mode.isin(ASSURANCE), mode))
    out.append(_rule(tests, "error", "critical without assurance mode", critical & mode.isNull()))
    out.append(_rule(tests, "error", "critical lane_b without a pack", critical & (mode == "lane_b") & ~covered))
    out.append(_rule(tests, "error", "critical human_only with packs", critical & (mode == "human_only") & covered))
    text = lambda c: F.array_join(F.col(c), ",")
    stale = coverage_drift(tests, packs).where("drifted")
    out.append(_rule(stale, "warning", "stale packs", F.lit(True), F.concat(F.lit("-"), text("missing"), F.lit(" +"), text("extra"))))
    return reduce(DataFrame.unionByName, out)
