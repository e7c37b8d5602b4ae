"""Markdown as rows: what stands under each heading, labels read out of headings, and labels rendered from elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.evaluation import derived_labels

#: How a case's heading is written. Fixed values.
CASE_LEVEL, CASE = 3, r"_([A-Za-z0-9]+)\b[^\n]*?\*\*(full|partial|none)\*\*"
TITLE = "## Cases"


def sections(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, ordinal, level, heading, body of each section of Markdown texts; what precedes the first heading has level 0.

    A text is split at its headings in place: no window, no sort. Null texts have no sections.
    """
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)^(?=#{1,6} )")
    rows = texts.select(*keys, F.posexplode(parts).alias("ordinal", "part")).where("ordinal > 0 OR part <> ''")
    first = F.substring_index("part", "\n", 1)
    level = F.when(F.col("part").rlike("^#{1,6} "), F.length(F.regexp_extract("part", "^(#{1,6}) ", 1))).otherwise(0)
    heading = F.when(level > 0, F.trim(F.regexp_replace(first, "^#{1,6} +", ""))).otherwise("")
    body = F.when(level > 0, F.regexp_replace(F.col("part"), r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    return rows.select(*keys, "ordinal", level.alias("level"), heading.alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def written_labels(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, case_id, label of the case headings alone: a label that prose mentions isn't one. The last heading of a case counts."""
    rows = sections(texts, keys, text).where(F.col("level") == CASE_LEVEL)
    part = lambda i: F.lower(F.regexp_extract("heading", "(?i)" + CASE, i))
    found = rows.select(*keys, part(1).alias("case_id"), part(2).alias("label"), "ordinal").where("label <> ''")
    return found.groupBy(*keys, "case_id").agg(F.max_by("label", "ordinal").alias("label"))


def derived(elements: DataFrame) -> DataFrame:
    """control_id, case_id, label of element values (control_id, case_id, element_id, ordinal, value)."""
    return derived_labels(elements, ["control_id", "case_id"]).select("control_id", "case_id", "label")


def _table(rows: Column) -> Column:
    line = lambda e: F.concat(F.lit("| `"), e["element_id"], F.lit("` | "), F.coalesce(e["value"], F.lit("")), F.lit(" |"))
    return F.concat(F.lit("| element | |\n|---|---|\n"), F.array_join(F.transform(rows, line), "\n"))


def rendered(elements: DataFrame) -> DataFrame:
    """control_id, text: the Markdown of each control's labels, cases and their elements in order.

    elements: control_id, case_id, element_id, ordinal, value (Y, N, n/a or ?). A control's elements and cases are few.
    """
    cases = elements.groupBy("control_id", "case_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "element_id", "value"))).alias("_rows"))
    said = cases.join(derived(elements), ["control_id", "case_id"])
    n = lambda v: F.size(F.filter("_rows", lambda e: e["value"] == v)).cast("string")
    head = F.concat(F.lit("### `"), F.col("control_id"), F.lit("_"), F.col("case_id"), F.lit("` → **"), F.coalesce("label", F.lit("unknown")), F.lit("**"))
    counts = F.concat(n("Y"), F.lit(" evidenced, "), n("N"), F.lit(" not evidenced, "), n("n/a"), F.lit(" not applicable."))
    block = F.concat_ws("\n\n", head, counts, _table(F.col("_rows")))
    whole = said.select("control_id", "case_id", block.alias("block")).groupBy("control_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "block"))).alias("_cases"))
    return whole.select("control_id", F.concat(F.lit("# "), F.col("control_id"), F.lit(f"\n\n{TITLE}\n\n"), F.array_join(F.transform("_cases", lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("text"))


def label_drift(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """control_id, case_id, derived, written, state: stale, missing (not written), orphan (written of no case) or current."""
    a = derived(elements).select("control_id", "case_id", F.coalesce("label", F.lit("unknown")).alias("derived"))
    b = written_labels(texts, ["control_id"]).select("control_id", "case_id", F.col("label").alias("written"))
    state = F.when(F.col("written").isNull(), "missing").when(F.col("derived").isNull(), "orphan").when(F.col("derived") == F.col("written"), "current").otherwise("stale")
    return a.join(b, ["control_id", "case_id"], "full_outer").withColumn("state", state)
