"""What is handed on: knowledge as text and what it says of controls, traces of thresholds, tracker proposals, a status report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators import retrieval
from attestra.operators.bundles import canonical
from attestra.operators.contracts import FRAMEWORKS
from attestra.operators.declared import TIERS

#: Which kinds of memory each role prefers, and by how much. Fixed values.
ROLE_KINDS = {"challenger": (3, ["challenge_pattern"]), "assessor": (2, ["precedent", "approved_interpretation", "evidence_pattern"])}
#: Points for a memory that names the control, and for a test that is the control's own. Fixed values.
NAMED, EXACT = 8, 20
#: A score that a user interface lets through, and days until a test is due where nobody says. Fixed values.
SHOWN, CADENCE = 18.0, 100
OUT_OF_TIERS = 99


def tier_rank(c: Column) -> Column:
    """1 for the most authoritative tier; unknown ones come last."""
    return F.coalesce(*(F.when(c == t, F.lit(i + 1)) for i, t in enumerate(TIERS)), F.lit(OUT_OF_TIERS))


def framework_names(c: Column) -> Column:
    """All names of a framework, by any of them."""
    groups = [F.when(c.isin(a, b), F.array(F.lit(a), F.lit(b))) for a, b in FRAMEWORKS.items()]
    return F.coalesce(*groups, F.array(c))


def memory_text(topic: str, statement: str, kind: str, controls: str, tags: str, patterns: str, prompt: str) -> Column:
    """A memory as one text: its fields by name, lists flattened, what is null left out; patterns: a map of lists."""
    return F.concat_ws(" ", topic, statement, kind, controls, tags, F.flatten(F.map_values(patterns)), prompt)


def memories_for(memories: DataFrame, queries: DataFrame, role: str, limit: int = 5) -> DataFrame:
    """query_id, id, score, rank of memories that name a query's control, or all (`*`), or share labels with it.

    memories: id, type, authority_tier, controls (array), text (memory_text()); queries: query_id, key (the control), text.
    Ties go to the more authoritative, then to the greater id.
    """
    points, kinds = ROLE_KINDS.get(role, (0, [""]))
    every = F.array_contains("controls", "*")
    asked = queries.select("query_id", "key", F.concat_ws(" ", "key", "text").alias("text"))
    # a memory of all controls is named by each query's key: its keys are the keys that are asked for
    keys = asked.agg(F.collect_set("key").alias("_keys"))  # one row, of the queries that the caller states
    items = memories.crossJoin(F.broadcast(keys)).select("id", F.when(every, F.col("_keys")).otherwise(F.col("controls")).alias("keys"), "text", tier_rank(F.col("authority_tier")).alias("tier"), F.when(F.col("type").isin(kinds), points).otherwise(0).alias("bonus"))
    return retrieval.overlap_rank(items, asked, limit, (NAMED, 1))


def tests_for(testing: DataFrame, queries: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, id, score, rank of testing knowledge for a control: its own first, then what shares labels, within its framework by any name.

    testing: id, control_id, framework, authority_tier, text; queries: query_id, key (the control), framework, text.
    """
    name = lambda c: F.array_min(framework_names(F.col(c)))
    # each query meets the records of its framework alone: the framework goes before every label and key
    tagged = lambda words: F.array_join(F.transform(words, lambda w: F.concat(F.col("_f"), F.lit("_"), w)), " ")
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    label = lambda df, c: tagged(E.tokens(F.col(c), "labels"))
    items = testing.withColumn("_f", flat(name("framework")))
    items = items.select("id", F.array(F.concat("_f", F.lit("/"), "control_id")).alias("keys"), label(items, "text").alias("text"), tier_rank(F.col("authority_tier")).alias("tier"), F.lit(0).alias("bonus"))
    asked = queries.withColumn("_f", flat(name("framework"))).withColumn("_t", F.concat_ws(" ", "key", "text"))
    asked = asked.select("query_id", F.concat("_f", F.lit("/"), "key").alias("key"), label(asked, "_t").alias("text"))
    return retrieval.overlap_rank(items, asked, limit, (EXACT, 1))


def threshold_trace(scores: DataFrame, queries: DataFrame, k: int, depth: int) -> DataFrame:
    """query_id, library, query_terms, rank, id, score, within_k, passes_shown: each query's first `depth` passages, before any gate.

    scores: query_id, id, score, ranked already if there is a rank; queries: query_id, library, text.
    """
    ranked = scores.where(F.col("rank") <= depth) if "rank" in scores.columns else retrieval.top(scores, depth)
    asked = queries.select("query_id", "library", F.size(F.array_distinct(E.tokens(F.col("text")))).alias("query_terms"))
    return ranked.join(asked, "query_id").select("query_id", "library", "query_terms", "rank", "id", (F.round(F.col("score") * 10_000) / 10_000).alias("score"), (F.col("rank") <= k).alias("within_k"), (F.col("score") >= SHOWN).alias("passes_shown"))


def evidence_hash(results: DataFrame, without: str = "note") -> Column:
    """sha256 of each result as canonical JSON, without its note."""
    kept = results.drop(without)
    return F.sha2(canonical(F.struct(*(F.col(c) for c in kept.columns)), kept.schema), 256)


def tracker_proposals(results: DataFrame, tracker: DataFrame) -> DataFrame:
    """n, hotspot, last_run, result, residual_risk, next_run, engine, evidence, note: a row of the tracker for each result, to be reviewed.

    results: n, hotspot, run_at (ISO text), engine, failed, cases, result, residual_risk, note; tracker: n, hotspot, max_days.
    """
    hashed = results.withColumn("_hash", evidence_hash(results))
    rows = hashed.join(tracker.select("n", F.col("hotspot").alias("_named"), "max_days"), "n", "left")
    day = F.to_date(F.substring("run_at", 1, 10))
    return rows.select("n", F.coalesce("_named", "hotspot").alias("hotspot"), day.cast("string").alias("last_run"), "result", "residual_risk", F.date_add(day, F.coalesce(F.col("max_days").cast("int"), F.lit(CADENCE))).cast("string").alias("next_run"), "engine", F.substring("_hash", 1, 16).alias("evidence"), "note")


def status_report(parts: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """part, status, errors, rows: PASS or BLOCKED for each (name, rows, whether a row is an error); no rows at all are INCONCLUSIVE."""
    out = []
    for i, (name, rows, wrong) in enumerate(parts):
        counts = rows.agg(F.count_if(F.coalesce(wrong, F.lit(False))).alias("errors"), F.count("*").alias("rows"))
        state = F.when(F.col("rows") == 0, "INCONCLUSIVE").when(F.col("errors") > 0, "BLOCKED").otherwise("PASS")
        out.append(counts.select(F.lit(i).alias("ordinal"), F.lit(name).alias("part"), state.alias("status"), "errors", "rows"))
    return reduce(DataFrame.unionByName, out)
