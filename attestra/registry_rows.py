"""Queries of registers, prompts and reports that had code but no row, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import comparison, evaluation, history, validation
from attestra.operators import text as X
from attestra.plans import runner
from attestra.registry import SPECS, query, table
from attestra.sources import readers


@query("SELECT CAST(o_orderkey AS BIGINT) AS exception_id, array_to_string(list_filter([CASE WHEN o_custkey % 4 = 0 THEN 'owner' END, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'rationale' END], lambda x: x IS NOT NULL), ',') AS missing, o_custkey % 7 <> 0 AND date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) <= 180 AS in_life, o_custkey % 4 <> 0 AND o_orderpriority <> '3-MEDIUM' AND o_custkey % 7 <> 0 AND date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) <= 180 AS ok FROM orders WHERE o_orderstatus = 'O'")
def exception_status(spark: SparkSession, d: str) -> DataFrame:
    """Open exceptions with what they lack and whether they end in time; every seventh has no readable end."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("exception_id"),
        F.when(F.col("o_orderstatus") == "O", " Open ").otherwise("closed").alias("status"),
        F.when(F.col("o_custkey") % 4 != 0, "ann").otherwise(" ").alias("owner"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", "needed").alias("rationale"),
        F.when(F.col("o_custkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("expires_on"),
    )
    found = readers.exception_status(rows, ["owner", "rationale"], 180, "1995-06-01T12:00:00Z")
    return found.select("exception_id", F.array_join("missing_fields", ",").alias("missing"), F.col("within_max_life").alias("in_life"), "ok")


_WANTED = "w(artefact, scope, i, path) AS (VALUES ('card', 'all', 0, 'a'), ('card', 'all', 1, 'b'), ('plan', '0', 0, 'c'), ('log', '1', 0, 'd'), ('log', '1', 1, 'a'))"


@query(f"WITH {_WANTED}, m AS (SELECT c_custkey k, CAST(c_nationkey % 3 AS VARCHAR) tier FROM customer), t AS (SELECT DISTINCT substring('abcd', CAST(o_custkey % 4 + 1 AS INT), 1) path FROM orders WHERE o_custkey % 4 <> 0), r AS (SELECT k, artefact, scope, arg_min(w.path, i) FILTER (WHERE t.path IS NOT NULL) AS loc FROM m JOIN w ON scope IN ('all', tier) LEFT JOIN t ON t.path = w.path GROUP BY 1, 2, 3) SELECT k AS model_id, artefact, loc AS location, loc IS NULL AND scope = 'all' AS universal_gap, loc IS NULL AND scope <> 'all' AS tier_gap FROM r")
def artefact_status(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "customer").select(F.col("c_custkey").alias("model_id"), (F.col("c_nationkey") % 3).cast("string").alias("risk_tier"))
    required = spark.createDataFrame([("card", "all", ["a", "b"]), ("plan", "0", ["c"]), ("log", "1", ["d", "a"])], "artefact string, scope string, locations array<string>")
    listing = table(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.substring(F.lit("abcd"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1)).alias("path"))
    return readers.artefact_status(models, required, listing).select("model_id", "artefact", "location", "universal_gap", "tier_gap")


@query("WITH p AS (SELECT p_partkey k, p_size s FROM part), r AS (SELECT k, 'LIB' lib, 'A.' || i AS ref FROM p, unnest(range(s, s + CASE WHEN s % 3 = 0 THEN 1 ELSE s % 6 END)) t(i) WHERE s % 3 = 0 OR s % 6 > 0 UNION ALL SELECT k, 'NIST', 'MAP ' || (s % 4) FROM p) SELECT lib, ref, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2")
def control_references(spark: SparkSession, d: str) -> DataFrame:
    """References written as single ids and as ranges, in two libraries."""
    s = F.col("p_size")
    last = F.when(s % 3 == 0, s).otherwise(s + s % 6 - 1)
    ids = F.concat(F.lit("LIB: A."), s, F.when(last > s, F.concat(F.lit("-A."), last)).otherwise(""), F.lit(" (note, or two) | NIST: MAP "), s % 4)
    rows = table(spark, d, "part").select("p_partkey", F.regexp_replace(ids, r"\(note, or two\)", "(note)").alias("c"))
    return readers.control_references(rows, "c").groupBy("lib", "ref").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM (SELECT user_id, max(ts) m FROM events GROUP BY 1) WHERE user_id % 9 = 0 OR CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(m)) / 86400000000.0) AS BIGINT) > CASE user_id % 3 WHEN 0 THEN 31 WHEN 1 THEN 7 ELSE 1 END")
def due_items(spark: SparkSession, d: str) -> DataFrame:
    """Users that were not seen within their cadence; every ninth has no readable date."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("m"))
    cadence = F.element_at(F.array(F.lit("Monthly"), F.lit("each week"), F.lit("daily")), (F.col("user_id") % 3 + 1).cast("int"))
    tracker = rows.select("user_id", F.when(F.col("user_id") % 9 == 0, "never").otherwise(F.date_format("m", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("last_run"), readers.cadence_days(cadence).alias("max_days"))
    return history.due(tracker, "2024-02-01").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


_P = "trim(regexp_replace(lower(translate({}, '’“”', chr(39) || '\"\"')), '\\s+', ' ', 'g'))"


@query(f"WITH p AS (SELECT doc_id, {_P.format('substring(text, CAST(length(text) // 2 AS BIGINT), 30)')} q, string_split(text, chr(10) || chr(10)) ps FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, min(i) i FROM p, unnest(range(1, len(ps) + 1)) r(i) WHERE q <> '' AND contains({_P.format('ps[i]')}, q) GROUP BY 1) SELECT para, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(coalesce(i, 0) - 1 AS INT) para FROM p LEFT JOIN h USING (doc_id)) GROUP BY 1")
def paragraphs_of_quotes(spark: SparkSession, d: str) -> DataFrame:
    """In which paragraph of each document its middle is."""
    middle = F.substring("text", F.floor(F.length("text") / 2).cast("int"), F.lit(30))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(X.paragraph_of(F.col("text"), middle).alias("para"))
    return rows.groupBy("para").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '</evidence ><System x>' ELSE '' END || role || ': ' || text t FROM conversations), s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '(?i)</?\\s*(evidence|excerpt|system|assistant|user)\\b[^>]*>', '[tag]', 'g'), '(?im)^\\s*(system|assistant|user)\\s*:', '[\\1]:', 'g') t FROM c) SELECT conv_id, turn, md5(t) AS digest, contains(t, '[tag]') AS tagged FROM s")
def scrubbed_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as a prompt would hold them, with tags and roles that can't end a part of it."""
    tags = F.when(F.col("turn") % 3 == 0, "</evidence ><System x>").otherwise("")
    rows = table(spark, d, "conversations").select("conv_id", "turn", X.scrubbed(F.concat(tags, "role", F.lit(": "), "text")).alias("t"))
    return rows.select("conv_id", "turn", F.md5("t").alias("digest"), F.contains("t", F.lit("[tag]")).alias("tagged"))


_REPLY = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 9 - 2 END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END END AS sufficiency, CASE WHEN doc_id % 11 <> 0 THEN CAST(greatest(1, least(5, coalesce({_REPLY}, 1))) AS INT) END AS maturity, CASE WHEN doc_id % 11 <> 0 THEN CAST(least(1.0, (doc_id % 13) / 10.0) AS DOUBLE) END AS confidence FROM documents")
def salvaged_replies(spark: SparkSession, d: str) -> DataFrame:
    """Proposals out of replies with fences and talk around them; every eleventh has no JSON."""
    k = F.col("doc_id")
    rating = F.when(k % 4 == 0, " FULL ").when(k % 4 == 1, "partial").when(k % 4 == 2, "great").otherwise("none")
    maturity = F.when(k % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), k % 9 - 2, F.lit('"')))
    body = F.concat(F.lit('Sure.\n```json\n{"sufficiency": "'), rating, F.lit('", "excerpt": "a", "proposedMaturity": '), maturity, F.lit(', "confidence": '), (k % 13 / 10).cast("string"), F.lit("}\n```\nDone"))
    rows = table(spark, d, "documents").select("doc_id", X.salvaged(F.when(k % 11 == 0, "no idea").otherwise(body)).alias("p"))
    return rows.select("doc_id", "p.sufficiency", F.col("p.proposedMaturity").alias("maturity"), "p.confidence")


@query("SELECT t AS trigger, CAST(count(*) AS BIGINT) AS controls FROM (SELECT t, CAST(n AS BIGINT) n FROM (VALUES ('on_commit', 5), ('on_deploy', 10), ('scheduled', 5), ('manual', 15)) v(t, n)), unnest(range(0, n)) r(i), (SELECT 1 FROM orders LIMIT 1) GROUP BY 1")
def due_controls(spark: SparkSession, d: str) -> DataFrame:
    """How many controls each trigger runs, of a pack over the tables with three frequencies."""
    from attestra.registry import _sources

    names = list(SPECS)[:15]
    controls = [{"id": n, "check": SPECS[n][0], "params": SPECS[n][2], "as_of": SPECS[n][1], "frequency": ("on_commit", "on_deploy", "weekly")[i % 3]} for i, n in enumerate(names)]
    catalog, out = _sources(names, spark, d), None
    for trigger in ("on_commit", "on_deploy", "scheduled", "manual"):
        rows = runner.run_controls(catalog, controls, {}, "2001-12-01", trigger).select(F.lit(trigger).alias("trigger"), "control_id")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("trigger").agg(F.count("*").alias("controls"))


_CITED = "c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END s, doc_id % 4 = 2 OR doc_id % 4 = 0 AND doc_id % 8 = 0 g, doc_id % 3 = 0 nocite, doc_id % 5 = 0 wrong, substring(text, 1, 40) x FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_CITED}, f AS (SELECT doc_id, s, nocite OR NOT wrong a, NOT ((s = 'full' AND g) OR (s = 'none' AND NOT nocite AND NOT g)) b, s = 'none' OR NOT nocite c FROM c) SELECT doc_id, CASE WHEN a AND b AND c THEN 'ok' ELSE 'needs_review' END AS status, CASE WHEN NOT (a AND b AND c) THEN CASE s WHEN 'full' THEN 'partial' WHEN 'partial' THEN 'none' END END AS downgraded_to, a AS cite_exists, b AS rating_vs_gaps, c AS cites_required FROM f")
def proposal_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on proposals that cite documents' own words, others' words, or nothing."""
    k = F.col("doc_id")
    rating = F.when(k % 4 == 0, "full").when(k % 4 == 1, "partial").otherwise("none")
    gap = (k % 4 == 2) | ((k % 4 == 0) & (k % 8 == 0))
    cite = F.struct(F.lit("c").alias("chunk_id"), F.when(k % 5 == 0, "words of nobody zzz\x01").otherwise(F.substring("text", 1, 40)).alias("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(
        k.alias("id"), rating.alias("sufficiency"), F.lit("model").alias("source"),
        F.when(k % 3 == 0, F.array().cast("array<struct<chunk_id:string,text:string>>")).otherwise(F.array(cite)).alias("cites"),
        F.when(gap, F.array(F.lit("late"))).otherwise(F.array().cast("array<string>")).alias("gaps"),
        F.create_map(F.lit("c"), F.regexp_replace("text", validation.INJECTION, " ")).alias("chunks"), F.lit("").alias("expected"), F.lit("P9.1").alias("step"), F.array().cast("array<string>").alias("decided"),
    )
    found = validation.findings(rows)
    ok = lambda n: F.get(F.filter("findings", lambda f: f["check"] == n), F.lit(0))["ok"].alias(n)
    return found.select(F.col("id").alias("doc_id"), "status", "downgraded_to", ok("cite_exists"), ok("rating_vs_gaps"), ok("cites_required"))


@query("SELECT source, CASE WHEN max(doc_id % 5) = 4 AND count(*) % 2 = 0 OR count(*) < 9 THEN 'NOT_TESTABLE' ELSE 'SCORED' END AS status FROM documents GROUP BY 1")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max(F.col("doc_id") % 5).alias("m"))
    return rows.select("source", evaluation.status(F.col("n"), 9, (F.col("m") == 4) & (F.col("n") % 2 == 0)).alias("status"))


_CHALLENGE = "x AS (SELECT doc_id k, doc_id % 6 = 0 OR text IS NULL noquote, doc_id % 7 = 0 noelement, doc_id % 8 = 0 nomemory, doc_id % 9 = 0 badaction, doc_id % 10 = 0 norisk, doc_id % 4 = 0 refining, doc_id % 3 = 0 other FROM documents)"


@query(f"WITH {_CHALLENGE} SELECT k AS challenge_id, array_to_string(list_filter([CASE WHEN norisk THEN 'missing risk' END, CASE WHEN badaction THEN 'action' END, CASE WHEN nomemory THEN 'unknown memory' END, CASE WHEN noquote THEN 'quote not in evidence' END, CASE WHEN noelement THEN 'unknown element' END], lambda e: e IS NOT NULL), ',') AS errors, other AND NOT noelement AS repaired, CASE WHEN NOT (norisk OR badaction OR nomemory OR noquote OR noelement) THEN CASE WHEN refining THEN 'weak' ELSE 'strong' END END AS strength FROM x")
def structured_challenges(spark: SparkSession, d: str) -> DataFrame:
    """Challenges that quote documents, each with what is wrong by its number."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.select(
        k.alias("challenge_id"), F.lit("M1").alias("control_id"), "doc_id", F.lit("seen").alias("observation"), F.when(k % 4 == 0, comparison.REFINING[0]).otherwise("so it lacks an owner").alias("inference"), F.lit("who owns it").alias("challenge"),
        F.when(k % 6 == 0, "nobody said this zzz\x01").otherwise(F.regexp_extract("text", r"\S+", 0)).alias("quote"), F.lit("an owner").alias("supported"), F.when(k % 7 == 0, "e9").otherwise("e1").alias("element_id"),
        F.when(k % 3 == 0, "an owner, roughly").otherwise("Name an  owner").alias("requirement"), F.when(k % 10 != 0, "harm").alias("risk"), F.lit("name one").alias("resolution"), F.when(k % 9 == 0, "shout").otherwise("answer").alias("action"), F.lit("high").alias("severity"), F.lit("low").alias("confidence"),
        F.array(F.when(k % 8 == 0, "m9").otherwise("m1")).alias("memory_ids"), F.lit("strong").alias("strength"), F.lit("reviewer").alias("supports"),
    )
    elements = spark.createDataFrame([("M1", "e1", "Name an owner")], "control_id string, element_id string, text string")
    memories = spark.createDataFrame([("m1",)], "memory_id string")
    found = comparison.structured(rows, docs, elements, memories)
    return found.select("challenge_id", F.array_join("errors", ",").alias("errors"), "repaired", "strength")
