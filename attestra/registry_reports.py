"""Queries of reports and knowledge, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators import reports, retrieval
from attestra.registry import _BM25, PACK_SQL, asked, pack, passages, query, table

_LABELS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_-]{{2,}}'))"
_TIER = "CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 99 END"


@query(f"WITH i AS (SELECT doc_id id, source, {_TIER} tier, CASE WHEN lang = 'fr' THEN 3 ELSE 0 END bonus, unnest({_LABELS.format('text')}) w FROM documents), n AS (SELECT doc_id id, source, {_TIER} tier, CASE WHEN lang = 'fr' THEN 3 ELSE 0 END bonus FROM documents), q AS (SELECT item_id query_id, 'src' || (item_id % 20) key, unnest({_LABELS.format(chr(39) + 'src' + chr(39) + ' || (item_id % 20) || ' + chr(39) + ' ' + chr(39) + ' || text')}) w FROM benchmark), o AS (SELECT query_id, id, count(*) c FROM q JOIN i USING (w) GROUP BY 1, 2), m AS (SELECT item_id query_id, id FROM benchmark, n WHERE source = 'src' || (item_id % 20) OR id = 0), s AS (SELECT query_id, id, coalesce(c, 0) + CASE WHEN m.id IS NOT NULL THEN 8 ELSE 0 END x FROM o FULL JOIN m USING (query_id, id)), r AS (SELECT query_id, id, x + bonus score, row_number() OVER (PARTITION BY query_id ORDER BY x + bonus DESC, tier, id DESC) k FROM s JOIN n USING (id)) SELECT query_id, id, CAST(score AS BIGINT) AS score, CAST(k AS INT) AS rank FROM r WHERE k <= 5")
def memories_for_challenger(spark: SparkSession, d: str) -> DataFrame:
    """Documents as memories: French ones are challenge patterns, the first one is of all controls."""
    k = F.col("doc_id")
    tier = F.element_at(F.array(*map(F.lit, [*reports.TIERS, "hearsay"])), (k % 6 + 1).cast("int"))
    rows = table(spark, d, "documents").select(k.alias("id"), F.when(F.col("lang") == "fr", "challenge_pattern").otherwise("precedent").alias("type"), tier.alias("authority_tier"), F.when(k == 0, F.array(F.lit("*"))).otherwise(F.array("source")).alias("controls"), "text")
    queries = asked(spark, d).withColumn("key", F.concat(F.lit("src"), F.col("query_id") % 20))
    # of the one of all controls, its own source doesn't count
    return reports.memories_for(rows, queries, "challenger").withColumn("score", F.col("score").cast("long"))


_TRACE = _BM25.replace("k <= 6", "k <= 10")


@query(f"SELECT t.query_id, item_id % 3 AS library, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-\\.]{{1,}}'))) AS INT) AS query_terms, rank, id, round(score, 4) AS score, rank <= 6 AS within_k, score >= 18 AS passes_shown FROM ({_TRACE}) t JOIN benchmark ON item_id = t.query_id")
def threshold_trace(spark: SparkSession, d: str) -> DataFrame:
    p, q = passages(spark, d), asked(spark, d)
    return reports.threshold_trace(retrieval.bm25_top(p, q, 10).withColumn("score", F.round("score", 6)), q.withColumn("library", F.col("query_id") % 3), 6, 10)


@query("WITH r AS (SELECT user_id n, count(*) FILTER (WHERE event_type = 'error') f, count(*) c, max(ts) m FROM events GROUP BY 1), j AS (SELECT *, strftime(m, '%Y-%m-%dT%H:%M:%S') t FROM r) SELECT n, CASE WHEN n % 4 = 0 THEN 'H' || n ELSE 'named ' || n END AS hotspot, substring(t, 1, 10) AS last_run, CASE WHEN f > 0 THEN 'Fail' ELSE 'Pass' END AS result, strftime(CAST(substring(t, 1, 10) AS DATE) + CAST(CASE WHEN n % 4 = 0 THEN 100 ELSE 30 + n % 5 END AS INTEGER), '%Y-%m-%d') AS next_run, substring(sha256('{\"cases\": ' || c || ', \"engine\": \"own\", \"failed\": ' || f || ', \"hotspot\": \"H' || n || '\", \"n\": ' || n || ', \"residual_risk\": \"High\", \"result\": \"' || CASE WHEN f > 0 THEN 'Fail' ELSE 'Pass' END || '\", \"run_at\": \"' || t || '\"}'), 1, 16) AS evidence FROM j")
def tracker_proposals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("n")).agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("cases"), F.max("ts").alias("m"))
    results = e.select("n", F.concat(F.lit("H"), "n").alias("hotspot"), F.date_format("m", "yyyy-MM-dd'T'HH:mm:ss").alias("run_at"), F.lit("own").alias("engine"), "failed", "cases", F.when(F.col("failed") > 0, "Fail").otherwise("Pass").alias("result"), F.lit("High").alias("residual_risk"), F.lit("note").alias("note"))
    tracker = e.where("n % 4 <> 0").select("n", F.concat(F.lit("named "), "n").alias("hotspot"), (30 + F.col("n") % 5).alias("max_days"))
    return reports.tracker_proposals(results, tracker).select("n", "hotspot", "last_run", "result", "next_run", "evidence")


@query(f"WITH r AS ({PACK_SQL}) SELECT 'controls' AS part, CASE WHEN count(*) FILTER (WHERE verdict = 'FAIL') > 0 THEN 'BLOCKED' ELSE 'PASS' END AS status, CAST(count(*) FILTER (WHERE verdict = 'FAIL') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS rows FROM r UNION ALL SELECT 'documents', CASE WHEN count(*) FILTER (WHERE text = '') > 0 THEN 'BLOCKED' ELSE 'PASS' END, count(*) FILTER (WHERE text = ''), count(*) FROM documents UNION ALL SELECT 'late lines', 'BLOCKED', count(*), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'nothing', 'INCONCLUSIVE', 0, 0")
def status_report(spark: SparkSession, d: str) -> DataFrame:
    docs, lines = table(spark, d, "documents"), table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [("controls", pack(spark, d), F.col("verdict") == "FAIL"), ("documents", docs, E.empty(F.col("text"))), ("late lines", lines.where("l_shipdate < o_orderdate"), F.lit(True)), ("nothing", docs.where("false"), F.lit(True))]
    return reports.status_report(parts).drop("ordinal")
