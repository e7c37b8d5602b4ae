"""Queries of references, declarations, stored bundles, carried values, labels, commits and state, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import bundles, carry, declared, evaluation, sections, universes
from attestra.plans.shared import fresh_folder
from attestra.registry import query, table
from attestra.sources import commits
from attestra.streaming.logs import KeyedState

# Nested documents and references ------------------------------------------------------------------


@query("SELECT 'meta' AS path, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS total FROM events UNION ALL SELECT 'meta.props', count(*), NULL FROM events UNION ALL SELECT 'meta.props.k', count(*), CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) FROM events UNION ALL SELECT 'kind.' || event_type, count(*), CAST(sum(user_id) AS BIGINT) FROM events GROUP BY event_type UNION ALL SELECT 'kind', count(*), NULL FROM events")
def nested_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every key path of nested events, how many have it and the sum of its numbers."""
    text = F.concat(F.lit('{"meta": {"props": '), "props", F.lit('}, "kind": {"'), "event_type", F.lit('": '), F.col("user_id").cast("string"), F.lit("}}"))
    rows = table(spark, d, "events").select("event_id", F.parse_json(text).alias("doc"))
    paths = universes.flattened(rows, "doc", ["event_id"], levels=4)
    return paths.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.expr("try_cast(value AS bigint)")).alias("total"))


_POLICY = "SELECT 'golden_state.r' || n_regionkey || '.n' || n_nationkey || '.name' p FROM nation UNION SELECT 'r' || n_regionkey || '.n' || n_nationkey || '.name' FROM nation UNION SELECT 'limits.n' || n_nationkey FROM nation"


@query(f"WITH k AS ({_POLICY}), r AS (SELECT CAST(c_custkey AS VARCHAR) o, 'policy' kind, 'r' || (c_custkey % 5) || '.n' || c_nationkey || '.name' ref FROM customer UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'policy', 'limits.n' || (o_custkey % 30) FROM orders UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'supplier', CAST(l_suppkey + l_linenumber AS VARCHAR) FROM lineitem) SELECT kind, ref, CAST(count(*) AS BIGINT) AS uses, CAST(count(DISTINCT o) AS BIGINT) AS owners FROM r WHERE NOT (kind = 'policy' AND ref IN (SELECT p FROM k)) AND NOT (kind = 'supplier' AND ref IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)) GROUP BY 1, 2")
def unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References of three tables to key paths of nested policies, absolute or relative, and to suppliers."""
    n = table(spark, d, "nation")
    policy = F.parse_json(F.concat(F.lit('{"golden_state": {"r'), "n_regionkey", F.lit('": {"n'), "n_nationkey", F.lit('": {"name": "'), "n_name", F.lit('"}}}, "limits": {"n'), "n_nationkey", F.lit('": 1}}')))
    paths = universes.with_relative(universes.flattened(n.select(policy.alias("doc")), "doc", []).select("path").distinct(), "golden_state")
    known = universes.universe("policy", paths, "path").unionByName(universes.universe("supplier", table(spark, d, "supplier"), "s_suppkey"))
    named = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("r"), F.col("c_custkey") % 5, F.lit(".n"), "c_nationkey", F.lit(".name")).alias("ref"))
    limits = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("limits.n"), F.col("o_custkey") % 30)).alias("refs"))
    parts = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") + F.col("l_linenumber")).alias("ref"))
    asked = [universes.references("policy", named, "c_custkey", "ref"), universes.references("policy", limits, "o_orderkey", "refs"), universes.references("supplier", parts, "l_orderkey", "ref")]
    lost = universes.unresolved(reduce(DataFrame.unionByName, asked), known)
    return lost.groupBy("kind", "ref").agg(F.count("*").alias("uses"), F.count_distinct("owner").alias("owners"))


_TESTS = "t AS (SELECT 'M' || c_custkey id, ['critical', 'high', 'medium', 'low', 'none'][CAST(c_nationkey % 5 + 1 AS INT)] sev, [NULL, 'lane_a', 'lane_b', 'hybrid', 'human_only', 'other'][CAST(c_custkey % 6 + 1 AS INT)] mode, 'P' || (c_nationkey % 9) || '.' || (c_custkey % 4) play, CASE WHEN c_acctbal > 5000 THEN ['K' || c_custkey] ELSE [] END packs FROM customer), k AS (SELECT DISTINCT 'K' || o_custkey id, 'M' || (o_custkey + CASE WHEN o_custkey % 10 = 0 THEN 100000000 ELSE 0 END) ctl, 'P' || (o_custkey % 11) || '.1' play FROM orders), s AS (SELECT DISTINCT 'P' || (s_nationkey % 8) || '.' || i step FROM supplier, range(0, 4) r(i))"


@query(
    f"WITH {_TESTS}, g AS (SELECT t.id, list_sort(packs) a, coalesce((SELECT list_sort(list(DISTINCT k.id)) FROM k WHERE k.ctl = t.id), []) b FROM t), "
    "e AS (SELECT 'error' level, id owner, 'unknown play' rule, play about FROM t WHERE play NOT IN (SELECT step FROM s) UNION ALL SELECT 'error', id, 'unknown play', play FROM k WHERE play NOT IN (SELECT step FROM s) UNION ALL SELECT 'error', id, 'unknown control', ctl FROM k WHERE ctl NOT IN (SELECT id FROM t) UNION ALL SELECT 'error', id, 'severity', sev FROM t WHERE sev = 'none' UNION ALL SELECT 'error', id, 'assurance mode', mode FROM t WHERE mode = 'other' UNION ALL SELECT 'error', id, 'critical without assurance mode', '' FROM t WHERE sev = 'critical' AND mode IS NULL UNION ALL SELECT 'error', id, 'critical lane_b without a pack', '' FROM t WHERE sev = 'critical' AND mode = 'lane_b' AND len(packs) = 0 UNION ALL SELECT 'error', id, 'critical human_only with packs', '' FROM t WHERE sev = 'critical' AND mode = 'human_only' AND len(packs) > 0 UNION ALL SELECT 'warning', id, 'stale packs', '-' || array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') || ' +' || array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') FROM g WHERE a <> b) SELECT DISTINCT level, owner, rule, about FROM e"
)
def link_report(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    play = lambda a, b: F.array(F.concat(F.lit("P"), a, F.lit("."), b))
    tests = table(spark, d, "customer").select(
        F.concat(F.lit("M"), key).alias("control_id"),
        pick(["critical", "high", "medium", "low", "none"], nation % 5).alias("severity"),
        pick([None, "lane_a", "lane_b", "hybrid", "human_only", "other"], key % 6).alias("assurance_mode"),
        play(nation % 9, key % 4).alias("play_refs"),
        F.when(F.col("c_acctbal") > 5000, F.array(F.concat(F.lit("K"), key))).otherwise(F.array().cast("array<string>")).alias("lane_b_packs"),
    )
    asked = F.col("o_custkey")
    packs = table(spark, d, "orders").select("o_custkey").distinct().select(
        F.concat(F.lit("K"), asked).alias("pack_id"),
        F.array(F.concat(F.lit("MAS-AIRG-M"), asked + F.when(asked % 10 == 0, 100_000_000).otherwise(0)), F.lit("ISO-1")).alias("framework_refs"),
        play(asked % 11, F.lit("1")).alias("play_refs"),
        F.array(F.lit("limits.days")).alias("policy_refs"),
    )
    steps = table(spark, d, "supplier").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("P"), F.col("s_nationkey") % 8, F.lit("."), i))).alias("step_id")).distinct()
    policy = universes.flattened(spark.sql("SELECT parse_json('{\"limits\": {\"days\": 3}}') AS doc"), "doc", []).select("path")
    return universes.link_report(tests, tests.select("control_id"), packs, steps, tests.select("control_id"), policy)


# Declarations ------------------------------------------------------------------------------------

EVENT_SCHEMA = {
    "type": "object",
    "required": ["id", "kind", "user", "note"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^E-[0-9]{1,3}$"},
        "kind": {"type": "string", "enum": ["click", "view", "purchase"]},
        "user": {"type": "integer", "minimum": 1, "maximum": 100},
        "note": {"type": "string", "minLength": 3},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "k": {"type": "number", "maximum": 50}}}},
    },
}
_K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"
_FAULTS = [
    ("id", "pattern", "event_id > 999"),
    ("kind", "enum", "event_type NOT IN ('click', 'view', 'purchase')"),
    ("user", "minimum", "user_id < 1"),
    ("user", "maximum", "user_id > 100"),
    ("note", "required", "value < 2"),
    ("note", "type", "value >= 2 AND value < 4"),
    ("note", "minLength", "value >= 4 AND value < 6"),
    ("extra", "additionalProperties", "value > 60"),
    ("tags[0].k", "maximum", f"{_K} > 50"),
    ("tags[1].name", "required", f"{_K} % 3 = 0"),
    ("tags[2].name", "required", f"{_K} % 21 = 0"),
    ("tags", "uniqueItems", f"{_K} % 7 = 0"),
]


@query("SELECT path, rule, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS path, '{r}' AS rule, event_id FROM events WHERE {c}" for p, r, c in _FAULTS) + f" UNION ALL SELECT 'id' AS path, 'duplicate' AS rule, event_id FROM events WHERE event_id IN (SELECT event_id - 1 FROM events WHERE {_K} = 1) OR {_K} = 1 AND event_id > 0) GROUP BY 1, 2")
def declaration_errors(spark: SparkSession, d: str) -> DataFrame:
    """Declarations made of events, with faults where the events say so, against a schema and each other."""
    rows = table(spark, d, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    # in a run of events that take the id of the one before, all have the id of the one before the run
    own = F.when(~F.coalesce((k == 1) & (F.col("event_id") > 0), F.lit(False)), F.col("event_id"))
    rows = carry.carried(rows, ["event_id"], own, F.floor(F.col("event_id") / 10_000), "twin")
    twin = F.col("twin")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    note = F.when(F.col("value") < 2, "").when(F.col("value") < 4, ', "note": 7').when(F.col("value") < 6, ', "note": "no"').otherwise(', "note": "noted"')
    first = F.concat(F.lit('{"name": "a", "k": '), k, F.lit("}"))
    second = F.when(k % 3 == 0, '{"k": 1}').otherwise('{"name": "b", "k": 1}')
    tags = F.concat(F.lit(', "tags": ['), first, F.lit(", "), second, F.when(k % 7 == 0, F.concat(F.lit(", "), second)).otherwise(""), F.lit("]"))
    # of events that take the id of the one before, the id's pattern is that one's
    text = F.concat(F.lit('{"id": '), quoted(F.concat(F.lit("E-"), twin)), F.lit(', "kind": '), quoted(F.col("event_type")), F.lit(', "user": '), "user_id", note, tags, F.when(F.col("value") > 60, ', "extra": null').otherwise(""), F.lit("}"))
    found = declared.checked(rows.select("event_id", F.parse_json(text).alias("doc")), "doc", EVENT_SCHEMA, ["id"])
    return found.select("event_id", F.explode("errors").alias("e")).groupBy(F.col("e.path").alias("path"), F.col("e.rule").alias("rule")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


# Bundles and signatures ----------------------------------------------------------------------------


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """A bundle for each supplier: a result for each kind of line that it has; some have been changed since."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", F.concat_ws("-", "l_returnflag", "l_linestatus").alias("control_id")).agg(F.count("*").alias("examined"), F.min("l_linenumber").alias("least"))
    verdict = F.when(F.col("examined") % 3 == 0, "FAIL").when(F.col("least") > 1, "NOT_TESTABLE").otherwise("PASS")
    human = F.when(F.col("examined") % 6 == 0, F.lit("ann"))
    results = lines.select("l_suppkey", F.struct("control_id", "examined", verdict.alias("verdict"), human.alias("human_verdict")).alias("r"))
    rows = results.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("r")).alias("results")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    made = rows.select(F.concat(F.lit("B"), "s_suppkey").alias("bundle_id"), F.lit("2026-01-01").alias("run_at"), F.concat("s_name", F.lit(' "é🙂\n')).alias("note"), "results")
    made = made.withColumn("sha256", bundles.digest(made))
    changed = F.transform("results", lambda r: r.withField("verdict", F.lit("PASS")))
    return made.withColumn("results", F.when(F.substring("sha256", 1, 1).isin("0", "1", "2"), changed).otherwise(F.col("results")))


_RESULTS = "l AS (SELECT l_suppkey s, l_returnflag || '-' || l_linestatus c, count(*) n, min(l_linenumber) m FROM lineitem GROUP BY 1, 2), v AS (SELECT s, c, n, CASE WHEN n % 3 = 0 THEN 'FAIL' WHEN m > 1 THEN 'NOT_TESTABLE' ELSE 'PASS' END v, n % 6 = 0 h FROM l), b AS (SELECT s, sha256('{\"bundle_id\": \"B' || s || '\", \"note\": \"' || s_name || ' \\\"\\u00e9\\ud83d\\ude42\\n\", \"results\": [' || string_agg('{\"control_id\": \"' || c || '\", \"examined\": ' || n || ', \"verdict\": \"' || v || '\"}', ', ' ORDER BY c) || '], \"run_at\": \"2026-01-01\"}') sha, bool_or(v <> 'PASS') more FROM v JOIN supplier ON s = s_suppkey GROUP BY s, s_name), k AS (SELECT s, sha, substring(sha, 1, 1) IN ('0', '1', '2') bad, substring(sha, 1, 1) IN ('0', '1', '2') AND more broken FROM b), z AS (SELECT s, c, n, CASE WHEN bad THEN 'PASS' ELSE v END v, h FROM v JOIN k USING (s))"


@query(f"WITH {_RESULTS} SELECT 'B' || s AS bundle_id, CAST(count(*) AS BIGINT) AS controls, CAST(count(*) FILTER (WHERE v = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE v = 'FAIL') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE v = 'NOT_TESTABLE') AS BIGINT) AS not_testable, CAST(count(*) FILTER (WHERE v <> 'PASS' AND NOT h) AS BIGINT) AS unsigned, NOT any_value(broken) AS intact, any_value(sha) AS sha256 FROM z JOIN k USING (s) GROUP BY s")
def bundle_integrity(spark: SparkSession, d: str) -> DataFrame:
    made = _bundles(spark, d)
    return bundles.summarised(made).drop("run_at").join(made.select("bundle_id", "sha256"), "bundle_id")


@query(
    f"WITH {_RESULTS}, e AS (SELECT 'B' || l_suppkey b, s c, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) t, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'r' || l_linenumber END who, CASE WHEN l_linenumber = 6 THEN 'FINE' ELSE 'ACCEPT' END disp, l_linenumber = 5 w FROM (SELECT *, CASE WHEN l_linenumber = 4 THEN 'none' ELSE l_returnflag || '-' || l_linestatus END s FROM lineitem)), o AS (SELECT e.* FROM e JOIN k ON 'B' || k.s = e.b JOIN z ON z.s = k.s AND z.c = e.c WHERE w OR (NOT broken AND trim(who) <> '' AND disp = 'ACCEPT')), f AS (SELECT b, c, max(t) t, arg_max(who, t) who, arg_max(w, t) w FROM o GROUP BY 1, 2) SELECT 'B' || z.s AS bundle_id, z.c AS control_id, z.v AS verdict, CASE WHEN NOT w THEN who END AS reviewer, CASE WHEN NOT w THEN t END AS signed_at FROM z LEFT JOIN f ON f.b = 'B' || z.s AND f.c = z.c"
)
def signed_results(spark: SparkSession, d: str) -> DataFrame:
    """Results with the signatures that stand, from an append-only register that also holds refused and withdrawn ones."""
    line = F.col("l_linenumber")
    entries = table(spark, d, "lineitem").select(
        F.concat(F.lit("B"), "l_suppkey").alias("bundle_id"),
        F.when(line == 4, "none").otherwise(F.concat_ws("-", "l_returnflag", "l_linestatus")).alias("control_id"),
        (F.col("l_orderkey") * 10 + line).alias("at"),
        F.when(line == 7, " ").otherwise(F.concat(F.lit("r"), line)).alias("reviewer"),
        F.when(line == 6, "FINE").otherwise("ACCEPT").alias("disposition"),
        (line == 5).alias("withdrawn"),
    )
    return bundles.signed(_bundles(spark, d), entries).drop("disposition")


@query("SELECT user_id AS run, CAST(count(*) AS BIGINT) AS n_parts, sha256('{' || string_agg(x, ', ' ORDER BY x) || '}') AS assessment_id FROM (SELECT DISTINCT user_id, '\"' || event_type || '-' || regexp_extract(props, '[0-9]+') || '\": ' || CASE WHEN event_type = 'error' THEN 'null' ELSE '\"' || sha256(props) || '\"' END x FROM events) GROUP BY 1")
def assessment_identities(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0)
    parts = table(spark, d, "events").select(F.col("user_id").alias("run"), F.concat_ws("-", "event_type", k).alias("part"), F.when(F.col("event_type") != "error", F.sha2("props", 256)).alias("value"))
    return bundles.assessment_ids(parts)


@query("WITH a AS (SELECT c_custkey k, c_mktsegment t FROM customer), d AS (SELECT DISTINCT o_orderpriority g, o_custkey + CASE WHEN o_custkey % 9 = 0 THEN 1000000000 ELSE 0 END k, CASE WHEN o_custkey % 4 = 0 THEN 'new' END t FROM orders), s AS (SELECT g, d.k, coalesce(d.t, a.t, 'new') t, a.t l FROM d LEFT JOIN a USING (k)) SELECT g AS draft_id, CAST(count(*) FILTER (WHERE l IS NULL) AS BIGINT) AS added, CAST((SELECT count(*) FROM a) - count(l) AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE l <> t) AS BIGINT) AS changed, CAST(count(*) AS BIGINT) AS controls, CASE g WHEN '1-URGENT' THEN 'no source_title' WHEN '2-HIGH' THEN 'no approver,no ticket' ELSE '' END AS problems FROM s GROUP BY 1")
def draft_changes(spark: SparkSession, d: str) -> DataFrame:
    """What drafts of requirements change, and which can be promoted."""
    live = table(spark, d, "customer").select(F.col("c_custkey").alias("control_id"), F.col("c_mktsegment").alias("text"))
    key = F.col("o_custkey") + F.when(F.col("o_custkey") % 9 == 0, 1_000_000_000).otherwise(0)
    said = table(spark, d, "orders").select(F.col("o_orderpriority").alias("draft_id"), key.alias("control_id"), F.when(F.col("o_custkey") % 4 == 0, "new").alias("_new")).distinct()
    said = said.join(live.withColumnRenamed("text", "_was"), "control_id", "left").select("draft_id", "control_id", F.coalesce("_new", "_was", F.lit("new")).alias("text"))
    changes = bundles.draft_changes(live, said)
    drafts = said.select("draft_id").distinct().select("draft_id", F.lit("draft").alias("status"), F.when(F.col("draft_id") != "1-URGENT", "Notice").alias("source_title"), F.lit("N1").alias("source_reference"), F.lit("1").alias("base_version"))
    approvals = drafts.where("draft_id <> '2-HIGH'").select("draft_id", F.lit("ann").alias("approved_by"), F.lit("T-1").alias("ticket"))
    judged = bundles.promotable(drafts, changes, approvals).select("draft_id", F.array_join("problems", ",").alias("problems"))
    return changes.join(judged, "draft_id")


# Order and time ------------------------------------------------------------------------------------


@query("WITH e AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN user_id END v FROM events) SELECT play, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) play FROM e) GROUP BY 1")
def carried_values(spark: SparkSession, d: str) -> DataFrame:
    """Each event belongs to the user of the last purchase, over all events in order."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    filled = carry.carried(rows, ["event_id"], F.when(F.col("event_type") == "purchase", F.col("user_id")), F.floor(F.col("event_id") / 500), "play")
    return filled.groupBy("play").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_RUN_CASES = "SELECT 'R' || (event_id // 1000 % 3) run, (event_id % 1000 + 1000 * (event_id // 3000)) // 2 c, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'none' ELSE 'full' END got FROM events"


@query(f"WITH r AS (SELECT *, CASE WHEN c % 2 = 0 THEN 'full' ELSE 'none' END want FROM ({_RUN_CASES})), g AS (SELECT run, c, min(coalesce(got, '')) <> max(coalesce(got, '')) q, bool_and(coalesce(got = want, false)) ok FROM r GROUP BY 1, 2), m AS (SELECT max(run) newest FROM r), p AS (SELECT max(run) prior FROM r, m WHERE run < newest) SELECT n.c AS case_id, b.ok AND NOT b.q AS incumbent_agree, n.ok AND NOT n.q AS challenger_agree, n.q AS quarantined, coalesce(b.ok AND NOT b.q AND NOT n.ok AND NOT n.q, false) AS regressed FROM g n JOIN m ON n.run = newest LEFT JOIN (SELECT g.* FROM g JOIN p ON run = prior) b ON b.c = n.c")
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.col("event_id")
    run = F.concat(F.lit("R"), F.floor(n / 1000) % 3)
    case = F.floor((n % 1000 + 1000 * F.floor(n / 3000)) / 2)
    got = F.when(F.col("event_type") == "error", F.lit(None).cast("string")).when(F.col("event_type") == "click", "none").otherwise("full")
    rows = e.select(run.alias("run_id"), run.alias("run_at"), F.lit("c").alias("corpus_sha"), case.alias("case_id"), F.lit(0).alias("run_index"), F.when(case % 2 == 0, "full").otherwise("none").alias("want"), got.alias("got"))
    return evaluation.compared_runs(rows).select("case_id", "incumbent_agree", "challenger_agree", "quarantined", "regressed")


@query("WITH p AS (SELECT o_orderkey k, o_custkey, string_agg(CASE l_returnflag WHEN 'R' THEN 'assess/' WHEN 'A' THEN 'corpus/' ELSE 'docs/' END || l_linenumber, '|' ORDER BY l_linenumber, l_returnflag) ps, bool_or(l_returnflag = 'R') r, bool_or(l_returnflag = 'A') a FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT k AS commit, CASE WHEN o_custkey % 3 = 0 THEN 'TCK-' || o_custkey END AS ticket_ref, ps AS paths, coalesce(r AND a, false) AS touches_both, coalesce(r, false) AS touches_governed_paths FROM p WHERE k <= (SELECT max(k) - 50 FROM p) AND k > 100")
def commit_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A log made of orders, the newest first, parsed from its text, and the commits of a range that touch what must be kept apart."""
    path = F.concat(F.when(F.col("l_returnflag") == "R", "src/assess/").when(F.col("l_returnflag") == "A", "src/corpus/").otherwise("src/docs/"), "l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", path.alias("p")))), lambda x: x["p"]), "\n").alias("paths"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    subject = F.concat(F.lit("Change"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit(" for TCK-"), "o_custkey")).otherwise(""))
    text = F.concat(F.concat_ws(commits.FIELD, F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("Ann"), F.lit("a@b.c"), F.date_format("o_orderdate", "yyyy-MM-dd"), subject), F.lit("\n\n"), F.coalesce("paths", F.lit("")), F.lit("\nother/file\n"))
    log = commits.parsed(orders.select((-F.col("o_orderkey")).alias("ordinal"), text.alias("value")), ["assess/"], "src/")
    ends = table(spark, d, "orders").agg(F.max("o_orderkey").alias("m"), F.max(F.when(F.col("o_orderkey") <= 100, F.col("o_orderkey"))).alias("l")).first()
    last = table(spark, d, "orders").where(F.col("o_orderkey") <= ends.m - 50).agg(F.max("o_orderkey")).first()[0]
    found = commits.commit_range(log, f"{ends.l:012d}", f"{last:012d}", ["assess/"], ["corpus/"])
    return found.select(F.col("commit").cast("long").alias("commit"), "ticket_ref", F.when(F.size("paths") > 0, F.array_join("paths", "|")).alias("paths"), "touches_both", "touches_governed_paths")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) k FROM events) WHERE k = 1")
def folded_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, from a log of three batches that are folded one by one, one of them twice."""
    log = table(spark, d, "events").select("event_id", "user_id", "event_type")
    state = KeyedState(spark, fresh_folder(spark, "state"), ["user_id"], "event_id", 8)
    for number, kinds in enumerate((["view"], ["click", "error"], ["click", "error"], ["purchase"])):
        state.fold(log.where(F.col("event_type").isin(kinds)), "log", min(number, 1) if number < 3 else 2)
    rest = log.where(~F.col("event_type").isin("view", "click", "error", "purchase"))
    state.fold(rest, "log", 3)
    return state.read()


# Labels in Markdown ---------------------------------------------------------------------------------


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of labelled documents: a control for each source, a case for each document, three elements each."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    mark = lambda on, off: F.when(on, "Y").when(off, "n/a").otherwise("N")
    n = F.col("doc_id")
    cells = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(f"e{i}").alias("element_id"), v.alias("value")) for i, v in enumerate((mark(F.col("quality") == 1, n % 5 == 0), mark(F.col("toxic") == 0, n % 7 == 0), mark(n % 2 == 0, n % 3 == 0)))))
    return rows.select(F.col("source").alias("control_id"), n.cast("string").alias("case_id"), F.explode(cells).alias("x")).select("control_id", "case_id", "x.*")


_CELLS = "d AS (SELECT source, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, doc_id, CASE WHEN quality = 1 THEN 'Y' WHEN doc_id % 5 = 0 THEN 'n/a' ELSE 'N' END v FROM d UNION ALL SELECT source, doc_id, CASE WHEN toxic = 0 THEN 'Y' WHEN doc_id % 7 = 0 THEN 'n/a' ELSE 'N' END FROM d UNION ALL SELECT source, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Y' WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'N' END FROM d), l AS (SELECT source, doc_id, CASE WHEN count(*) FILTER (WHERE v <> 'n/a') = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE v = 'N') = 0 THEN 'full' WHEN count(*) FILTER (WHERE v = 'Y') = 0 THEN 'none' ELSE 'partial' END label FROM c GROUP BY 1, 2)"


@query(f"WITH {_CELLS} SELECT source AS control_id, CAST(doc_id AS VARCHAR) AS case_id, label AS derived, CASE WHEN doc_id % 11 = 0 OR label = 'unknown' THEN NULL WHEN doc_id % 13 = 0 THEN 'none' ELSE label END AS written, CASE WHEN doc_id % 11 = 0 OR label = 'unknown' THEN 'missing' WHEN doc_id % 13 = 0 AND label <> 'none' THEN 'stale' ELSE 'current' END AS state FROM l")
def label_drift(spark: SparkSession, d: str) -> DataFrame:
    """Labels rendered as Markdown and then changed or cut out in places, read back and held against the elements."""
    elements = _elements(spark, d)
    texts = sections.rendered(elements)
    parts = sections.sections(texts, ["control_id"])
    case = F.regexp_extract("heading", sections.CASE, 1).try_cast("long")  # a case without a label has none
    heading = F.when(case % 13 == 0, F.regexp_replace("heading", r"\*\*(full|partial|none)\*\*", "**none**")).otherwise(F.col("heading"))
    kept = parts.where("level = 3").where(F.coalesce(case % 11 != 0, F.lit(True))).select("control_id", "ordinal", F.concat(F.lit("### "), heading, F.lit("\nmentions `x_1` as **full** in passing\n"), "body").alias("part"))
    again = kept.groupBy("control_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return sections.label_drift(elements, again)


@query(f"WITH {_CELLS} SELECT source AS control_id, label, CAST(count(*) AS BIGINT) AS cases FROM l WHERE label <> 'unknown' GROUP BY 1, 2")
def rendered_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as they read in the Markdown that is rendered from elements."""
    return sections.written_labels(sections.rendered(_elements(spark, d)), ["control_id"]).groupBy("control_id", "label").agg(F.count("*").alias("cases"))
