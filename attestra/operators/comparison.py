"""Two readings of one control, element by element; and the challenges that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators import text as X

#: Words for a status, each made the first of its row. Fixed values.
STATUS_WORDS = {"met": ["met", "evidenced", "yes", "pass", "satisfied"], "not_evidenced": ["not_evidenced", "not evidenced", "not met", "not_met", "no", "fail", "missing"], "not_applicable": ["not_applicable", "not applicable", "n/a", "na"]}
#: Words by which a rebuttal says that it isn't one. Fixed values.
REFINING = ["does not contradict", "does not rebut", "does not demonstrate", "does not establish", "does not overturn", "not sufficient to rebut", "not enough to rebut"]


def status_of(c: Column, unknown: str = "unset") -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    cases: list[tuple[Column, Column | str]] = [(low.isin(words), word) for word, words in STATUS_WORDS.items()]
    return E.one_of([*cases, (low.isin("", "unset", "?"), "unset")], F.lit(unknown))


def readings(verdicts: DataFrame) -> DataFrame:
    """control_id, element_id, status, excerpt of a reading; of repeated elements, the last (ordinal) counts."""
    last = F.max_by(F.struct("status", "excerpt"), "ordinal")
    rows = verdicts.groupBy("control_id", "element_id").agg(last.alias("x"))
    return rows.select("control_id", "element_id", status_of(F.col("x.status")).alias("status"), F.coalesce("x.excerpt", F.lit("")).alias("excerpt"))


def aligned(elements: DataFrame, reviewer: DataFrame, assessor: DataFrame) -> DataFrame:
    """Each declared element (control_id, element_id) with both statuses; unset is not agreement."""
    side = lambda df, name: readings(df).select("control_id", "element_id", F.col("status").alias(name))
    rows = elements.select("control_id", "element_id").join(side(reviewer, "reviewer"), ["control_id", "element_id"], "left").join(side(assessor, "assessor"), ["control_id", "element_id"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("unset")) for c in ("reviewer", "assessor")})
    compared = (F.col("reviewer") != "unset") & (F.col("assessor") != "unset")
    return rows.withColumn("compared", compared).withColumn("agrees", F.when(compared, F.col("reviewer") == F.col("assessor")))


def agreement(rows: DataFrame, min_compared: int = 3) -> DataFrame:
    """control_id, counts and rate of aligned rows; the rate is null below a least number compared."""
    counts = rows.groupBy("control_id").agg(
        F.count("*").alias("n_elements"),
        F.count_if("compared").alias("n_compared"),
        F.count_if("agrees").alias("n_agree"),
        F.count_if(F.col("reviewer") == "unset").alias("reviewer_unset"),
        F.count_if(F.col("assessor") == "unset").alias("assessor_unset"),
        F.array_sort(F.collect_list(F.when(F.col("agrees") == F.lit(False), F.col("element_id")))).alias("disagreements"),
    )
    rate = F.when(F.col("n_compared") >= min_compared, E.half_even(F.col("n_agree") / F.col("n_compared"), 3))
    return counts.withColumn("agreement_rate", rate)


def headline(counts: DataFrame) -> DataFrame:
    """counts with a sentence of them."""
    rate = F.when(F.col("agreement_rate").isNull(), F.lit("too few compared for a rate")).otherwise(F.format_string("%.0f%% agreement", F.col("agreement_rate") * 100))
    return counts.withColumn("headline", F.concat(rate, F.format_string(" (%d of %d compared, %d elements)", "n_agree", "n_compared", "n_elements")))


def scoped(challenges: DataFrame, disputed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Challenges on disputed elements (control_id, element_id), and a row with how many went."""
    kept = challenges.join(disputed.select("control_id", "element_id").distinct(), ["control_id", "element_id"], "left_semi")
    dropped = challenges.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("dropped"))
    return kept, dropped


def rebuttals(challenges: DataFrame) -> DataFrame:
    """challenges with strength settled, substantive (whether it is strong) and errors listed.

    Columns: claim, fact_meaning, rebuttal, strength, risk (the claim's test), observation, inference,
    risk_to_address and what_it_supports (said elsewhere, used where the test lacks them; may be absent),
    quote, fact, supports. An unknown strength is weak; a strong one with a part lacking, or whose
    rebuttal says that it isn't one, is weak; any without a quote or a fact is rejected.
    """
    has = set(challenges.columns)
    said = lambda *names: F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for n in names if n in has for c in [F.col(n).cast("string")]), F.lit(""))
    parts = {"claim": said("claim", "observation"), "fact_meaning": said("fact_meaning", "what_it_supports"), "rebuttal": said("rebuttal", "inference"), "risk": said("risk", "risk_to_address")}
    lacking = {n: c == "" for n, c in parts.items()}
    quote, fact, asked = said("quote"), said("fact"), said("strength")
    refines = F.lower(parts["rebuttal"]).rlike("|".join(REFINING))
    part_lacks = reduce(Column.__or__, lacking.values())
    strength = F.when((quote == "") | (fact == ""), "rejected").when(asked == "rejected", "rejected").when((asked == "strong") & ~part_lacks & ~refines, "strong").otherwise("weak")
    found = [*((n, c) for n, c in lacking.items()), ("quote", quote == ""), ("fact", fact == "")]
    errors = F.array_compact(F.array(*(F.when(c, F.lit(f"{n} missing")) for n, c in found), F.when(~asked.isin("strong", "weak", "rejected"), F.lit("unknown strength"))))
    supports = F.lower(said("supports"))
    rows = challenges.withColumns({**parts, "strength": strength, "errors": errors, "supports": F.when(supports.isin("reviewer", "assessor"), supports).otherwise("neither")})
    return rows.withColumn("substantive", F.col("strength") == "strong")


#: What a challenge may ask for, and how sure or grave it may be. Fixed values.
ACTIONS = ["answer", "request_evidence", "revisit_read", "escalate"]
GRAVE, SURE = ["low", "medium", "high", "critical"], ["low", "medium", "high"]


def structured(challenges: DataFrame, evidence: DataFrame, elements: DataFrame, memories: DataFrame) -> DataFrame:
    """Challenges with errors (what keeps each from being taken), where their quotes are, and requirements as they read.

    challenges: challenge_id, control_id, doc_id (the evidence), observation, inference, challenge, quote, supported (what
    the quote shows), element_id, requirement, risk, resolution, action, severity, confidence, memory_ids (array), strength,
    supports and claim parts as rebuttals() takes them. evidence: doc_id, text; elements: control_id, element_id, text; memories: memory_id.

    A quote must be found in its document: `locator` says where. An element must be the control's: its text is the
    requirement, whatever the challenge wrote; `repaired` says that this differed. A challenge with errors has no strength.
    """
    known = elements.select("control_id", "element_id", F.col("text").alias("_said"))
    unknown = challenges.select("challenge_id", F.explode("memory_ids").alias("memory_id")).join(memories.select("memory_id"), "memory_id", "left_anti")
    unknown = unknown.groupBy("challenge_id").agg(F.count("*").alias("_unknown"))
    found = X.located(evidence, challenges.select(F.col("challenge_id").alias("quote_id"), "doc_id", "quote")).select(F.col("quote_id").alias("challenge_id"), "locator")
    rows = challenges.join(known, ["control_id", "element_id"], "left").join(unknown, "challenge_id", "left").join(found, "challenge_id", "left")
    lacks = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    outside = lambda c, words: ~F.coalesce(F.col(c).isin(words), F.lit(False))
    rules = [(f"missing {c}", lacks(c)) for c in ("observation", "inference", "challenge", "risk", "resolution")]
    rules += [("action", outside("action", ACTIONS)), ("severity", outside("severity", GRAVE)), ("confidence", outside("confidence", SURE)), ("unknown memory", F.col("_unknown").isNotNull()), ("quote not in evidence", F.col("locator").isNull()), ("unknown element", F.col("_said").isNull())]
    listed = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))
    said = {"fact": F.when(F.col("locator").isNotNull(), F.col("quote")), "what_it_supports": F.col("supported"), "risk_to_address": F.col("risk")}
    judged = rebuttals(rows.withColumns(said)).withColumnRenamed("errors", "weaknesses").withColumn("errors", listed)
    repaired = F.col("_said").isNotNull() & (E.plain(F.col("_said")) != E.plain(F.col("requirement")))
    strength = F.when(F.size("errors") == 0, F.col("strength"))
    kept = [c for c in challenges.columns if c not in ("requirement", "strength")]
    return judged.select(*kept, F.coalesce("_said", "requirement").alias("requirement"), repaired.alias("repaired"), "locator", "errors", "weaknesses", strength.alias("strength"))


def outcomes(challenges: DataFrame) -> DataFrame:
    """control_id, tally of settled challenges and outcome: substantive, weak_or_refining or no_rebuttal."""
    n = lambda c: F.count_if(c)
    counts = challenges.groupBy("control_id").agg(n(F.col("strength") == "strong").alias("strong"), n(F.col("strength") == "weak").alias("weak"), n(F.col("supports") == "reviewer").alias("for_reviewer"), n(F.col("supports") == "assessor").alias("for_assessor"), n(F.col("supports") == "neither").alias("for_neither"))
    return counts.withColumn("outcome", F.when(F.col("strong") > 0, "substantive").when(F.col("weak") > 0, "weak_or_refining").otherwise("no_rebuttal"))


def dossier_status(dossiers: DataFrame) -> DataFrame:
    """dossiers with status from their challenges (array of structs with response): no_challenges, open, partially_addressed or closed."""
    size = F.size(F.coalesce("challenges", F.array().cast(dossiers.schema["challenges"].dataType)))
    answered = F.size(F.filter("challenges", lambda c: c["response"].isNotNull()))
    return dossiers.withColumn("status", F.when(size <= 0, "no_challenges").when(answered == 0, "open").when(answered < size, "partially_addressed").otherwise("closed"))


def resolution(items: DataFrame) -> DataFrame:
    """Of each id, the resolution that fits: the one supplied, else an exact failure mode, else the one with most words shared (the first of ties), else empty.

    Columns: id, supplied, mode, text, options (array of failure_mode, text).
    """
    stop = F.array(*map(F.lit, ["that", "this", "with", "from", "have", "been", "were", "they", "will", "their", "which", "there", "does", "into"]))
    words = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{4,}"), F.lit(0))), stop)
    exact = F.get(F.filter("options", lambda o: E.plain(o["failure_mode"]) == E.plain(F.col("mode"))), F.lit(0))["text"]
    mine = words(F.concat_ws(" ", "mode", "text"))
    scored = F.transform("options", lambda o, i: F.struct(F.size(F.array_intersect(mine, words(F.concat_ws(" ", o["failure_mode"], o["text"])))).alias("n"), (-i).alias("i"), o["text"].alias("t")))
    best = F.array_max(scored)
    return items.select("id", F.coalesce(F.when(F.trim("supplied") != "", F.col("supplied")), F.when(F.trim(F.coalesce("mode", F.lit(""))) != "", exact), F.when(best["n"] > 0, best["t"]), F.lit("")).alias("resolution"))
