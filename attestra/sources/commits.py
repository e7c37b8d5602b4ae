"""A repository's log as records: exported text, parsed in the plan, and ranges of commits.

The export is `git log --name-only --format=%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s`: a record separator before each
commit, unit separators between its fields, then a path a line. Spark reads it record by record, so a log of
any length is many tasks, and no commit is put together from several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of records and of fields; what names a ticket. Fixed values.
RECORD, FIELD, TICKET = "\x1e", "\x1f", r"\b([A-Z]{2,10}-\d+)\b"
FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s"


def under(paths: Column, prefixes: list[str]) -> Column:
    """Whether any path begins with one of the prefixes."""
    if not prefixes:
        return F.lit(False)
    return F.coalesce(F.exists(paths, lambda p: F.array_contains(F.array(*(p.startswith(x) for x in prefixes)), True)), F.lit(False))


def parsed(records: DataFrame, governed: list[str] | None = None, prefix: str = "", ticket: str = TICKET) -> DataFrame:
    """ordinal, commit, author, email, date, message, ticket_ref, paths, touches_governed_paths of records (ordinal, value).

    Paths are made relative to `prefix`, and those elsewhere left out; such a commit has no paths. What isn't a commit is left out.
    """
    head = F.split(F.substring_index("value", "\n", 1), FIELD, 5)
    lines = F.transform(F.split(F.regexp_replace("value", r"^[^\n]*\n?", ""), "\n"), lambda x: F.trim(x))
    paths = F.filter(lines, lambda x: (x != "") & x.startswith(prefix))
    rows = records.where(F.size(head) == 5).select("ordinal", *(F.trim(head[i]).alias(n) for i, n in enumerate(("commit", "author", "email", "date", "message"))), F.transform(paths, lambda x: F.substring(x, len(prefix) + 1, 1 << 20)).alias("paths"))
    named = F.regexp_extract("message", ticket, 1)
    return rows.withColumn("ticket_ref", F.when(named != "", named)).withColumn("touches_governed_paths", under(F.col("paths"), governed or []))


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, value of the records of an exported log, the newest first as the log has them."""
    return spark.read.option("lineSep", RECORD).text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ordinal"), "value")


def git_log(spark: SparkSession, path: str, governed: list[str] | None = None, prefix: str = "", ticket: str = TICKET) -> DataFrame:
    return parsed(log_records(spark, path), governed, prefix, ticket)


def commit_range(commits: DataFrame, since: str | None, until: str | None, first: list[str], second: list[str]) -> DataFrame:
    """Commits after `since` up to `until`, by their place in the log, with touches_both: paths under both lists of prefixes.

    `since` or `until` may be a beginning of an id, or None for the log's ends; an id that isn't in the log gives no commits.
    """
    place = lambda at: commits.where(F.col("commit").startswith(at)).agg(F.min("ordinal").alias("at"))
    rows = commits
    for at, inside in ((since, lambda: F.col("ordinal") < F.col("at")), (until, lambda: F.col("ordinal") >= F.col("at"))):
        if at is not None:
            rows = rows.crossJoin(F.broadcast(place(at))).where(inside()).drop("at")  # one row
    return rows.withColumn("touches_both", under(F.col("paths"), first) & under(F.col("paths"), second))
