"""License scans by canonical digests (operator 10), in DataFrame operations alone.

A text is made canonical: lower case, no lines of copyright claims or reserved rights, punctuation and white space to
single spaces, equivalent spellings made one. Texts whose canonical forms have equal sha256 are the
same licence. Whole documents, and each of their lines and paragraphs (divided by lines without
letters or digits) as a text of its own, are joined by that digest with the known licences: notices,
full texts, and the paragraphs that only one full text has (licence_catalogue.py); those lists
are parameters, bounded by what a caller writes down. All that needs a look at every
character is done once for a document; spelling and digests only for texts that begin with a
word with which some known text, or another spelling of it, begins: no other can match.

A null or empty text, or one of nothing but copyright lines, matches nothing: licences is then an
empty string. Rows with equal doc_id share what any of them matches; a null doc_id matches nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licence_catalogue as catalogue
from .common import table

#: Equivalent spellings, each made the second. Fixed values.
SPELLINGS: list[tuple[str, str]] = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("noncommercial", "non commercial"), ("merchantibility", "merchantability"), ("v 2 0", "version 2 0"), ("http", "https")]
#: A line that claims copyright: the word or sign, then a year or a holder.
COPYRIGHT = r"(?m)^[\s#/*;.-]*(?:all rights reserved[. \t\r]*(?:\n|$)|(?:copyright\s*(?:\(c\)|©|by\b|:|,)?\s*(?:\(c\)|©|by\b|[0-9]{4})|\(c\)\s*[0-9]{4}|©)[^\n]*\n?)"
#: Runs of anything that isn't part of a word, but for line ends.
BLANKS = r"[ \t\r\x0B\f\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E‘’“”–—©]+"


def flat(text: Column) -> Column:
    """Lower case without copyright lines, its words a space apart, its lines kept."""
    low = F.lower(text)
    claims = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")
    return F.regexp_replace(F.when(claims, F.regexp_replace(low, COPYRIGHT, "")).otherwise(low), BLANKS, " ")


def spelled(words: Column) -> Column:
    """The canonical form of a flat text."""
    out = F.concat(F.lit(" "), F.regexp_replace(words, r"\s+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def first_words(canonical: list[str]) -> list[str]:
    """Words with which a flat text may begin if its canonical form is one of these."""
    words = {c.split(" ")[0] for c in canonical if c}
    while more := {a.split(" ")[0] for a, b in SPELLINGS if b.split(" ")[0] in words} - words:
        words |= more
    return sorted(words)


def scanned(docs: DataFrame, known: Sequence[tuple[str, str]] | None = None, sections: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, licences (names in order, comma-joined), n_matches (texts that match), whole (name, if the whole document is a known text rather than a section)."""
    spark = docs.sparkSession
    known = catalogue.known() if known is None else known
    sections = catalogue.sections() if sections is None else sections
    given = spark.createDataFrame([(n, t, True) for n, t in known] + [(n, t, False) for n, t in sections], "licence string, text string, entire boolean")
    listed = given.groupBy("licence", spelled(flat(F.col("text"))).alias("c")).agg(F.bool_or("entire").alias("entire")).collect()  # as the caller wrote down
    digests = spark.createDataFrame([(r.licence, r.c, r.entire) for r in listed if r.c], "licence string, c string, entire boolean").select("licence", F.sha2("c", 256).alias("digest"), "entire")
    begins = first_words([r.c for r in listed])
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.explode(F.array(flat(F.col("text")))).alias("t"))
    fits = lambda p: F.substring_index(F.ltrim(p), " ", 1).isin(begins)
    part = lambda p, whole: F.struct(F.lit(whole).alias("all"), p.alias("part"))
    none = F.array().cast("array<string>")
    lines = F.filter(F.when(F.col("t").contains("\n"), F.split("t", "\n")).otherwise(none), fits)
    several = F.filter(F.when(F.col("t").rlike("\n ?\n"), F.filter(F.split("t", "\n ?(?=\n)"), lambda p: F.trim(F.regexp_replace(p, "^\\s+|\\s+$", "")).contains("\n"))).otherwise(none), lambda p: fits(F.translate(p, "\n", " ")))
    whole = F.filter(F.array(F.col("t")), lambda p: fits(F.translate(F.substring(F.regexp_replace(p, "^\\s+", ""), 1, 2 + max(map(len, begins), default=0)), "\n", " ")))
    parts = texts.select("doc_id", F.explode(F.concat(F.transform(whole, lambda p: part(p, True)), F.transform(lines, lambda p: part(p, False)), F.transform(several, lambda p: part(p, False)))).alias("p"))
    found = parts.select("doc_id", "p.all", F.sha2(spelled(F.col("p.part")), 256).alias("digest")).join(F.broadcast(digests), "digest")
    by_doc = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.count("*").alias("n_matches"), F.min(F.when(F.col("all") & F.col("entire"), F.col("licence"))).alias("whole"))
    out = docs.select("doc_id").join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "whole")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
