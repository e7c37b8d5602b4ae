"""Control contracts: what a control's text and declaration say, as columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import exprs as E

#: Fields in which a decision's place is noted, by preference, and how much of it is shown. Fixed values.
WHERE_FIELDS, WHERE_MOST = ["where", "why", "note", "evidence"], 150
#: Names under which a framework is asked for. Fixed values.
FRAMEWORKS = {"MGF_Agentic": "MGF Agentic", "ISO42001": "ISO 42001", "NIST_AI_RMF": "NIST AI RMF"}
LEVELS = ["none", "partial", "full"]
#: How cells are written: the fields of a play's header, the ids of test steps and of elements, an element's
#: scope, and where a requirement's sentences and clauses end. Fixed values.
HEADER_FIELDS = ["Trigger", "Frequency", "Owner", "Exit gate"]
STEP_ID, ELEMENT_ID, SCOPE = r"^[DO]\d+", r"^e\d+\.", r"\s\[([^\]]+)\]$"
SENTENCE_END, CLAUSE_END, LEAST_CLAUSE = r"(?<=[.;])\s+", r",\s+and\s+|,\s+(?=which\b|that\b)", 12


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def bare_id(c: Column) -> Column:
    """A control's id without its star."""
    return F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("★"), F.lit("")))


def header_field(header: Column, name: str) -> Column:
    """What a play's header says after a field's name: of the parts that bars divide, the first that begins with or holds it; a bar before no field divides nothing."""
    fields = "|".join(HEADER_FIELDS)
    parts = F.split(F.coalesce(header, F.lit("")), rf"(?i)\s*\|\s*(?={fields})")
    said = F.filter(F.transform(parts, lambda x: F.split(x, rf"(?i){name}\s*[—–:-]+", 2)), lambda x: (F.size(x) == 2) & (F.trim(x[1]) != ""))
    return F.coalesce(squeezed(F.get(said, F.lit(0))[1]), F.lit(""))


def lines_of(c: Column) -> Column:
    """The lines of a cell that say something."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def items_of(c: Column) -> Column:
    """Items that semicolons, bullets or line ends divide, without the dashes before them."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;\n•]+"), lambda x: F.regexp_replace(x, "^[ -]+|[ -]+$", "")), lambda x: x != "")


def _told(line: Column, number: Column, mark: str, letter: str) -> tuple[Column, Column]:
    """The id that a line begins with, or one by its number, and what the line says after it."""
    own = F.regexp_extract(line, mark, 0)
    rest = F.when(own != "", F.ltrim(F.substr(line, F.length(own) + 1))).otherwise(line)
    return F.when(own != "", F.rtrim(F.translate(own, ".", ""))).otherwise(F.concat(F.lit(letter), number + 1)), rest


def step_list(c: Column) -> Column:
    """id, text of a cell's test steps, one a line: D1 or O2 before it is its id, else s and its number."""

    def step(line: Column, i: Column) -> Column:
        own, rest = _told(line, i, STEP_ID, "s")
        return F.struct(own.alias("id"), F.when(F.startswith(own, F.lit("s")), rest).otherwise(F.trim(F.regexp_replace(rest, "^[.:]", ""))).alias("text"))

    return F.transform(lines_of(c), step)


def element_list(c: Column) -> Column:
    """id, text, scope of a cell's elements, one a line: `e1. text [scope]`. A line without an id has the scope `model`."""

    def element(line: Column, i: Column) -> Column:
        marked = line.rlike("(?i)" + ELEMENT_ID)
        own, rest = _told(line, i, "(?i)" + ELEMENT_ID, "e")
        scope = F.when(marked, F.regexp_extract(line, SCOPE, 1)).otherwise("")
        text = F.when(scope != "", F.regexp_replace(rest, SCOPE, "")).otherwise(rest)
        return F.struct(own.alias("id"), F.trim(text).alias("text"), F.when(scope != "", scope).otherwise("model").alias("scope"))

    return F.transform(lines_of(c), element)


def boundary_text(none: Column, partial: Column, full: Column) -> Column:
    """What each level takes, those that are said, in order, divided by bars."""
    said = [F.when(squeezed(c) != "", F.concat(F.lit(f"{level}: "), squeezed(c))) for level, c in zip(LEVELS, (none, partial, full), strict=True)]
    return F.concat_ws(" | ", *said)


def requirement_parts(c: Column) -> Column:
    """Sentences and clauses of a requirement, of LEAST_CLAUSE characters or more; the whole if there are none."""
    text = squeezed(c)
    clauses = F.flatten(F.transform(F.split(text, SENTENCE_END), lambda s: F.split(s, CLAUSE_END)))
    bare = F.transform(clauses, lambda x: F.btrim(x, F.lit(" ,.;")))
    long = F.filter(bare, lambda x: F.length(x) >= LEAST_CLAUSE)
    return F.when(F.size(long) > 0, long).otherwise(F.filter(F.array(text), lambda x: x != ""))


def artefact_names(c: Column) -> Column:
    """Artefacts that a control expects, divided by semicolons or line ends."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", ""))


def place_of(rows: DataFrame) -> Column:
    """Where a decision was read, from the first field that says so, cut to a pointer."""
    said = F.coalesce(*(F.when(squeezed(E.field(rows, f)) != "", squeezed(E.field(rows, f))) for f in WHERE_FIELDS), F.lit(""))
    return F.when(F.length(said) <= WHERE_MOST, said).otherwise(F.concat(F.rtrim(F.substring(said, 1, WHERE_MOST)), F.lit(" …")))


def searched(controls: DataFrame, words: str) -> DataFrame:
    """Controls whose id, title or requirement holds what was typed, without regard to case."""
    return controls.where(F.lower(F.concat_ws(" ", "control_id", "title", "requirement")).contains(words.strip().lower()))


def query_text(controls: DataFrame) -> DataFrame:
    """query_id, text: what a control is searched for by."""
    return controls.select(bare_id(F.col("control_id")).alias("query_id"), squeezed(F.concat_ws(" ", "title", "requirement")).alias("text"))


def contract_of(contracts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (control_id, framework) with the first contract (ordinal, framework, control_id, ...) of that id in that framework, by any of its names."""
    name = lambda c: F.coalesce(*(F.when(c == a, F.lit(b)) for a, b in FRAMEWORKS.items()), c)
    rest = [c for c in contracts.columns if c not in ("control_id", "framework", "ordinal")]
    first = contracts.groupBy(bare_id(F.col("control_id")).alias("_id"), name(F.col("framework")).alias("_fw")).agg(F.min_by(F.struct(*rest), "ordinal").alias("_c"))
    return asked.join(first, (bare_id(asked["control_id"]) == F.col("_id")) & (name(asked["framework"]) == F.col("_fw")), "left").select(*asked.columns, *(F.col(f"_c.{c}").alias(c) for c in rest))


def elements(contracts: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """control_id, ordinal, element_id, text, scope, locator of contracts' elements that documents can show: not those that are tested (lane b), nor without text, and of the given scopes.

    contracts: control_id, elements (array of id, text, lane, scope, locator).
    """
    rows = contracts.select("control_id", F.posexplode("elements").alias("ordinal", "e")).where((squeezed(F.col("e.text")) != "") & (F.coalesce("e.lane", F.lit("a")) != "b"))
    scope = F.coalesce("e.scope", F.lit("model"))
    rows = rows.where(F.lower(scope).isin(scopes)) if scopes is not None else rows
    said = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    return rows.select("control_id", "ordinal", said("e.id", F.concat(F.lit("e"), "ordinal")).alias("element_id"), squeezed(F.col("e.text")).alias("text"), scope.alias("scope"), said("e.locator", F.format_string("controls.%s.elements[%d]", "control_id", "ordinal")).alias("locator"))


def listed(rows: DataFrame, by: str, item: str, divider: str = "; ") -> DataFrame:
    """by, n, text: a group's items as one line, in order."""
    return rows.groupBy(by).agg(F.count(item).alias("n"), F.array_join(F.array_sort(F.collect_set(item)), divider).alias("text"))
