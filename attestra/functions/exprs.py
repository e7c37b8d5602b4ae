"""Column expressions shared by the operators; nothing here reads data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE_FOUND = "NOT_TESTABLE"
RATING_RANK = {"none": 0, "partial": 1, "full": 2}
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
DAY = 86_400_000_000
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def field(df: DataFrame, name: str) -> Column:
    """A column, dotted or not; null where the records have no such field."""
    return F.col(name) if name.split(".")[0] in df.columns else F.lit(None).cast("string")


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.select(field(df, name).alias("x")).schema[0].dataType


def key_text(c: Column, kind: T.DataType) -> Column:
    """A string under which equal values of mixed types are equal; null stays null.

    Strings ignore case and outer blanks; yes-words, true and the number 1 are one value, their opposites another.
    """
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        return F.when(x == 1, "true").when(x == 0, "false").otherwise(F.concat(F.lit("#"), x.cast("string")))
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "yes", "y", "1"), "true").when(s.isin("false", "no", "n", "0"), "false").otherwise(s)


def field_key(df: DataFrame, name: str) -> Column:
    return key_text(field(df, name), kind_of(df, name))


def literal_key(value: object) -> Column:
    """key_text of a driver-side value."""
    if value is None:
        return F.lit(None).cast("string")
    kind = T.BooleanType() if isinstance(value, bool) else T.DoubleType() if isinstance(value, (int, float)) else T.StringType()
    return key_text(F.lit(value), kind)


def matches(df: DataFrame, where: dict | None) -> Column:
    """Whether a record is in scope; null equals null."""
    if not where:
        return F.lit(True)
    return field_key(df, where["field"]).eqNullSafe(literal_key(where["equals"]))


def empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def moment(df: DataFrame, name: str) -> Column:
    """A timestamp from a date, a timestamp or ISO text; null if it can't be read."""
    c, kind = field(df, name), kind_of(df, name)
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return c.cast("timestamp")
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(ISO), F.try_to_timestamp(s))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two moments, rounded down: an hour before is -1 day."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY)).cast("long")


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def number(c: Column) -> Column:
    return c.try_cast("double")


def rank_of(c: Column, ranks: dict[str, int], default: int | None = None) -> Column:
    out = F.lit(default).cast("int")
    for word, n in ranks.items():
        out = F.when(c == word, F.lit(n)).otherwise(out)
    return out


def plain(c: Column) -> Column:
    """Lower case, straight quotes, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), "’“”", "'\"\"")), r"\s+", " "))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def tokens(c: Column, kind: str = "terms") -> Column:
    """Words of a text, in order: terms (2 or more characters), lexemes (1 or more), labels (3 or more, distinct); İ is an i, as in SQL."""
    pattern = {"terms": r"[a-z0-9][a-z0-9\-\.]{1,}", "lexemes": r"[a-z0-9][a-z0-9\-\.]*", "labels": r"[a-z0-9][a-z0-9_-]{2,}"}[kind]
    found = F.regexp_extract_all(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("İ"), F.lit("i"))), F.lit(pattern), F.lit(0))
    return F.array_distinct(found) if kind == "labels" else found


def one_of(pairs: list[tuple[Column, Column | str]], default: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default) if default is not None else out


def sha_prefix(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)
