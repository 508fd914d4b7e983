"""Delimited lines that fail to parse: valid rows out, failing rows with the reason.

A schema is a list of fields, each with an optional pattern of its valid content. From it one anchored
pattern for whole rows is generated; a row that it accepts is valid at once. A row that fails passes through
prefix patterns, one for each number of leading fields: the first that fails names the first broken field.
Both stages are Catalyst expressions over one scan; nothing is shuffled, and the broken rows need no second
read.

All repetitions are possessive: a pattern never goes back over what it has read, so that its time is linear
in the line and Java's matcher loops instead of recursing, whatever the length of a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\s\u00a0\ufeff\u2000-\u200b\u202f\u3000]"
#: A field with any content: quoted, with doubled quotes inside, or without quotes.
ANY = r"(?:\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^\";]*+)"


@dataclass(frozen=True)
class Field:
    """A column of the file. item: pattern of its content, outer blanks removed; cut: characters that
    separate several items in it ('' for a single one); reason: name of the failure."""

    name: str
    item: str = ""
    cut: str = ""
    reason: str = ""


BUILDING_ITEM = r"[1-9][0-9]{0,3}(?:-?\p{L})?(?:/[0-9]{1,4}\p{L}?)?(?: корп\. [0-9]+)?"
#: The fourteen columns of a directory file, in the file's order.
DIRECTORY_FIELDS = (
    Field("region"),
    Field("old_district"),
    Field("new_district"),
    Field("otg"),
    Field("city"),
    Field("city_index", r"[0-9]{4,5}", "", "city_index"),
    Field("street"),
    Field("buildings", BUILDING_ITEM, ",;", "buildings"),
    Field("sort_center_1"),
    Field("sort_center_2"),
    Field("delivery_district"),
    Field("tech_index"),
    Field("features"),
    Field("not_working"),
)


def field_pattern(f: Field) -> str:
    """Pattern of a field whose content is valid."""
    if not f.item:
        return ANY
    b = BLANKS
    one = rf"{b}*+(?:{f.item}{b}*+)?+"
    bare = f.cut.replace(";", "")
    plain = rf"{one}(?:[{bare}]{one})*+" if bare else one
    quoted = rf"{one}(?:[{f.cut}]{one})*+" if f.cut else one
    return rf"(?:\"{quoted}\"|{plain})"


def row_pattern(fields: tuple[Field, ...]) -> str:
    """Anchored pattern of a whole valid row."""
    return r"\A" + ";".join(map(field_pattern, fields)) + r"\z"


def prefix_patterns(fields: tuple[Field, ...], content: bool) -> list[str]:
    """For each number of leading fields the anchored pattern that they are well-formed and, if content, valid."""
    parts = [field_pattern(f) if content else ANY for f in fields]
    return [r"\A" + ";".join(parts[: k + 1]) + r"(?:;|\z)" for k in range(len(parts))]


def first_failing(line: Column, patterns: list[str]) -> Column:
    """Number of the first pattern, from 1, that the line fails; one more than there are if it passes all."""
    out = F.lit(len(patterns) + 1)
    for k, p in reversed(list(enumerate(patterns))):
        out = F.when(~line.rlike(p), k + 1).otherwise(out)
    return out


def fields_of(line: Column) -> Column:
    """Content of the fields of a well-formed line, without the quotes around it and inside it.

    Each match begins where the one before ended.
    """
    parts = F.regexp_extract_all(F.concat(F.lit(";"), line), F.lit(rf"\G;({ANY})"), 1)
    return F.transform(parts, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def strip_blanks(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{BLANKS}+|{BLANKS}+\z", "")


def classify(df: DataFrame, line: str, fields: tuple[Field, ...] = DIRECTORY_FIELDS) -> DataFrame:
    """df with `_fields` (array of field contents, NULL for broken quoting), `_reason` ('' for a valid line) and
    `_field` (number of the first broken field, from 1; NULL for a valid line).

    Broken quoting anywhere goes before a wrong number of columns, and that before invalid content. With too few
    columns the first missing field is the broken one, with too many the first surplus one. A NULL or blank
    line has the wrong number of columns.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    n = len(fields)
    whole, formed = F.col("_whole"), F.col("_formed")
    out = df.withColumn("_whole", text.rlike(row_pattern(fields)))
    out = out.withColumn("_formed", whole | text.rlike(rf"\A{ANY}(?:;{ANY})*+\z")).withColumn("_fields", F.when(formed, fields_of(text)))
    count = F.size("_fields")
    at = (
        F.when(whole, F.lit(None).cast("int"))
        .when(~formed, first_failing(text, prefix_patterns(fields, False)))
        .when(count != n, F.least(count, F.lit(n)) + 1)
        .otherwise(first_failing(text, prefix_patterns(fields, True)))
    )
    named = F.array(*[F.lit(f.reason or f.name) for f in fields])
    out = out.withColumn("_field", at)
    return out.withColumn("_reason", F.when(whole, "").when(~formed, "quoting").when(count != n, "column_count").otherwise(F.element_at(named, F.col("_field")))).drop("_whole", "_formed")


def parse_rows(df: DataFrame, key: str, line: str, fields: tuple[Field, ...] = DIRECTORY_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(valid, failed): key and the named fields of valid lines; key, reason and field_no of failing ones.

    Columns of df other than key and line are ignored, so that names which clash with the fields don't
    matter. Repeated lines stay repeated. An empty table gives two empty ones.
    """
    own = df.select(F.col(key).alias("_key"), F.col(line).alias("_line"))
    done = classify(own, "_line", fields)
    good = done.where(F.col("_reason") == "").select(
        F.col("_key").alias(key), *[F.get("_fields", F.lit(k)).alias(f.name) for k, f in enumerate(fields)]
    )
    bad = done.where(F.col("_reason") != "").select(F.col("_key").alias(key), F.col("_reason").alias("reason"), F.col("_field").alias("field_no"))
    return good, bad
