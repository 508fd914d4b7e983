"""The queries of the general problems over the tables of a data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.operators.multivalue import known_values, split_values
from kvartal.operators.orphans import Reference, orphan_report, orphans
from kvartal.operators.row_parse import parse_rows
from kvartal.plans import general_sql as sql
from kvartal.session import table

REFERENCES = (
    Reference("districts", "district_id", "region_id", "regions", "region_id"),
    Reference("streets", "street_id", "city_id", "cities", "city_id"),
    Reference("houses", "house_id", "street_id", "streets", "street_id"),
)


def p1_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parse_rows(table(spark, sf_dir, "magistral_raw").where(~F.col("line_no").eqNullSafe(1)), "raw_id", "line")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_rows(spark, sf_dir)[1].select(F.col("raw_id").cast("bigint"), "reason")


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing lines with the number of their first broken field."""
    return p1_rows(spark, sf_dir)[1]


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_rows(spark, sf_dir)[0]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [orphans(table(spark, sf_dir, r.child), table(spark, sf_dir, r.parent), r) for r in REFERENCES]
    return reduce(DataFrame.unionByName, parts)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_values(table(spark, sf_dir, "houses"), "house_number")
    return split_values(table(spark, sf_dir, "magistral"), "record_id", "buildings", known)


QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p1_fields": p1_fields, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found}
_ORPHANS = " UNION ALL ".join(sql.orphans(r.child, r.row_key, r.ref, r.parent, r.key) for r in REFERENCES)
SQL = {
    "p1_found": sql.P1_FOUND,
    "p1_valid": sql.P1_VALID,
    "p1_fields": sql.P1_FIELDS,
    "p5_found": _ORPHANS,
    "p5_report": f"SELECT table_name, reason, period, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY ALL",
    "p6_found": sql.P6_FOUND,
}
