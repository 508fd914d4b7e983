"""The queries of the training-data problems over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvartal.llm.canonical import canonical_cities
from kvartal.llm.entity_match import match_streets
from kvartal.llm.lookalike import consistent_texts, equal_looking
from kvartal.llm.looking_sql import equal_looking_sql
from kvartal.llm.mixing import mix_report, plan_copies, sized
from kvartal.llm.same_address import same_addresses
from kvartal.llm.tokenize import encode_texts
from kvartal.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_cities(
        {
            "addresses": (table(spark, sf_dir, "addresses"), "row_id", "city", ["region", "district"], ["index", "old_index"]),
            "magistral": (table(spark, sf_dir, "magistral"), "record_id", "city", ["region", "old_district", "new_district", "delivery_district"], ["city_index", "tech_index"]),
        },
        table(spark, sf_dir, "cities"),
    )


def p2_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_streets(table(spark, sf_dir, "magistral"), table(spark, sf_dir, "streets"), table(spark, sf_dir, "cities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_match(spark, sf_dir).select("record_id", "street_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_addresses(table(spark, sf_dir, "addresses"), table(spark, sf_dir, "streets"), table(spark, sf_dir, "cities"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_copies(sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    return mix_report(sizes, targets, plan_copies(sizes, targets))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_looking(table(spark, sf_dir, "documents"))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_match": p2_match,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
}
SQL = {"p9_found": equal_looking_sql()}
