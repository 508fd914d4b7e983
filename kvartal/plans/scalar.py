"""Queries of the scalar functions over the address tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvartal.functions import similarity as S
from kvartal.functions import text as X
from kvartal.functions.dual import Ex, text
from kvartal.functions.sql import ONE, TWO, register
from kvartal.session import spread, table


def select_query(source: str, key: str, columns: dict[str, Ex], where: Ex | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query that computes columns of every row of a table, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spread(table(spark, sf_dir, source), key)
        if where is not None:
            df = df.where(where.col)
        return df.select(key, *[e.col.alias(n) for n, e in columns.items()])

    sql = f"SELECT {key}, " + ", ".join(f"{e.check} AS {n}" for n, e in columns.items()) + f" FROM {source}"
    return run, sql + (f" WHERE {where.check}" if where is not None else "")


def rounded(x: Ex) -> Ex:
    return Ex(f"round({x.spark}, 6)", f"round({x.check}, 6)")


_city, _street, _building = text("city"), text("street"), text("building")
_now, _was = X.normalize_text(text("street")), X.normalize_text(text("old_street"))
_city_of, _street_of = X.city_in_street(_street)
_house_of, _street_rest = X.building_in_street(_street)
_region, _district = X.repaired_area(text("region"), text("district"))
_split = X.split_full_address(_city, _street, _building)
_parsed = X.parse_full_address(_street)

_PLANS = {
    "text_normalized": select_query("addresses", "row_id", {"norm_city": X.normalize_text(_city), "norm_street": X.normalize_text(_street), "norm_building": X.normalize_text(_building)}),
    "city_normalized": select_query("magistral", "record_id", {"norm_city": X.normalize_city(_city)}),
    "street_normalized": select_query("magistral", "record_id", {"norm_street": X.normalize_street(_street)}),
    "street_kind": select_query("magistral", "record_id", {"kind": X.street_kind(_street)}),
    "region_normalized": select_query("magistral", "record_id", {"norm_region": X.normalize_region(text("region"))}),
    "consonants": select_query("magistral", "record_id", {"city_consonants": X.consonants(_city)}),
    "building_keys": select_query("addresses", "row_id", {"building_key": X.building_key(_building), "base": X.building_base(_building), "has_letter": X.has_letter(_building)}),
    "postcodes": select_query("addresses", "row_id", {"query_index": X.query_index(text("index")), "postcode": X.postcode(text("index")), "raw_postcode": X.postcode(text("index"), False)}),
    "city_in_street": select_query("addresses", "row_id", {"found_city": _city_of, "rest_street": _street_of}),
    "building_in_street": select_query("addresses", "row_id", {"found_building": _house_of, "rest_street": _street_rest}),
    "area_repaired": select_query("addresses", "row_id", {"region": _region, "district": _district}),
    "full_address_split": select_query("addresses", "row_id", {"city": _split[0], "street": _split[1], "building": _split[2]}),
    "full_address_parsed": select_query("addresses", "row_id", {**{f"parsed_{k}": v for k, v in _parsed.items()}, "is_full": X.is_full_address(_street)}),
    "index_to_use": select_query("magistral", "record_id", {"use_index": X.closed_index(text("not_working"), text("city_index"))}),
    "similarities": select_query(
        "streets",
        "street_id",
        {
            "jaro_winkler": rounded(S.jaro_winkler(_now, _was)),
            "levenshtein": rounded(S.levenshtein_similarity(_now, _was)),
            "tokens": rounded(S.token_similarity(_now, _was)),
            "consonants": rounded(S.consonant_similarity(_now, _was)),
        },
    ),
}
_plain_street, _plain_house = X.plain_house(_street)
_PLANS |= {
    "plain_normalized": select_query("addresses", "row_id", {"plain_text": X.plain_text(_building), "plain_city": X.plain_city(_city), "plain_street": X.plain_street(_street), "cut_street": _plain_street, "cut_house": _plain_house, "leading_number": X.leading_number(_building)}),
    "cache_keys": select_query("addresses", "row_id", {"cache_key": X.cache_key(_city, _street, text("region"), text("district"))}),
    "address_texts": select_query("addresses", "row_id", {"full_address": X.full_address(text("region"), text("district"), _city, _street, _building)}),
    "reparsed_rows": select_query("addresses", "row_id", X.reparsed(_city, _street, _building)),
    "office_texts": select_query("magistral", "record_id", {"redirect": X.redirect_text(text("not_working")), "picked": X.picked_index(text("not_working"), text("city_index")), "lines": X.house_lines(text("buildings"))}),
}
QUERIES = {k: q for k, (q, _) in _PLANS.items()}
SQL = {k: s for k, (_, s) in _PLANS.items()}


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions, called from SQL, on current and former street names."""
    register(spark)
    table(spark, sf_dir, "streets").createOrReplaceTempView("kv_streets")
    ones = ", ".join(f"kv_{n}(street) AS {n}" for n in ONE)
    twos = ", ".join(f"round(kv_{n}(kv_normalize_text(street), kv_normalize_text(old_street)), 6) AS {n}" for n in TWO)
    return spark.sql(f"SELECT street_id, {ones}, {twos} FROM kv_streets")


QUERIES["sql_functions"] = sql_functions
SQL["sql_functions"] = "SELECT street_id, " + ", ".join([f"{f(_street).check} AS {n}" for n, f in ONE.items()] + [f"round({f(_now, _was).check}, 6) AS {n}" for n, f in TWO.items()]) + " FROM streets"
