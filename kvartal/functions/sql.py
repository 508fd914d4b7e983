"""The normalizers and similarities as functions of Spark SQL.

They are SQL functions, not Python ones: Catalyst puts their expressions in place of the calls.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kvartal.functions import similarity as S
from kvartal.functions import text as X
from kvartal.functions.dual import Ex

ONE = {
    "normalize_text": X.normalize_text, "normalize_city": X.normalize_city, "normalize_street": X.normalize_street, "normalize_region": X.normalize_region, "street_kind": X.street_kind, "consonants": X.consonants,
    "building_key": X.building_key, "building_base": X.building_base, "query_index": X.query_index, "postcode": X.postcode, "plain_text": X.plain_text, "plain_street": X.plain_street, "plain_city": X.plain_city,
}
TWO = {"jaro_winkler": S.jaro_winkler, "levenshtein_similarity": S.levenshtein_similarity, "token_similarity": S.token_similarity, "consonant_similarity": S.consonant_similarity}


def register(spark: SparkSession, prefix: str = "kv_") -> list[str]:
    """Temporary functions kv_normalize_city(text) and so on; the names. NULL counts as ''."""
    a, b = Ex("coalesce(a, '')"), Ex("coalesce(b, '')")
    for n, f in ONE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{n}(a STRING) RETURNS STRING RETURN {f(a).spark}")
    for n, f in TWO.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{n}(a STRING, b STRING) RETURNS DOUBLE RETURN {f(a, b).spark}")
    return [prefix + n for n in (*ONE, *TWO)]
