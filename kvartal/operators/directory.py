"""Lookups in the classifier store and the directory, and the upkeep of both.

Everything is a join or an aggregate over the whole tables: one postcode, one city or one prefix is a filter
on the result, which Catalyst pushes down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of place kinds in lists, by the beginning of the name.
KIND_ORDER = ("м. ", "смт ", "с. ", "с-ще ")


def trimmed(c: str | Column) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest order (upsert: later rows replace earlier ones).

    Rows with an empty key are left out; ties are broken by all columns, so the result is defined.
    """
    own = df.where(" AND ".join(f"trim({k}) != ''" for k in keys))
    rest = [c for c in df.columns if c not in keys]
    best = own.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_order"), *[F.col(c).alias(c) for c in rest])).alias("_row"))
    return best.select(*keys, *[f"_row.{c}" for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after new rows replaced old ones of equal key; columns that only one side has are added."""
    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def add_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those new rows whose key it doesn't hold."""
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def stale(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows that must be fetched again: older than days, or without a time. days <= 0: none with a time."""
    fresh = F.col(at).isNotNull() if days <= 0 else F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")
    return df.where(~F.coalesce(fresh, F.lit(False)))


def classifier_addresses(cities: DataFrame, streets: DataFrame, houses: DataFrame) -> DataFrame:
    """houses, streets and cities joined; repeated rows of the store count once."""
    c = cities.select(trimmed("city_id").alias("city_id"), "region", "district", "city", "city_type_short").distinct()
    s = streets.select(trimmed("street_id").alias("street_id"), trimmed("city_id").alias("city_id"), "street", "street_type_short", "old_street").distinct()
    h = houses.select(trimmed("street_id").alias("street_id"), "house_number", "normalized_house_number", "postcode").distinct()
    return h.join(s, "street_id").join(c, "city_id")


def by_postcode(addresses: DataFrame) -> DataFrame:
    """postcode, addresses, streets, cities: what lies under each five-digit postcode."""
    code = F.regexp_replace(F.coalesce("postcode", F.lit("")), " ", "")
    padded = F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code)
    own = addresses.where(code.rlike("^[0-9]+$")).withColumn("postcode", padded)
    return own.groupBy("postcode").agg(F.count("*").alias("addresses"), F.countDistinct("street_id").alias("streets"), F.countDistinct("city_id").alias("cities"))


def house_lookup(requests: DataFrame, houses: DataFrame) -> DataFrame:
    """street_id, house, postcode, exact: the houses of each wanted (street_id, house); where none has the
    number, all houses of the street."""
    h = houses.select(trimmed("street_id").alias("street_id"), F.upper(F.regexp_replace("normalized_house_number", "[- ]", "")).alias("number"), "postcode").distinct()
    met = requests.join(h, (requests.street_id == h.street_id) & (requests.house == h.number)).select(requests.street_id, "house", "number", "postcode", F.lit(True).alias("exact"))
    missed = requests.join(met, ["street_id", "house"], "left_anti")
    return met.unionByName(missed.join(h, "street_id").select("street_id", "house", "number", "postcode", F.lit(False).alias("exact")))


def prefixes(names: DataFrame, name: str, least: int = 3, most: int = 7) -> DataFrame:
    """prefix, name: small-letter beginnings of each distinct name, with and without its kind."""
    bare = F.regexp_replace(name, "^(м\\. |смт\\.? |с\\. |с-ще )", "")
    own = names.select(F.col(name).alias("name"), F.explode(F.array_distinct(F.array(F.col(name), bare))).alias("form")).where(F.length("form") >= least).distinct()
    cut = F.explode(F.sequence(F.lit(least), F.least(F.length("form"), F.lit(most)))).alias("n")
    return own.select("name", "form", cut).select(F.lower(F.expr("substring(form, 1, n)")).alias("prefix"), "name").distinct()


def autocomplete(names: DataFrame, name: str, most: int = 10) -> DataFrame:
    """prefix, rank, name: for each beginning the first names, towns before villages, then by letter."""
    kind = F.lit(len(KIND_ORDER))
    for i, k in reversed(list(enumerate(KIND_ORDER))):
        kind = F.when(F.startswith("name", F.lit(k)), i).otherwise(kind)
    w = Window.partitionBy("prefix").orderBy(kind, "name")
    return prefixes(names, name).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("prefix", "rank", "name")


def streets_of_city(directory: DataFrame) -> DataFrame:
    """city, streets: how many distinct streets each city cell has."""
    return directory.where("city != '' AND street != ''").groupBy("city").agg(F.countDistinct("street").alias("streets"))


def street_postcodes(directory: DataFrame) -> DataFrame:
    """city, street, city_index, buildings: the buildings of the first row of each index of a street."""
    own = directory.where("city != '' AND street != '' AND city_index != ''")
    return own.groupBy("city", "street", "city_index").agg(F.min_by(F.coalesce("buildings", F.lit("")), "record_id").alias("buildings"))


def display_names(directory: DataFrame) -> DataFrame:
    """city, district, display: the district is added where a city's name lies in several."""
    district = F.coalesce(F.when(F.col("new_district") != "", F.col("new_district")), F.col("old_district"), F.lit(""))
    pairs = directory.where("city != ''").select("city", district.alias("district")).distinct()
    several = pairs.where("district != ''").groupBy(F.lower("city").alias("k")).agg(F.countDistinct("district").alias("n"))
    out = pairs.join(several, F.lower("city") == several.k, "left")
    shown = F.when((F.coalesce("n", F.lit(0)) > 1) & (F.col("district") != ""), F.concat("city", F.lit(" ("), "district", F.lit(")"))).otherwise(F.col("city"))
    return out.select("city", "district", shown.alias("display"))


def least_index(directory: DataFrame) -> DataFrame:
    """city, min_index: the least index of each city, '00000' where none is valid."""
    valid = F.when(F.col("city_index").rlike("^[0-9]{5}$"), F.col("city_index"))
    return directory.where("city != ''").groupBy("city").agg(F.coalesce(F.min(valid), F.lit("00000")).alias("min_index"))


def nearest_office(wanted: DataFrame, offices: DataFrame) -> DataFrame:
    """city, anchor, office: the working office of the city with the index nearest to the wanted one.

    An index without number counts as distance 0; ties go to the smaller index. wanted: city, anchor;
    offices: city, office, working. Offices are distinct before they meet the wanted ones of their city.
    """
    open_ = offices.where("working AND office != ''").select("city", "office").distinct()
    number = lambda c: F.when(F.col(c).rlike("^[0-9]{4,5}$"), F.col(c).cast("int"))
    far = F.coalesce(F.abs(number("office") - number("anchor")), F.lit(0))
    return wanted.distinct().join(open_, "city").groupBy("city", "anchor").agg(F.min(F.struct(far.alias("d"), F.col("office").alias("office"))).alias("best")).select("city", "anchor", "best.office")


def office_working(lock_code: str = "lock_code", is_security: str = "is_security") -> Column:
    """Whether an office works: no lock code, and no place under guard."""
    return F.coalesce(F.col(lock_code), F.lit("")).isin("", "0") & ~F.coalesce(F.col(is_security), F.lit(False))


def containing(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose cell holds the part, whatever the case."""
    return df.where(F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(part.lower())))


def names_overlap(a: str, b: str) -> Column:
    """Whether one of two names holds the other, whatever the case."""
    x, y = F.lower(F.coalesce(F.col(a), F.lit(""))), F.lower(F.coalesce(F.col(b), F.lit("")))
    return F.contains(x, y) | F.contains(y, x)


def street_names_of(directory: DataFrame) -> DataFrame:
    """city, street: the distinct streets of each city cell."""
    return directory.where("city != '' AND street != ''").select("city", "street").distinct()


#: Kinds that the manual form cuts from the beginning of a street, in order of trial.
FORM_KINDS = ("вул. ", "провул. ", "пров. ", "бульв. ", "б-р ", "просп. ", "пр. ", "пл. ")


def form_street(c: str) -> Column:
    """A street as the manual form compares it."""
    out = F.col(c)
    for k in reversed(FORM_KINDS):
        out = F.when(F.startswith(F.col(c), F.lit(k)), F.expr(f"substring({c}, {len(k) + 1})")).otherwise(out)
    return F.lower(out)


def manual_choices(asked: DataFrame, directory: DataFrame) -> DataFrame:
    """ask_id, choices, index: what the manual form offers for each (ask_id, city, district, street): the number of distinct
    indexes of the street, and the least of them; without a street of that name the least index of the city,
    '00000' if there is none.

    Cities are equal but for case; a district that is given must be part of the row's. Indexes are compared as
    text.
    """
    district = F.coalesce(F.when(F.col("new_district") != "", F.col("new_district")), F.col("old_district"), F.lit(""))
    d = directory.where("city != ''").select(F.lower("city").alias("k"), F.lower(district).alias("d"), form_street("street").alias("s"), F.when(F.col("city_index") != "", F.col("city_index")).alias("i")).distinct()
    a = asked.select("ask_id", F.lower("city").alias("k"), F.lower(F.coalesce("district", F.lit(""))).alias("q_d"), F.lower(F.coalesce("street", F.lit(""))).alias("q_s"))
    # Rows of the directory meet distinct questions: districts those of the city, streets only the very street.
    inside = F.contains("d", "q_d") & F.col("i").isNotNull()
    least = a.select("k", "q_d").distinct().join(d.groupBy("k", "d").agg(F.min("i").alias("i")), "k").where(inside).groupBy("k", "q_d").agg(F.min("i").alias("least"))
    own = a.where("q_s != ''").select("k", "q_d", "q_s").distinct().join(d.withColumnRenamed("s", "q_s"), ["k", "q_s"]).where(inside)
    own = own.groupBy("k", "q_d", "q_s", "i").agg(F.count("*").alias("n")).groupBy("k", "q_d", "q_s").agg(F.count("*").alias("choices"), F.min("i").alias("own"))
    out = a.join(own, ["k", "q_d", "q_s"], "left").join(least, ["k", "q_d"], "left")
    return out.select("ask_id", F.coalesce("choices", F.lit(0)).cast("bigint").alias("choices"), F.coalesce("own", "least", F.lit("00000")).alias("index"))


def directory_statistics(records: DataFrame) -> DataFrame:
    """One row: total_records and how many city prefixes, regions and postcodes the blocks know. records:
    linkage.prepared_directory."""
    count = lambda c, when: F.countDistinct(F.when(when, c))
    return records.agg(
        F.count("*").alias("total_records"), count(F.substring("r_city", 1, 2), F.length("r_city") >= 2).alias("prefixes_2"), count(F.substring("r_city", 1, 3), F.length("r_city") >= 3).alias("prefixes_3"),
        count(F.col("r_region"), F.col("r_region") != "").alias("regions"), count(F.col("r_post"), F.col("r_post") != "").alias("postcodes"),
    )


def unexpired(cache: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Cached answers that are no more than days whole days old; those without a time are expired."""
    return cache.where(F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col(at).cast("timestamp"))) / 86400) <= days, F.lit(False)))


def answered(wanted: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """The cache after the wanted keys that it lacks were fetched once each. fetch: rows of the cache for distinct keys."""
    return cache.unionByName(fetch(wanted.select(key).distinct().join(cache, key, "left_anti")), allowMissingColumns=True)


def refreshed(parents: DataFrame, store: DataFrame, snapshots: DataFrame, fetch: Callable[[DataFrame], DataFrame], parent: str, keys: list[str], now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(store, snapshots) after the children of all parents without a fresh snapshot were fetched: one level of a
    hierarchical crawl, from regions down to houses.

    fetch: rows like store, with cached_at, for a table of parent keys; snapshots: parent, cached_at. Parents
    whose children are fresh are not asked for; rows of a parent that fails stay as they are.
    """
    fresh = snapshots.join(stale(snapshots, "cached_at", now, days), parent, "left_anti")
    due = parents.select(parent).where(f"{parent} != ''").distinct().join(fresh, parent, "left_anti")
    new = fetch(due)
    marks = new.select(parent).distinct().withColumn("cached_at", now.cast("timestamp_ntz"))
    return upsert(store, new, keys, "cached_at"), latest(snapshots.unionByName(marks), [parent], "cached_at")


def persisted(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A table kept under path: read if it is there and whole, else (or if force) built and written anew."""
    if not force:
        try:
            out = spark.read.parquet(path)
            out.limit(1).collect()
            return out
        except Exception as e:  # noqa: BLE001 - a missing or broken table is built again
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) and "CANNOT_READ_FILE" not in str(e) and "Parquet" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
