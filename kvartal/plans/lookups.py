"""Queries of the lookup, store and sheet operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.functions import text as X
from kvartal.functions.dual import name, text
from kvartal.operators import directory as D
from kvartal.operators import linkage as L
from kvartal.operators import sheet as H
from kvartal.plans import matching as M
from kvartal.session import table
from kvartal.sources.files import with_aliases


def postcode_addresses(spark: SparkSession, d: str) -> DataFrame:
    return D.by_postcode(D.classifier_addresses(table(spark, d, "cities"), table(spark, d, "streets"), table(spark, d, "houses")))


def house_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every house and, as a number that no street has, one missing house of every street."""
    h = table(spark, d, "houses")
    own = h.select(D.trimmed("street_id").alias("street_id"), F.upper(F.regexp_replace("normalized_house_number", "[- ]", "")).alias("house"))
    none = own.select("street_id", F.lit("NONE").alias("house"))
    return D.house_lookup(own.union(none).where("street_id IS NOT NULL AND house IS NOT NULL").distinct(), h)


def city_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return D.autocomplete(table(spark, d, "magistral").where("city IS NOT NULL"), "city")


def streets_of_city(spark: SparkSession, d: str) -> DataFrame:
    return D.streets_of_city(table(spark, d, "magistral"))


def street_postcodes(spark: SparkSession, d: str) -> DataFrame:
    return D.street_postcodes(table(spark, d, "magistral"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    return D.display_names(table(spark, d, "magistral"))


def least_index(spark: SparkSession, d: str) -> DataFrame:
    return D.least_index(table(spark, d, "magistral"))


def nearest_office(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "magistral").where("city != ''")
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    return D.nearest_office(m.select("city", cell("tech_index").alias("anchor")), m.select("city", cell("city_index").alias("office"), (F.trim(cell("not_working")) == "").alias("working")))


def latest_houses(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "houses").select(D.trimmed("street_id").alias("street_id"), "house_number", "postcode", "cached_at", "house_id")
    return D.latest(h, ["street_id", "house_number"], "cached_at").select("street_id", "house_number", "postcode", "house_id")


def stale_streets(spark: SparkSession, d: str) -> DataFrame:
    return D.stale(table(spark, d, "streets").distinct(), "cached_at", F.lit("2025-06-01").cast("timestamp_ntz"), 180).groupBy("city_id").agg(F.count("*").alias("stale"))


def processed_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "addresses").select("row_id", H.is_empty().alias("is_empty"), H.already_processed().alias("already"))


def changed_indexes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "addresses").select("row_id", "index", "old_index")
    return H.changed_cells(a.select("row_id", F.col("old_index").alias("index")), a.select("row_id", "index"), "row_id", ["index"])


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return H.run_statistics(H.write_back(table(spark, d, "addresses"), M.resolve(spark, d)[2], least=90))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    q, found, decided = M.resolve(spark, d)
    return H.quality_report(table(spark, d, "addresses"), q, found, decided, table(spark, d, "magistral"))


def sheet_responses(spark: SparkSession, d: str) -> DataFrame:
    _, found, decided = M.resolve(spark, d)
    out = H.responses(found, decided)
    return out.withColumn("results", F.array_join(F.transform("results", lambda x: F.concat_ws("/", x["rank"], x["r_raw"], x["confidence"])), ";"))


def semi_automatic(spark: SparkSession, d: str) -> DataFrame:
    return H.semi_automatic(table(spark, d, "addresses"), M.resolve(spark, d)[2])


def shown_results(spark: SparkSession, d: str) -> DataFrame:
    """Ten results of each request, and as recommendation the greatest index that the request found."""
    _, found, _ = M.resolve(spark, d)
    return H.with_recommendation(L.ranked(found, 10), found.select("row_id", F.coalesce("most_raw", "r_raw").alias("r_raw")), limit=10)


def sheet_columns(spark: SparkSession, d: str) -> DataFrame:
    """The request table as a user's sheet: old index kept, columns filtered, cells mapped to fields."""
    a = H.with_old_index(table(spark, d, "addresses").select("row_id", "city", "street", "building", "region", "index"), "index")
    own, mapping = H.filter_columns(a, {"city": [0], "street": [1, 2], "building": [1, 2], "region": [3], "index": [4], "old_index": [5]}, "row_id", keep_old=True)
    return H.map_rows(own, mapping, "row_id").select("row_id", "city", "street", "building", "region", "index", "old_index")


def sheet_saved(spark: SparkSession, d: str) -> DataFrame:
    """Edited rows of the first client put back among all rows."""
    a = table(spark, d, "addresses").select("row_id", "city", "index", "client_id")
    edited = a.where("client_id != ''").withColumn("index", F.lpad(F.coalesce("index", F.lit("")), 6, "0"))
    return H.merge_sheet(a, edited, "row_id", ["index"]).select("row_id", "city", F.coalesce("index", F.lit("")).alias("index"))


def street_list(spark: SparkSession, d: str) -> DataFrame:
    return D.street_names_of(table(spark, d, "magistral"))


def manual_choices(spark: SparkSession, d: str) -> DataFrame:
    """The manual form for every request."""
    a = table(spark, d, "addresses").select(F.col("row_id").alias("ask_id"), "city", "district", D.form_street("street").alias("street"))
    return D.manual_choices(a, table(spark, d, "magistral"))


def directory_statistics(spark: SparkSession, d: str) -> DataFrame:
    return D.directory_statistics(M._inputs(spark, d)[1])


def fresh_answers(spark: SparkSession, d: str) -> DataFrame:
    return D.unexpired(table(spark, d, "streets").distinct(), "cached_at", F.lit("2025-06-01").cast("timestamp")).groupBy("city_id").agg(F.count("*").alias("fresh"))


def overlapping_cities(spark: SparkSession, d: str) -> DataFrame:
    """Current and former names of cities of which one holds the other."""
    return table(spark, d, "cities").where("old_city != '' AND city != ''").where(D.names_overlap("city", "old_city")).select("city_id")


def aliases_of_streets(spark: SparkSession, d: str) -> DataFrame:
    """All names of the streets of the classifier that were renamed."""
    s = table(spark, d, "streets").where("old_street != '' AND street != ''").join(table(spark, d, "cities").select("city_id", "city"), "city_id")
    aliases = s.select(X.normalize_city(name("city")).col.alias("city"), X.normalize_street(name("old_street")).col.alias("old_street"), F.col("street").alias("new_street"))
    aliases = aliases.groupBy("city", "old_street").agg(F.max("new_street").alias("new_street"))
    out = with_aliases(s.select("street_id", "city", F.col("old_street").alias("street")).distinct(), aliases)
    return out.select("street_id", "city", "street", F.array_join("street_aliases", "|").alias("aliases"))


def tag_summary(spark: SparkSession, d: str) -> DataFrame:
    return H.tag_summary(quality_report(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        postcode_addresses, house_lookup, city_autocomplete, streets_of_city, street_postcodes, display_names, least_index, nearest_office,
        latest_houses, stale_streets, processed_rows, changed_indexes, run_statistics, quality_report, tag_summary,
        sheet_responses, semi_automatic, shown_results, sheet_columns, sheet_saved, street_list, manual_choices, directory_statistics, fresh_answers, overlapping_cities, aliases_of_streets,
    )
}

_T = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_DISTRICT = "coalesce(nullif(new_district, ''), old_district, '')"
SQL = {
    "postcode_addresses": f"""WITH c AS (SELECT DISTINCT {_T.format('city_id')} AS city_id, region, district, city, city_type_short FROM cities), s AS (SELECT DISTINCT {_T.format('street_id')} AS street_id, {_T.format('city_id')} AS city_id, street, street_type_short, old_street FROM streets),
        h AS (SELECT DISTINCT {_T.format('street_id')} AS street_id, house_number, normalized_house_number, replace(postcode, ' ', '') AS p FROM houses)
        SELECT CASE WHEN length(p) < 5 THEN lpad(p, 5, '0') ELSE p END AS postcode, count(*) AS addresses, count(DISTINCT h.street_id) AS streets, count(DISTINCT c.city_id) AS cities
        FROM h JOIN s ON h.street_id = s.street_id JOIN c ON s.city_id = c.city_id WHERE regexp_full_match(p, '[0-9]+') GROUP BY 1""",
    "house_lookup": f"""WITH h AS (SELECT DISTINCT {_T.format('street_id')} AS street_id, upper(regexp_replace(normalized_house_number, '[- ]', '', 'g')) AS number, postcode FROM houses),
        w AS (SELECT DISTINCT street_id, house FROM (SELECT street_id, number AS house FROM h UNION ALL SELECT street_id, 'NONE' FROM h) WHERE street_id IS NOT NULL AND house IS NOT NULL),
        met AS (SELECT w.street_id, house, number, postcode, true AS exact FROM w JOIN h ON w.street_id = h.street_id AND house = number)
        SELECT * FROM met UNION ALL SELECT w.street_id, house, number, postcode, false FROM w JOIN h ON w.street_id = h.street_id WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.street_id = w.street_id AND met.house = w.house)""",
    "city_autocomplete": r"""WITH f AS (SELECT DISTINCT city AS name, unnest([city, regexp_replace(city, '^(м\. |смт\.? |с\. |с-ще )', '')]) AS form FROM magistral WHERE city IS NOT NULL),
        p AS (SELECT DISTINCT lower(left(form, CAST(n AS BIGINT))) AS prefix, name FROM f, range(3, 8) t(n) WHERE length(form) >= n),
        k AS (SELECT prefix, name, row_number() OVER (PARTITION BY prefix ORDER BY CASE WHEN starts_with(name, 'м. ') THEN 0 WHEN starts_with(name, 'смт ') THEN 1 WHEN starts_with(name, 'с. ') THEN 2 WHEN starts_with(name, 'с-ще ') THEN 3 ELSE 4 END, name) AS rank FROM p)
        SELECT prefix, CAST(rank AS INTEGER) AS rank, name FROM k WHERE rank <= 10""",
    "streets_of_city": "SELECT city, count(DISTINCT street) AS streets FROM magistral WHERE city <> '' AND street <> '' GROUP BY city",
    "street_postcodes": "SELECT city, street, city_index, arg_min(coalesce(buildings, ''), record_id) AS buildings FROM magistral WHERE city <> '' AND street <> '' AND city_index <> '' GROUP BY ALL",
    "display_names": f"""WITH p AS (SELECT DISTINCT city, {_DISTRICT} AS district FROM magistral WHERE city <> '')
        SELECT city, district, CASE WHEN district <> '' AND (SELECT count(DISTINCT o.district) FROM p o WHERE lower(o.city) = lower(p.city) AND o.district <> '') > 1 THEN city || ' (' || district || ')' ELSE city END AS display FROM p""",
    "least_index": "SELECT city, coalesce(min(CASE WHEN regexp_full_match(city_index, '[0-9]{5}') THEN city_index END), '00000') AS min_index FROM magistral WHERE city <> '' GROUP BY city",
    "nearest_office": """WITH w AS (SELECT DISTINCT city, coalesce(tech_index, '') AS anchor FROM magistral WHERE city <> ''), o AS (SELECT DISTINCT city, city_index AS office FROM magistral WHERE city_index <> '' AND trim(coalesce(not_working, ''), ' ') = ''),
        d AS (SELECT w.city, anchor, office, coalesce(abs(CASE WHEN regexp_full_match(office, '[0-9]{4,5}') THEN CAST(office AS INTEGER) END - CASE WHEN regexp_full_match(anchor, '[0-9]{4,5}') THEN CAST(anchor AS INTEGER) END), 0) AS far FROM w JOIN o ON w.city = o.city)
        SELECT city, anchor, office FROM (SELECT *, row_number() OVER (PARTITION BY city, anchor ORDER BY far, office) AS k FROM d) WHERE k = 1""",
    "latest_houses": f"""SELECT street_id, house_number, postcode, house_id FROM (SELECT *, row_number() OVER (PARTITION BY street_id, house_number ORDER BY cached_at DESC, postcode DESC NULLS LAST, house_id DESC) AS k
        FROM (SELECT {_T.format('street_id')} AS street_id, house_number, postcode, cached_at, house_id FROM houses) WHERE trim(street_id) <> '' AND trim(house_number) <> '') WHERE k = 1""",
    "stale_streets": "SELECT city_id, count(*) AS stale FROM (SELECT DISTINCT * FROM streets) WHERE cached_at IS NULL OR cached_at < TIMESTAMP '2025-06-01' - INTERVAL 180 DAYS GROUP BY city_id",
    "processed_rows": r"""SELECT row_id, regexp_full_match(coalesce(city, '') || coalesce(street, '') || coalesce(building, '') || coalesce(region, ''), '[\s\x{a0}]*') AS is_empty,
        (CASE WHEN lower(trim(coalesce("index", ''))) IN ('nan', 'none') THEN '' ELSE trim(coalesce("index", '')) END <> '' AND CASE WHEN lower(trim(coalesce("index", ''))) IN ('nan', 'none') THEN '' ELSE trim(coalesce("index", '')) END
        <> CASE WHEN lower(trim(coalesce(old_index, ''))) IN ('nan', 'none') THEN '' ELSE trim(coalesce(old_index, '')) END) AS already FROM addresses""",
    "changed_indexes": """SELECT row_id, 'index' AS field, coalesce(old_index, '') AS old_value, coalesce("index", '') AS new_value FROM addresses WHERE coalesce(old_index, '') <> coalesce("index", '')""",
    "run_statistics": f"""SELECT count(*) AS total, count(CASE WHEN e THEN 1 END) AS skipped, count(CASE WHEN NOT e AND applied THEN 1 END) AS applied, count(CASE WHEN NOT e AND NOT applied AND mode = 'manual' THEN 1 END) AS manual,
        count(CASE WHEN NOT e AND NOT applied AND mode <> 'manual' THEN 1 END) AS not_found, round(count(CASE WHEN NOT e AND applied THEN 1 END) / greatest(count(*) - count(CASE WHEN e THEN 1 END), 1), 6) AS efficiency, round(count(CASE WHEN NOT e AND applied THEN 1 END) / greatest(count(CASE WHEN NOT e THEN 1 END), 1), 6) AS decided_share
        FROM (SELECT d.mode, d.mode = 'auto' AND d.auto_index <> '' AND d.auto_confidence >= 90 AND NOT e AS applied, e FROM (SELECT row_id, regexp_full_match(coalesce(city, '') || coalesce(street, '') || coalesce(building, '') || coalesce(region, ''), '[\\s\\x{{a0}}]*') AS e FROM addresses) a JOIN ({M.SQL['match_decisions']}) d ON a.row_id = d.row_id)""",
}
_tag = lambda c, n: f"CASE WHEN {c} THEN '{n}' END"
_tag_list = ", ".join(
    _tag(c, n)
    for n, c in {
        "placeholder_index": f"{X.strip(name('input_index')).check} IN ('', '*', '00000', '01000')", "street_building_same_source": f"input_street <> '' AND input_building <> '' AND {X.normalize_text(name('input_street')).check} = {X.normalize_text(name('input_building')).check}",
        "building_extracted": "processed_building <> '' AND processed_building <> input_building", "street_cleaned": "processed_street <> input_street", "no_candidates": "total_found = 0", "manual_review": "mode = 'manual'",
        "many_candidates": "total_found >= 50", "general_index_top": "general", "low_top_confidence": "top1_confidence < 90", "input_index_differs_from_top": "query_index_used <> '' AND top_index <> '' AND query_index_used <> top_index", "ambiguous_high_confidence": "sure > 1",
    }.items()
)
_input = ", ".join(f"coalesce(a.\"{c}\", '') AS input_{c}" for c in ("index", "region", "district", "city", "street", "building"))
_top = lambda k, n, x: f"max(CASE WHEN pos = {k} THEN {x} END) AS top{k}_{n}"
_cells = {"index": "r_raw", "confidence": "confidence", "city": "coalesce(m.city, '')", "street": f"CASE WHEN is_general THEN '{H.GENERAL_STREET}' ELSE coalesce(m.street, '') END", "buildings": "coalesce(m.buildings, '')"}
_tops = ", ".join(_top(k, n, x) for k in (1, 2, 3) for n, x in _cells.items() if k == 1 or n != "buildings")
SQL["quality_report"] = f"""{M.resolved_sql()},
    top AS (SELECT row_id, {_tops}, bool_or(CASE WHEN pos = 1 THEN is_general END) AS general, max(CASE WHEN pos = 1 THEN r_index END) AS top_index, count(CASE WHEN pos <= 20 AND confidence >= 90 THEN 1 END) AS sure FROM found LEFT JOIN magistral m ON found.record_id = m.record_id GROUP BY row_id),
    x AS (SELECT a.row_id AS row_number, {_input}, {X.query_index(text('index')).check.replace('"index"', 'a."index"')} AS query_index_used, q.city AS processed_city, q.street AS processed_street, q.building AS processed_building, d.* EXCLUDE (row_id), top.* EXCLUDE (row_id)
        FROM addresses a JOIN q ON a.row_id = q.row_id JOIN decided d ON a.row_id = d.row_id LEFT JOIN top ON a.row_id = top.row_id)
    SELECT {', '.join(f"array_to_string(list_filter([{_tag_list}], lambda t: t IS NOT NULL), ',') AS issue_tags" if c == 'issue_tags' else f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if c.startswith('top') else c for c in H.REPORT_COLUMNS)} FROM x"""
SQL["tag_summary"] = f"""WITH t AS MATERIALIZED ({SQL['quality_report']}) SELECT 'mode' AS what, mode AS name, count(*) AS n FROM t GROUP BY mode UNION ALL SELECT 'rows', 'rows_analyzed', count(*) FROM t UNION ALL
    SELECT 'tag', name, count(*) FROM (SELECT unnest(string_split(issue_tags, ',')) AS name FROM t WHERE issue_tags <> '') GROUP BY name"""
_MISSING = "lower(trim(coalesce({0}, ''))) IN ('nan', 'none')"
_CLEAN = "CASE WHEN " + _MISSING + " THEN '' ELSE trim(coalesce({0}, '')) END"
_TRIM = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
_FORM = "lower(CASE " + " ".join(f"WHEN starts_with({{0}}, '{k}') THEN substring({{0}}, {len(k) + 1})" for k in D.FORM_KINDS) + " ELSE {0} END)"
SQL["sheet_responses"] = f"""{M.resolved_sql()}, l AS (SELECT row_id, string_agg(pos || '/' || r_raw || '/' || confidence, ';' ORDER BY pos) AS results FROM found WHERE pos <= 20 GROUP BY row_id)
    SELECT d.row_id, mode, total_found, mode = 'auto' AS applied, auto_index, coalesce(results, '') AS results FROM decided d LEFT JOIN l ON d.row_id = l.row_id"""
SQL["semi_automatic"] = f"""{M.resolved_sql()}, o AS (SELECT d.row_id, auto_index, mode = 'auto' AND auto_index <> '' AS auto FROM decided d JOIN addresses a ON a.row_id = d.row_id
    WHERE NOT regexp_full_match(coalesce(city, '') || coalesce(street, '') || coalesce(building, '') || coalesce(region, ''), '[\\s\\x{{a0}}]*') AND NOT ({_CLEAN.format('a."index"')} <> '' AND {_CLEAN.format('a."index"')} <> {_CLEAN.format('old_index')}))
    SELECT row_id, auto_index FROM o WHERE auto AND row_id < coalesce((SELECT min(row_id) FROM o WHERE NOT auto), 9223372036854775807)"""
SQL["shown_results"] = f"{M.resolved_sql()} SELECT row_id, CAST(pos AS INTEGER) AS rank, r_raw, false AS recommended FROM found WHERE pos <= 10 UNION ALL SELECT row_id, 11, max(r_raw), true FROM found GROUP BY row_id"
_BOTH = f"trim(CASE WHEN {_TRIM.format('street')} <> '' THEN {_TRIM.format('street')} || ' ' ELSE '' END || {_TRIM.format('building')}, ' ')"
SQL["sheet_columns"] = f"""SELECT row_id, {_TRIM.format('city')} AS city, {_BOTH} AS street, {_BOTH} AS building, {_TRIM.format('region')} AS region, {_TRIM.format('"index"')} AS "index", {_TRIM.format('"index"')} AS old_index FROM addresses"""
SQL["sheet_saved"] = """SELECT row_id, city, CASE WHEN client_id <> '' THEN lpad(coalesce("index", ''), 6, '0') ELSE coalesce("index", '') END AS "index" FROM addresses"""
SQL["street_list"] = "SELECT DISTINCT city, street FROM magistral WHERE city <> '' AND street <> ''"
SQL["manual_choices"] = f"""WITH d AS (SELECT DISTINCT lower(city) AS k, lower({_DISTRICT}) AS d, {_FORM.format('street')} AS s, CASE WHEN city_index <> '' THEN city_index END AS i FROM magistral WHERE city <> ''),
    m AS (SELECT a.row_id, i, coalesce({_FORM.format('a.street')} <> '' AND s = {_FORM.format('a.street')}, false) AS same FROM addresses a JOIN d ON lower(a.city) = k AND contains(d.d, lower(coalesce(a.district, ''))))
    SELECT a.row_id AS ask_id, count(DISTINCT CASE WHEN same THEN i END) AS choices, coalesce(min(CASE WHEN same THEN i END), min(i), '00000') AS "index" FROM addresses a LEFT JOIN m ON a.row_id = m.row_id GROUP BY a.row_id"""
SQL["directory_statistics"] = f"""SELECT count(*) AS total_records, count(DISTINCT CASE WHEN length(r_city) >= 2 THEN left(r_city, 2) END) AS prefixes_2, count(DISTINCT CASE WHEN length(r_city) >= 3 THEN left(r_city, 3) END) AS prefixes_3,
    count(DISTINCT CASE WHEN r_region <> '' THEN r_region END) AS regions, count(DISTINCT CASE WHEN r_post <> '' THEN r_post END) AS postcodes FROM {M.RECORDS_SQL}"""
SQL["fresh_answers"] = "SELECT city_id, count(*) AS fresh FROM (SELECT DISTINCT * FROM streets) WHERE floor((epoch(TIMESTAMP '2025-06-01') - floor(epoch(cached_at))) / 86400) <= 30 GROUP BY city_id"
SQL["overlapping_cities"] = "SELECT city_id FROM cities WHERE old_city <> '' AND city <> '' AND (contains(lower(city), lower(old_city)) OR contains(lower(old_city), lower(city)))"
SQL["aliases_of_streets"] = f"""WITH s AS (SELECT street_id, c.city, street, old_street FROM streets s JOIN cities c ON s.city_id = c.city_id WHERE old_street <> '' AND street <> ''),
    a AS (SELECT {X.normalize_city(name('city')).check} AS k, {X.normalize_street(name('old_street')).check} AS o, max(street) AS street FROM s GROUP BY ALL)
    SELECT DISTINCT street_id, s.city, old_street AS street, CASE WHEN n = '' THEN '' ELSE n || CASE WHEN n = 'без назви' THEN '|відсутня' ELSE '' END || CASE WHEN w <> '' AND w <> n THEN '|' || w ELSE '' END END AS aliases
    FROM (SELECT *, {X.normalize_city(name('city')).check} AS k, {X.normalize_street(name('old_street')).check} AS n FROM s) s LEFT JOIN (SELECT k AS ak, o, {X.normalize_street(name('street')).check} AS w FROM a) a ON k = ak AND n = o"""
