"""Queries of the matching operators, and their SQL: a brute-force comparison inside each city."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.functions import similarity as S
from kvartal.functions import text as X
from kvartal.functions.dual import Ex, name
from kvartal.operators import linkage as L
from kvartal.operators import meeting
from kvartal.operators.meeting import first_results
from kvartal.session import checkpointed, spread, table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return checkpointed(L.prepared_requests(spread(table(spark, sf_dir, "addresses"), "row_id"))), checkpointed(L.prepared_directory(spread(table(spark, sf_dir, "magistral"), "record_id")))


def _columns(stage: dict[str, Ex]) -> str:
    return ", ".join(f'{e.check} AS "{n}"' for n, e in stage.items())


def requests_sql() -> str:
    sql = "addresses"
    for stage in L.request_stages():
        sql = f"(SELECT row_id, {_columns(stage)} FROM {sql})"
    return sql


RECORDS_SQL = f"(SELECT record_id, {_columns(L.record_stage())} FROM magistral)"
_city = S.token_similarity(name("q_city"), name("r_city")).check


def scored_sql() -> str:
    """All pairs of a block and one city, or without a city on one side, scored."""
    block = L.BLOCK.replace("!=", "<>")
    region = f"SELECT DISTINCT q_region, r_region FROM (SELECT DISTINCT q_region FROM q) CROSS JOIN (SELECT DISTINCT r_region FROM r) WHERE {L.region_fits().check}"
    both = "SELECT q.*, r.* EXCLUDE (r_city), r.r_city, c.city_sim FROM q JOIN c ON q.q_city = c.q_city JOIN r ON c.r_city = r.r_city"
    none = "SELECT q.*, r.* EXCLUDE (r_city), r.r_city, 0.0::DOUBLE AS city_sim FROM q JOIN r ON {on} WHERE (q_city = '' OR r_city = '') AND {rest}"
    lone = none.format(on="q_region = r_region", rest="q_region <> ''") + " UNION ALL " + none.format(on="q_post = r_post", rest="q_post <> '' AND NOT (q_region <> '' AND q_region = r_region)")
    pairs = f"SELECT *, {L.STRATEGY} AS strategy FROM ({both} UNION ALL {lone}) WHERE ({block}) AND (q_region, r_region) IN ({region})"
    stages = L.score_stages()
    street = f"SELECT q_options, q_street, r_street, {stages[0]['raw_street'].check} AS raw_street FROM (SELECT DISTINCT q_options, q_street, r_street FROM pairs)"
    inner = "SELECT pairs.*, s.raw_street FROM pairs JOIN s ON pairs.q_options = s.q_options AND pairs.q_street = s.q_street AND pairs.r_street = s.r_street"
    for stage in stages[1:]:
        inner = f"SELECT *, {_columns(stage)} FROM ({inner})"
    return f"""WITH q AS MATERIALIZED (SELECT * FROM {requests_sql()}), r AS MATERIALIZED (SELECT * FROM {RECORDS_SQL}),
    c AS MATERIALIZED (SELECT * FROM (SELECT q_city, r_city, {_city} AS city_sim FROM (SELECT DISTINCT q_city, r_city FROM (SELECT DISTINCT q_city FROM q WHERE q_city <> '') CROSS JOIN (SELECT DISTINCT r_city FROM r WHERE r_city <> '')) WHERE least(length(q_city), length(r_city)) * 4 >= greatest(length(q_city), length(r_city))) WHERE city_sim >= {L.CITY_LEAST}),
    pairs AS MATERIALIZED ({pairs}), s AS MATERIALIZED ({street}),
    scored AS MATERIALIZED (SELECT {', '.join(L.SCORED)} FROM ({inner}) WHERE score >= {L.LEAST_SCORE})"""


def _decide_sql(found: str, general: bool) -> str:
    """The rule on the list of each request's results, step by step."""
    sure = f"x.confidence >= {L.AUTO_CONFIDENCE}" + (f" OR (x.is_general AND x.score >= {L.GENERAL_LEAST})" if general else "")
    names = "list_distinct(list_transform(list_filter(p3, lambda x: x.r_raw <> ''), lambda x: x.r_index))"
    return f"""(SELECT row_id, total_found, top_score, q_index, q_house, coalesce((len(p3) = 1 OR len({names}) = 1)
            AND (q_index = '' OR q_index = p3[1].r_index OR (NOT p3[1].is_general AND p3[1].confidence >= {L.SURE_CONFIDENCE})) AND (p3[1].is_general OR q_house = '' OR p3[1].house_part >= {L.HOUSE_BASE}), false) AS auto, p3[1] AS chosen
        FROM (SELECT *, CASE WHEN len(p2) >= 2 AND o[1].confidence >= {L.SURE_CONFIDENCE} AND o[1].confidence > o[2].confidence THEN [o[1]] ELSE p2 END AS p3 FROM (SELECT *, list_reverse_sort(list_transform(p2, lambda x: {{'confidence': x.confidence, 'score': x.score, 'pos': -x.pos, 'r_raw': x.r_raw, 'r_index': x.r_index, 'house_part': x.house_part, 'is_general': x.is_general, 'record_id': x.record_id}})) AS o
        FROM (SELECT *, CASE WHEN len(list_filter(p, lambda x: x.r_index = q_index)) > 0 AND q_index <> '' THEN list_filter(p, lambda x: x.r_index = q_index) ELSE p END AS p2
        FROM (SELECT row_id, q_index, q_house, total_found, top_score, list_filter(l, lambda x: {sure}) AS p FROM (SELECT row_id, any_value(q_index) AS q_index, any_value(q_house) AS q_house, count(*) AS total_found, max(score) AS top_score,
            list({{'confidence': confidence, 'score': score, 'pos': pos, 'r_raw': r_raw, 'r_index': r_index, 'house_part': house_part, 'is_general': is_general, 'record_id': record_id}} ORDER BY pos) AS l FROM {found} GROUP BY row_id))))))"""


_POSITION = "row_number() OVER (PARTITION BY row_id ORDER BY score DESC, confidence DESC, stage, part, strategy, record)"


def resolved_sql() -> str:
    """scored_sql, then found (with pos) and decided."""
    return scored_sql() + f""", unboxed AS (SELECT * FROM scored WHERE row_id NOT IN (SELECT row_id FROM q WHERE q_box)),
    best AS (SELECT *, row_number() OVER (PARTITION BY row_id, r_key ORDER BY confidence DESC, r_raw = '', r_raw, score DESC, strategy, record_id) AS k, first_value(struct_pack(a := -score, b := strategy, c := record_id)) OVER (PARTITION BY row_id, r_key ORDER BY score DESC, strategy, record_id) AS f FROM unboxed),
    first_found AS MATERIALIZED (SELECT row_id, record_id, score, confidence, r_index, r_raw, house_part, q_index, q_house, false AS is_general, 0 AS stage, f.a AS part, f.b AS strategy, f.c AS record FROM best WHERE k = 1),
    one_found AS (SELECT *, {_POSITION} AS pos FROM first_found), one AS MATERIALIZED (SELECT * FROM {_decide_sql('one_found', False)}),
    towns AS (SELECT r_city, r_region, coalesce(m.region, '') AS region, coalesce(nullif(new_district, ''), old_district, '') AS district, min(CASE WHEN regexp_full_match(city_index, '[0-9]{{5}}') THEN city_index END) AS r_raw, min(r.record_id) AS record
        FROM r JOIN magistral m ON r.record_id = m.record_id WHERE r_city <> '' GROUP BY ALL),
    raw_general AS (SELECT q.row_id, q.q_index, q.q_house, {X.normalize_text(name('region')).check.replace('"region"', 't.region')} AS n_region, {X.normalize_text(name('district')).check.replace('"district"', 't.district')} AS n_district, r_raw, record
        FROM q JOIN one ON q.row_id = one.row_id AND NOT one.auto JOIN towns t ON q_city = r_city WHERE q_city <> '' AND q_city NOT IN {L.NO_GENERAL} AND r_raw IS NOT NULL AND (q_region = '' OR q_region = r_region)),
    general AS MATERIALIZED (SELECT row_id, CAST(NULL AS BIGINT) AS record_id, {L.GENERAL_SCORE}::DOUBLE AS score, 89 AS confidence, regexp_replace(min(r_raw), '^0+', '') AS r_index, min(r_raw) AS r_raw, 0.0::DOUBLE AS house_part, any_value(q_index) AS q_index, any_value(q_house) AS q_house, true AS is_general, 1 AS stage, 0.0 AS part, 0 AS strategy, min(record) AS record
        FROM raw_general g WHERE NOT EXISTS (SELECT 1 FROM first_found f WHERE f.row_id = g.row_id AND f.r_raw = g.r_raw) GROUP BY row_id, n_region, n_district),
    found AS MATERIALIZED (SELECT *, {_POSITION} AS pos FROM (SELECT * FROM first_found UNION ALL SELECT * FROM general)),
    two_found AS (SELECT * FROM found WHERE row_id IN (SELECT row_id FROM general)), two AS MATERIALIZED (SELECT * FROM {_decide_sql('two_found', True)}),
    deed AS (SELECT * FROM two UNION ALL SELECT * FROM one WHERE row_id NOT IN (SELECT row_id FROM two)),
    decided AS MATERIALIZED (SELECT q.row_id, CASE WHEN q_box OR coalesce(auto, false) THEN 'auto' WHEN total_found IS NULL THEN 'none' ELSE 'manual' END AS mode, CASE WHEN q_box THEN 1 ELSE coalesce(total_found, 0) END AS total_found,
        round(CASE WHEN q_box THEN {L.BOX_CONFIDENCE / 100} ELSE coalesce(top_score, 0.0) END, 6) AS top_score, CASE WHEN q_box THEN '{L.BOX_INDEX}' WHEN auto THEN chosen.r_raw ELSE '' END AS auto_index,
        CAST(CASE WHEN q_box THEN {L.BOX_CONFIDENCE} WHEN auto THEN chosen.confidence ELSE 0 END AS INTEGER) AS auto_confidence FROM q LEFT JOIN deed ON q.row_id = deed.row_id)"""


def requests_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prepared_requests(spread(table(spark, sf_dir, "addresses"), "row_id")).withColumn("q_options", F.array_join("q_options", "|"))


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.block_sizes(*_inputs(spark, sf_dir))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting.scored_pairs(*_inputs(spark, sf_dir)).select("row_id", "record_id", F.round("score", 6).alias("score"), "confidence", "strategy")


def resolve(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, found, decided) of a data folder."""
    q, r = _inputs(spark, sf_dir)
    places = checkpointed(L.general_places(table(spark, sf_dir, "magistral"), r))
    return q, *L.settled(q, checkpointed(first_results(q, r, places)), places)


def match_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ranked(resolve(spark, sf_dir)[1]).select("row_id", "rank", F.coalesce("record_id", F.lit(-1)).alias("record_id"), "is_general", "r_raw", F.round("score", 6).alias("score"), "confidence")


def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(spark, sf_dir)[2].withColumn("top_score", F.round("top_score", 6))


def general_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _inputs(spark, sf_dir)
    return L.general_results(q, L.general_places(table(spark, sf_dir, "magistral"), r)).drop("first")


QUERIES = {f.__name__: f for f in (requests_prepared, block_sizes, scored_pairs, match_ranked, match_decisions, general_results)}
SQL = {
    "requests_prepared": f"SELECT * EXCLUDE (q_options), array_to_string(q_options, '|') AS q_options FROM {requests_sql()}",
    "block_sizes": f"""WITH q AS (SELECT * FROM {requests_sql()}), r AS (SELECT * FROM {RECORDS_SQL})
        SELECT row_id, CASE WHEN length(q_city) >= 2 THEN (SELECT count(*) FROM r WHERE length(r_city) >= 2 AND left(r_city, 2) = left(q_city, 2)) ELSE 0 END AS by_city,
        CASE WHEN q_region <> '' THEN (SELECT count(*) FROM r WHERE r_region = q_region) ELSE 0 END AS by_region,
        CASE WHEN q_post <> '' THEN (SELECT count(*) FROM r WHERE r_post = q_post) ELSE 0 END AS by_index FROM q""",
    "scored_pairs": scored_sql() + " SELECT row_id, record_id, round(score, 6) AS score, confidence, strategy FROM scored",
    "match_ranked": resolved_sql() + " SELECT row_id, CAST(pos AS INTEGER) AS rank, coalesce(record_id, -1) AS record_id, is_general, r_raw, round(score, 6) AS score, confidence FROM found WHERE pos <= 20",
    "match_decisions": resolved_sql() + " SELECT * FROM decided",
    "general_results": f"""WITH q AS (SELECT * FROM {requests_sql()}), r AS (SELECT * FROM {RECORDS_SQL}),
        t AS (SELECT r_city, r_region, coalesce(m.region, '') AS region, coalesce(nullif(new_district, ''), old_district, '') AS district, min(CASE WHEN regexp_full_match(city_index, '[0-9]{{5}}') THEN city_index END) AS min_index
        FROM r JOIN magistral m ON r.record_id = m.record_id WHERE r_city <> '' GROUP BY ALL)
        SELECT row_id, t.region, t.district, min_index FROM q JOIN t ON q_city = r_city WHERE q_city <> '' AND min_index IS NOT NULL AND (q_region = '' OR q_region = r_region)""",
}
