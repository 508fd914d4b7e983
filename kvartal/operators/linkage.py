"""Matching of address requests with a directory: preparation, candidates, scores, general rows, decisions.

Requests meet directory rows of the same city, judged once per pair of distinct names. Of those, only four
kinds can reach the least score, and each is an equi-join: rows whose street is similar (judged once per
pair of distinct street names of the city), rows that hold the requested house, rows with the requested
index, and in major cities rows with a house of the same base or with a part in common (judged once per pair
of distinct houses). A request or row without a city needs the house and the index or the very street. No
number of candidates is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.functions import similarity as S
from kvartal.functions import text as X
from kvartal.functions.batch import token_similarity_column
from kvartal.functions.dual import Ex, array, call, case, cast, has, join, keep, like, lit, lower, name, text
from kvartal.session import checkpointed

# Weights, thresholds and bonuses of the score.
LEAST_SCORE, CITY_LEAST, STREET_LEAST, REGION_LEAST = 0.60, 0.90, 0.85, 0.85
CITY_WEIGHT, STREET_WEIGHT, STREET_LOW, INDEX_SAME, INDEX_OTHER = 0.35, 0.35, 0.10, 0.10, -0.02
HOUSE_SAME, HOUSE_BASE, HOUSE_PART, HOUSE_NONE, PERFECT, CAPITAL, KIND_PENALTY = 0.25, 0.12, 0.10, -0.05, 0.15, 0.10, 0.25
MAJOR_CITIES = ("київ", "донецьк", "харків", "одеса", "дніпро", "львів", "запоріжжя")
AUTO_CONFIDENCE, SURE_CONFIDENCE = 90, 98
#: Cities whose lowest index says nothing, the score of a general row, and the least score at which it may be taken.
NO_GENERAL = ("київ", "м.київ", "киів", "донецьк", "м.донецьк", "харків", "одеса", "дніпро", "львів", "запоріжжя")
GENERAL_SCORE, GENERAL_LEAST = 0.89, 0.85
#: What makes a street cell a post-office box, where, and the index of all boxes there.
BOX, BOX_CITY, BOX_INDEX, BOX_CONFIDENCE = "а/с|п/с|абонент", "київ", "01001", 95
#: Other names of streets everywhere, and in one city (city, former name, name), normalized.
NAMELESS = ("без назви", "відсутня")
STREET_ALIASES = (("бахмут", "горького", "олекси тихого"),)

_guarded = case(((X.normalize_text(name("street")) == X.normalize_text(name("building"))) & (name("building") != ""), ""), default=name("building"))
def street_options() -> Ex:
    """The street and its other names, each once; none for an empty street."""
    q, city = name("q_street"), name("q_city")
    renamed = case(*[((city == c) & (q == old), new) for c, old, new in STREET_ALIASES], default="")
    listed = keep(array(q, case((q == NAMELESS[0], NAMELESS[1]), default=""), renamed), lambda p: p != "")
    return Ex(f"array_distinct({listed.spark})", f"list_filter({listed.check}, lambda x, i: list_position({listed.check}, x) = i)")


_region, _district = X.repaired_area(name("region"), name("district"))
_split = X.split_full_address(name("city"), name("street"), name("building"))
_from_street = X.city_in_street(name("street"))
_house = X.building_in_street(name("street"))


_KEPT = ("city", "street", "building", "region", "district", "index", "q_city", "q_street", "q_kind", "q_house", "q_base", "q_region", "q_index", "q_post", "q_box")


def request_stages() -> list[dict[str, Ex]]:
    """Columns of a request after each step of its preparation; every step reads the one before."""
    raw = {c: text(c) for c in ("city", "street", "building", "region", "district", "index")}
    keep = {c: name(c) for c in raw}
    no_city, no_house = X.strip(name("city")) == "", X.strip(name("building")) == ""
    return [
        raw,
        keep | {"building": _guarded, "region": _region, "district": _district},
        keep | {"city": _split[0], "street": _split[1], "building": _split[2]},
        keep | {"city": case((no_city, _from_street[0]), default=name("city")), "street": case((no_city, _from_street[1]), default=name("street"))},
        keep | {"building": case((no_house, _house[0]), default=name("building")), "street": case((no_house & (_house[0] != ""), _house[1]), default=name("street"))},
        keep
        | {
            "q_city": X.normalize_city(name("city")), "q_street": X.normalize_street(name("street")), "q_kind": X.street_kind(name("street")), "q_house": X.building_key(name("building")),
            "q_base": case((X.has_letter(name("building")), X.building_base(name("building"))), default=""), "q_region": X.normalize_region(name("region")),
            "q_index": X.query_index(name("index")), "q_post": X.postcode(name("index")),
            "q_box": like(lower(name("street")), BOX, fold=False) & like(lower(name("city")), BOX_CITY, fold=False),
        },
        {c: name(c) for c in _KEPT} | {"q_options": street_options()},
    ]


HOUSES = r"transform(split(buildings, ',', -1), x -> regexp_replace(translate(upper(x), '- ', ''), '(?U)^\\s+|\\s+$', ''))"


def houses_of(e: Ex) -> Ex:
    """House keys of a comma list; a trailing comma gives an empty one, which is part of any house."""
    return Ex(HOUSES.replace("buildings", e.spark), f"list_transform(string_split({e.check}, ','), lambda x: regexp_replace(translate(upper(x), '- ', ''), '^\\s+|\\s+$', '', 'g'))")


def bases_of(e: Ex) -> Ex:
    return Ex(f"transform(split({e.spark}, ',', -1), x -> {X.building_base(Ex('x')).spark})", f"list_transform(string_split({e.check}, ','), lambda x: {X.building_base(Ex('x')).check})")


def district_of() -> Ex:
    return case((text("new_district") != "", text("new_district")), default=text("old_district"))


def record_stage() -> dict[str, Ex]:
    """Columns of a directory row that matching reads."""
    return {
        "r_city": X.normalize_city(text("city")), "r_street": X.normalize_street(text("street")), "r_kind": X.street_kind(text("street")), "r_region": X.normalize_region(text("region")),
        "buildings": text("buildings"), "r_built": text("buildings") != "", "r_houses": houses_of(text("buildings")), "r_bases": bases_of(text("buildings")), "r_index": X._no_zeros(X._bare_index(text("city_index"))), "r_post": X.postcode(text("city_index")), "r_raw": text("city_index"),
        "r_key": call("md5", join(array(X.normalize_text(text("region")), X.normalize_text(district_of()), X.normalize_city(text("city")), X.normalize_street(text("street")), X.building_key(text("buildings"))), "|")),
    }


def prepared_requests(addresses: DataFrame, key: str = "row_id", aliases: DataFrame | None = None) -> DataFrame:
    """Requests with their cells cleaned and the q_ columns that matching reads.

    aliases: city, old_street, new_street as sources.files.read_aliases gives them, added to the fixed ones.

    Each step goes through a generator of one row, which keeps the optimizer from writing the steps into one
    another: merged, every use of a cell would repeat all that was done to it.
    """
    df = addresses
    for stage in request_stages():
        df = df.select(key, F.inline(F.array(F.struct(*[e.col.alias(n) for n, e in stage.items()]))))
    if aliases is not None:
        a = aliases.select(F.col("city").alias("q_city"), F.col("old_street").alias("q_street"), X.normalize_street(name("new_street")).col.alias("_new"))
        own = F.when(F.col("_new") != "", F.array("_new")).otherwise(F.array().cast("array<string>"))
        df = df.join(a, ["q_city", "q_street"], "left").withColumn("q_options", F.array_distinct(F.concat("q_options", F.coalesce(own, F.array().cast("array<string>"))))).drop("_new")
    return df


def prepared_directory(magistral: DataFrame, key: str = "record_id") -> DataFrame:
    return magistral.select(key, *[e.col.alias(n) for n, e in record_stage().items()])


def _named(df: DataFrame, c: str, to: str) -> DataFrame:
    """c, to, to_bag, to_n, to_head: each distinct name with its key, the key's set of letters, length and first four letters."""
    own = df.select(c).distinct().select(c, F.inline(F.array(F.struct(S.sorted_tokens(name(c)).col.alias(to)))))
    head = F.lit(0).cast("bigint")
    for i in (1, 2, 3, 4):
        head = head * 65536 + F.pmod(F.ascii(F.substring(to, i, 1)), F.lit(65536))
    return own.select(c, to, F.expr(S.letter_set(to)).alias(f"{to}_bag"), F.length(to).alias(f"{to}_n"), head.alias(f"{to}_head"))


def _alike(a: str, b: str, least: float) -> Column:
    """Whether two keys can reach a Jaro-Winkler of least at all: lossless.

    With p equal letters in front, at most four, Jaro must reach (least - p/10) / (1 - p/10); with m matching
    letters it is at most (m/n + m/k + 1) / 3. A letter that the other key doesn't have, or not twice, can't
    match, which bounds m. a, b: columns as in _named.
    """
    other = F.col(f"{a}_head").bitwiseXOR(F.col(f"{b}_head"))
    needed = lambda i: F.lit(3 * (least - i / 10) / (1 - i / 10) - 1 - 1e-9)
    bound = F.when(F.shiftright(other, 48) != 0, needed(0)).when(F.shiftright(other, 32) != 0, needed(1)).when(F.shiftright(other, 16) != 0, needed(2)).when(other != 0, needed(3)).otherwise(needed(4))
    n, k = F.col(f"{a}_n"), F.col(f"{b}_n")
    m = F.least(n - F.expr(f"bit_count({a}_bag & ~{b}_bag)"), k - F.expr(f"bit_count({b}_bag & ~{a}_bag)"))
    return (n == 0) | (k == 0) | (m / n + m / k >= bound)


def similar_names(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, least: float) -> DataFrame:
    """on, a, b, similarity: pairs of distinct names that share the columns on and are similar enough."""

    def bagged(df: DataFrame, c: str, to: str) -> DataFrame:
        own = df.select(*on, c).where(F.col(c) != "").distinct()
        return own.join(_named(own, c, to), c)

    pairs = bagged(left, a, "_a").join(bagged(right, b, "_b"), on).where(_alike("_a", "_b", least)).select(*on, a, b)
    pairs = pairs.select("*", token_similarity_column(a, b).alias("similarity"))
    return pairs.where(F.col("similarity") >= least)


def letters(c: str, least: float) -> Column:
    """Blocks of a name: two names with a Jaro-Winkler of least share one.

    With an equal first letter they share that. Without, Jaro itself must reach least: with m common letters
    m/n + m/k >= 3 * least - 1, and m <= k, so m is at least 3 * least - 2 of the longer length. Of two sets of
    letters (equal ones numbered) in one order that share m, the first n - m + 1 of one and of the other have
    one in common. The order begins with the late letters of the alphabet, which are rarer.
    """
    each = F.split(c, "")
    marked = F.array_sort(F.transform(each, lambda x, i: F.concat(x, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))
    n = F.length(c)
    first = F.slice(F.reverse(marked), F.lit(1), F.greatest(n - F.ceil(n * F.lit(3 * least - 2) - 1e-9).cast("int") + 1, F.lit(1)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), F.substring(c, 1, 1))), first))


def similar_everywhere(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, similarity: all pairs of distinct names that are similar enough, met in blocks of letters. A name of single
    letters only is compared with all as it stands; such names are few."""

    def keyed(df: DataFrame, c: str) -> DataFrame:
        return df.select(c).where(F.col(c) != "").distinct().select(c, F.inline(F.array(F.struct(F.lower(c).alias("_raw"), S.sorted_tokens(name(c)).col.alias("_key")))))

    blocked = lambda df, c, by: df.select(c, F.explode(letters(by, least)).alias("block"))
    x, y = keyed(left, a), keyed(right, b)
    found = [
        similar_names(blocked(x.where("_key != ''"), a, "_key"), blocked(y.where("_key != ''"), b, "_key"), ["block"], a, b, least),
        similar_names(blocked(x.where("_key = ''"), a, "_raw"), blocked(y, b, "_raw"), ["block"], a, b, least),
        similar_names(blocked(x, a, "_raw"), blocked(y.where("_key = ''"), b, "_raw"), ["block"], a, b, least),
    ]
    return found[0].union(found[1]).union(found[2]).groupBy(a, b).agg(F.max("similarity").alias("similarity"))


def city_pairs(requests: DataFrame, records: DataFrame) -> DataFrame:
    """q_city, r_city, city_sim: similar names that share their first two letters, a region or an index."""
    q = requests.select("q_city", F.substring("q_city", 1, 2).alias("prefix"), F.col("q_region").alias("region"), F.col("q_post").alias("post"))
    r = records.select("r_city", F.substring("r_city", 1, 2).alias("prefix"), F.col("r_region").alias("region"), F.col("r_post").alias("post"))
    found = [similar_names(q.where(f"{on} != ''"), r, [on], "q_city", "r_city", CITY_LEAST).select("q_city", "r_city", "similarity") for on in ("prefix", "region", "post")]
    return found[0].union(found[1]).union(found[2]).groupBy("q_city", "r_city").agg(F.max("similarity").alias("city_sim"))


def candidates(requests: DataFrame, records: DataFrame, cities: DataFrame) -> DataFrame:
    """row_id, record_id, street_sim: pairs of one city that can reach LEAST_SCORE.

    Without a similar street a pair needs the house, or the index and something of the house (0.35 + 0.085 + 0.12
    and 0.35 + 0.085 + 0.10 are below 0.60), so a pair is found through a similar street, an equal house, or an
    equal index beside a house with the same base or a part in common. Major cities have 0.10 more: there such
    a house or the index is enough.
    """
    q = requests.join(cities, "q_city")
    said = q.select("row_id", F.col("r_city").alias("city_key"), F.explode("q_options").alias("q_street"))
    streets = similar_names(said, records.withColumnRenamed("r_city", "city_key"), ["city_key"], "q_street", "r_street", STREET_LEAST)
    by_street = said.join(streets.select("city_key", "q_street", "r_street"), ["city_key", "q_street"])
    by_street = by_street.join(records.select("record_id", F.col("r_city").alias("city_key"), "r_street"), ["city_key", "r_street"]).select("row_id", "record_id")
    houses = records.where("r_built").select("record_id", F.col("r_city").alias("city_key"), F.explode(F.array_distinct("r_houses")).alias("house"))
    by_house = q.where("q_house != ''").select("row_id", F.col("r_city").alias("city_key"), F.col("q_house").alias("house")).join(houses.where("house != ''"), ["city_key", "house"]).select("row_id", "record_id")
    return by_street.union(by_house).union(_indexed_pairs(requests, records, cities)).union(_major_pairs(q, records)).union(_homeless_pairs(requests, records)).distinct()


def _indexed_pairs(requests: DataFrame, records: DataFrame, cities: DataFrame) -> DataFrame:
    """row_id, record_id: pairs of one city and index that can reach LEAST_SCORE without a similar street and the very house.

    With the index, city and street they have 0.535 at most, so they need a house of the same base or with a
    part in common, and a street that the score of city and house asks for: if that is a similar one, it is
    found by the street. Only in major cities the index alone is enough.
    """
    asked = requests.where("q_index != ''").select("row_id", "q_city", "q_index", "q_house", "q_base", "q_kind")
    held = records.where("r_index != ''").withColumnRenamed("r_index", "q_index")
    # Which cities of a request have its index at all, once per city and index.
    towns = asked.select("q_city", "q_index").distinct().join(cities, "q_city").join(held.select("r_city", "q_index").distinct(), ["r_city", "q_index"])
    asked = asked.join(towns, ["q_city", "q_index"])
    major = F.col("q_city").isin(*MAJOR_CITIES) & F.col("r_city").isin(*MAJOR_CITIES)
    alone = asked.where(major).join(held.select("record_id", "r_city", "q_index"), ["r_city", "q_index"])
    cells = held.where("r_built AND r_street != ''").select("record_id", "r_city", "q_index", "r_kind", F.inline(F.array_distinct(F.arrays_zip(F.col("r_houses").alias("house"), F.col("r_bases").alias("base")))))
    met = asked.where(~major & (F.col("q_house") != "")).join(cells, ["r_city", "q_index"])
    same_base = (F.col("q_base") != "") & (F.col("q_base") == F.col("base"))
    conflict = (F.col("q_kind") != "") & (F.col("r_kind") != "") & (F.col("q_kind") != F.col("r_kind"))
    street = (LEAST_SCORE - 1e-6 - CITY_WEIGHT * F.col("city_sim") - INDEX_SAME - F.when(same_base, HOUSE_BASE).otherwise(HOUSE_PART)) / STREET_LOW
    met = met.where(same_base | F.expr("contains(q_house, house) OR contains(house, q_house)")).where(street + F.when(conflict, KIND_PENALTY).otherwise(0.0) < STREET_LEAST)
    return alone.select("row_id", "record_id").union(met.select("row_id", "record_id"))


def _homeless_pairs(requests: DataFrame, records: DataFrame) -> DataFrame:
    """row_id, record_id: pairs without a city on one side that can reach LEAST_SCORE: they need the very house, and the
    index or an equal street of the same region (0.35 + 0.25 is LEAST_SCORE)."""
    street = lambda c: F.coalesce(F.nullif(S.sorted_tokens(name(c)).col, F.lit("")), F.col(c))

    def keyed(df: DataFrame, index: str, region: str, of: str, *more) -> DataFrame:
        """By hashes of the index and of region and street: pairs are scored in full, so a clash only costs one."""
        keys = F.array_compact(F.array(F.when(F.col(index) != "", F.xxhash64(F.lit(0), index)), F.when(F.col(region) != "", F.xxhash64(F.lit(1), region, street(of)))))
        return df.select(*more, F.explode(keys).alias("key"))

    asked = requests.where("q_house != '' AND size(q_options) > 0").select("row_id", "q_city", "q_region", "q_index", F.concat(F.lit(","), "q_house", F.lit(",")).alias("house"), F.explode("q_options").alias("option"))
    held = records.where("r_built AND r_street != ''").withColumn("houses", F.concat(F.lit(","), F.array_join("r_houses", ","), F.lit(",")))
    found = []
    for a, b in ((asked.where("q_city = ''"), held), (asked.where("q_city != ''"), held.where("r_city = ''"))):
        a, b = keyed(a, "q_index", "q_region", "option", "row_id", "house"), keyed(b, "r_index", "r_region", "r_street", "record_id", "houses")
        found.append(a.distinct().join(b, "key").where("contains(houses, house)").select("row_id", "record_id"))
    return found[0].union(found[1])


def _major_pairs(q: DataFrame, records: DataFrame) -> DataFrame:
    """row_id, record_id: pairs of major cities that can reach LEAST_SCORE by the base or a part of the house.

    Houses and streets are judged once per pair of distinct ones of the city.
    """
    asked = q.where(F.col("q_city").isin(*MAJOR_CITIES) & F.col("r_city").isin(*MAJOR_CITIES) & (F.col("q_house") != "")).withColumnRenamed("r_city", "city_key")
    held = records.where(F.col("r_city").isin(*MAJOR_CITIES) & (F.col("buildings") != "")).withColumnRenamed("r_city", "city_key")
    cells = held.select("record_id", "city_key", "r_street", "r_index", F.explode(F.array_distinct(F.split("buildings", ",", -1))).alias("cell"))
    each = cells.select("city_key", "cell").distinct().withColumn("h", F.expr(HOUSES.replace("buildings", "cell"))[0]).withColumn("base", F.expr(X.building_base(Ex("cell")).spark))
    same_base = (F.col("q_base") != "") & (F.col("q_base") == F.col("base"))
    houses = asked.select("city_key", "q_house", "q_base").distinct().join(each, "city_key").where(same_base | F.expr("contains(q_house, h) OR contains(h, q_house)"))
    houses = houses.select("city_key", "q_house", "q_base", "cell", F.when(same_base, HOUSE_BASE).otherwise(HOUSE_PART).alias("part"))
    least = (LEAST_SCORE - CITY_WEIGHT - CAPITAL - HOUSE_BASE) / STREET_LOW - 1e-6
    asked = asked.select("row_id", "city_key", F.explode("q_options").alias("q_street"), "q_house", "q_base", "q_index")
    streets = similar_names(asked, held, ["city_key"], "q_street", "r_street", least)
    met = asked.join(houses, ["city_key", "q_house", "q_base"]).join(cells, ["city_key", "cell"]).join(streets, ["city_key", "q_street", "r_street"])
    index = F.when((F.col("q_index") != "") & (F.col("r_index") != ""), INDEX_OTHER).otherwise(0.0)
    return met.where(CITY_WEIGHT + CAPITAL + STREET_LOW * F.col("similarity") + F.col("part") + index >= LEAST_SCORE - 1e-6).select("row_id", "record_id")


def _any(xs: Ex, spark: str, check: str) -> Ex:
    return Ex(f"exists({xs.spark}, h -> {spark})", f"len(list_filter({xs.check}, lambda h: {check})) > 0")


def score_stages() -> list[dict[str, Ex]]:
    """Parts of the score of a pair, then the score; columns as in prepared_requests and prepared_directory."""
    conflict = (name("q_kind") != "") & (name("r_kind") != "") & (name("q_kind") != name("r_kind")) & ~((name("q_kind") == "street") & (name("raw_street") >= 0.98))
    one = S.token_similarity(Ex("o"), name("r_street"))
    best = Ex(f"array_max(transform(`q_options`, o -> {one.spark}))", f'list_max(list_transform("q_options", lambda o: {one.check}))')
    raw = case(((name("q_street") != "") & (name("r_street") != ""), best), default=0.0)
    keys = name("r_houses")
    asked = (name("q_house") != "") & name("r_built")
    same = Ex(f"array_contains({keys.spark}, `q_house`)", f'list_contains({keys.check}, "q_house")')
    base = (name("q_base") != "") & has(name("r_bases"), name("q_base"))
    part = _any(keys, "contains(`q_house`, h) OR contains(h, `q_house`)", 'contains("q_house", h) OR contains(h, "q_house")')
    major = "('" + "', '".join(MAJOR_CITIES) + "')"
    both_major = Ex(f"(`q_city` IN {major} AND `r_city` IN {major})", f'("q_city" IN {major} AND "r_city" IN {major})')
    street = name("street_sim")
    total = (
        name("city_sim") * lit(CITY_WEIGHT)
        + case((both_major, CAPITAL), default=0.0)
        + case(((name("q_street") == "") | (name("r_street") == ""), 0.0), (street < STREET_LEAST, street * lit(STREET_LOW)), default=street * lit(STREET_WEIGHT))
        + name("house_part")
        + case(((name("q_index") == "") | (name("r_index") == ""), 0.0), (name("q_index") == name("r_index"), INDEX_SAME), default=INDEX_OTHER)
        + case(((name("city_sim") >= 0.95) & (street >= 0.95) & (name("house_part") >= HOUSE_SAME), PERFECT), default=0.0)
    )
    clamp = Ex(f"greatest(0.0D, least({total.spark}, 1.0D))", f"greatest(0.0::DOUBLE, least({total.check}, 1.0::DOUBLE))")
    return [
        {"raw_street": raw},
        {"street_sim": case((conflict, Ex("greatest(0.0D, `raw_street` - 0.25D)", 'greatest(0.0::DOUBLE, "raw_street" - 0.25::DOUBLE)')), default=name("raw_street")), "house_part": case((~asked, 0.0), (same, HOUSE_SAME), (base, HOUSE_BASE), (part, HOUSE_PART), default=HOUSE_NONE)},
        {"score": Ex(f"round({clamp.spark}, 9)", f"round({clamp.check}, 9)")},
        {"confidence": cast(case(((name("score") >= 1.0) & (~has(name("q_options"), name("r_street")) | ((name("q_house") != "") & (name("house_part") < HOUSE_SAME))), 99), default=Ex("floor(`score` * 100 + 1e-7)", 'floor("score" * 100 + 1e-7)')), "int", "INTEGER")},
    ]


def region_fits() -> Ex:
    """Whether regions, if both are given, are similar."""
    q, r = name("q_region"), name("r_region")
    return case(((q == "") | (r == "") | (q == r), lit(True)), default=S.token_similarity(q, r) >= REGION_LEAST)


BLOCK = "(left(q_city, 2) = left(r_city, 2) AND length(q_city) >= 2) OR (q_region != '' AND q_region = r_region) OR (q_post != '' AND q_post = r_post)"
#: In which block a pair meets first.
STRATEGY = "CASE WHEN left(q_city, 2) = left(r_city, 2) AND length(q_city) >= 2 THEN 1 WHEN q_region <> '' AND q_region = r_region THEN 2 ELSE 3 END"
SCORED = ("row_id", "record_id", "score", "confidence", "strategy", "r_index", "r_raw", "r_key", "r_street", "house_part", "q_index", "q_house")


def scored_pairs(requests: DataFrame, records: DataFrame) -> DataFrame:
    """SCORED columns of all pairs with LEAST_SCORE or more.

    Requests without a city, street or house meet nothing through that part; rows with NULLs count as ''.
    """
    cities = checkpointed(city_pairs(requests, records))
    q = requests.select("row_id", *[c for c in _KEPT if c.startswith("q_") and c != "q_box"], "q_options")
    r = records.select("record_id", "r_city", "r_street", "r_kind", "r_region", "r_built", "r_houses", "r_bases", "r_index", "r_post", "r_raw", "r_key")
    df = candidates(q, records, cities).join(q, "row_id").join(r, "record_id").join(cities, ["q_city", "r_city"], "left")
    return _scores(df.where("city_sim IS NOT NULL OR q_city = '' OR r_city = ''").withColumn("city_sim", F.coalesce("city_sim", F.lit(0.0))))


def homeless_scores(requests: DataFrame, records: DataFrame) -> DataFrame:
    """scored_pairs of the pairs without a city on one side."""
    # Few pairs: written first, they meet the wide rows of both sides where those are.
    pairs = checkpointed(_homeless_pairs(requests, records).distinct())
    q = requests.select("row_id", *[c for c in _KEPT if c.startswith("q_") and c != "q_box"], "q_options")
    r = records.select("record_id", "r_city", "r_street", "r_kind", "r_region", "r_built", "r_houses", "r_bases", "r_index", "r_post", "r_raw", "r_key")
    return _scores(pairs.join(q, "row_id").join(r, "record_id").withColumn("city_sim", F.lit(0.0)))


def _scores(df: DataFrame) -> DataFrame:
    """SCORED columns of the pairs that reach LEAST_SCORE. df: all columns of both sides, and city_sim."""
    # Read three times: for its distinct regions, its distinct streets, and to be scored.
    df = checkpointed(df.where(BLOCK).withColumn("strategy", F.expr(STRATEGY)).drop("q_post", "r_post"))
    # Distinct first: pushed below, the filter would judge every pair.
    regions = checkpointed(df.select("q_region", "r_region").distinct()).where(region_fits().col)
    df = df.join(regions, ["q_region", "r_region"])
    stages = score_stages()[1:]
    streets = df.select("q_options", "r_street").distinct().select("*", F.explode_outer("q_options").alias("q_street"))
    streets = streets.select("q_options", "r_street", F.when((F.col("q_street") != "") & (F.col("r_street") != ""), token_similarity_column("q_street", "r_street")).otherwise(0.0).alias("s"))
    df = df.join(streets.groupBy("q_options", "r_street").agg(F.max("s").alias("raw_street")), ["q_options", "r_street"])
    for stage in stages:
        for n, e in stage.items():
            df = df.withColumn(n, e.col)
    return df.where(F.col("score") >= LEAST_SCORE).select(*SCORED)


def deduplicated(scored: DataFrame) -> DataFrame:
    """row_id, record_id, score, confidence, r_index, r_raw, house_part, q_index, q_house, is_general, and what orders
    them (first, after score and confidence): one row for each address that a request found, whatever its
    indexes.

    Of rows with one address the most confident stands for it, of these the one with the least index.
    """
    order = F.struct(-F.col("score"), "strategy", "record_id")
    kept = ["record_id", "score", "confidence", "r_index", "r_raw", "house_part", "q_index", "q_house"]
    best = F.min_by(F.struct(*kept), F.struct(-F.col("confidence"), F.col("r_raw") == "", "r_raw", -F.col("score"), "strategy", "record_id"))
    one = scored.groupBy("row_id", "r_key").agg(best.alias("x"), F.min(order).alias("o"))
    return one.select("row_id", "x.*", F.lit(False).alias("is_general"), F.struct(F.lit(0).alias("a"), F.col("o.col1").alias("b"), F.col("o.strategy").cast("long").alias("c"), F.col("o.record_id").cast("long").alias("d")).alias("first"))


def general_places(magistral: DataFrame, records: DataFrame) -> DataFrame:
    """r_city, r_region, region, district, min_index, first: each place as the directory writes its area, with its least
    valid index; places without one are left out."""
    valid = F.when(F.col("city_index").rlike("^[0-9]{5}$"), F.col("city_index"))
    area = magistral.select("record_id", F.coalesce("region", F.lit("")).alias("region"), district_of().col.alias("district"), valid.alias("valid"))
    towns = records.select("record_id", "r_city", "r_region").join(area, "record_id").where("r_city != ''")
    return towns.groupBy("r_city", "r_region", "region", "district").agg(F.min("valid").alias("min_index"), F.min("record_id").alias("first")).where("min_index IS NOT NULL")


def general_results(requests: DataFrame, places: DataFrame) -> DataFrame:
    """row_id, region, district, min_index, first: the least valid index of each place of the requested name."""
    q = requests.where("q_city != ''").select("row_id", "q_city", "q_region")
    return q.join(places, F.col("q_city") == F.col("r_city")).where("q_region = '' OR q_region = r_region").select("row_id", "region", "district", "min_index", "first")


def with_general(requests: DataFrame, found: DataFrame, decided: DataFrame, places: DataFrame) -> DataFrame:
    """Rows like found: the general rows of requests that found something, but nothing sure, outside the large cities.

    An index that is there already is left out; places that are written alike but for case are one.
    """
    no = [F.lit(c) for c in NO_GENERAL]
    open_ = decided.where("NOT auto").select("row_id").join(requests, "row_id").where((F.col("q_city") != "") & ~F.col("q_city").isin(*no))
    rows = general_results(open_, places).join(found.select("row_id", F.col("r_raw").alias("min_index")).distinct(), ["row_id", "min_index"], "left_anti")
    area = [X.normalize_text(name(c)).col.alias(f"n_{c}") for c in ("region", "district")]
    one = rows.select("row_id", *area, "min_index", "first").groupBy("row_id", "n_region", "n_district").agg(F.min("min_index").alias("r_raw"), F.min("first").alias("d"))
    asked = one.join(requests.select("row_id", "q_index", "q_house"), "row_id")
    return asked.select(
        "row_id", F.lit(None).cast("bigint").alias("record_id"), F.lit(GENERAL_SCORE).alias("score"), F.lit(int(GENERAL_SCORE * 100)).alias("confidence"), F.regexp_replace("r_raw", "^0+", "").alias("r_index"), "r_raw",
        F.lit(0.0).alias("house_part"), "q_index", "q_house", F.lit(True).alias("is_general"), F.struct(F.lit(1).alias("a"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("c"), F.col("d").cast("long").alias("d")).alias("first"),
    )


def decide(found: DataFrame, general: bool) -> DataFrame:
    """row_id, total_found, top_score, auto, chosen: one row per request with results, from aggregates only.

    Sure are the results from AUTO_CONFIDENCE on, and general ones if general; only those of the requested
    index, if there are any. Of several the first is taken if it is at least SURE_CONFIDENCE and alone at its
    confidence, or if all name one index. Another index than the requested one is corrected from
    SURE_CONFIDENCE on, never by a general row; a requested house must be in the list.
    """
    sure = F.col("confidence") >= AUTO_CONFIDENCE
    if general:
        sure = sure | (F.col("is_general") & (F.col("score") >= GENERAL_LEAST))
    place = F.struct(-F.col("score"), -F.col("confidence"), "first")
    row = F.struct("record_id", "r_raw", "r_index", "confidence", "house_part", "is_general")
    # Results that found stands for but doesn't hold, none of them sure; see meeting.
    more = F.sum("more") if "more" in found.columns else F.lit(0)
    own = found.withColumn("sure", sure).withColumn("same", sure & (F.col("q_index") != "") & (F.col("r_index") == F.col("q_index")))
    # At most one row for each confidence, so that the second step sees few of them.
    steps = own.groupBy("row_id", "sure", "same", "confidence").agg(
        F.count("*").alias("n"), more.alias("more"), F.max("score").alias("score"), F.min(F.when(F.col("r_raw") != "", F.col("r_index"))).alias("low"), F.max(F.when(F.col("r_raw") != "", F.col("r_index"))).alias("high"),
        F.min_by(row, place).alias("row"), F.min(place).alias("place"), F.first("q_index").alias("q_index"), F.first("q_house").alias("q_house"),
    )
    chosen = []
    for tag, among in (("all", F.col("sure")), ("same", F.col("same"))):
        of = lambda c, among=among: F.when(among, F.col(c))
        chosen.append(
            F.struct(
                F.coalesce(F.sum(of("n")), F.lit(0)).alias("n"), F.min(of("low")).alias("low"), F.max(of("high")).alias("high"), F.min_by(of("row"), of("place")).alias("first"),
                F.max(of("confidence")).alias("top"), F.max_by(of("row"), of("confidence")).alias("best"), F.max_by(of("n"), of("confidence")).alias("n_top"),
            ).alias(tag)
        )
    per = steps.groupBy("row_id").agg((F.sum("n") + F.coalesce(F.sum("more"), F.lit(0))).alias("total_found"), F.max("score").alias("top_score"), F.first("q_index").alias("q_index"), F.first("q_house").alias("q_house"), *chosen)
    per = per.withColumn("p", F.when(F.col("same.n") > 0, F.col("same")).otherwise(F.col("all")))
    alone = (F.col("p.n") > 1) & (F.col("p.top") >= SURE_CONFIDENCE) & (F.col("p.n_top") == 1)
    one = (F.col("p.n") == 1) | alone | F.coalesce(F.col("p.low") == F.col("p.high"), F.lit(False))
    per = per.withColumn("chosen", F.when(alone, F.col("p.best")).otherwise(F.col("p.first"))).withColumn("one", one)
    c = lambda n: F.col(f"chosen.{n}")
    indexed = (F.col("q_index") == "") | (F.col("q_index") == c("r_index")) | (~c("is_general") & (c("confidence") >= SURE_CONFIDENCE))
    housed = c("is_general") | (F.col("q_house") == "") | (c("house_part") >= HOUSE_BASE)
    return per.select("row_id", "total_found", "top_score", F.coalesce(F.col("one") & indexed & housed, F.lit(False)).alias("auto"), "chosen")


def resolved(requests: DataFrame, scored: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, decided): the results of each request, general rows among them, and one row per request: row_id, mode,
    total_found, top_score, auto_index, auto_confidence.

    mode is auto, manual (there are results) or none. Post-office boxes of the capital are decided by their
    rule alone.
    """
    return settled(requests, checkpointed(deduplicated(scored.join(requests.where("q_box").select("row_id"), "row_id", "left_anti"))), places)


def settled(requests: DataFrame, first: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As resolved. first: one row for each address that a request found, or as meeting.first_results gives them."""
    one = decide(first, False)
    general = checkpointed(with_general(requests, first, one, places))
    ids = general.select("row_id").distinct()
    again = first.join(ids, "row_id", "left_semi").unionByName(general, allowMissingColumns=True)
    two = decide(again, True)
    found = first.unionByName(general, allowMissingColumns=True)
    decided = one.join(ids, "row_id", "left_anti").unionByName(two)
    box = F.col("q_box")
    out = requests.select("row_id", "q_box").join(decided, "row_id", "left")
    auto = F.coalesce(F.col("auto"), F.lit(False))
    out = out.select(
        "row_id", F.when(box | auto, "auto").when(F.col("total_found").isNull(), "none").otherwise("manual").alias("mode"),
        F.when(box, 1).otherwise(F.coalesce("total_found", F.lit(0))).cast("bigint").alias("total_found"), F.when(box, BOX_CONFIDENCE / 100).otherwise(F.coalesce("top_score", F.lit(0.0))).alias("top_score"),
        F.when(box, BOX_INDEX).when(auto, F.col("chosen.r_raw")).otherwise("").alias("auto_index"), F.when(box, BOX_CONFIDENCE).when(auto, F.col("chosen.confidence")).otherwise(0).cast("int").alias("auto_confidence"),
    )
    return found, out


def ranked(found: DataFrame, most: int = 20) -> DataFrame:
    """The most best results of each request, with their rank: by score, confidence, then in the order of the directory."""
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), F.desc("confidence"), "first")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def block_sizes(requests: DataFrame, records: DataFrame) -> DataFrame:
    """row_id, by_city, by_region, by_index: how many directory rows each block of a request holds.

    Counts of blocks are joined, never their rows.
    """
    r_prefix = records.where("length(r_city) >= 2").groupBy(F.substring("r_city", 1, 2).alias("k")).agg(F.count("*").alias("by_city"))
    r_region = records.where("r_region != ''").groupBy(F.col("r_region").alias("k")).agg(F.count("*").alias("by_region"))
    r_post = records.where("r_post != ''").groupBy(F.col("r_post").alias("k")).agg(F.count("*").alias("by_index"))
    q = requests.select("row_id", F.when(F.length("q_city") >= 2, F.substring("q_city", 1, 2)).alias("p"), "q_region", "q_post")
    q = q.join(r_prefix, q.p == r_prefix.k, "left").drop("k").join(r_region, F.col("q_region") == r_region.k, "left").drop("k").join(r_post, F.col("q_post") == r_post.k, "left")
    return q.select("row_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("by_city", "by_region", "by_index")])
