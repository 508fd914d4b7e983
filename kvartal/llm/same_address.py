"""Problem 4: the same postal address written differently.

Rows are read into (city, kind, ordinal, given name, main word, house), whatever field holds the parts. The
city comes from its cell, else from an address written out in the street cell, else from the postal index as
other rows use it. Distinct readings ("nodes") of one city and house are candidates if they have the same
classifier street (entity_match), or, where the register doesn't know the street of one, if their words meet
in a block of sound keys and differ by few letters. Components are compared in levels, missing values being a
level of their own, and expectation-maximization estimates from the counts of the level patterns how much
each level speaks for a match. Pairs with a posterior of at least one half link their nodes, and the rows of
linked and of equal nodes are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.llm.canonical import MAX_BROADCAST, PLACED, SHARD, Cells, Fact, Places, clean_index, collect_places, index_cities, index_counts, packed, settle, sharded_facts
from kvartal.llm.entity_match import MOST_ERRORS, _reading, identified, match_mentions, mentions_of, near_words, parts_of, street_names
from kvartal.llm.names import _CITY_KIND, _FLAT, _GLUED, _STREET_KIND, HOUSE, Memo, StreetName, _house, parse_street, split_former, word_key, words
from kvartal.llm.weights import estimate
from kvartal.session import checkpointed

LEAST = 0.5

_DIGIT, _LATIN_LETTER = re.compile(r"\d"), re.compile(r"[A-Za-z]")
_COUNTRY = frozenset(word_key(w) for w in ("україна", "украина", "ukraine", "ukraina"))
_AREA = re.compile(r"(?:\bобл\b|\bобласть|\bр-н\b|\bрайон|\boblast|\braion)", re.I)
_LEAD_INDEX = re.compile(r"\s*(\d{5})(?:\s+|$)")
_LEAD = r"(?:(?:будинок|буд|дом|д|б|bud|b|d)\b\s*[.,№]*\s*|№\s*)"
_WHOLE_HOUSE = re.compile(rf"\s*{_LEAD}?({HOUSE.pattern})\s*[.,]*\s*", re.I)
_TAIL_HOUSE = re.compile(rf"^(.*?[^\s,])(?:[\s,]+({_LEAD})?|({_LEAD}))({HOUSE.pattern})\s*[.,]*\s*$", re.I | re.S)
_TAIL_ORDINAL = re.compile(r"[1-9]-?(?:й|я|е|є)")


class Address(NamedTuple):
    """options: the entries that the row may mean; named: whether any cell names a city; house: '' if none."""

    options: tuple[Fact, ...]
    named: bool
    reading: str
    house: str
    index: str


_EMPTY = StreetName("", 0, "", "")


def _house_of(text: str) -> str:
    """The house number if text is nothing else."""
    if not _DIGIT.search(text):
        return ""
    m = _WHOLE_HOUSE.fullmatch(_FLAT.sub("", text.lower().replace(" ", " ")).strip())
    return _house(HOUSE.search(m.group(1))) if m else ""


def _cut_house(text: str) -> tuple[str, str]:
    """A street without the house number at its end, and that number."""
    if not _DIGIT.search(text):
        return text.strip(), ""
    bare = _FLAT.sub("", text).strip()
    m = _TAIL_HOUSE.match(bare)
    if not m:
        return bare, ""
    lead = m.group(2) or m.group(3)
    if not lead and _TAIL_ORDINAL.fullmatch(m.group(4).strip()):
        return bare, ""
    return m.group(1), _house(HOUSE.search(m.group(4).lower()))


class Piece(NamedTuple):
    """A part of a written-out address between commas. what: skip, area, house, street, or maybe (a city, or
    a street without its kind)."""

    what: str
    text: str
    index: str
    typed: bool = False


def _classify(piece: str) -> Piece:
    index, piece = "", piece.strip()
    if m := _LEAD_INDEX.match(piece):
        index, piece = m.group(1), piece[m.end() :].strip()
    if not piece or (_DIGIT.search(piece) and not _FLAT.sub("", piece.lower()).strip()):
        return Piece("skip", "", index)
    if "(" not in piece and _AREA.search(piece):
        return Piece("area", piece, index)
    if h := _house_of(piece):
        return Piece("house", h, index)
    ws = words(_GLUED.sub(r"\1 ", piece))
    keys = [word_key(w) for w in ws]
    latin = [word_key(w, False) for w in ws] if _LATIN_LETTER.search(piece) else keys
    if len(ws) == 1 and (keys[0] in _COUNTRY or latin[0] in _COUNTRY):
        return Piece("skip", "", index)
    if any(k in _STREET_KIND for k in keys) or any(k in _STREET_KIND for k in latin):
        return Piece("street", piece, index)
    first = keys[0] if keys else ""
    # One letter before a word may be an initial; longer kinds are a city's.
    return Piece("maybe", piece, index, len(ws) > 1 and first in _CITY_KIND and len(first) > 1)


_piece = Memo(_classify)


def _split(text: str) -> list[Piece]:
    return [_piece[x] for x in text.split(",")] if text.strip() else []


def _unsure(named: bool, parts: list[Piece]) -> list[str]:
    """Parts of a row that must be looked up among the cities."""
    open_ = [x for x in parts if x.what in ("maybe", "street")]
    return [x.text for x in open_ if x.what == "maybe"] if not named or len(open_) > 1 else []


def _read_line(parts: list[Piece], named: bool, p: Cells) -> tuple[list[str], str, list[tuple[Fact, ...]], list, list[str], str]:
    """Street parts, house, cities found, their cells, hints and index of a text with any address parts."""
    streets, house, cities, cells, hints, index = [], "", [], [], [], ""
    unsure = set(_unsure(named, parts))
    for x in parts:
        index = index or x.index
        if x.what == "area":
            hints += p.hint_keys[x.text]
        elif x.what == "house":
            house = house or x.text
        elif x.what == "street":
            streets.append(x.text)
        elif x.what == "maybe":
            cell = p.cells[x.text]
            if x.text in unsure:
                p.search([cell.key])
            at = p.found.get(cell.key, ()) if x.text in unsure else ()
            if at or x.typed:
                cities.append(at)
                cells.append(cell)
            else:
                streets.append(x.text)
    return streets, house, cities, cells, hints, index


def read_address(city: str, street: str, building: str, hint: str, p: Cells) -> Address:
    """One row's parts. p: the listed places."""
    options: tuple[Fact, ...] = ()
    kind, hints, index = "", list(p.hint_keys[hint]), ""
    named = bool(city.strip())
    if named:
        cell = p.cells[city]
        p.search([cell.key])
        options, kind = p.found.get(cell.key, ()), cell.kind
        hints += cell.hints
        index = cell.index
    house = _house_of(building)
    parts, inner, cities, cells, more, line_index = _read_line(_split(street), named, p)
    if building.strip() and not house:
        b_parts, b_house, b_cities, b_cells, b_more, b_index = _read_line(_split(building), True, p)
        if b_parts and not b_house:
            cut = [_cut_house(x) for x in b_parts]
            b_house = next((h for _, h in cut if h), "")
        house = b_house
        if not parts:
            parts = b_parts
        cities, cells, more, line_index = cities + b_cities, cells + b_cells, more + b_more, line_index or b_index
    hints += more
    if not options:
        found = [(o, c) for o, c in zip(cities, cells) if o]
        if found:
            options, kind, named = found[0][0], found[0][1].kind, True
            hints += found[0][1].hints
        elif cities and len(parts):
            named = True
    cut = [_cut_house(x) for x in parts]
    house = house or inner or next((h for _, h in cut if h), "")
    best, was = _EMPTY, _EMPTY
    for text, _ in cut:
        now, former = split_former(text)
        name = parse_street(now)
        if name.main and (not best.main or (name.kind and not best.kind)):
            best, was = name, parse_street(former) if former else _EMPTY
    if len(options) > 1:
        options = tuple(p.choose(options, kind, hints))
    return Address(options, named, _reading(best, was) if best.main else "", house, index or line_index)


def _lookups(city: str, street: str, building: str, p: Cells) -> list[str]:
    """Keys of all parts of a row that may be looked up among the cities."""
    parts = [city] if city.strip() else []
    parts += _unsure(bool(city.strip()), _split(street))
    if building.strip() and not _house_of(building):
        parts += _unsure(True, _split(building))
    return [p.cells[x].key for x in parts]


_READ = f"_key bigint, {PLACED}, _index string, _old_index string, _reading string, house string"


def read_rows(rows: DataFrame, cities: DataFrame, key: str = "row_id", bound: int = MAX_BROADCAST, shard: int = SHARD) -> DataFrame:
    """One reading per row that names a street and a house; `_city` is '' for rows without any city cell. bound:
    cities up to which their list is broadcast; the result doesn't depend on it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = rows.select(F.col(key).cast("bigint").alias("_key"), text("city"), text("street"), text("building"), F.concat_ws(" ", "region", "district").alias("hint"), text("index"), text("old_index"))
    places = collect_places(cities, bound)

    def read(columns: list[list], p: Cells) -> pa.RecordBatch:
        out = []
        for k, city, street, building, hint, index, old in zip(*columns):
            a = read_address(city, street, building, hint, p)
            if not a.reading or not a.house or (a.named and not a.options):
                continue
            at = a.options
            out.append((k, (at[0].id if len(at) == 1 else None) if at else "", packed(at) if len(at) > 1 else None, a.index or index, old if index else (old or a.index), a.reading, a.house))
        text = pa.string()
        arrays = [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 7, (pa.int64(), *[text] * 6))]
        return pa.RecordBatch.from_arrays(arrays, names=["_key", "_city", "_options", "_index", "_old_index", "_reading", "house"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Places.shared(places)
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            # The names of a batch are searched together.
            p.search({k for city, street, building in zip(*columns[1:4]) for k in _lookups(city, street, building, p)})
            yield read(columns, p)

    if places is not None:
        return own.mapInArrow(run, _READ)

    names = own.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Cells()
        for b in batches:
            keys = [sorted(set(_lookups(*x, p))) for x in zip(*[c.to_pylist() for c in b.columns[1:4]])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.string()))], names=[*names, "keys"])

    # More cities than may be broadcast: the parts of all rows are looked up in shards and come back to their rows.
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    own = checkpointed(own.mapInArrow(keyed, fields + ", keys array<string>").withColumn("_row", F.monotonically_increasing_id()))
    each = own.select("_row", F.explode("keys").alias("key"))
    facts = sharded_facts(each.select("key").distinct(), cities, shard)
    met = each.join(facts, "key").groupBy("_row").agg(F.collect_list(F.struct("key", "options")).alias("found"))
    own = own.join(met, "_row", "left").drop("_row", "keys")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Cells()
        for b in batches:
            p.found = {x["key"]: tuple(Fact(**f) for f in x["options"]) for found in b.column(7).to_pylist() for x in found or ()}
            yield read([c.to_pylist() for c in b.columns[:7]], p)

    return own.mapInArrow(looked_up, _READ)


def placed_rows(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Readings with their city: namesakes settled, rows without city cell placed by their index."""
    read = checkpointed(rows)
    done = settle(read.where("_city IS NULL OR _city != ''"), cities, ["_index", "_old_index"])
    lone = index_cities(index_counts(read, "_index")).withColumnRenamed("_index", "_i")
    blank = read.where("_city = ''").withColumn("_i", F.coalesce(clean_index(F.col("_index")), clean_index(F.col("_old_index"))))
    # An index has five digits.
    blank = blank.join(F.broadcast(lone), "_i").withColumn("_city", F.col("_by_index"))
    return done.unionByName(blank.select(*done.columns))


# ---- comparison and weights

#: Levels of each component. main: same, renamed (the register says so), one letter, up to three. given: same, initial, one missing,
#: another. kind, index: same, one missing, another.
LEVELS = {"main": 4, "given": 4, "kind": 3, "index": 3}
#: First guess where no level is a disagreement.
GUESS = {"main": ([0.7, 0.1, 0.1, 0.1], [0.2, 0.3, 0.2, 0.3])}


def levels() -> dict[str, Column]:
    """Comparison levels of a pair of nodes, columns a_* and b_*."""
    a, b = lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")
    missing = lambda c: (a(c) == "") | (b(c) == "")
    prefix = ((F.length(a("given")) == 1) & F.startswith(b("given"), a("given"))) | ((F.length(b("given")) == 1) & F.startswith(a("given"), b("given")))
    far = F.levenshtein("a_main", "b_main", MOST_ERRORS)
    # A current and a former name of one street differ in all parts; the register explains that.
    renamed = (a("official") != "") & (a("official") == b("official")) & (far < 0)
    return {
        "main": F.when(a("main") == b("main"), 0).when(far == 1, 2).when(far > 1, 3).otherwise(1),
        "given": F.when(missing("given") | renamed, 2).when(a("given") == b("given"), 0).when(prefix, 1).otherwise(3),
        "kind": F.when(missing("kind"), 1).when(a("kind") == b("kind"), 0).otherwise(2),
        "index": F.when((F.size(a("indexes")) == 0) | (F.size(b("indexes")) == 0), 1).when(F.arrays_overlap(a("indexes"), b("indexes")), 0).otherwise(2),
    }


# Letters that sound alike, each written as the second.
SOUND = ("зжгбдвюящц", "сшхптфуашс")


def node_pairs(nodes: DataFrame) -> DataFrame:
    """place, a, b, a_*, b_*: pairs of nodes of one city and house that have the same classifier street, or of
    which the register doesn't know one, and whose words sound alike.

    Words meet in blocks of sound keys once per city (near_words), not once per house. Pairs that contradict
    each other in kind or given name are compared too: they are what the weights learn disagreement from.
    """
    parts = ["kind", "given", "main", "official", "indexes"]
    a = nodes.select("place", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in parts], F.col("ord").alias("a_ord"), "city")
    b = nodes.select("place", F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in parts], F.col("ord").alias("b_ord"))
    listed = a.drop("city", "a_ord").join(b.drop("b_ord"), (a.place == b.place) & (a.a_official == b.b_official)).where("a_official != '' AND a < b").drop(b.place)
    words = checkpointed(nodes.groupBy("city", "ord", "main").agg(F.max(F.col("official") == "").alias("open")))
    open_words = words.where("open").select("city", "ord", "main")
    near = near_words(open_words, words.select("city", "ord", "main"), lambda w: F.translate(w, *SOUND)).select("city", "ord", "main", "s_main")
    near = near.unionByName(open_words.withColumn("s_main", F.col("main")))
    left = a.where("a_official = ''").join(near.select("city", F.col("ord").alias("a_ord"), F.col("main").alias("a_main"), "s_main"), ["city", "a_ord", "a_main"])
    # Two open nodes meet from both sides; one of them is enough.
    unknown = left.join(b, (left.place == b.place) & (left.a_ord == b.b_ord) & (left.s_main == b.b_main)).where("a != b AND (b_official != '' OR a < b)").drop(b.place)
    return listed.unionByName(unknown.select(*listed.columns))


def linked_nodes(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """place, a, b, posterior: linked nodes."""
    fields = [*LEVELS, "known"]
    known = (F.col("a_official") != "") & (F.col("b_official") != "")
    pairs = checkpointed(node_pairs(nodes).select("place", "a", "b", known.alias("known"), *[c.cast("int").alias(f) for f, c in levels().items()]))
    # At most as many rows as there are patterns of levels.
    counts = pairs.groupBy(*fields).agg(F.count("*").alias("n")).toPandas()
    if not len(counts):
        return pairs.select("place", "a", "b", F.lit(1.0).alias("posterior")).where("false")
    # The register decides what it knows on both sides; where it is silent, another kind or given name is another street.
    known = counts["known"].to_numpy(bool)
    never = ((counts["kind"] == LEVELS["kind"] - 1) | (counts["given"] == LEVELS["given"] - 1)).to_numpy()
    counts.loc[known, "posterior"] = 1.0
    counts.loc[~known, "posterior"] = estimate(counts[~known], LEVELS, never[~known], GUESS).posterior
    scored = pairs.sparkSession.createDataFrame(counts[[*fields, "posterior"]])
    return pairs.join(F.broadcast(scored), fields).where(F.col("posterior") >= least).select("place", "a", "b", "posterior")


def same_addresses(addresses: DataFrame, streets: DataFrame, cities: DataFrame, key: str = "row_id", bound: int = MAX_BROADCAST, shard: int = SHARD) -> DataFrame:
    """key_a, key_b (key_a < key_b): all pairs of rows that denote one location.

    Rows without a listed city, a street or a house number denote none; NULL and empty cells are missing
    values. Copies count: rows that read alike are one node and all its rows are paired. Repeated keys are rows
    of their own but are not paired with themselves.
    """
    rows = placed_rows(read_rows(addresses, cities, key, bound, shard), cities)
    # City with house, and the reading: 128 bits that name a node.
    rows = checkpointed(rows.select("_key", "_city", "_reading", "house", F.coalesce(clean_index(F.col("_index")), F.lit("")).alias("index"), F.xxhash64("_city", "house").alias("place"), F.xxhash64("_reading").alias("node")))
    best = match_mentions(checkpointed(mentions_of(rows)), checkpointed(street_names(streets, cities))).select("mid", "mid2", F.col("street_id").alias("official"))
    # A node's indexes have five digits each.
    nodes = rows.groupBy("place", "node", "_city", "_reading").agg(F.collect_set(F.when(F.col("index") != "", F.col("index"))).alias("indexes"))
    nodes = identified(nodes).join(best, ["mid", "mid2"], "left")
    nodes = checkpointed(nodes.select("place", "node", F.col("_city").alias("city"), *parts_of(F.col("_reading"))[:4], F.coalesce("official", F.lit("")).alias("official"), "indexes"))
    links = linked_nodes(nodes).select("place", "a", "b")
    x, y = rows.select("place", F.col("node").alias("a"), F.col("_key").alias("x")), rows.select("place", F.col("node").alias("b"), F.col("_key").alias("y"))
    pairs = links.join(x, ["place", "a"]).join(y, ["place", "b"]).where("x != y").select("x", "y")
    copies = x.join(y, (x.place == y.place) & (x.a == y.b)).where("x < y").select("x", "y")
    return pairs.unionByName(copies).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
