"""Problem 3: values typed freely, mapped to a canonical list of cities.

The reference list becomes a BK-tree under Levenshtein's metric in the folded alphabet of names.py. Up to
MAX_BROADCAST entries (a checked count) the list is broadcast and each worker builds the tree once; rows are
then placed in one pass without a shuffle, and only distinct names of a batch are searched. A larger list is
sharded (match_to_reference): every distinct name meets the trees of the shards it can be near to, and what
the shards find is joined to the rows. Both ways share every rule after the search and give the same result.

Every entry within RADIUS is found; an entry is accepted if one typing error (insertion, deletion,
substitution, swap of neighbours) explains the difference. Namesakes are told apart by region and district,
then by the postal index as other rows of the same tables use it, then by the region of the index, at last by
population.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.bktree import BKTree
from kvartal.llm.names import Memo, joined, one_edit, parse_city, word_key, words
from kvartal.session import checkpointed

RADIUS = 2
#: Entries up to which the reference list is collected and broadcast; beyond, it is sharded, with the same result.
MAX_BROADCAST = 100_000
#: Entries of one shard's tree, and values that meet it in one task.
SHARD, BLOCK = 50_000, 50_000
#: A swap counts 2 in Levenshtein's metric and 1 as a typing error, so RADIUS covers one error.
_REGION_FILL = frozenset(word_key(w) for w in ("обл", "область", "області", "р-н", "район", "району", "oblast", "raion"))


def name_key(name: str | None) -> str:
    return parse_city(name).key if name else ""


def entry_keys(name: str | None, former: str | None) -> set[str]:
    """Keys under which an entry is found: of its names, also as a transliterated cell reads them."""
    return {k for n in (name, former) if n for k in (name_key(n), joined(name_key(n)))} - {""}


def hint_words(text: str) -> tuple[str, ...]:
    return tuple(k for w in words(text) if (k := word_key(w)) not in _REGION_FILL)


class Fact(NamedTuple):
    """What is known of a reference entry; the keys are region and district in the folded alphabet."""

    id: str
    region: str
    population: int
    kind: str
    region_key: str
    district_key: str


FACT = "id string, region string, population bigint, kind string, region_key string, district_key string"
#: Open options travel as one string, NULL for nearly all rows: id, region, population of each.
PLACED = "_city string, _options string"
_FIELD, _ENTRY = "\x1f", "\x1e"
_FACT_TYPE = pa.struct([("id", pa.string()), ("region", pa.string()), ("population", pa.int64()), ("kind", pa.string()), ("region_key", pa.string()), ("district_key", pa.string())])


def packed(options: Iterable[Fact]) -> str:
    return _ENTRY.join(_FIELD.join((o.id, o.region, str(o.population))) for o in options)


def fact(id_: str, kind: str | None, region: str | None, district: str | None, population: int | None) -> Fact:
    return Fact(id_, region or "", int(population or 0), parse_city(f"{kind} x").kind if kind else "", word_key((region or "").lower().strip()), word_key((district or "").lower().strip()))


class Cells:
    """Parsed cells and hints of a worker, and the entries that each key names."""

    def __init__(self):
        self.found: dict[str, tuple[Fact, ...]] = {}
        self.cells = Memo(parse_city)
        self.hint_keys = Memo(hint_words)

    def search(self, keys: Iterable[str]) -> None:
        """Put the entries that each key names into found."""

    def choose(self, options: tuple[Fact, ...], kind: str, hints: list[str]) -> list[Fact]:
        """Those options that region and district speak for the most; all if none does."""
        if len(options) < 2:
            return list(options)
        says = lambda key: any(h == key or (len(h) > 6 and one_edit(h, key)) for h in hints)
        scores = [4 * says(o.region_key) + 3 * (bool(o.district_key) and says(o.district_key)) for o in options]
        best = max(scores)
        return [o for o, s in zip(options, scores) if s == best]


class Places(Cells):
    """The broadcast reference list with its tree. rows: (id, name, former name, kind, region, district, population)."""

    _built: dict[int, Places] = {}

    def __init__(self, rows: list[tuple]):
        super().__init__()
        self.by_key: dict[str, list[Fact]] = {}
        for r in rows:
            f = fact(r[0], *r[3:])
            for key in entry_keys(r[1], r[2]):
                self.by_key.setdefault(key, []).append(f)
        self.tree = BKTree(list(self.by_key))

    @classmethod
    def shared(cls, rows: list[tuple]) -> Places:
        """One tree per worker process, whatever the number of its tasks."""
        mark = hash(tuple(rows))
        if mark not in cls._built:
            cls._built.clear()
            cls._built[mark] = cls(rows)
        return cls._built[mark]

    def search(self, keys: Iterable[str]) -> None:
        if len(self.found) > 200_000:
            self.found.clear()
        new = []
        for k in set(keys):
            if k not in self.found:
                if k in self.by_key:
                    self.found[k] = tuple(self.by_key[k])
                else:
                    new.append(k)
        for k, hits in zip(new, self.tree.search(new, RADIUS)):
            near = {f for e, _ in hits if one_edit(k, self.tree.entries[e]) for f in self.by_key[self.tree.entries[e]]}
            self.found[k] = tuple(sorted(near))


def collect_places(cities: DataFrame, bound: int = MAX_BROADCAST) -> list[tuple] | None:
    """The distinct reference rows, or None if there are more than bound."""
    rows = _entries(cities).limit(bound + 1).collect()
    return None if len(rows) > bound else sorted((tuple(r) for r in rows), key=lambda r: str(r[0]))


def _entries(cities: DataFrame) -> DataFrame:
    return cities.select(*[F.col(c).cast("string") for c in ("city_id", "city", "old_city", "city_type_short", "region", "district")], F.coalesce(F.col("population"), F.lit(0)).cast("long").alias("population")).where("city_id IS NOT NULL").distinct()


def coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """A batch's column as numbers of its distinct values, and these; NULL is a value like others."""
    d = column.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def place_batch(p: Cells, cells: pa.Array, hints: pa.Array) -> tuple[pa.Array, pa.Array]:
    """`_city` and `_options` of a batch (see place). Each distinct cell is judged once, and of those with
    namesakes each distinct pair of cell and hints."""
    at, names = coded(cells)
    parsed = [p.cells[c] for c in names]
    p.search([c.key for c in parsed])
    found = [p.found.get(c.key, ()) for c in parsed]
    city: list[str | None] = ["" if not f else f[0].id if len(f) == 1 else None for f in found]
    options: list[list[Fact] | None] = [None] * len(city)
    many = np.flatnonzero(np.array([len(f) > 1 for f in found], bool)[at]) if len(found) else np.zeros(0, int)
    if len(many):
        said, texts = coded(hints)
        pairs, back = np.unique(at[many].astype(np.int64) * len(texts) + said[many], return_inverse=True)
        for x in pairs.tolist():
            c, h = divmod(x, len(texts))
            left = p.choose(found[c], parsed[c].kind, [*p.hint_keys[texts[h] or ""], *parsed[c].hints])
            city.append(left[0].id if len(left) == 1 else None)
            options.append(None if len(left) == 1 else left)
        at = at.astype(np.int64)
        at[many] = len(names) + back
    at = pa.array(at)
    return pa.array(city, pa.string()).take(at), pa.array([None if o is None else packed(o) for o in options], pa.string()).take(at)


def place(rows: DataFrame, places: list[tuple], keep: list[str], cell: str, hints: list[str]) -> DataFrame:
    """keep of rows with a non-blank cell, `_city` ('' if the cell names no entry, NULL if it names several
    that the hints don't tell apart) and then these in `_options`."""
    own = rows.select(*keep, F.col(cell).alias("_cell"), F.concat_ws(" ", *hints).alias("_hints"))
    own = own.where(F.col("_cell").rlike(r"(?U)\S"))
    n = len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:n]) + ", " + PLACED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Places.shared(places)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *place_batch(p, b.column(n), b.column(n + 1))], names=[*keep, "_city", "_options"])

    return own.mapInArrow(run, schema)


def clean_index(x):
    """A postal index as five digits; NULL for placeholders and anything else."""
    bare = F.regexp_replace(x, r"[\s ]", "")
    return F.when(bare.rlike(r"^[0-9]{4,5}$") & ~F.lpad(bare, 5, "0").isin("00000", "01000"), F.lpad(bare, 5, "0"))


def index_counts(placed: DataFrame, index: str) -> DataFrame:
    """(_index, _city, n): rows of each city with each index, the indexes cleaned once per distinct value."""
    used = placed.where(F.col("_city").isNotNull() & (F.col("_city") != "")).groupBy(F.col(index).alias("_raw"), "_city").agg(F.count("*").alias("n"))
    used = used.select(clean_index(F.col("_raw")).alias("_index"), "_city", "n").where("_index IS NOT NULL")
    return used.groupBy("_index", "_city").agg(F.sum("n").alias("n"))


def index_cities(counts: DataFrame) -> DataFrame:
    """(_index, _by_index): the city that most rows with this index name. At most 100,000 rows, as an index
    has five digits, so it may be broadcast."""
    return counts.groupBy("_index").agg(F.max_by("_city", F.struct("n", "_city")).alias("_by_index"))


def settle(placed: DataFrame, cities: DataFrame, indexes: list[str]) -> DataFrame:
    """placed (a table without lineage) with `_city` also for namesakes, and without `_options`: by index, by
    the region that the index begins with, at last the most populous (smallest id of equals).

    Only the rows left open are written anew; the others are read from placed.
    """
    names = [c for c in placed.columns if c != "_options"]
    if placed.where("_city IS NULL").isEmpty():
        return placed.select(*names)
    counts = checkpointed(index_counts(placed, indexes[0]))
    regions = cities.select(F.col("city_id").cast("string").alias("_city"), F.coalesce("region", F.lit("")).alias("_region")).groupBy("_city").agg(F.min("_region").alias("_region"))
    by_prefix = (
        counts.groupBy(F.substring("_index", 1, 2).alias("_prefix"), "_city").agg(F.sum("n").alias("n"))
        .join(regions, "_city").groupBy("_prefix", "_region").agg(F.sum("n").alias("n"))
        .groupBy("_prefix").agg(F.max_by("_region", F.struct("n", "_region")).alias("_prefix_region"))
    )
    index = F.coalesce(*[clean_index(F.col(i)) for i in indexes])
    left = placed.where(F.col("_city").isNull()).withColumn("_i", index).withColumn("_prefix", F.substring("_i", 1, 2))
    # An index has five digits and a prefix two: both tables are bounded.
    left = left.join(F.broadcast(index_cities(counts).withColumnRenamed("_index", "_i")), "_i", "left").join(F.broadcast(by_prefix), "_prefix", "left")
    ranked = F.array_max(
        F.transform(
            F.transform(F.split("_options", _ENTRY), lambda x: F.split(x, _FIELD)),
            lambda o: F.struct(
                (o[0] == F.coalesce(F.col("_by_index"), F.lit(""))).cast("int").alias("a"), (o[1] == F.coalesce(F.col("_prefix_region"), F.lit("?"))).cast("int").alias("b"),
                o[2].cast("long").alias("c"), F.coalesce(-o[0].try_cast("long"), F.lit(0)).alias("d"), o[0].alias("id"),
            ),
        )
    )
    left = checkpointed(left.withColumn("_city", ranked["id"]).select(*names))
    return placed.where(F.col("_city").isNotNull()).select(*names).unionByName(left)


def match_to_reference(values: DataFrame, value: str, entries: DataFrame, entry: str, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK, nearest: bool = True) -> DataFrame:
    """value, entry, distance: for each distinct value every entry within radius, or, if nearest, those at the
    least distance; entry and distance are NULL for a value without any. For reference lists of any size.

    An entry's length is its distance from the empty string, the root of all trees: a value only meets
    shards of lengths within radius of its own. Lengths with more than shard entries are split by hash, so
    that no tree outgrows a task, and values come in blocks. NULL and empty values and entries are left out;
    ties give several rows.
    """
    own = values.select(F.col(value).alias("value")).where(F.col("value") != "").distinct()
    held = entries.select(F.col(entry).alias("entry")).where(F.col("entry") != "").distinct().withColumn("_n", F.length("entry"))
    blocks = max(1, -(-own.count() // block))
    # One row for each length of an entry and part of it.
    parts = held.groupBy("_n").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("_parts"))
    spread = own.withColumn("_n", F.explode(F.sequence(F.length("value") - radius, F.length("value") + radius))).join(parts, "_n")
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_block", F.pmod(F.xxhash64("value"), F.lit(blocks))).drop("_parts")
    held = held.join(parts, "_n").withColumn("_part", F.pmod(F.xxhash64("entry"), F.col("_parts")).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).drop("_parts")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree, queries = BKTree(right["entry"].tolist()), left["value"].tolist()
        out = [(q, tree.entries[e], d) for q, hits in zip(queries, tree.search(queries, radius)) for e, d in hits]
        return pd.DataFrame(out, columns=["value", "entry", "distance"])

    at = ["_n", "_part", "_block"]
    hits = spread.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(run, "value string, entry string, distance int")
    if nearest:
        least = hits.groupBy("value").agg(F.min("distance").alias("least"))
        hits = hits.join(least, "value").where("distance = least").drop("least")
    return own.join(hits, "value", "left")


def sharded_facts(keys: DataFrame, cities: DataFrame, shard: int = SHARD) -> DataFrame:
    """key, options: the facts of all entries that each distinct key names, as Places.search finds them, for a
    list of any size. keys: key."""
    schema = f"entry string, fact struct<{', '.join(x.replace(' ', ': ') for x in FACT.split(', '))}>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(key, fact(r[0], *r[3:])._asdict()) for r in zip(*[c.to_pylist() for c in b.columns]) for key in sorted(entry_keys(r[1], r[2]))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([f for _, f in out], _FACT_TYPE)], names=["entry", "fact"])

    entries = checkpointed(_entries(cities).mapInArrow(read, schema))
    hits = match_to_reference(keys, "key", entries, "entry", RADIUS, shard, nearest=False).where("entry IS NOT NULL")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([one_edit(v, e) for v, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    hits = hits.mapInArrow(accept, "value string, entry string, distance int").join(entries, "entry")
    # An entry named outright is not searched further.
    per = hits.groupBy("value").agg(F.min("distance").alias("least"), F.collect_set(F.struct("distance", "fact")).alias("all"))
    kept = F.filter("all", lambda x: (F.col("least") > 0) | (x["distance"] == 0))
    return per.select(F.col("value").alias("key"), F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["fact"]))).alias("options"))


def place_sharded(rows: DataFrame, cities: DataFrame, keep: list[str], cell: str, hints: list[str], shard: int = SHARD) -> DataFrame:
    """As place, for a reference list of any size."""
    own = rows.select(*keep, F.col(cell).alias("_cell"), F.concat_ws(" ", *hints).alias("_hints"))
    own = own.where(F.col("_cell").rlike(r"(?U)\S"))
    n = len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    columns = own.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Memo(name_key)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([cells[c] for c in b.column(n).to_pylist()], pa.string())], names=[*columns, "key"])

    own = checkpointed(own.mapInArrow(keyed, schema + ", key string"))
    met = own.join(sharded_facts(own.select("key").distinct(), cities, shard), "key", "left").drop("key")
    final = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:n]) + ", " + PLACED

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Cells()
        for b in batches:
            # A key has the same options in all rows.
            p.found = {p.cells[c].key: tuple(Fact(**f) for f in o or ()) for c, o in zip(b.column(n).to_pylist(), b.column(n + 2).to_pylist())}
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *place_batch(p, b.column(n), b.column(n + 1))], names=[*keep, "_city", "_options"])

    return met.mapInArrow(choose, final)


def canonical_cities(tables: dict[str, tuple[DataFrame, str, str, list[str], list[str]]], cities: DataFrame, bound: int = MAX_BROADCAST, shard: int = SHARD) -> DataFrame:
    """table_name, row_key, city_id: the reference city of every non-blank cell, '' if it names none.

    tables: name -> (rows, key column, cell column, hint columns, index columns). NULL and blank cells give
    no row; repeated rows give repeated rows; an empty reference list leaves all cells unmatched. bound:
    entries up to which the list is broadcast; the result doesn't depend on it.
    """
    places = collect_places(cities, bound)
    parts = []
    for name, (rows, key, cell, hints, indexes) in tables.items():
        own = rows.select(
            F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.col(cell).alias("cell"),
            F.concat_ws(" ", *hints).alias("hints"), F.col(indexes[0]).alias("index_a"), F.col(indexes[-1]).alias("index_b"),
        )
        keep = ["table_name", "row_key", "index_a", "index_b"]
        parts.append(place(own, places, keep, "cell", ["hints"]) if places is not None else own)
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    if places is None:
        placed = place_sharded(placed, cities, keep, "cell", ["hints"], shard)
    placed = checkpointed(placed)
    return settle(placed, cities, ["index_a", "index_b"]).select("table_name", "row_key", F.col("_city").alias("city_id"))
