"""Problem 2: streets of a directory and of a classifier that share no identifier.

Directory cells are read into (city, kind, ordinal, given name or initial, main word), and so are the current
and former names of classifier streets. A mention's candidates are the streets of its city with the same main
word, those whose main word is within a few typing errors (distinct words meet through marks, see
name_marks), and those of the former name that the cell adds. Kind and given name must not contradict. How
the parts agree is compared in levels, and expectation-maximization estimates from the counts of the level
patterns what each level says.

A factor graph over the candidate pairs gives the confidences: each mention means at most one street, and
each street takes at most one mention of a form (how kind, given name and name are written). Loopy belief
propagation passes messages along the pairs, as sums over the mention and over the street's slot, until no
message changes; pairs that compete with no other have their marginal at once, by the same formula. A word
that no listed street has is a misspelling, and a street may be misspelled in any number of ways: such
mentions, and those that add a former name, compete for streets among themselves only by their own candidates.
Rows are matched as distinct mentions, so that copies and popular streets cost nothing extra.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.functions.similarity import letter_set
from kvartal.llm.bktree import typing_errors as count_errors
from kvartal.llm.canonical import MAX_BROADCAST, PLACED, SHARD, Places, coded, collect_places, place_batch, place_sharded, settle
from kvartal.llm.names import StreetName, parse_street, split_former
from kvartal.llm.weights import estimate
from kvartal.session import checkpointed

#: Least marginal probability of a match.
LEAST = 0.5
#: Typing errors in a main word: one in any, two from seven letters, MOST_ERRORS from nine if given names agree.
MOST_ERRORS = 3
#: Letters up to which a word may have one error only.
SHORT = 6
#: Messages are passed until none changes by more than TOLERANCE; ROUNDS is only a guard, and warns.
DAMPING, ROUNDS, TOLERANCE = 0.3, 200, 1e-3
#: Rounds between two tables that cut the lineage.
ROUNDS_A_TABLE = 4
#: Levels of the comparison. main: same; one error in seven letters or more; in fewer; two or three errors; errors, though the word
#: is itself a listed name; not compared. given: same, initial, none on either side, one missing, another. kind: same, none written,
#: one unwritten, another. former: current, former name. added: the former name that the cell adds is the
#: street's; none added, or another way of writing.
LEVELS = {"main": 6, "given": 5, "kind": 4, "former": 2, "added": 2}
#: First guess where the last level is no disagreement.
GUESS = {"main": ([0.7, 0.08, 0.06, 0.08, 0.02, 0.06], [0.2, 0.1, 0.1, 0.2, 0.3, 0.1]), "former": ([0.7, 0.3], [0.6, 0.4]), "added": ([0.1, 0.9], [0.02, 0.98])}
_EMPTY = StreetName("", 0, "", "")
_NAMES = "kind string, ord int, given string, main string"


def _reading(now: StreetName, was: StreetName) -> str:
    """A street cell as read, in one string; no part holds the bar."""
    return f"{now.kind}|{now.ord}|{now.given}|{now.main}|{was.ord}|{was.given}|{was.main}"


def read_cell(cell: str) -> str:
    now, was = split_former(cell)
    name = parse_street(now)
    return _reading(name, parse_street(was) if was else _EMPTY) if name.main else ""


def readings(cells: pa.Array) -> pa.Array:
    """Each distinct cell of a batch is read once."""
    at, distinct = coded(cells)
    return pa.array([read_cell(c) for c in distinct], pa.string()).take(pa.array(at))


def split_reading(reading: Column) -> Column:
    return F.split(reading, r"\|")


def parts_of(reading: Column) -> list[Column]:
    """kind, ord, given, main, was_ord, was_given, was_main of a reading."""
    return split_parts(split_reading(reading))


def split_parts(x: Column) -> list[Column]:
    cast = {"ord": "int", "was_ord": "int"}
    return [F.get(x, F.lit(i)).cast(cast.get(n, "string")).alias(n) for i, n in enumerate(("kind", "ord", "given", "main", "was_ord", "was_given", "was_main"))]


def street_names(streets: DataFrame, cities: DataFrame) -> DataFrame:
    """street_id, city, former, kind, ord, given, main: current and former names of each distinct street.

    Streets without id or name, and those whose city reference leads nowhere, give no row. The kind stands in
    its own column or in the name; a former name without kind has the street's.
    """
    own = streets.select(
        F.trim(F.col("street_id").cast("string")).alias("street_id"), F.regexp_replace(F.col("city_id"), r"(?U)^\s+|\s+$", "").alias("city"),
        F.coalesce("street_type_short", F.lit("")).alias("kind"), F.coalesce("street", F.lit("")).alias("street"), F.coalesce("old_street", F.lit("")).alias("old"),
    ).where(F.col("street_id").isNotNull()).distinct()
    own = own.join(cities.select(F.col("city_id").cast("string").alias("city")).distinct(), "city", "left_semi").select("street_id", "city", "kind", "street", "old")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cities, former, parsed = [], [], [], []
            for sid, cid, kind, street, old in zip(*[c.to_pylist() for c in b.columns]):
                now = parse_street(f"{kind} {street}")
                before = parse_street(old)
                if before[1:] == now[1:]:
                    before = _EMPTY
                for name, is_old in ((now, False), (before, True)):
                    if name.main:
                        ids.append(sid)
                        cities.append(cid)
                        former.append(is_old)
                        parsed.append(name._replace(kind=name.kind or now.kind))
            kinds, ords, givens, mains = zip(*parsed) if parsed else ((), (), (), ())
            columns = [pa.array(ids, pa.string()), pa.array(cities, pa.string()), pa.array(former, pa.bool_()), pa.array(kinds, pa.string()), pa.array(ords, pa.int32()), pa.array(givens, pa.string()), pa.array(mains, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["street_id", "city", "former", *StreetName._fields])

    return own.mapInArrow(run, f"street_id string, city string, former boolean, {_NAMES}")


def read_mentions(records: DataFrame, cities: DataFrame, key: str, city: str, street: str, hints: list[str], index: str, bound: int = MAX_BROADCAST, shard: int = SHARD) -> DataFrame:
    """_key, _city, _reading (see parts_of) of the rows whose cells name a listed city and a street."""
    places = collect_places(cities, bound)
    # Blank cells read as no city and no street and fall out at the end.
    own = records.where(F.col(city).isNotNull() & F.col(street).isNotNull())
    own = own.select(F.col(key).alias("_key"), F.col(index).alias("_index"), F.col(city).alias("_cell"), F.concat_ws(" ", *hints).alias("_hints"), F.col(street).alias("_street"))
    schema = f"_key {own.schema['_key'].dataType.simpleString()}, _index {own.schema['_index'].dataType.simpleString()}, "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Places.shared(places)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *place_batch(p, b.column(2), b.column(3)), readings(b.column(4))], names=["_key", "_index", "_city", "_options", "_reading"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], readings(b.column(4))], names=["_key", "_index", "_cell", "_hints", "_reading"])

    if places is not None:
        placed = own.mapInArrow(run, schema + PLACED + ", _reading string")
    else:
        text = own.mapInArrow(read, schema + "_cell string, _hints string, _reading string")
        placed = place_sharded(text.withColumnRenamed("_cell", "_named"), cities, ["_key", "_index", "_reading"], "_named", ["_hints"], shard)
    return settle(checkpointed(placed), cities, ["_index"]).where("_city != '' AND _reading != ''").select("_key", "_city", "_reading")


#: Words of so many letters and more are marked alike, counted from their beginning and end.
LONG = 13


def _less_one(tag: int, start: int, n: int, last: int = 0) -> list[tuple[int, ...]]:
    """The strings that n letters leave without one of them: tag, first letter (from the end if negative), letters before
    and after the one left out, and another letter that is added (0: none)."""
    return [(tag, start, i, n - 1 - i, last) for i in range(n)]


def _begin(n: int) -> int:
    return 3 if n in (7, 9) else 4


def _end(n: int) -> int:
    return 4 if n <= 8 else 6


#: Tags of marks: of the whole word, its beginning, its end.
_WHOLE, _BEGIN, _END = range(3)


def name_marks(n: int) -> list[tuple[int, ...]]:
    """Marks of a classifier name of four letters or more; it shares one with mention_marks of every word that is within the
    typing errors of candidate_pairs.

    Up to SHORT letters there is one error at most: a name and a word with one are equal if each loses one
    letter or none. Longer names have a beginning and an end that don't overlap. Of three errors at most, one
    of the two has at most one; a swap across its border changes one letter of it. A part with at most one
    error and the letters of the mention in its place leave an equal string if each loses one letter. Where
    beginning and end meet, a swap across both and an error in each are still three: the beginning is also
    marked as after that swap.
    """
    if n <= SHORT:
        return [(_WHOLE, 1, n, 0, 0), *_less_one(_WHOLE, 1, n)]
    begin, end = _begin(n), _end(n)
    # Without its last letter, the swapped beginning is the other one without its own.
    swapped = _less_one(_BEGIN, 1, begin - 1, begin + 1) if n >= 9 and begin + end == n else []
    return _less_one(_BEGIN, 1, begin) + _less_one(_END, -end, end) + swapped


def mention_marks(n: int) -> list[tuple[int, ...]]:
    """Marks of a mentioned word of four letters or more, for each length that the name meant may have."""
    shorter, longer = 3 if n >= 12 else 2 if n >= 9 else 1, MOST_ERRORS if n >= 9 else 2 if n >= 7 else 1
    lengths = range(max(n - shorter, SHORT + 1), n + longer + 1)
    marks = [(_WHOLE, 1, n, 0, 0), *_less_one(_WHOLE, 1, n)] if n <= SHORT + 1 else []
    if n >= SHORT:
        marks += [m for k in sorted({_begin(x) for x in lengths}) for m in _less_one(_BEGIN, 1, k)]
        marks += [m for k in sorted({_end(x) for x in lengths}) for m in _less_one(_END, -k, k)]
    return marks


def marked(words: DataFrame, word: str, marks: Callable[[int], list[tuple[int, ...]]], keep: list[str], seed: str = "seed") -> DataFrame:
    """keep, sign: words, once for each of their marks; sign stands for it and for seed.

    The marks of each length are a constant, and rows are cut by generated code: as functions of arrays the same takes five
    times as long.
    """
    of_length = ", ".join(f"array({', '.join(map(str, marks(n)))})" if n >= 4 else "array()" for n in range(LONG + 1))
    each = words.select(*keep, seed, word, F.explode(F.get(F.expr(f"array({of_length})"), F.least(F.length(word), F.lit(LONG)))).alias("_at"))
    tag, start, before, after, last = (F.col(f"_at.col{i}") for i in range(1, 6))
    w = F.col(word)
    text = F.concat(F.substring(w, start, before), F.substring(w, start + before + 1, after), F.substring(w, last, F.least(last, F.lit(1))))
    return each.select(*keep, F.xxhash64(seed, tag, text).alias("sign"))


def typing_errors(a: str, b: str) -> Column:
    """Column of the typing errors between two columns. Not repeated where a filter uses it as well."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(count_errors(x.tolist(), y.tolist()), dtype="int32")

    return F.pandas_udf(run, T.IntegerType()).asNondeterministic()(a, b)


def _given_agrees(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b) | ((F.length(a) == 1) & F.startswith(b, a)) | ((F.length(b) == 1) & F.startswith(a, b))


def _kind_agrees(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)


def near_words(said: DataFrame, known: DataFrame, sound=lambda word: word) -> DataFrame:
    """city, ord, main, s_main, typo: said words and the other known words of their city and ordinal within the
    typing errors that candidate_pairs admits. said, known: city, ord, main. sound maps words letter by
    letter before they are marked, which only brings more of them together."""
    both = said.select("city", "ord", "main", F.lit(True).alias("said")).unionByName(known.select("city", "ord", "main", F.lit(False).alias("said"))).where(F.length("main") >= 4)
    both = both.groupBy("city", "ord", "main").agg(F.bool_or("said").alias("said"), F.bool_or(~F.col("said")).alias("known"))
    words = checkpointed(both.withColumn("bag", F.expr(letter_set("main"))).withColumn("id", F.monotonically_increasing_id()))

    def signed(which: str, marks: Callable[[int], list[tuple[int, ...]]], tag: str) -> DataFrame:
        own = [f"{tag}{c}" for c in ("id", "main", "bag")]
        return marked(words.where(which).select(*[F.col(c).alias(tag + c) for c in ("id", "main", "bag")], F.xxhash64("city", "ord").alias("seed"), sound(F.col("main")).alias("key")), "key", marks, own)

    met = signed("said", mention_marks, "m_").join(signed("known", name_marks, "s_").hint("shuffle_hash"), "sign").where("m_id != s_id")
    size = F.least(F.length("m_main"), F.length("s_main"))
    most = F.when(size <= SHORT, 1).when(size <= 8, 2).otherwise(MOST_ERRORS)
    # Each error but a swap changes a letter that the words have, and no more; a swap counts 2 in Levenshtein's metric.
    changed = F.greatest(F.expr("bit_count(m_bag & ~s_bag)"), F.expr("bit_count(s_bag & ~m_bag)"))
    met = met.where((changed <= most) & ((F.levenshtein("m_main", "s_main", MOST_ERRORS) >= 0) | ((changed < most) & (F.levenshtein("m_main", "s_main", 2 * MOST_ERRORS) >= 0))))
    met = met.select("m_id", "s_id", F.col("m_main").alias("main"), "s_main").distinct()
    size = F.least(F.length("main"), F.length("s_main"))
    most = F.when(size <= SHORT, 1).when(size <= 8, 2).otherwise(MOST_ERRORS)
    met = met.withColumn("typo", typing_errors("main", "s_main")).where(F.col("typo") <= most)
    at = words.select(F.col("id").alias("m_id"), "city", "ord")
    return met.join(at, "m_id").select("city", "ord", "main", "s_main", "typo")


#: Pairs that can't be matches: another given name or another kind.
_CONTRADICTS = f"given = {LEVELS['given'] - 1} OR kind = {LEVELS['kind'] - 1}"


def candidate_pairs(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mid, mid2, street_id, the levels, form, n_m: pairs of mentions and streets with equal or near main words,
    and the number of those of the mention that don't contradict each other. form is NULL where the mention
    doesn't compete for the street.

    mentions: mid, mid2, city and the parts of a reading.
    """
    # Streets that are equal in all that is compared can't be told apart: the smallest id stands for them.
    compared = ("s_kind", "s_given", "former")
    each = F.array_sort(F.collect_list(F.struct(F.col("kind").alias("s_kind"), F.col("given").alias("s_given"), "former", "street_id")))
    differs = lambda x, y: reduce(or_, [x[c] != y[c] for c in compared])
    listed = names.groupBy("city", "ord", "main").agg(each.alias("each"))
    listed = checkpointed(listed.select("city", "ord", "main", F.filter("each", lambda x, i: (i == 0) | differs(x, F.get("each", i - 1))).alias("listed")))
    near = checkpointed(near_words(mentions, listed))
    # A word of some city's list is rarely a misspelling.
    vocabulary = listed.select("main", F.lit(True).alias("known")).distinct()
    near = near.join(vocabulary, "main", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # What a word may mean: the streets that are called so, and those of near words.
    itself = listed.select("city", "ord", "main", F.lit(0).alias("level"), "listed")
    others = near.join(listed.select("city", "ord", F.col("main").alias("s_main"), "listed"), ["city", "ord", "s_main"])
    level = F.when(F.col("known"), 4).when(F.col("typo") > 1, 3).when(F.least(F.length("main"), F.length("s_main")) < 7, 2).otherwise(1)
    others = others.select("city", "ord", "main", (level + F.when(F.col("typo") == MOST_ERRORS, 8).otherwise(0)).alias("level"), "listed")
    means = itself.unionByName(others).groupBy("city", "ord", "main").agg(F.collect_list(F.struct("level", "listed")).alias("means"))
    means = means.select("city", "ord", "main", F.flatten(F.transform("means", lambda w: F.transform(w["listed"], lambda x: F.struct(w["level"].alias("level"), x.alias("s"))))).alias("x"))
    fits = lambda given, s: _given_agrees(given, s["s_given"]) & _kind_agrees(F.col("kind"), s["s_kind"])
    # Three errors, marked by 8, only count if both given names are there.
    three = lambda x: (x["level"] < 8) | ((F.col("given") != "") & (x["s"]["s_given"] != ""))
    counts = lambda x: three(x) & fits(F.col("given"), x["s"])
    met = mentions.join(means.hint("shuffle_hash"), ["city", "ord", "main"])
    # Most mentions have one candidate, which needs no function of arrays.
    met = met.withColumn("n_m", F.when(F.size("x") > 1, F.size(F.filter("x", counts))).when(counts(F.get("x", F.lit(0))), 1).otherwise(0))
    met = met.select("mid", "mid2", "kind", "given", "was_main", "n_m", F.explode("x").alias("x")).where(three(F.col("x")))
    met = met.select("mid", "mid2", "kind", "given", "was_main", "n_m", F.col("x.s").alias("s"), (F.col("x.level") % 8).alias("main"))

    def levelled(df: DataFrame, given: str, added: Column) -> DataFrame:
        g, s = F.col(given), F.col("s.s_given")
        levels = {
            "given": F.when((g == "") & (s == ""), 2).when((g == "") | (s == ""), 3).when(~_given_agrees(g, s), 4).when((F.length(g) > 1) & (F.length(s) > 1), 0).otherwise(1),
            "kind": F.when((F.col("kind") == "") & (F.col("s.s_kind") == ""), 1).when((F.col("kind") == "") | (F.col("s.s_kind") == ""), 2).when(F.col("kind") == F.col("s.s_kind"), 0).otherwise(3),
            "former": F.col("s.former").cast("int"),
            "added": added,
        }
        return df.select("mid", "mid2", F.col("s.street_id").alias("street_id"), "main", *[c.cast("int").alias(n) for n, c in levels.items()], *[c for c in ("n_m", "form") if c in df.columns])

    form = F.when((F.col("main") == 0) | (F.col("main") == 4), F.xxhash64(F.col("kind") != "", F.least(F.length("given"), F.lit(2)), "s.former"))
    plain = levelled(met.where("was_main = ''").withColumn("form", form), "given", F.lit(1))
    # The former name that a cell adds in brackets points at the street by itself.
    adding = mentions.where("was_main != ''")
    was = adding.select("mid", "mid2", "kind", F.col("was_given").alias("given"), F.col("city"), F.col("was_ord").alias("ord"), F.col("was_main").alias("main")).join(listed, ["city", "ord", "main"])
    was = was.withColumn("s", F.explode("listed")).where(fits(F.col("given"), F.col("s")))
    both = levelled(met.where("was_main != ''"), "given", F.lit(1)).drop("n_m").unionByName(levelled(was.withColumn("main", F.lit(5)), "given", F.lit(0)))
    both = both.groupBy("mid", "mid2", "street_id").agg(F.min(F.struct("main", "given", "kind", "former")).alias("x"), F.min("added").alias("added")).select("mid", "mid2", "street_id", "x.*", "added")
    both = both.withColumn("form", F.lit(None).cast("bigint")).withColumn("n_m", F.count(F.when(F.expr(f"NOT ({_CONTRADICTS})"), 1)).over(Window.partitionBy("mid", "mid2")).cast("int"))
    return plain.unionByName(both)


def weighted(pairs: DataFrame) -> DataFrame:
    """pairs (a table without lineage) with odds, as the levels' weights give them."""
    fields = list(LEVELS)
    # At most as many rows as there are patterns of levels.
    counts = pairs.groupBy(*fields).agg(F.count("*").alias("n")).toPandas()
    pairs = pairs.where(f"NOT ({_CONTRADICTS})")
    if not len(counts):
        return pairs.withColumn("odds", F.lit(1.0))
    w = estimate(counts, LEVELS, ((counts["given"] == LEVELS["given"] - 1) | (counts["kind"] == LEVELS["kind"] - 1)).to_numpy(), GUESS)
    total = F.lit(w.prior)
    for f in fields:
        total = total + F.element_at(F.array(*[F.lit(x) for x in w.log[f]]), F.col(f) + 1)
    return pairs.withColumn("odds", F.exp(F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def marginals(odds: DataFrame) -> DataFrame:
    """mid, mid2, street_id, probability, n_m: marginal of each pair under the one-to-one factors.

    odds: mid, mid2, street_id, form, n_m, odds. Messages are ratios: a is what the mention's factor tells the pair,
    1 / (1 + the others' odds), b the same from the street's slot. They are damped and passed until none changes
    by more than TOLERANCE; a graph that doesn't settle within ROUNDS raises a warning with the last change.
    """
    w_m, w_s = Window.partitionBy("mid", "mid2"), Window.partitionBy("street_id", "form")
    key = ["mid", "mid2", "street_id"]
    # Slots with more than one mention, and the pairs that compete with another: the edges that messages pass along.
    slots = checkpointed(odds.where("form IS NOT NULL").groupBy("street_id", "form").agg((F.count("*") - 1).alias("rivals")).where("rivals > 0"))
    ranked = odds.select(*key, "form", "odds", "n_m").join(slots, ["street_id", "form"], "left").withColumn("rivals", F.coalesce("rivals", F.lit(0)))
    alone = (F.col("n_m") == 1) & (F.col("rivals") == 0)
    lone = ranked.where(alone).select(*key, (F.col("odds") / (1 + F.col("odds"))).alias("probability"), "n_m")
    graph = checkpointed(ranked.where(~alone)).withColumn("a", F.lit(1.0)).withColumn("b", F.lit(1.0))
    last = 0.0
    for _ in range(ROUNDS // ROUNDS_A_TABLE):
        for _ in range(ROUNDS_A_TABLE):
            # A sum over the group less the own term: the message to a pair leaves out what came from it.
            sent = graph.withColumn("b_new", F.when(F.col("rivals") == 0, 1.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), F.sum(F.col("odds") * F.col("a")).over(w_s) - F.col("odds") * F.col("a")))))
            sent = sent.withColumn("b_new", (1 - DAMPING) * F.col("b_new") + DAMPING * F.col("b"))
            sent = sent.withColumn("a_new", 1 / (1 + F.greatest(F.lit(0.0), F.sum(F.col("odds") * F.col("b_new")).over(w_m) - F.col("odds") * F.col("b_new"))))
            sent = sent.withColumn("a_new", (1 - DAMPING) * F.col("a_new") + DAMPING * F.col("a"))
            change = F.abs(F.col("a_new") - F.col("a")) + F.abs(F.col("b_new") - F.col("b"))
            graph = sent.select(*key, "form", "odds", "n_m", "rivals", F.col("a_new").alias("a"), F.col("b_new").alias("b"), change.alias("change"))
        graph = checkpointed(graph)
        last = graph.agg(F.max("change")).first()[0] or 0.0
        if last < TOLERANCE:
            break
    else:
        warnings.warn(f"messages still change by {last:.3g} after {ROUNDS} rounds", stacklevel=2)
    belief = F.col("odds") * F.col("a") * F.col("b")
    return lone.unionByName(graph.select(*key, (belief / (1 + belief)).alias("probability"), "n_m"))


def match_mentions(mentions: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """mid, mid2, street_id, probability: the likeliest street of each mention that reaches least; ties take the
    smallest street_id."""
    found = marginals(weighted(checkpointed(candidate_pairs(mentions, names))))
    one = found.where("n_m = 1").select("mid", "mid2", "street_id", "probability")
    best = found.where("n_m > 1").groupBy("mid", "mid2").agg(F.max_by(F.struct("street_id", "probability"), F.struct(F.round("probability", 6), F.coalesce(-F.col("street_id").try_cast("long"), F.lit(0)))).alias("best"))
    return one.unionByName(best.select("mid", "mid2", "best.*")).where(F.col("probability") >= least)


def identified(rows: DataFrame) -> DataFrame:
    """rows with mid and mid2: 128 bits that stand for _city and _reading in later steps."""
    return rows.withColumn("mid", F.xxhash64("_city", "_reading")).withColumn("mid2", F.xxhash64("_reading", "_city"))


def mentions_of(rows: DataFrame) -> DataFrame:
    """mid, mid2, city and the parts of each distinct reading."""
    own = rows.select(F.col("_city").alias("city"), "_reading").distinct()
    # Split in a step of its own: as results of the aggregate, the parts would each split the reading again.
    own = identified(own.select("city", "_reading", F.col("city").alias("_city"))).withColumn("_split", split_reading(F.col("_reading")))
    return own.select("mid", "mid2", "city", *split_parts(F.col("_split")))


def match_streets(records: DataFrame, streets: DataFrame, cities: DataFrame, key: str = "record_id", bound: int = MAX_BROADCAST, shard: int = SHARD) -> DataFrame:
    """key, street_id, confidence: the classifier street that each directory record means.

    Records without city or street cell, and those without counterpart, give no row; repeated records give
    repeated rows. Empty tables give an empty result. bound: cities up to which their list is broadcast; the
    result doesn't depend on it.
    """
    hints = ["region", "old_district", "new_district", "delivery_district"]
    rows = read_mentions(records, cities, key, "city", "street", hints, "city_index", bound, shard)
    best = match_mentions(checkpointed(mentions_of(rows)), checkpointed(street_names(streets, cities)))
    # One row per mention and no hot key on that side: hashed, so that the rows needn't be sorted.
    return identified(rows).select(F.col("_key").alias(key), "mid", "mid2").join(best.hint("shuffle_hash"), ["mid", "mid2"]).select(key, "street_id", F.col("probability").alias("confidence"))
