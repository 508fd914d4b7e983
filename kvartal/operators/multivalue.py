"""Several values packed in one field: one row per value, with its position.

Candidate spans of a cell come from three sources: quoted parts (one pair of quotes is one value), whole
values known from a dictionary, found by a multi-pattern automaton, and numbers as the grammar writes them.
Dynamic programming picks the best cover: the most covered characters, then the most known values, then the
fewest pieces. A known value with a delimiter in it covers more than its pieces and so stays whole
("12, корп. 1").

The dictionary is broadcast up to a checked size; a larger one is spread over shards with an automaton each,
all cells meet every shard, and the spans come back to their cells. The result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.session import checkpointed

L = "A-Za-zÀ-ɏЀ-ԯ"
UP = "A-ZЀ-ЯҐ"
#: A number with what belongs to it: a letter, parts joined by / or -, one capital after a single blank.
NUMBER = re.compile(rf"[0-9]+(?:[{L}](?![{L}])[0-9]*)?(?:[/-](?:[0-9]+(?:[{L}](?![{L}])[0-9]*)?|[{L}](?![{L}])))*(?: [{UP}](?![{L}0-9]))?")
QUOTED = re.compile(r"\"([^\"]*)\"|(?<!\w)'([^']*)'|«([^»]*)»|“([^”]*)”|„([^“”]*)[“”]")
#: Known values up to which the dictionary is collected and broadcast, and values of one shard beyond.
MAX_DICTIONARY = 50_000
#: Cells that meet a shard in one task.
BLOCK = 100_000


def is_plain(value: str) -> bool:
    """Whether the grammar finds the value as a whole wherever it stands: the dictionary needn't hold it."""
    return NUMBER.fullmatch(value) is not None


def automaton(values):
    """Automaton over those known whole values that the grammar alone would cut or miss."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for v in values:
        if v and not is_plain(v):
            a.add_word(v, len(v))
    if len(a):
        a.make_automaton()
    return a


def best_cover(spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Non-overlapping spans (start, end, known, value) of the greatest cover, in order."""
    spans.sort(key=lambda s: (s[1], s[0], s[2]))
    # best[i]: (covered, known, -pieces) of the first i spans; last[i]: index before the span, or None.
    best, took, ends = [(0, 0, 0)], [0], []
    for i, (start, end, known, _) in enumerate(spans):
        j = i
        while j and ends[j - 1] > start:
            j -= 1
        b = best[j]
        with_it = (b[0] + end - start, b[1] + known, b[2] - 1)
        if with_it > best[i]:
            best.append(with_it)
            took.append(j + 1)
        else:
            best.append(best[i])
            took.append(0)
        ends.append(end)
    out, i = [], len(spans)
    while i:
        if took[i]:
            out.append(spans[i - 1])
            i = took[i] - 1
        else:
            i -= 1
    return out[::-1]


def known_spans(cell: str, known) -> list[tuple[int, int]]:
    """Where known values stand in a cell, not inside a longer word or number."""
    if not len(known):
        return []
    part = lambda c: c.isalnum() or c in "/-"
    found = [(last - size + 1, last + 1) for last, size in known.iter(cell)]
    inside = lambda a, b: (a > 0 and part(cell[a - 1]) and part(cell[a])) or (b < len(cell) and part(cell[b - 1]) and part(cell[b]))
    return [(a, b) for a, b in found if not inside(a, b)]


def segment(cell: str, known, spans: Iterable[tuple[int, int]] = ()) -> list[str]:
    """The values of one cell, in its order. known: automaton; spans: places of known values found elsewhere."""
    spans = [(start, end, 1, cell[start:end]) for start, end in spans]
    if '"' in cell or "'" in cell or "«" in cell or "“" in cell or "„" in cell:
        held = []
        for m in QUOTED.finditer(cell):
            inner = m.group(m.lastindex).strip()
            if inner and "0" <= inner[0] <= "9":
                spans.append((m.start(), m.end(), 1, inner))
                held.append((m.start(), m.end()))
    for m in NUMBER.finditer(cell):
        spans.append((m.start(), m.end(), 0, m.group()))
    spans += [(start, end, 1, cell[start:end]) for start, end in known_spans(cell, known)]
    return [s[3] for s in best_cover(spans)]


def known_values(values: DataFrame, column: str) -> DataFrame:
    """v: the distinct non-empty values that the automaton needs, outer blanks removed."""
    own = values.select(F.trim(F.col(column)).alias("v")).where(F.col("v") != "").distinct()

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not is_plain(v) for v in b.column(0).to_pylist()], pa.bool_()))

    return own.mapInArrow(needed, "v string")


def split_values(df: DataFrame, key: str, column: str, dictionary: DataFrame | list[str], key_type: str = "bigint", value: str = "building", bound: int = MAX_DICTIONARY) -> DataFrame:
    """key, pos, value: one row for each value of column, pos from 1 in the cell's order.

    dictionary: known whole values, as known_values gives them, or a list. Repeated values stay, empty items
    get no position. NULL, empty and digitless cells give no row. Columns other than key and column are
    ignored. bound: known values up to which they are broadcast; the result doesn't depend on it.
    """
    if isinstance(dictionary, DataFrame):
        rows = dictionary.limit(bound + 1).collect()
        values = None if len(rows) > bound else sorted(r.v for r in rows)
    else:
        values = dictionary
    own = df.select(F.col(key).cast(key_type).alias("_key"), F.col(column).alias("_cell")).where(F.col("_cell").rlike("[0-9]"))
    if values is None:
        own = _with_spans(own, dictionary, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(values or [])
        for b in batches:
            keys, pos, out = [], [], []
            found = b.column(2).to_pylist() if values is None else [None] * b.num_rows
            for k, cell, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found):
                for i, v in enumerate(segment(cell, known, [(s["a"], s["b"]) for s in spans or ()])):
                    keys.append(k)
                    pos.append(i + 1)
                    out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(pos, pa.int32()), pa.array(out, pa.string())], ["_key", "_pos", "_value"])

    split = own.mapInArrow(run, f"_key {key_type}, _pos int, _value string")
    return split.select(F.col("_key").alias(key), F.col("_pos").alias("pos"), F.col("_value").alias(value))


def _with_spans(own: DataFrame, dictionary: DataFrame, shard: int) -> DataFrame:
    """own with `_spans`: where known values of a dictionary of any size stand in each cell."""
    own = checkpointed(own.withColumn("_row", F.monotonically_increasing_id()))
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((dictionary, shard), (own, BLOCK)))
    cells = own.select("_row", "_cell", F.pmod("_row", F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    held = dictionary.select("v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("_shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = automaton(right["v"])
        out = [(row, a, b) for row, cell in zip(left["_row"], left["_cell"]) for a, b in known_spans(cell, known)]
        return pd.DataFrame(out, columns=["_row", "a", "b"])

    spans = cells.groupBy("_shard", "_block").cogroup(held.groupBy("_shard", "_block")).applyInPandas(run, "_row long, a int, b int")
    return own.join(spans.groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("_spans")), "_row", "left").select("_key", "_cell", "_spans")
