"""Expressions written once and rendered for Spark SQL and for the SQL of a checking engine.

An Ex holds both texts. The Spark text goes through expr(), so Catalyst sees built-in functions only, with
whole-stage code generation; the other text is what the tests and the driver run on the same tables. Where
the engines differ (regular-expression flags, string escapes, argument orders), the difference is kept here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters, spelled out because the engines' short forms differ outside ASCII.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


class Ex:
    def __init__(self, spark: str, check: str | None = None):
        self.spark, self.check = spark, spark if check is None else check

    @property
    def col(self) -> Column:
        return F.expr(self.spark)

    def _bin(self, op: str, other) -> Ex:
        o = lit(other)
        return Ex(f"({self.spark} {op} {o.spark})", f"({self.check} {op} {o.check})")

    def __add__(self, o):
        return self._bin("+", o)

    def __sub__(self, o):
        return self._bin("-", o)

    def __mul__(self, o):
        return self._bin("*", o)

    def __truediv__(self, o):
        return self._bin("/", o)

    def __eq__(self, o):  # type: ignore[override]
        return self._bin("=", o)

    def __ne__(self, o):  # type: ignore[override]
        return self._bin("<>", o)

    def __lt__(self, o):
        return self._bin("<", o)

    def __le__(self, o):
        return self._bin("<=", o)

    def __gt__(self, o):
        return self._bin(">", o)

    def __ge__(self, o):
        return self._bin(">=", o)

    def __and__(self, o):
        return self._bin("AND", o)

    def __or__(self, o):
        return self._bin("OR", o)

    def __invert__(self):
        return Ex(f"(NOT {self.spark})", f"(NOT {self.check})")

    __hash__ = None  # type: ignore[assignment]


def quoted(text: str) -> tuple[str, str]:
    """A string literal for both engines."""
    raw = f"r'{text}'" if "'" not in text else 'r"' + text + '"'
    return raw, "'" + text.replace("'", "''") + "'"


def lit(v) -> Ex:
    if isinstance(v, Ex):
        return v
    if isinstance(v, str):
        return Ex(*quoted(v))
    if isinstance(v, bool):
        return Ex(str(v).lower())
    if isinstance(v, float):
        return Ex(f"{v!r}D", f"CAST({v!r} AS DOUBLE)")
    return Ex(str(v))


def call(name: str, *args, check: str = "") -> Ex:
    a = [lit(x) for x in args]
    return Ex(f"{name}({', '.join(x.spark for x in a)})", f"{check or name}({', '.join(x.check for x in a)})")


def name(column: str) -> Ex:
    return Ex(f"`{column}`", f'"{column}"')


def text(column: str) -> Ex:
    """A column with missing values as ''."""
    return call("coalesce", name(column), "")


def lower(x: Ex) -> Ex:
    return call("lower", x)


def upper(x: Ex) -> Ex:
    return call("upper", x)


def size(x: Ex) -> Ex:
    return Ex(f"char_length({x.spark})", f"CAST(length({x.check}) AS INTEGER)")


def translate(x: Ex, old: str, new: str) -> Ex:
    return call("translate", x, old, new)


def sub(x: Ex, pattern: str, by: str = "", group: int = 0) -> Ex:
    """Every match replaced by a text; group puts back a group before it."""
    p, c = quoted("(?iu)" + pattern)[0], quoted("(?i)" + pattern)[1]
    spark_by, check_by = quoted((f"${group}" if group else "") + by), quoted((f"\\{group}" if group else "") + by)
    return Ex(f"regexp_replace({x.spark}, {p}, {spark_by[0]})", f"regexp_replace({x.check}, {c}, {check_by[1]}, 'g')")


def like(x: Ex, pattern: str, fold: bool = True) -> Ex:
    p, c = quoted(("(?iu)" if fold else "") + pattern)[0], quoted(("(?i)" if fold else "") + pattern)[1]
    return Ex(f"({x.spark} RLIKE {p})", f"regexp_matches({x.check}, {c})")


def extract(x: Ex, pattern: str, group: int = 1, fold: bool = True) -> Ex:
    """A group of the first match, '' without one."""
    p, c = quoted(("(?iu)" if fold else "") + pattern)[0], quoted(("(?i)" if fold else "") + pattern)[1]
    return Ex(f"coalesce(regexp_extract({x.spark}, {p}, {group}), '')", f"coalesce(regexp_extract({x.check}, {c}, {group}), '')")


def case(*pairs, default) -> Ex:
    """CASE WHEN of (condition, value) pairs."""
    ps, d = [(c, lit(v)) for c, v in pairs], lit(default)
    return Ex("CASE " + " ".join(f"WHEN {c.spark} THEN {v.spark}" for c, v in ps) + f" ELSE {d.spark} END", "CASE " + " ".join(f"WHEN {c.check} THEN {v.check}" for c, v in ps) + f" ELSE {d.check} END")


def part(x: Ex, by: str, n: int) -> Ex:
    return call("split_part", x, by, n)


def cast(x: Ex, spark: str, check: str = "") -> Ex:
    return Ex(f"CAST({x.spark} AS {spark})", f"CAST({x.check} AS {check or spark})")


# ---- lists


def split(x: Ex, by: str) -> Ex:
    return Ex(f"split({x.spark}, {quoted(by)[0]}, -1)", f"string_split({x.check}, {quoted(by)[1]})")


def each(x: Ex, f: Callable[[Ex], Ex], var: str = "p") -> Ex:
    y = f(Ex(var))
    return Ex(f"transform({x.spark}, {var} -> {y.spark})", f"list_transform({x.check}, lambda {var}: {y.check})")


def keep(x: Ex, f: Callable[[Ex], Ex], var: str = "p") -> Ex:
    y = f(Ex(var))
    return Ex(f"filter({x.spark}, {var} -> {y.spark})", f"list_filter({x.check}, lambda {var}: {y.check})")


def count(x: Ex) -> Ex:
    return Ex(f"size({x.spark})", f"CAST(len({x.check}) AS INTEGER)")


def item(x: Ex, i: int | Ex) -> Ex:
    """Item i from 0; '' beyond the end."""
    n = lit(i)
    return Ex(f"coalesce(get({x.spark}, {n.spark}), '')", f"coalesce(({x.check})[CAST({n.check} + 1 AS BIGINT)], '')")


def rest(x: Ex, start: int | Ex) -> Ex:
    """Items from start, counted from 0."""
    n = lit(start)
    return Ex(f"slice({x.spark}, {n.spark} + 1, greatest(size({x.spark}) - ({n.spark}), 0))", f"list_slice({x.check}, CAST({n.check} + 1 AS BIGINT), CAST(len({x.check}) AS BIGINT))")


def join(x: Ex, by: str) -> Ex:
    return Ex(f"array_join({x.spark}, {quoted(by)[0]})", f"array_to_string({x.check}, {quoted(by)[1]})")


def has(x: Ex, v) -> Ex:
    return call("array_contains", x, v, check="list_contains")


def sort(x: Ex) -> Ex:
    return call("array_sort", x, check="list_sort")


def array(*xs) -> Ex:
    return call("array", *xs, check="list_value")


def let(value: Ex, f: Callable[[Ex], Ex], var: str) -> Ex:
    """f of a value that is written and evaluated once, under the name var."""
    y = f(Ex(var))
    return Ex(f"transform(array({value.spark}), {var} -> {y.spark})[0]", f"list_transform([{value.check}], lambda {var}: {y.check})[1]")


def lookup(x: Ex, pairs: dict[str, Ex]) -> Ex:
    """The value beside x, or x itself. Values are constants, folded at planning."""
    keys = [quoted(k) for k in pairs]
    spark = ", ".join(f"{k[0]}, {v.spark}" for k, v in zip(keys, pairs.values()))
    check = ", ".join(f"{k[1]}: {v.check}" for k, v in zip(keys, pairs.values()))
    return Ex(f"coalesce(try_element_at(map({spark}), {x.spark}), {x.spark})", f"coalesce(MAP {{{check}}}[{x.check}], {x.check})")
