"""String similarities as expressions of built-in functions, for both engines (see dual.py).

Jaro keeps, for the letters of the first string in order, the positions of the second they matched; all
else follows from that list. Transpositions count as halves, not rounded.
"""

from __future__ import annotations

from kvartal.functions.dual import Ex, case, join, keep, let, lit, lower, size, sort, split
from kvartal.functions.text import consonants, strip


def jaro(a: Ex, b: Ex) -> Ex:
    """Jaro similarity of two non-empty strings."""
    window = "greatest(char_length({0}), char_length({1})) {2} 2 - 1"
    w_spark, w_check = window.format(a.spark, b.spark, "div"), f"greatest(length({a.check}), length({b.check})) // 2 - 1"
    spark = f"""
    transform(array(named_struct('a', split({a.spark}, ''), 'b', split({b.spark}, ''), 'n', char_length({a.spark}), 'm', char_length({b.spark}), 'w', cast(greatest(0, {w_spark}) as int))), r ->
      transform(array(named_struct('u', aggregate(sequence(0, greatest(r.n - 1, 0)), cast(array() as array<int>), (u, i) ->
          concat(u, slice(filter(sequence(greatest(0, i - r.w), greatest(greatest(0, i - r.w), least(i + r.w, r.m - 1))),
            j -> j < r.m and r.b[j] = r.a[i] and not array_contains(u, j)), 1, 1))), 'n', r.n, 'm', r.m, 'b', r.b)), s ->
        case when size(s.u) = 0 then 0.0D else
          (cast(size(s.u) as double) / s.n + cast(size(s.u) as double) / s.m
           + (size(s.u) - size(filter(sequence(0, size(s.u) - 1), k -> s.b[s.u[k]] <> s.b[array_sort(s.u)[k]])) / 2.0D) / size(s.u)) / 3.0D end)[0])[0]"""
    check = f"""
    list_transform([{{'a': string_split({a.check}, ''), 'b': string_split({b.check}, ''), 'n': length({a.check}), 'm': length({b.check}), 'w': greatest(0, {w_check})}}], lambda r:
      list_transform([{{'u': list_reduce(list_transform(range(0, r.n), lambda i: [i]), lambda u, i:
          list_concat(u, list_filter(range(greatest(0, i[1] - r.w), least(i[1] + r.w, r.m - 1) + 1),
            lambda j: r.b[j + 1] = r.a[i[1] + 1] and not list_contains(u, j))[1:1]), []::BIGINT[]), 'n': r.n, 'm': r.m, 'b': r.b}}], lambda s:
        case when len(s.u) = 0 then 0.0::DOUBLE else
          (len(s.u)::DOUBLE / s.n + len(s.u)::DOUBLE / s.m
           + (len(s.u) - len(list_filter(range(0, len(s.u)), lambda k: s.b[s.u[k + 1] + 1] <> s.b[list_sort(s.u)[k + 1] + 1])) / 2.0::DOUBLE) / len(s.u)) / 3.0::DOUBLE end)[1])[1]"""
    return Ex(spark, check)


def _common(a: Ex, b: Ex) -> Ex:
    """Number of equal letters at the beginning, four at most."""
    out: Ex = lit(0)
    for i in (4, 3, 2, 1):
        same = Ex(f"(char_length({a.spark}) >= {i} AND char_length({b.spark}) >= {i} AND left({a.spark}, {i}) = left({b.spark}, {i}))", f"(length({a.check}) >= {i} AND length({b.check}) >= {i} AND left({a.check}, {i}) = left({b.check}, {i}))")
        out = case((same, i), default=out) if i == 4 else Ex(out.spark.replace("ELSE 0 END", f"WHEN {same.spark} THEN {i} ELSE 0 END"), out.check.replace("ELSE 0 END", f"WHEN {same.check} THEN {i} ELSE 0 END"))
    return out


def jaro_winkler(a: Ex, b: Ex) -> Ex:
    """0 if a string is empty, 1 if they are equal but for case; the prefix counts from a Jaro of 0.7."""

    def scored(x: Ex, y: Ex) -> Ex:
        value = let(jaro(x, y), lambda j: case((j < 0.7, j), default=j + _common(x, y) * lit(0.1) * (lit(1.0) - j)), "v")
        return case(((x == "") | (y == ""), 0.0), (x == y, 1.0), default=value)

    return let(lower(a), lambda x: let(lower(b), lambda y: scored(x, y), "jb"), "ja")


def levenshtein_similarity(a: Ex, b: Ex) -> Ex:
    # The checking engine counts bytes: there the letters are first put one to one into single-byte signs.
    small = lambda x: f"translate({x}, 'абвгґдеєжзиіїйклмнопрстуфхцчшщьюяыэёъ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+<>')"
    d = Ex(f"levenshtein({a.spark}, {b.spark})", f"levenshtein({small(a.check)}, {small(b.check)})")
    longest = Ex(f"greatest(char_length({a.spark}), char_length({b.spark}))", f"greatest(length({a.check}), length({b.check}))")
    return case(((a == "") | (b == ""), 0.0), default=lit(1.0) - d / longest)


def sorted_tokens(x: Ex) -> Ex:
    """Words of at least two letters, small, sorted, joined by blanks."""
    return join(sort(keep(split(lower(strip(x)), " "), lambda p: size(p) > 1)), " ")


def token_similarity(a: Ex, b: Ex) -> Ex:
    """Jaro-Winkler of the sorted words; of the strings as they are if one has only single letters."""

    def scored(x: Ex, y: Ex) -> Ex:
        single = (x == "") | (y == "")
        return jaro_winkler(case((single, a), default=x), case((single, b), default=y))

    return let(sorted_tokens(a), lambda x: let(sorted_tokens(b), lambda y: scored(x, y), "tb"), "ta")


def letter_set(c: str) -> str:
    """Spark SQL: which letters a column has (bits 0 to 31) and which at least twice (32 to 63). Letters that share a bit only
    hide a difference, so bits of one set that another lacks never count too many."""
    bits = "aggregate({0}, 0L, (a, x) -> a | shiftleft(1L, {1} + pmod(ascii(x), 32)))"
    twice = f"filter(array_distinct(split({c}, '')), x -> length({c}) - length(replace({c}, x, '')) >= 2)"
    return bits.format(f"split({c}, '')", 0) + " | " + bits.format(twice, 32)


def consonant_similarity(a: Ex, b: Ex) -> Ex:

    def scored(x: Ex, y: Ex) -> Ex:
        none = (x == "") | (y == "")
        return jaro_winkler(case((none, a), default=x), case((none, b), default=y)) * case((none, 0.5), default=1.0)

    return let(consonants(a), lambda x: let(consonants(b), lambda y: scored(x, y), "cb"), "ca")


__all__ = ["consonant_similarity", "jaro", "jaro_winkler", "letter_set", "levenshtein_similarity", "sorted_tokens", "token_similarity"]
