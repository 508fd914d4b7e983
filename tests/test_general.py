"""Lines that fail to parse, orphan references, packed values."""

import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kvartal.operators.multivalue import automaton, best_cover, is_plain, known_values, segment, split_values
from kvartal.operators.orphans import Reference, orphan_report, orphans
from kvartal.operators.row_parse import parse_rows

GOOD = "Київська;;Район;ТГ;м. Місто;01024;вул. Довга;1, 2А, 3-Б/4в;СЦ 1;СЦ 2;Район;01000;;"


def brute(line):
    """A character-by-character reader of one line."""
    line, i, fields = line or "", 0, []
    while True:
        if line[i : i + 1] == '"':
            i, buf = i + 1, []
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        buf.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                buf.append(line[i])
                i += 1
            if i < len(line) and line[i] != ";":
                return "quoting"
            fields.append("".join(buf))
        else:
            j = line.find(";", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            break
        i += 1
    if len(fields) != 14:
        return "column_count"
    if not re.fullmatch(r"([0-9]{4,5})?", fields[5].strip()):
        return "city_index"
    number = r"[1-9][0-9]{0,3}(?:-?[^\W\d_])?(?:/[0-9]{1,4}[^\W\d_]?)?(?: корп\. [0-9]+)?"
    if any(p.strip() and not re.fullmatch(number, p.strip()) for p in re.split("[,;]", fields[7])):
        return "buildings"
    return ""


def change_(k, v):
    parts = GOOD.split(";")
    return ";".join(parts[:k] + [v] + parts[k + 1 :])


def cases():
    change = change_
    out = [GOOD, None, "", " ", GOOD + ";", ";" * 13, '"' * 6, '"";' * 13 + '""', change(5, ""), change(5, " 1024 "), change(5, "123"), change(5, "５３０２１"), change(7, '"1;2;3"'), change(7, '"1""2"'), change(7, "0"), change(7, "12345"), change(7, "7 корп. 2"), change(7, ",,1,"), change(12, '"а ""б"" в"'), change(12, 'а "б"'), change(12, ' "б"'), change(12, '"б" '), change(12, '"б'), change(4, '"м. ""М"""')]
    long = ",".join(str(1 + i % 900) for i in range(3000))
    out += [change(12, "а\ue000б"), change(12, "\"а;б\ue000\""), change(3, 'x"y'), '"' + GOOD, GOOD + ';"']
    return out + [change(7, long), change(7, long + ",x"), change(12, '"' + '""' * 4000 + '"'), change(12, '"' + '""' * 4000), change(6, "я" * 20000)]


def test_lines_against_a_plain_reader(spark):
    rows = [(i, x, "clash", "other") for i, x in enumerate(cases())]
    df = spark.createDataFrame(rows, "raw_id long, line string, region string, reason string")
    good, bad = parse_rows(df, "raw_id", "line")
    found = {r.raw_id: r.reason for r in bad.collect()}
    assert found == {i: brute(x) for i, x, *_ in rows if brute(x)}
    valid = {r.raw_id: r for r in good.collect()}
    assert set(valid) == {i for i, x, *_ in rows if not brute(x)}
    places = {r.raw_id: r.field_no for r in bad.collect()}
    at = {x: i for i, x, *_ in rows}
    assert places[at[GOOD + ";"]] == 15 and places[at[""]] == 2 and places[at[change_(5, "123")]] == 6 and places[at[change_(7, "0")]] == 8
    assert places[at[change_(3, 'x"y')]] == 4 and places[at[change_(12, '"б')]] == 13 and places[at['"' + GOOD]] == 1 and places[at[GOOD + ';"']] == 15
    assert valid[at[change_(12, "а\ue000б")]].features == "а\ue000б" and valid[at[change_(12, "\"а;б\ue000\"")]].features == "а;б\ue000"
    assert valid[0].buildings == "1, 2А, 3-Б/4в" and valid[12].buildings == "1;2;3" and valid[18].features == 'а "б" в'


def test_lines_repeat_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "raw_id long, line string")
    assert parse_rows(df, "raw_id", "line")[1].count() == 2
    empty = spark.createDataFrame([], "raw_id long, line string")
    assert [p.count() for p in parse_rows(empty, "raw_id", "line")] == [0, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet='";а1, ', max_size=30), min_size=1, max_size=40))
def test_any_line_gets_the_plain_verdict(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id long, line string")
    found = {r.raw_id: r.reason for r in parse_rows(df, "raw_id", "line")[1].collect()}
    assert found == {i: brute(x) for i, x in enumerate(lines) if brute(x)}


def test_orphans(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    child = spark.createDataFrame(
        [(1, " a ", day(5)), (1, " a ", day(5)), (2, "b", day(5)), (3, "c", day(5)), (4, "d", day(5)), (5, None, day(5)), (6, "  ", day(5)), (7, "a", None), (8, "zz", None), (9, "e", day(5)), (10, "b", day(9))],
        "house_id long, street_id string, cached_at timestamp_ntz",
    )
    parent = spark.createDataFrame(
        [("a", day(1), None), ("b ", day(6), None), ("c", day(1), day(5)), ("d", day(1), day(6)), ("e", day(1), day(2)), ("e", day(1), None), (None, day(1), None), ("", day(1), None)],
        "street_id string, cached_at timestamp_ntz, removed_at timestamp_ntz",
    )
    ref = Reference("houses", "house_id", "street_id", "streets", "street_id")
    found = orphans(child, parent, ref)
    got = sorted((r.row_key, r.reason, r.period) for r in found.collect())
    assert got == [("2", "late", "2025-01"), ("3", "deleted", "2025-01"), ("8", "missing", None)]
    assert {(r.reason, r.orphans) for r in orphan_report(found).collect()} == {("late", 1), ("deleted", 1), ("missing", 1)}
    assert orphans(child.limit(0), parent, ref).count() == 0
    assert {r.reason for r in orphans(child, parent.limit(0), ref).collect()} == {"missing"}


def test_orphans_without_times(spark):
    child = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, ref string, _id string")
    parent = spark.createDataFrame([("a", "z")], "key string, _at string")
    assert [(r.row_key, r.reason) for r in orphans(child, parent, Reference("t", "id", "ref", "p", "key")).collect()] == [("2", "missing")]


KNOWN = automaton(["46 А", "18, корп. 2", "12-14", "7", "б/н 5", "3 б"])


def test_segments():
    seg = lambda x: segment(x, KNOWN)
    assert seg("1,2;3|4\n5\t6 7") == list("1234567")
    assert seg("44 46 А, 48") == ["44", "46 А", "48"]
    assert seg('3/9 5 "21;Б" "25, корп. 1"') == ["3/9", "5", "21;Б", "25, корп. 1"]
    assert seg("'48Г' і '49' та '51'") == ["48Г", "49", "51"]
    assert seg("12 та 14") == ["12", "14"] and seg("12та") == ["12"]
    assert seg("17-23,19,19") == ["17-23", "19", "19"]
    assert seg("69/8Б、70，71 • 72") == ["69/8Б", "70", "71", "72"]
    assert seg("5 АБ") == ["5"] and seg("5  А") == ["5"]
    # Known values keep their delimiters; without the dictionary they are cut.
    assert seg("17; 18, корп. 2; 19") == ["17", "18, корп. 2", "19"] and segment("17; 18, корп. 2; 19", automaton([])) == ["17", "18", "2", "19"]
    assert seg("118, корп. 2") == ["118", "2"] and seg("18, корп. 21") == ["18", "21"] and seg("1,3 б,б/н 5") == ["1", "3 б", "б/н 5"] and seg("3 бж") == ["3"]
    assert seg('"7') == ["7"] and seg("б/н") == [] and seg("") == []
    assert segment("44 46 А, 48", automaton([])) == ["44", "46 А", "48"]


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5), st.integers(0, 1)), max_size=9))
def test_cover_is_the_best_of_all(spans):
    from itertools import combinations

    spans = [(a, a + n, k, "") for a, n, k in spans]
    value = lambda c: (sum(e - s for s, e, _, _ in c), sum(k for *_, k, _ in c), -len(c))
    free = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2))
    best = max(value(c) for n in range(len(spans) + 1) for c in combinations(spans, n) if free(c))
    got = best_cover(list(spans))
    assert free(got) and value(got) == best


def test_split_values(spark):
    df = spark.createDataFrame([(1, "5, 6", "x"), (1, "5, 6", "x"), (2, None, "x"), (3, "-", "x"), (4, "9 " * 5000, "x"), (5, "1; 2, к. 1; 3", "x")], "record_id long, buildings string, pos string")
    known = known_values(spark.createDataFrame([(" 5",), ("2, к. 1 ",), ("2, к. 1",), ("3; 4",), (None,), ("",)], "v string"), "v")
    assert sorted(r.v for r in known.collect()) == ["2, к. 1", "3; 4"]
    got = [(r.record_id, r.pos, r.building) for r in split_values(df, "record_id", "buildings", known).collect()]
    assert got[:4] == [(1, 1, "5"), (1, 2, "6")] * 2 and len(got) == 5007 and got[5003] == (4, 5000, "9") and [v for k, _, v in got if k == 5] == ["1", "2, к. 1", "3"]
    sharded = split_values(df, "record_id", "buildings", known, bound=1)
    assert sorted(map(tuple, sharded.collect())) == sorted(got)
    assert split_values(df.limit(0), "record_id", "buildings", []).count() == 0 and split_values(df.limit(0), "record_id", "buildings", known, bound=1).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="12а,; -/А", max_size=14), st.lists(st.text(alphabet="12а,; -/А", min_size=1, max_size=6), max_size=4))
def test_plain_entries_change_nothing(cell, values):
    """Entries that the grammar finds by itself may be left out of the automaton."""
    plain = [v for v in values if is_plain(v)]
    assert segment(cell, automaton(plain)) == segment(cell, automaton([]))
    rest = [v for v in values if not is_plain(v)]
    assert segment(cell, automaton(values)) == segment(cell, automaton(rest))
