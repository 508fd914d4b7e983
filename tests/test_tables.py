"""Lookups, store upkeep, sheets, sources and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kvartal.operators import directory as D
from kvartal.operators import linkage as L
from kvartal.operators import sheet as H
from kvartal.sources import files as I
from kvartal.session import checkpointed
from kvartal.streaming import requests as R


def test_upsert_and_ttl(spark):
    t = lambda n: dt.datetime(2025, 1, n)
    old = spark.createDataFrame([("1", "а", t(1)), ("2", "б", t(1)), ("", "в", t(1))], "id string, name string, at timestamp")
    new = spark.createDataFrame([("2", "бб", t(2), "x"), ("3", "г", None, "y")], "id string, name string, at timestamp, more string")
    got = {r.id: r.name for r in D.upsert(old, new, ["id"], "at").collect()}
    assert got == {"1": "а", "2": "бб", "3": "г"}
    assert D.add_missing(old, new.select("id", "name", "at"), ["id"]).count() == 4
    assert {r.id for r in D.stale(new, "at", F.lit(t(5)), 2).collect()} == {"2", "3"} and {r.id for r in D.stale(new, "at", F.lit(t(5)), 0).collect()} == {"3"}


def test_nearest_office(spark):
    offices = spark.createDataFrame([("К", "08133", False), ("К", "08134", True), ("К", "08140", True)], "city string, office string, working boolean")
    assert D.nearest_office(spark.createDataFrame([("К", "08133")], "city string, anchor string"), offices).first().office == "08134"


def test_autocomplete(spark):
    rows = [(x,) for x in ("с. Київка", "м. Київ", "смт Київське")]
    got = [r.name for r in D.autocomplete(spark.createDataFrame(rows, "city string"), "city").where("prefix = 'киї'").orderBy("rank").collect()]
    assert got == ["м. Київ", "смт Київське", "с. Київка"]


def test_mapping(spark):
    assert H.looks_headerless(["30019905", "Київ", "Хрещатик 1", "01001"]) and not H.looks_headerless(["city", "street", "index"]) and not H.looks_headerless(["1", "2"])
    with pytest.raises(ValueError):
        H.valid_mapping({"street": [0]}, ["a"])
    df = spark.createDataFrame([(1, " Київ ", "Main 12", 1001.0), (2, None, "", float("nan"))], "id int, a string, b string, c double")
    rows = {r.id: r for r in H.map_rows(df, {"city": [0, 9], "street": [1], "building": [1, 2], "color": [0]}, "id").collect()}
    assert (rows[1].city, rows[1].street, rows[1].building) == ("Київ", "Main 12", "Main 12 1001") and rows[2].city == ""


def test_sheet_changes(spark, tmp_path):
    before = spark.createDataFrame([(1, "01001"), (2, None), (3, "79000")], "row_id int, index string")
    after = spark.createDataFrame([(1, "01002"), (3, "79000")], "row_id int, index string")
    assert [(r.row_id, r.old_value, r.new_value) for r in H.changed_cells(before, after, "row_id", ["index"]).collect()] == [(1, "01001", "01002")]
    assert sorted((r.row_id, r["index"]) for r in H.merge_sheet(before, after, "row_id", ["index"]).collect()) == [(1, "01002"), (2, None), (3, "79000")]
    log = spark.createDataFrame([(1, "index", 1, "a", False), (1, "index", 2, "b", True)], "row_id int, field string, seq int, value string, undone boolean")
    assert H.replay(log).first().value == "a"
    assert H.load_mapping(str(tmp_path), "x/../my map") is None
    H.save_mapping(str(tmp_path), "my map", {"city": [1]})
    assert H.load_mapping(str(tmp_path), "my map") == {"city": [1]}


def test_directory_file(spark, tmp_path):
    header = ";".join(I.DIRECTORY_HEADERS)
    (tmp_path / "u.csv").write_bytes(("﻿" + header + "\nКиївська;;Р;;м. Київ; 01001 ;вул. Довга;1,2;;;;;;\n").encode())
    (tmp_path / "c.csv").write_bytes((header + "\r\nКиївська;;Р;;м. Київ;01001;вул. Довга;1,2;;;;;;\r\n").encode("cp1251"))
    got = I.read_directory(spark, str(tmp_path / "u.csv")).first()
    assert (got.region, got.city_index, got.not_working) == ("Київська", "01001", "")
    lines = I.decoded_lines(spark, str(tmp_path / "*.csv")).where("line_no = 2").collect()
    assert len(lines) == 2 and all("вул. Довга" in r.line for r in lines)


def test_sheets_and_xml(spark, tmp_path):
    df = spark.createDataFrame([("Київ", "01001"), ("Львів <&>", None)], "city string, index string")
    path = I.write_xlsx(df, str(tmp_path / "a.xlsx"))
    assert [tuple(r) for r in I.read_sheet(spark, path).collect()] == [("Київ", "01001"), ("Львів <&>", "")]
    (tmp_path / "a.xml").write_text("<Entries><Entry><ID>1</ID><NAME>Київ</NAME></Entry><Entry><ID>2</ID></Entry></Entries>", encoding="utf-8")
    assert [tuple(r) for r in I.read_entries(spark, str(tmp_path / "a.xml"), "Entry", ["ID", "NAME"]).collect()] == [("1", "Київ"), ("2", "")]
    (tmp_path / "al.csv").write_text("city,old_street,new_street,source\nБахмут,Горького,Олекси Тихого,x\nБахмут,,y,z\n", encoding="utf-8")
    aliases = I.read_aliases(spark, str(tmp_path / "al.csv"))
    rows = spark.createDataFrame([("Бахмут", "ВУЛ.ГОРЬКОГО"), ("Голубине", "БЕЗ НАЗВИ")], "city string, street string")
    got = {r.city: r.street_aliases for r in I.with_aliases(rows, aliases).collect()}
    assert got == {"Бахмут": ["горького", "олекси тихого"], "Голубине": ["без назви", "відсутня"]}
    I.append_events(df, "search", str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def small(spark):
    requests = [(1, "Київ", "вул. Хрещатик", "1", "", "", "01001"), (2, "Київ", "Хрещ", "1", "", "", ""), (3, "", "", "", "", "", ""), (4, "Київ", "шосе Харківське", "168", "", "", "")]
    records = [(10, "", "", "Р", "м. Київ", "01001", "вул. Хрещатик", "1", ""), (11, "", "", "Р", "м. Київ", "02121", "вул. Харківське шосе", "166,168", ""), (12, "", "", "Р", "м. Київ", "01024", "вул. Велика", "43,43/1,43/2", "")]
    q = spark.createDataFrame(requests, "row_id long, city string, street string, building string, region string, district string, index string")
    r = spark.createDataFrame(records, "record_id long, region string, old_district string, new_district string, city string, city_index string, street string, buildings string, not_working string")
    return q, r


def test_matching(spark):
    q, r = small(spark)
    pq, pr = L.prepared_requests(q), L.prepared_directory(r)
    scores = {(x.row_id, x.record_id): (x.score, x.confidence) for x in L.scored_pairs(pq, pr).collect()}
    assert scores[1, 10][0] >= 0.95 and 0.5 < scores[2, 10][0] < 1.0 and scores[4, 11][0] >= 0.95
    places = L.general_places(r, pr)
    found, decided = L.resolved(pq, L.scored_pairs(pq, pr), places)
    modes = {x.row_id: (x.mode, x.auto_index) for x in decided.collect()}
    assert modes[1] == ("auto", "01001") and modes[3] == ("none", "") and len(modes) == 4
    assert {x.min_index for x in L.general_results(pq, places).where("row_id = 1").collect()} == {"01001"}
    assert {x.row_id for x in L.ranked(found).where("rank = 1").collect()} == {1, 2, 4}


def decided(spark, rows, index="", house="", general=False):
    """Outcome of the rule on results (index, confidence, score, house_part), in their order."""
    data = [(1, i, s, c, n.lstrip("0"), n, h, index.lstrip("0"), house, g, (0, -s, 1, i)) for i, (n, c, s, h, g) in enumerate(rows)]
    df = spark.createDataFrame(data, "row_id long, record_id long, score double, confidence int, r_index string, r_raw string, house_part double, q_index string, q_house string, is_general boolean, first struct<a: int, b: double, c: long, d: long>")
    r = L.decide(df, general).first()
    return r.chosen.r_raw if r.auto else None


def test_decisions(spark):
    row = lambda index, confidence, score=None, part=0.25, general=False: (index, confidence, score or confidence / 100, part, general)
    assert decided(spark, [row("01001", 99)], house="1") == "01001"
    assert decided(spark, [row("01001", 99), row("01002", 99)], house="1") is None
    assert decided(spark, [row("51912", 100), row("51918", 90)], house="37") == "51912"
    assert decided(spark, [row("10020", 100)], index="10001", house="2") == "10020"
    assert decided(spark, [row("15504", 98, part=0.0, general=True)], index="01001", house="43") is None
    assert decided(spark, [row("69089", 100, 1.0), row("69039", 99, 1.0), row("69083", 91)], house="5") == "69089"
    assert decided(spark, [row("51273", 100), row("28115", 100), row("71602", 99)], house="16") is None
    assert decided(spark, [row("01001", 99, part=-0.05)], house="999") is None
    # One index in several rows; the requested index goes first; a wrong index is only corrected from 98 on.
    assert decided(spark, [row("01001", 95), row("1001", 93)]) == "01001" and decided(spark, [row("01001", 95), row("01002", 93)], index="1002") == "01002"
    assert decided(spark, [row("01001", 95)], index="1002") is None and decided(spark, [row("", 95), row("01002", 93)]) == ""
    assert decided(spark, [row("15504", 89, part=0.0, general=True)], house="7") is None
    assert decided(spark, [row("15504", 89, part=0.0, general=True)], house="7", general=True) == "15504"


def test_equal_addresses_are_one_result(spark):
    columns = "row_id long, record_id long, r_key string, score double, confidence int, strategy int, r_index string, r_raw string, house_part double, q_index string, q_house string"
    rows = [(1, 1, "a", 0.9, 90, 1, "15504", "15504", 0.0, "", ""), (1, 2, "a", 0.9, 90, 1, "15304", "15304", 0.0, "", ""), (1, 3, "b", 0.95, 95, 2, "", "", 0.0, "", ""), (1, 4, "b", 0.9, 95, 1, "7", "00007", 0.0, "", "")]
    got = {r.record_id: r.r_raw for r in L.deduplicated(spark.createDataFrame(rows, columns)).collect()}
    assert got == {2: "15304", 4: "00007"}


def test_street_aliases_and_boxes(spark):
    asks = [(1, "Бахмут", "вул. Горького", "5"), (2, "Місто", "без назви", "5"), (3, "м. Київ", "а/с 12", ""), (4, "Місто", "вул. Стара", "5"), (5, "", "вул. Нова", "5")]
    held = [(1, "м. Бахмут", "вул. Олекси Тихого", "84500"), (2, "Місто", "відсутня", "00002"), (3, "Місто", "вул. Нова", "00003")]
    q = spark.createDataFrame([(*a, "", "", "00003" if a[0] == 5 else "") for a in asks], "row_id long, city string, street string, building string, region string, district string, index string")
    r = spark.createDataFrame([(*h, "5", "", "", "") for h in held], "record_id long, city string, street string, city_index string, buildings string, region string, old_district string, new_district string")
    aliases = spark.createDataFrame([("місто", "стара", "вул. Нова")], "city string, old_street string, new_street string")
    pq, pr = L.prepared_requests(q, aliases=aliases), L.prepared_directory(r)
    _, done = L.resolved(pq, L.scored_pairs(pq, pr), L.general_places(r, pr))
    got = {x.row_id: (x.mode, x.auto_index, x.auto_confidence) for x in done.collect()}
    assert got[1] == ("auto", "84500", 99 if got[1][2] == 99 else 100) and got[2][:2] == ("auto", "00002") and got[3] == ("auto", "01001", 95) and got[4][:2] == ("auto", "00003")
    assert got[5][0] == "manual"  # no city: found by house and index, below the sure confidence


def test_major_cities_lose_no_pair(spark):
    """Pairs that reach the least score by the base or a part of the house, against the SQL that compares all."""
    duckdb = pytest.importorskip("duckdb")
    from kvartal.plans import matching as M

    asks = [(1, "Львів", "вул. Шевченка", "5А", "79001"), (2, "Львів", "Шевченка", "5А", ""), (3, "м. Харків", "вул. Зелена", "12", ""), (4, "Тернопіль", "вул. Шевченка", "5А", ""), (5, "Одеса", "Садова", "7/9", "65001"), (6, "Львів", "", "5А", ""), (7, "Львів", "Шевчука", "", "79002")]
    held = [(1, "м. Львів", "вул. Шевчука", "5, 7", ""), (2, "Львів", "вул. Шептицька", "15а,", "79003"), (3, "Харків", "вул. Земляна", "112, 3", ""), (4, "Тернопіль", "вул. Шевчука", "5", ""), (5, "Одеса", "вул. Сонячна", "9", ""), (6, "Львів", "Шевська", "1,,2", ""), (7, "Одеса", "вул. Садибна", "7", "65002"), (8, "Львів", "", "5", "")]
    addresses = spark.createDataFrame([(*a, "", "") for a in asks], "row_id long, city string, street string, building string, index string, region string, district string")
    magistral = spark.createDataFrame([(*h, "", "", "") for h in held], "record_id long, city string, street string, buildings string, city_index string, region string, old_district string, new_district string")
    got = L.scored_pairs(L.prepared_requests(addresses), L.prepared_directory(magistral)).collect()
    con = duckdb.connect()
    for name, df in (("addresses", addresses.toPandas()), ("magistral", magistral.toPandas())):
        con.register(name, df)
    want = {(a, b): (s, c) for a, b, s, c, _ in con.execute(M.SQL["scored_pairs"]).fetchall()}
    assert len(got) == len(want) and {(r.row_id, r.record_id): (round(r.score, 6), r.confidence) for r in got} == want
    assert len(want) >= 4 and (2, 1) in want


def test_streams(spark, tmp_path):
    q, r = small(spark)
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    R.match_stream(stream, L.prepared_directory(r).cache(), L.general_places(r, L.prepared_directory(r)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    times = spark.createDataFrame([(dt.datetime(2025, 1, 1, 1), dt.datetime(2025, 1, 1, 5)), (dt.datetime(2025, 1, 1, 2), dt.datetime(2025, 1, 1, 2))], "requested_at timestamp, loaded_at timestamp")
    row = R.arrivals(times).first()
    assert (row.n, row.late) == (2, 1)


def test_house_lookup_falls_back(spark):
    houses = spark.createDataFrame([("1", "5", "5", "01001"), ("1 ", "6-А", "6А", "01002"), ("2", "9", "9", None)], "street_id string, house_number string, normalized_house_number string, postcode string")
    wanted = spark.createDataFrame([("1", "6А"), ("2", "77"), ("3", "1")], "street_id string, house string")
    got = sorted((r.street_id, r.house, r.number, r.exact) for r in D.house_lookup(wanted, houses).collect())
    assert got == [("1", "6А", "6А", True), ("2", "77", "9", False)]
    assert D.house_lookup(wanted.limit(0), houses).count() == 0


def test_tables_without_rows(spark):
    q, r = small(spark)
    pq, pr = L.prepared_requests(q.limit(0)), L.prepared_directory(r.limit(0))
    assert L.scored_pairs(pq, L.prepared_directory(r)).count() == 0 and L.scored_pairs(L.prepared_requests(q), pr).count() == 0
    all_ = L.prepared_requests(q)
    assert {x["mode"] for x in L.resolved(all_, L.scored_pairs(all_, pr), L.general_places(r.limit(0), pr))[1].collect()} == {"none"}
    assert D.autocomplete(r.limit(0), "city").count() == 0 and D.least_index(r.limit(0)).count() == 0


def test_index_alone_is_no_candidate(spark):
    """Rows that share no more than city and index are no candidates, and no pair that scores is lost by that."""
    duckdb = pytest.importorskip("duckdb")
    from kvartal.plans import matching as M

    streets = ("вул. Шевченка", "пров. Шевчука", "Шептицького", "вул. Лісова", "площа Зелена", "")
    asks = [(i, city, s, b, x) for i, (city, s, b, x) in enumerate((c, s, b, x) for c in ("Тернопіль", "Тернопіл", "Львів") for s in streets for b in ("5А", "12", "7/9", "") for x in ("46001", ""))]
    held = [(i, city, s, b, "46001") for i, (city, s, b) in enumerate((c, s, b) for c in ("м. Тернопіль", "Львів") for s in ("вул. Шевчика", "пров. Сонячний", "Шептицька", "") for b in ("5, 7", "15а,", "112, 3", "40", ""))]
    addresses = spark.createDataFrame([(*a, "", "") for a in asks], "row_id long, city string, street string, building string, index string, region string, district string")
    magistral = spark.createDataFrame([(*h, "", "", "") for h in held], "record_id long, city string, street string, buildings string, city_index string, region string, old_district string, new_district string")
    q, r = (checkpointed(x) for x in (L.prepared_requests(addresses), L.prepared_directory(magistral)))
    con = duckdb.connect()
    for name, df in (("addresses", addresses.toPandas()), ("magistral", magistral.toPandas())):
        con.register(name, df)
    want = {(a, b) for a, b, *_ in con.execute(M.SQL["scored_pairs"]).fetchall()}
    met = {(x.row_id, x.record_id) for x in L.candidates(q, r, checkpointed(L.city_pairs(q, r))).collect()}
    alone = [(a[0], h[0]) for a in asks for h in held if a[1] == "Тернопіль" and h[1] == "м. Тернопіль" and a[2] == "вул. Лісова" and (a[3] == "" or h[3] in ("40", ""))]
    assert want <= met and len(want) > 100 and alone and not met & {*alone}


def test_manual_form_meets_no_whole_city(spark):
    """Many questions and many streets of one city: the rows that meet grow with either, not with their product."""
    n = 300
    asked = spark.createDataFrame([(i, "МІСТО" if i % 2 else "Місто", None if i % 3 else "Рай", f"вулиця{i}") for i in range(n)] + [(n, None, "", "вулиця1"), (n + 1, "Село", "", "вулиця1"), (n + 2, "Місто", "Ні", "вулиця1")], "ask_id long, city string, district string, street string")
    held = [("Місто", "Район" if j % 2 else "", "Старий", f"вулиця{j}", f"{10000 + j}" if j % 5 else "") for j in range(n)] + [("місто", "", "", "вулиця2", "09999"), ("місто", "", "", None, "08888")]
    directory = spark.createDataFrame(held, "city string, new_district string, old_district string, street string, city_index string")
    out = D.manual_choices(asked, directory)
    want = {}
    for i, city, part, street in ((r.ask_id, r.city, r.district, r.street) for r in asked.collect()):
        rows = [(s, x or None) for c, new, old, s, x in held if city and c.lower() == city.lower() and (part or "").lower() in (new or old).lower()]
        own, all_ = {x for s, x in rows if s == street and x}, [x for _, x in rows if x]
        want[i] = (len(own), min(own) if own else min(all_, default="00000"))
    assert {r.ask_id: (r.choices, r["index"]) for r in out.collect()} == want

    def rows(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return rows(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return rows(plan.plan())
        kids = plan.children()
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
        return max([own, *(rows(kids.apply(k)) for k in range(kids.size()))])

    df = out._jdf
    df.collectToPython()
    assert rows(df.queryExecution().executedPlan()) < 3 * n


def test_rows_under_an_index_that_cannot_score(spark):
    """Classifier rows under the index of a request: only those of its city with a similar street or something of the house."""
    from kvartal.operators import classifier as K

    asked = spark.createDataFrame([(1, "46001", "тернопіль", "5А", "5", "street", ["шевченка"]), (2, "46001", "тернопіль", "", "", "", ["лісова"]), (3, "46001", "", "5А", "5", "", ["шевченка"]), (4, "79001", "львів", "", "", "", ["шевченка"])], "row_id long, q_raw string, q_city string, q_house string, q_base string, q_kind string, q_options array<string>")
    code = [(1, "46001", "тернопіль", "шевчено", "street", "40"), (2, "46001", "тернопіль", "зелена", "", "5, 7"), (3, "46001", "тернопіль", "зелена", "", "40"), (4, "46001", "чортків", "шевченка", "street", "5А"), (5, "46001", "тернопіль", "зелена", "lane", "15А"), (6, "46001", "тернопіль", "зелена", "lane", "5А"), (7, "79001", "львів", "зелена", "", ""), (8, "79002", "львів", "шевченка", "", "")]
    code = spark.createDataFrame(code, "code_id long, q_raw string, r_city string, r_street string, r_kind string, house_number string")
    got = {(r.row_id, r.code_id) for r in K.code_pairs(asked, code).collect()}
    assert got == {(1, 1), (1, 2), (1, 5), (1, 6), (3, 1), (3, 4), (4, 7)}
