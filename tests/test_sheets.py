"""Sheets, stores, classifier results, functions of SQL."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from kvartal.functions import batch
from kvartal.functions import sql as Q
from kvartal.operators import classifier as K
from kvartal.operators import directory as D
from kvartal.operators import linkage as L
from kvartal.operators import sheet as H
from kvartal.session import _shared_folder, checkpointed, released
from kvartal.sources import files as I


def test_columns_of_a_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "Київ", "Main 12", "01001"), (2, "y", "", None, None)], "id int, other string, city string, street_with_building string, index string")
    old = H.with_old_index(df, "index")
    assert [r[H.OLD_INDEX] for r in old.orderBy("id").collect()] == ["01001", ""] and H.with_old_index(old, "city").columns == old.columns
    own, mapping = H.filter_columns(old, {"city": [1], "street": [2], "building": [2], "index": [3, 77]}, "id", keep_old=True)
    assert own.columns == ["id", "city", "street_with_building", "index", H.OLD_INDEX] and mapping == {"city": [0], "street": [1], "building": [1], "index": [2]}
    assert H.kept_mapping(mapping, ["a"], ["a"]) == mapping and H.kept_mapping(mapping, ["a"], ["b"]) == {}
    assert [r.id for r in H.row_range(df, "id", 2).collect()] == [2] and H.row_range(df, "id", 1, 1).count() == 1
    assert [r.id for r in H.sorted_sheet(df, "index").collect()] == [2, 1] and H.sorted_sheet(df, "index", False).first().id == 1
    H.save_mapping(str(tmp_path), "а-1", {"city": [0]})
    assert H.list_mappings(str(tmp_path)) == ["а-1"] and H.delete_mapping(str(tmp_path), "а-1") and not H.delete_mapping(str(tmp_path), "а-1")


def test_runs(spark):
    rows = spark.createDataFrame([(i, "К", "", "", "", "", "") for i in range(1, 6)] + [(6, "", None, "", "", "", "")], "row_id long, city string, street string, building string, region string, index string, old_index string")
    decided = spark.createDataFrame([(1, "auto", 1, 1.0, "01001", 100), (2, "auto", 1, 0.9, "01002", 89), (3, "manual", 2, 0.8, "", 0), (4, "auto", 1, 1.0, "01004", 95), (5, "none", 0, 0.0, "", 0), (6, "none", 0, 0.0, "", 0)], "row_id long, mode string, total_found long, top_score double, auto_index string, auto_confidence int")
    back = H.write_back(rows, decided, least=90)
    assert {r.row_id for r in H.applied_rows(back, "applied").collect()} == {1, 4} and H.applied_rows(back, "unapplied").count() == 4 and H.applied_rows(back).count() == 6
    s = H.run_statistics(back).first()
    assert (s.total, s.skipped, s.applied, s.manual, s.not_found, s.efficiency, s.decided_share) == (6, 1, 2, 1, 2, 0.4, 0.4)
    assert {r.row_id for r in H.semi_automatic(rows, decided).collect()} == {1, 2} and {r.row_id for r in H.semi_automatic(rows, decided, start=4).collect()} == {4}
    found = spark.createDataFrame([(1, 10, "01001", 100, 1.0, False, 0), (1, 11, "01009", 90, 0.9, False, 1), (3, None, "00003", 89, 0.89, True, 0)], "row_id long, record_id long, r_raw string, confidence int, score double, is_general boolean, first int")
    answers = {r.row_id: r for r in H.responses(found, decided, most=1).collect()}
    assert len(answers) == 6 and [x.r_raw for x in answers[1].results] == ["01001"] and answers[1].applied and answers[5].results == []
    shown = H.with_recommendation(L.ranked(found), spark.createDataFrame([(1, "7"), (1, "8"), (9, "9")], "row_id long, r_raw string"), limit=1)
    assert sorted((r.row_id, r.rank, r.r_raw) for r in shown.collect()) == [(1, 1, "01001"), (1, 2, "8"), (3, 1, "00003"), (9, 2, "9")]


def test_undo(spark):
    log = spark.createDataFrame([(1, "index", n, str(n), False) for n in range(1, 6)], "row_id int, field string, seq int, value string, undone boolean")
    value = lambda df: H.replay(df).first().value
    back = checkpointed(H.undo(log, 2))
    assert value(back) == "3" and value(H.redo(back)) == "4" and value(H.redo(back, 9)) == "5" and value(H.undo(log, 9, depth=4)) == "1"


def test_store_upkeep(spark, tmp_path):
    now = F.lit(dt.datetime(2025, 3, 1))
    parents = spark.createDataFrame([("a",), ("b",), ("c",), ("",)], "city_id string")
    store = spark.createDataFrame([("1", "a", dt.datetime(2025, 1, 1)), ("9", "c", dt.datetime(2025, 2, 28))], "street_id string, city_id string, cached_at timestamp_ntz")
    marks = spark.createDataFrame([("a", dt.datetime(2025, 1, 1)), ("c", dt.datetime(2025, 2, 28))], "city_id string, cached_at timestamp_ntz")
    asked = []

    def fetch(due):
        asked.extend(sorted(r.city_id for r in due.collect()))
        return spark.createDataFrame([("1", "a", dt.datetime(2025, 3, 1)), ("2", "a", dt.datetime(2025, 3, 1))], store.schema)

    rows, fresh = D.refreshed(parents, store, marks, fetch, "city_id", ["street_id"], now, 30)
    assert asked == ["a", "b"] and sorted(r.street_id for r in rows.collect()) == ["1", "2", "9"]
    assert {r.city_id: r.cached_at.month for r in fresh.collect()} == {"a": 3, "c": 2}
    cache = spark.createDataFrame([("k", "v", dt.datetime(2025, 1, 30, 1)), ("l", "w", dt.datetime(2025, 1, 28)), ("m", "x", None)], "key string, answer string, at timestamp")
    assert {r.key for r in D.unexpired(cache, "at", F.lit(dt.datetime(2025, 3, 1)), 30).collect()} == {"k"}
    more = D.answered(spark.createDataFrame([("k",), ("z",), ("z",)], "key string"), cache, lambda due: due.withColumn("answer", F.lit("new")))
    assert sorted(r.key for r in more.collect()) == ["k", "l", "m", "z"]
    path, built = str(tmp_path / "kept"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [D.persisted(spark, path, build).count(), D.persisted(spark, path, build).count(), D.persisted(spark, path, build, force=True).count()] == [1, 1, 2] and len(built) == 2


def test_lookups(spark):
    df = spark.createDataFrame([("Київ", "0", False), ("Львів", "5", False), (None, None, None)], "city string, lock_code string, is_security boolean")
    assert [r.city for r in D.containing(df, "city", "ИЇ").collect()] == ["Київ"] and df.where(D.office_working()).count() == 2
    assert df.where(D.names_overlap("city", "lock_code")).count() == 1
    rows = [(1, "Київ", "", "Р1", "вул. Довга", "01002"), (2, "київ", "Р2", "", "Довга", "01001"), (3, "Київ", "", "", "пр. Інший", ""), (4, "Село", "", "", "", None)]
    directory = spark.createDataFrame(rows, "record_id long, city string, old_district string, new_district string, street string, city_index string")
    asked = spark.createDataFrame([(1, "КИЇВ", "", "довга"), (2, "Київ", "р1", "Довга"), (3, "Київ", "", "Нема"), (4, "Село", "", "x"), (5, "Ніде", "", ""), (6, None, None, None)], "ask_id long, city string, district string, street string")
    assert {r.ask_id: (r.choices, r["index"]) for r in D.manual_choices(asked, directory).collect()} == {1: (2, "01001"), 2: (1, "01002"), 3: (0, "01001"), 4: (0, "00000"), 5: (0, "00000"), 6: (0, "00000")}


def test_directory_files_in_any_encoding(spark, tmp_path):
    heads = list(I.DIRECTORY_HEADERS)
    (tmp_path / "a.csv").write_bytes(("﻿" + ";".join(heads) + "\nКиївська;;Р;;м. Київ; 01001 ;\"вул. \"\"Довга\"\"; 1\";1,2;;;;;;\n").encode())
    (tmp_path / "b.csv").write_bytes((";".join([heads[4], heads[0]]) + "\r\nм. Львів;Львівська\r\n\r\n").encode("cp1251"))
    got = {r.city: r for r in I.read_directory_files(spark, str(tmp_path / "*.csv")).collect()}
    assert set(got) == {"м. Київ", "м. Львів"} and got["м. Київ"].street == 'вул. "Довга"; 1' and got["м. Київ"].city_index == "01001" and got["м. Львів"].region == "Львівська" and got["м. Львів"].street == ""
    df = spark.createDataFrame([("1", "auto", "x,y"), ("2", "manual", "")], "row_number string, mode string, issue_tags string")
    I.save_report(df, str(tmp_path / "r.csv"))
    assert {(r.name, r.n) for r in spark.read.json(str(tmp_path / "r.csv.summary.json")).collect()} == {("rows_analyzed", 2), ("auto", 1), ("manual", 1), ("x", 1), ("y", 1)}
    assert I.write_xlsx(df, str(tmp_path / "old.xls")).endswith("old.xlsx") and os.path.exists(tmp_path / "old.xlsx")


def test_classifier_results(spark):
    cities = spark.createDataFrame([("29713", "Київ", None, "м.", "Київська", "", 2_827_400), ("2", "Київець", "", "с.", "", "", 5)], "city_id string, city string, old_city string, city_type_short string, region string, district string, population int")
    streets = spark.createDataFrame([("street-1", "29713", "Пасхаліна Юрія", "вул.", "Ілліча"), ("street-2", "29713", "Інша", "вул.", None)], "street_id string, city_id string, street string, street_type_short string, old_street string")
    houses = spark.createDataFrame([("street-1", "23", "23", "02096"), ("street-1", "25", "25", "02097"), ("street-2", "1", "1", "02000")], "street_id string, house_number string, normalized_house_number string, postcode string")
    asks = [(1, "Київ", "вул.Ілліча", "23", ""), (2, "Київ", "вул.Ілліча", "99", ""), (3, "", "", "", "2000"), (4, "Одеса", "Ілліча", "23", "")]
    q = L.prepared_requests(spark.createDataFrame([(*a, "", "") for a in asks], "row_id long, city string, street string, building string, index string, region string, district string"))
    got = [r for r in K.classifier_results(q, cities, streets, houses).orderBy("row_id", "rank").collect()]
    first = got[0]
    assert (first.row_id, first.postcode, first.confidence, first.matched_old_street) == (1, "02096", 99, "Ілліча") and {r.row_id for r in got} == {1}
    empty = K.classifier_results(q.limit(0), cities, streets, houses)
    assert empty.count() == 0 and K.classifier_results(q, cities.limit(0), streets, houses).count() == 0
    assert [r.house_number for r in K.house_choices(spark.createDataFrame([("street-1", "99"), ("street-1", "25")], "street_id string, q_house string"), houses).orderBy("q_house", "house_number").collect()] == ["25", "23", "25"]


def test_similar_names_lose_none(spark):
    """Blocks of letters and letter sets against all pairs."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("абвгд", k=rng.randint(1, 9))) for _ in range(150)})
    pairs = [(a, b) for a in names for b in names]
    scores = dict(zip(pairs, batch.jaro([a for a, _ in pairs], [b for _, b in pairs])))
    wink = {k: j if j < 0.7 else j + 0.1 * (1 - j) * len(os.path.commonprefix([k[0][:4], k[1][:4]])) for k, j in scores.items()}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for least in (0.8, 0.9):
        blocked = df.select("n", F.explode(L.letters("n", least)).alias("block"))
        met = {(r.a, r.b) for r in blocked.withColumnRenamed("n", "a").join(blocked.withColumnRenamed("n", "b"), "block").select("a", "b").collect()}
        assert all(k in met for k, v in wink.items() if v >= least)
        some = df.union(spark.createDataFrame([("а б",), ("аб в",), ("а",)], "n string"))
        got = {(r.a, r.b): r.similarity for r in L.similar_everywhere(some.withColumnRenamed("n", "a"), some.withColumnRenamed("n", "b"), "a", "b", least).collect()}
        every = [r.n for r in some.distinct().collect()]
        pairs = [(a, b) for a in every for b in every]
        want = {k: v for k, v in zip(pairs, batch.token_similarity([a for a, _ in pairs], [b for _, b in pairs])) if v >= least}
        assert got.keys() == want.keys()
    words = [n for n in names if len(n) > 1]
    for least in (0.72, 0.85, 0.9):
        own = spark.createDataFrame([("x", n) for n in words], "k string, n string")
        got = {(r.a, r.b) for r in L.similar_names(own.withColumnRenamed("n", "a"), own.withColumnRenamed("n", "b"), ["k"], "a", "b", least).collect()}
        assert got == {k for k, v in wink.items() if v >= least and len(k[0]) > 1 and len(k[1]) > 1}


def test_sql_functions(spark):
    assert "kv_normalize_city" in Q.register(spark)
    row = spark.sql("SELECT kv_normalize_city('м. Київ') AS a, kv_normalize_street(NULL) AS b, kv_token_similarity('а б вг', 'вг') AS c").first()
    assert (row.a, row.b, row.c) == ("киів", "", 1.0)


def test_intermediate_tables(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        _shared_folder(Elsewhere)
    with released(spark):
        df = checkpointed(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
