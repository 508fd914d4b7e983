"""Golden values of normalization and similarity."""

import random

import pytest

from kvartal.functions import batch as B
from kvartal.functions import similarity as S
from kvartal.functions import text as X
from kvartal.functions.dual import name, quoted


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    out = f(*[name(f"c{i}") for i in range(len(values))])
    if isinstance(out, tuple):
        return tuple(df.select(*[e.col.alias(f"x{i}") for i, e in enumerate(out)]).first())
    return df.select(out.col.alias("x")).first().x


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.normalize_city, "м. Київ", "киів"), (X.normalize_city, "місто Львів", "львів"), (X.normalize_city, "с. Петрівка", "петрівка"), (X.normalize_city, "г. Киев", "киів"),
        (X.normalize_street, "вул. Шевченка", "шевченка"), (X.normalize_street, "проспект Перемоги", "перемоги"), (X.normalize_street, "провулок Тихий", "тихий"),
        (X.normalize_street, "Шевченка вул.", "шевченка вул"), (X.normalize_street, "вул. Харківське шосе", "харківське"), (X.normalize_street, "шосе Харківське", "харківське"),
        (X.normalize_street, "вул. Л.Т.Українки", "лесі тараса украінки"), (X.normalize_text, "  Привіт   Світ  ", "привіт світ"), (X.normalize_text, "Test-123", "test-123"),
        (X.street_kind, "вул. Харківське шосе", "highway"), (X.street_kind, "вул. Довга", "street"), (X.street_kind, "пров. Тихий", "lane"), (X.street_kind, "пр-т Миру", "avenue"),
        (X.building_base, "117-А", "117"), (X.building_base, "88-2", ""), (X.query_index, " 01024 ", "1024"), (X.query_index, "01000", ""), (X.postcode, "1024", "01024"),
        (X.postcode, "*", ""), (X.normalize_region, "Київська обл.", "киівська"), (X.consonants, "Київ", "кв"),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, f, value) == want


def test_pairs(spark):
    assert one(spark, X.building_in_street, "ВАСИЛЯ СТУСА 5-А") == ("5-А", "ВАСИЛЯ СТУСА")
    assert one(spark, X.building_in_street, "Святошинська 27-КОРП1, #63") == ("27", "Святошинська")
    assert one(spark, X.repaired_area, "Києво-Святошинський р-н", "Київська обл.") == ("Київська обл.", "Києво-Святошинський р-н")
    assert one(spark, X.repaired_area, "Святошинський", "") == ("", "Святошинський")
    assert one(spark, X.has_letter, "117-А") is True and one(spark, X.has_letter, "88-2") is False


@pytest.mark.parametrize(
    "street, want",
    [
        ("01032, м. Київ, вул. Жильянська, буд. 59, кв. 1009", ("м. Київ", "вул. Жильянська", "59")),
        ("01001, Київ, Будівельників, 12а, 61", ("Київ", "Будівельників", "12а")),
        ("79040 м. Львів, вул. Городоцька, буд. 357", ("м. Львів", "вул. Городоцька", "357")),
        ("вул. Довга", ("", "вул. Довга", "")),
    ],
)
def test_full_address(spark, street, want):
    assert one(spark, X.split_full_address, "", street, "") == want


def test_closed_index(spark):
    assert one(spark, X.closed_index, "Тимчасово не функціонує", "01001") == "*"
    assert one(spark, X.closed_index, "ВПЗ закрито, 02002", "01001") == "02002"
    assert one(spark, X.closed_index, "", "01001") == "01001"


def plain_jaro(a, b):
    w = max(0, max(len(a), len(b)) // 2 - 1)
    free, met = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                met.append((i, j))
                break
    if not met:
        return 0.0
    m, order = len(met), sorted(j for _, j in met)
    t = sum(a[i] != b[j] for (i, _), j in zip(met, order)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_similarities_agree(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("абвг", k=rng.randint(1, 10))), "".join(rng.choices("абвг", k=rng.randint(1, 10)))) for _ in range(300)]
    want = [plain_jaro(a, b) for a, b in pairs]
    assert abs(B.jaro([a for a, _ in pairs], [b for _, b in pairs]) - want).max() < 1e-12
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c0 string, c1 string").select("i", S.jaro(name("c0"), name("c1")).col.alias("x")).collect()
    assert max(abs(r.x - want[r.i]) for r in rows) < 1e-12
    words = [("вул Шевченка", "Шевченка вул"), ("", "а"), ("м київ", "київ м"), ("а б", "а в"), ("Київ", "київ"), ("мартен", "мартнe"), ("аб", "вг")]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(words)], "i int, c0 string, c1 string").select("i", S.token_similarity(name("c0"), name("c1")).col.alias("x")).collect()
    batch = B.token_similarity([a for a, _ in words], [b for _, b in words])
    assert max(abs(r.x - batch[r.i]) for r in got) < 1e-12 and batch[0] == 1.0 and batch[1] == 0.0


def test_literals():
    assert quoted("п'ят") == ('r"п\'ят"', "'п''ят'")


def test_jaro_of_batches_by_bits():
    """Words of one number's bits and longer ones, repeated words, and what a word at a time gives."""
    words = ["а", "аб", "володимира гедебенка", "x" * 63, "x" * 64, "ab" * 32, "ba" * 32, "x" * 65, "ab" * 40, "Ґанок", "ґанок"]
    pairs = [(a, b) for a in words for b in words] * 2
    got, want = B.jaro([a for a, _ in pairs], [b for _, b in pairs]), [plain_jaro(a, b) for a, b in pairs]
    assert abs(got - want).max() < 1e-12
    short = [(a, b) for a, b in pairs if max(len(a), len(b)) <= B.BITS]
    assert abs(B.jaro([a for a, _ in short], [b for _, b in short]) - [plain_jaro(a, b) for a, b in short]).max() < 1e-12
    assert B.jaro_winkler(["Ґанок", "", "а"], ["ґанок", "а", ""]).tolist() == [1.0, 0.0, 0.0] and len(B.token_similarity([], [])) == 0
