"""Normalization of address text: cities, streets, regions, house numbers and postal indexes.

Every function takes and gives an Ex (see dual.py), whose `.col` is a Spark Column of built-in functions.
Missing values are ''; wrap a column with dual.text first.
"""

from __future__ import annotations

import re

from kvartal.functions.dual import NOT_W, WS, Ex, array, call, case, count, each, extract, item, join, keep, let, like, lit, lookup, lower, part, rest, size, split, sub, translate, upper

# Former and Russian names of cities and the current ones.
CITY_RENAMES = {
    "киев": "київ", "харьков": "харків", "днепр": "дніпро", "днепропетровск": "дніпро", "львов": "львів", "николаев": "миколаїв", "пятихатки": "п'ятихатки",
    "сєвєродонецьк": "сіверськодонецьк", "северодонецк": "сіверськодонецьк", "димитров": "мирноград", "красноармійськ": "покровськ", "артемівськ": "бахмут",
    "дніпропетровськ": "дніпро", "кіровоград": "кропивницький", "дніпродзержинськ": "кам'янське", "новоград-волинський": "звягель",
    "володимир-волинський": "володимир", "переяслав-хмельницький": "переяслав", "іллічівськ": "чорноморськ", "комсомольськ": "горішні плавні",
    "кузнецовськ": "вараш", "южне": "південне", "червоноград": "шептицький",
}
# Initials before a street's surname and the given names they stand for, in this order.
INITIALS = (("л", "лесі"), ("т", "тараса"), ("б", "богдана"), ("і", "івана"), ("м", "миколи"), ("в", "василя"), ("г", "григорія"), ("п", "петра"), ("о", "олександра"))
# Words before a city's and a street's name, and street kinds that may stand behind it.
CITY_PREFIX = r"(?:місто|город|нас\.?WS*пункт|н\.?WS*п\.?|смт|сел(?:ище)?|с-ще|м|г|с)\.?WS+".replace("WS", WS)
STREET_PREFIX = r"(?:вул(?:иця)?|пров(?:улок)?|бульв(?:ар)?|бул|просп(?:ект)?|пр-т|прт\.?|пр\.?|пл(?:оща)?|шосе)\.?"
STREET_SUFFIX = r"(?:шосе|просп(?:ект)?|пр-т|прт|бульв(?:ар)?|пров(?:улок)?)\.?"
# Beginnings that make the first part of a street cell a city, and cities known without one.
CITY_STARTS = ("м.", "місто", "с.", "село", "смт.", "с-ще", "селище")
KNOWN_CITIES = ("київ", "харків", "одеса", "дніпро", "львів", "запоріжжя", "кривий ріг", "миколаїв", "донецьк")
VOWELS = "аеиіоуюяёэы"
PLACEHOLDER_INDEXES = ("*", "00000", "01000")
COUNTRY = ("украина", "ukraine")
_LETTER = "[а-яіїєґa-z]"
BUILDING = rf"\d+(?:[/-]\d+)?(?:(?:-|{WS})?{_LETTER})?"


def strip(x: Ex) -> Ex:
    """Without white space at both ends, whatever kind."""
    return sub(x, rf"^{WS}+|{WS}+$")


def squeeze(x: Ex) -> Ex:
    return strip(sub(x, f"{WS}+", " "))


def normalize_text(x: Ex) -> Ex:
    """Small letters, Russian letters as Ukrainian ones, everything but letters, digits, _ and - as a blank."""
    out = translate(lower(squeeze(x)), "ыэёїъ", "иееі")
    return squeeze(sub(out, r"[^\p{L}\p{N}_\s-]", " "))


def normalized(value: str) -> str:
    """normalize_text of a constant."""
    out = value.lower().translate(str.maketrans({"ы": "и", "э": "е", "ё": "е", "ї": "і", "ъ": ""}))
    return " ".join(re.sub(r"[^\w\s-]", " ", out).split())


def normalize_city(x: Ex) -> Ex:
    """The name without its kind, normalized, in its current form."""
    bare = normalize_text(strip(sub(x, rf"^{WS}*{CITY_PREFIX}")))
    return lookup(bare, {old: lit(normalized(new)) for old, new in CITY_RENAMES.items()})


def normalize_street(x: Ex) -> Ex:
    """The name without its kind before or behind it, with initials written out, normalized.

    The kind is cut without a word boundary, as the matching rules have it. Each initial is replaced twice,
    since two adjacent ones share their boundary.
    """
    out = strip(sub(x, rf"^{WS}*{STREET_PREFIX}{WS}*"))
    out = sub(out, rf"{WS}+{STREET_SUFFIX}{WS}*$")
    for letter, given in INITIALS:
        for _ in range(2):
            out = sub(out, rf"(^|{NOT_W}){letter}\.{WS}*", given + " ", group=1)
    return normalize_text(out)


def street_kind(x: Ex) -> Ex:
    """highway, avenue, boulevard, lane, square, street or '': a kind behind the name goes before one in front."""
    s = lower(strip(x))
    behind = (("highway", "шосе"), ("avenue", r"(?:проспект|просп\.?|пр-т|прт\.?)"), ("boulevard", r"(?:бульвар|бульв\.?)"), ("lane", r"(?:провулок|пров\.?)"))
    before = (("lane", "пров(?:улок)?"), ("avenue", "(?:просп(?:ект)?|пр-т|прт|пр)"), ("boulevard", "(?:бульв(?:ар)?|бул)"), ("square", "пл(?:оща)?"), ("highway", "шосе"), ("street", "вул(?:иця)?"))
    rules = [(like(s, rf"(^|{NOT_W}){p}$"), kind) for kind, p in behind] + [(like(s, rf"^{p}({NOT_W}|$)"), kind) for kind, p in before]
    return case(*rules, default="")


def normalize_region(x: Ex) -> Ex:
    return normalize_text(sub(strip(lower(x)), rf"{WS}*(область|обл\.?){WS}*$"))


def consonants(x: Ex) -> Ex:
    return sub(normalize_text(x), rf"[^\p{{L}}]|[{VOWELS}]")


def building_key(x: Ex) -> Ex:
    """Capital letters without hyphens and blanks."""
    return strip(translate(upper(x), "- ", ""))


def building_base(x: Ex) -> Ex:
    """The number and fraction of a number with at most one letter, else ''."""
    return extract(strip(translate(upper(x), " ", "")), r"^(\d+(?:/\d+)?)(?:-?[A-ZА-ЯІЇЄҐ])?$")


def has_letter(x: Ex) -> Ex:
    return like(strip(translate(upper(x), " ", "")), r"^\d+(?:/\d+)?-?[A-ZА-ЯІЇЄҐ]$")


def _no_zeros(x: Ex) -> Ex:
    return sub(x, "^0+")


def _bare_index(x: Ex) -> Ex:
    return translate(strip(x), " ", "")


def query_index(x: Ex) -> Ex:
    """A requested index without leading zeros; '' for placeholders and anything but digits."""
    bare = _bare_index(x)
    return case(*[(bare == p, "") for p in PLACEHOLDER_INDEXES], (~like(bare, "^[0-9]+$"), ""), default=_no_zeros(bare))


def postcode(x: Ex, placeholders: bool = True) -> Ex:
    """An index with leading zeros up to five digits; '' for placeholders and anything but digits."""
    bare = _bare_index(x)
    padded = case((size(bare) < 5, call("lpad", bare, 5, "0")), default=bare)
    return case(*[(bare == p, "") for p in PLACEHOLDER_INDEXES if placeholders], (~like(bare, "^[0-9]+$"), ""), default=padded)


def city_in_street(x: Ex) -> tuple[Ex, Ex]:
    """(city, street): the first comma part of a street cell if it begins like a city or is a known one."""
    head = strip(part(x, ",", 1))
    starts = "|".join(s.replace(".", r"\.") for s in CITY_STARTS)
    known = like(head, f"^({starts})") | like(normalize_text(head), "^(" + "|".join(KNOWN_CITIES) + ")$")
    yes = like(x, ",") & known
    others = join(each(rest(split(x, ","), 1), strip), ", ")
    return case((yes, head), default=""), case((yes, others), default=x)


def building_in_street(x: Ex) -> tuple[Ex, Ex]:
    """(building, street) of a street cell that ends in a house number; ('', cell) otherwise."""
    pattern = rf"^([^\n]*?){WS}+({BUILDING})(?:{WS}*[-/]?{WS}*(?:корп|корпус|к)\.?{WS}*\d+)?{WS}*(?:,[^\n]*|#[^\n]*)?$"
    street, building = strip(extract(x, pattern, 1)), strip(extract(x, pattern, 2))
    yes = like(x, pattern) & (size(street) >= 3) & ~like(street, "-$")
    return case((yes, building), default=""), case((yes, street), default=x)


def repaired_area(region: Ex, district: Ex) -> tuple[Ex, Ex]:
    """(region, district) put right: swapped cells, or a bare district name in the region's cell."""

    def has_word(x: Ex, words: str) -> Ex:
        return like(x, rf"(^|{NOT_W})({words})({NOT_W}|$)")

    swapped = has_word(lower(region), "р-н|район") & has_word(lower(district), "обл|область")
    bare = ~has_word(lower(region), "обл|область") & like(lower(region), "(ський|цький|зький)$") & (district == "")
    return case((swapped, district), (bare, ""), default=region), case((swapped, region), (bare, region), default=district)


def house_in_parts(parts: Ex) -> Ex:
    """The first house number among address parts: parts that say so first, apartments never."""
    flat = rf"^{WS}*(?:кв\.?|квартира|пом\.?|прим\.?|офіс|оф\.?|office|apt\.?)({NOT_W}|$)"
    after = rf"(?:{WS}|,|$|корп|корпус|кв|офіс)"
    usable = keep(parts, lambda p: (p != "") & (p != "*") & (p != "#") & (p != "#-") & ~like(p, flat))
    # The first match is taken; what follows a number without a word after it is no part of it.
    named = keep(each(usable, lambda p: strip(extract(p, rf"(?:буд\.?|будинок|д\.?){WS}*({BUILDING}){after}"))), lambda p: p != "")
    any_ = keep(each(usable, lambda p: strip(extract(p, rf"({BUILDING}){after}"))), lambda p: p != "")
    return case((count(named) > 0, item(named, 0)), default=item(any_, 0))


def _address_parts(street: Ex) -> Ex:
    """Non-empty comma parts of a street cell, without a leading index and country."""

    def cut(parts: Ex) -> Ex:
        headed = extract(item(parts, 0), rf"^\d{{4,5}}{WS}+(.+)$")
        first = case((headed != "", headed), default=item(parts, 0))
        whole = Ex(f"concat(array({first.spark}), {rest(parts, 1).spark})", f"list_concat([{first.check}], {rest(parts, 1).check})")
        return case((count(parts) < 2, Ex("cast(array() as array<string>)", "[]::VARCHAR[]")), (like(item(parts, 0), r"^\d{4,5}$"), rest(parts, 1)), default=whole)

    def bare(parts: Ex) -> Ex:
        return case((like(normalize_text(item(parts, 0)), "^(" + "|".join(COUNTRY) + ")$"), rest(parts, 1)), default=parts)

    return let(let(keep(each(split(street, ","), strip), lambda p: p != ""), cut, "cut"), bare, "bare")


def split_full_address(city: Ex, street: Ex, building: Ex) -> tuple[Ex, Ex, Ex]:
    """(city, street, building) when the street cell holds a whole address; unchanged cells otherwise."""
    given = city != ""
    city_like = rf"^(м|г|місто|город|с|смт|с-ще)\.?{WS}*"

    def named(parts: Ex, i: int) -> Ex:
        return like(normalize_text(item(parts, i)), city_like) & (count(parts) > i)

    def begin(parts: Ex) -> Ex:
        """Number of the part that is the street."""
        same = (normalize_city(item(parts, 0)) != "") & (normalize_city(item(parts, 0)) == normalize_city(city))
        return case(*[(named(parts, i), i + 1) for i in range(3)], (given & same, 1), (given, 0), default=1)

    def in_city(parts: Ex) -> Ex:
        found = case(*[(named(parts, i), item(parts, i)) for i in range(3)], (given, ""), default=item(parts, 0))
        return let(found, lambda f: case(((count(parts) >= 2) & (f != "") & (~given | like(strip(city), rf"^г\.?{WS}*")), f), default=city), "found_city")

    def in_street(parts: Ex) -> Ex:
        return let(begin(parts), lambda at: case(((count(parts) >= 2) & (at < count(parts)), item(parts, at)), default=street), "part_no")

    def in_building(parts: Ex) -> Ex:
        return let(begin(parts), lambda at: case(((count(parts) >= 2) & (at < count(parts)) & (building == ""), house_in_parts(rest(parts, at + 1))), default=building), "part_no")

    parts, comma = _address_parts(street), like(street, ",")
    return tuple(case((comma, let(parts, f, "pieces")), default=own) for f, own in ((in_city, city), (in_street, street), (in_building, building)))  # type: ignore[return-value]


# ---- whole addresses in one text

_TOWN = r"[А-ЯІЇЄҐа-яіїєґ'`-]+"
# What introduces a city, a street and a house in a written-out address, in order of trial.
CITY_WORDS = (r"м\.WS*([^,]+)", r"містоWS+([^,]+)", r"с\.WS*([^,]+)", r"смт\.WS*([^,]+)", r"селищеWS+([^,]+)", rf",WS*({_TOWN}),")
STREET_WORDS = tuple(
    p for short, long in (("вул", "вулиця"), ("пров", "провулок"), ("бульв", "бульвар"), ("просп", "проспект"), ("пл", "площа"), ("кв", "квартал")) for p in (rf"{short}\.WS*([^,]+)", rf"{long}WS+([^,]+)")
)
HOUSE_WORDS = (
    r"буд\.WS*([^,]+)", r"будинокWS+([^,]+)", r"d\.WS*(\d+[а-яa-z/-]*)", r"д\.?WS*(\d+[а-яa-z/-]*)", r",WS*(\d+[а-яa-z/-]*)WS*,", r",WS*(\d+[а-яa-z/-]*)WS*$",
)


def _first(x: Ex, patterns: tuple[str, ...], refuse: str = "") -> Ex:
    rules = []
    for p in patterns:
        got = strip(extract(x, p.replace("WS", WS)))
        ok = like(x, p.replace("WS", WS))
        rules.append((ok & ~like(lower(got), refuse) if refuse else ok, got))
    return case(*rules, default="")


def _until(x: Ex, pattern: str) -> Ex:
    return strip(sub(x, rf"(?s)(?:{pattern}).*$"))


def parse_full_address(x: Ex) -> dict[str, Ex]:
    """index, city, street and building of an address in one text; '' for what isn't found."""
    t = strip(x)
    return {
        "index": extract(t, r"^(\d{5})"),
        "city": _first(t, CITY_WORDS, r"область|обл\.|район|р-н"),
        "street": _until(_first(t, STREET_WORDS), rf",?{WS}*буд\.?|,?{WS}*будинок|,?{WS}*\d+[а-яa-z/-]*{WS}*,"),
        "building": _until(_first(t, HOUSE_WORDS), rf",?{WS}*офіс|,?{WS}*кв\.|,?{WS}*корп\."),
    }


def is_full_address(x: Ex) -> Ex:
    """Whether a text begins with an index and names a place or street."""
    return like(x, r"^\d{5}[^\n]*?(м\.|вул\.|с\.|смт\.)")


def closed_index(not_working: Ex, index: Ex) -> Ex:
    """The index to use: that of the office named instead of a closed one, * if it is closed for good."""
    office = like(not_working, "ВПЗ", fold=False)
    there = extract(not_working, r"(\d{5})")
    return case((office & (there != ""), there), (office, "*"), (like(not_working, "Тимчасово не функціонує", fold=False), "*"), default=index)


# ---- second set of normalizers, and texts for display

# Kind words that the second set of normalizers cuts wherever they stand, in this order.
PLAIN_STREET_KINDS = (r"вул\.?", "вулиця", r"пров\.?", "провулок", r"бульв\.?", "бульвар", r"просп\.?", "проспект", r"пл\.?", "площа")
PLAIN_CITY_KINDS = (r"м\.?", "місто", r"с\.?", "село", r"смт\.?", "селище WS міського WS типу", r"сел\.?", "селище")


def plain_text(x: Ex) -> Ex:
    """Small letters and single blanks; everything but letters, digits, _ and - is dropped."""
    return strip(sub(squeeze(lower(x)), r"[^\p{L}\p{N}_\s-]"))


def _without(x: Ex, kinds: tuple[str, ...]) -> Ex:
    for k in kinds:
        x = sub(x, k.replace(" WS ", f"{WS}+") + f"{WS}+")
    return plain_text(x)


def plain_street(x: Ex) -> Ex:
    return _without(x, PLAIN_STREET_KINDS)


def plain_city(x: Ex) -> Ex:
    return _without(x, PLAIN_CITY_KINDS)


def plain_house(x: Ex) -> tuple[Ex, Ex]:
    """(street, house) of a street cell that ends in a number; (cell, '') otherwise."""
    pattern = rf"^([^\n]+?){WS}+([0-9]+(?:[-/]|{WS})?[А-Яа-яA-Za-z]*)$"
    yes = like(strip(x), pattern, fold=False)
    return case((yes, strip(extract(strip(x), pattern, 1, fold=False))), default=x), case((yes, strip(extract(strip(x), pattern, 2, fold=False))), default="")


def leading_number(x: Ex) -> Ex:
    return extract(strip(x), "^([0-9]+)")


def cache_key(*parts: Ex) -> Ex:
    """Key of a cached answer: the non-empty parts, small and trimmed, hashed."""
    return call("md5", join(keep(array(*[strip(lower(p)) for p in parts]), lambda p: p != ""), "|"))


def confidence_band(x: Ex) -> Ex:
    return case((x >= 90, "high"), (x >= 70, "middle"), default="low")


def _closed(x: Ex) -> Ex:
    return like(x, "Тимчасово не функціонує", fold=False)


def redirect_text(not_working: Ex) -> Ex:
    """Where a closed office sends its mail: what stands behind the first comma, or the whole note."""
    return case((~_closed(not_working), ""), (like(not_working, ",", fold=False), strip(extract(not_working, r"(?s)^[^,]*,(.*)$", 1, fold=False))), default=not_working)


def picked_index(not_working: Ex, index: Ex) -> Ex:
    """The index that a pick by hand gives: * for a closed office."""
    return case((_closed(not_working), "*"), default=index)


def house_lines(buildings: Ex, most: int = 10) -> Ex:
    """A list of houses as lines of most items."""
    items = keep(each(split(buildings, ","), strip), lambda p: p != "")
    spark = f"array_join(transform(sequence(0, greatest(size({items.spark}) - 1, 0) div {most}), i -> array_join(slice({items.spark}, i * {most} + 1, {most}), ',')), '\\n')"
    check = f"array_to_string(list_transform(range(0, greatest(CAST(len({items.check}) AS BIGINT) - 1, 0) // {most} + 1), lambda i: array_to_string(list_slice({items.check}, i * {most} + 1, (i + 1) * {most}), ',')), chr(10))"
    return Ex(spark, check)


def full_address(region: Ex, district: Ex, city: Ex, street: Ex, building: Ex) -> Ex:
    """The parts that are there, with commas."""
    house = case((building != "", Ex(f"concat('буд. ', {building.spark})", f"('буд. ' || {building.check})")), default="")
    return join(keep(array(region, district, city, street, house), lambda p: p != ""), ", ")


def reparsed(city: Ex, street: Ex, building: Ex) -> dict[str, Ex]:
    """Cells after a street cell that holds a whole address is taken apart; parts that it doesn't name stay. A text
    that names neither city nor street is left alone."""
    found = parse_full_address(street)
    use = is_full_address(street) & ((found["city"] != "") | (found["street"] != ""))
    out = {c: case((use & (found[c] != ""), found[c]), default=own) for c, own in (("city", city), ("street", street), ("building", building))}
    return out | {"detected": is_full_address(street), "parsed": use}
