"""Reading Ukrainian place names as people type them: one folded alphabet for Cyrillic, Russian spelling,
look-alike letters and Latin transliteration, and parsers for city cells, street cells and house numbers.

All functions take and give plain strings; the operators call them on Arrow batches.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Look-alike Latin letters inside Cyrillic words, by their small form.
LOOKALIKE = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "i": "и", "k": "к", "m": "м", "t": "т", "b": "в", "h": "н", "u": "и", "n": "п"}
# Letters that Ukrainian and Russian spelling exchange, and signs that are not kept.
FOLDED = {"ы": "и", "і": "и", "ї": "и", "й": "и", "ґ": "г", "є": "е", "э": "е", "ё": "е", "ў": "у", "ь": "", "ъ": ""}
SIGNS = "'’‘ʼ`´ʹ′＇́­​‌‍⁠﻿"
# Romanization of Ukrainian, longest first, read back into the folded alphabet.
LATIN = (
    ("shch", "щ"), ("zgh", "зг"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("zh", "ж"), ("ia", "я"), ("ya", "я"), ("iu", "ю"), ("yu", "ю"), ("ie", "е"), ("ye", "е"), ("yi", "и"),
    ("a", "а"), ("b", "б"), ("v", "в"), ("h", "г"), ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"), ("y", "и"), ("i", "и"), ("j", "и"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"),
    ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("c", "ц"), ("w", "в"), ("x", "х"), ("q", "к"),
)
_LATIN = dict(LATIN)
_LATIN_RE = re.compile("|".join(k for k, _ in LATIN))
_CYRILLIC = re.compile("[а-яіїєґёыэъ]")
_TO_CYRILLIC = {ord(k): v for k, v in (LOOKALIKE | FOLDED).items()} | {ord(c): "" for c in SIGNS}
_NO_SIGNS = {ord(c): "" for c in SIGNS}
#: Pairs that romanization can't tell from a single letter.
_JOINED = (("иа", "я"), ("иу", "ю"), ("ие", "е"), ("тс", "ц"), ("кг", "х"), ("шч", "щ"), ("ии", "и"))
_ONLY_LOOKALIKES = re.compile(f"[{''.join(LOOKALIKE)}]+")


def word_key(word: str, cyrillic_near: bool = True) -> str:
    """A small-letter word in the folded alphabet.

    A word without any Cyrillic letter is read as transliterated, unless it has only look-alike letters and
    stands among Cyrillic ones.
    """
    if _CYRILLIC.search(word) or (cyrillic_near and _ONLY_LOOKALIKES.fullmatch(word)):
        key = word.translate(_TO_CYRILLIC)
    else:
        key = _LATIN_RE.sub(lambda m: _LATIN[m.group()], word.translate(_NO_SIGNS))
    return key


def joined(key: str) -> str:
    """A reference key as a transliterated query reads it."""
    for a, b in _JOINED:
        key = key.replace(a, b)
    return key


class Memo(dict):
    """A dictionary that fills itself and is emptied at a bound, so that a worker's memory stays level."""

    def __init__(self, fill, bound: int = 200_000):
        super().__init__()
        self.fill, self.bound = fill, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.fill(key)
        return value


def _keys(*words: str) -> frozenset[str]:
    return frozenset(k for w in words for k in (word_key(w), word_key(w, False)))


# Words that stand before or after a city's name, by kind.
CITY_KINDS = {
    "м.": _keys("м", "м-то", "місто", "г", "гор", "город", "city", "m"),
    "с.": _keys("с", "село", "дер", "village"),
    "смт": _keys("смт", "пгт"),
    "с-ще": _keys("с-ще", "селище", "сел", "пос", "поселок"),
    "х.": _keys("хутір", "хут"),
}
_CITY_KIND = {w: kind for kind, words in CITY_KINDS.items() for w in words}
_CITY_FILL = _keys("of", "town") | {"оф"}
# Words that name a street's kind.
STREET_KINDS = {
    "вул": _keys("вул", "вулиця", "вулиц", "ул", "улица", "вулица"),
    "пров": _keys("пров", "провулок", "провул", "пер", "переулок", "провулк"),
    "просп": _keys("просп", "проспект", "пр", "пр-т", "прт", "пр-кт"),
    "бульв": _keys("бульв", "бульвар", "бул", "б-р"),
    "шосе": _keys("шосе", "шоссе", "ш"),
    "пл": _keys("пл", "площа", "площадь"),
    "наб": _keys("наб", "набережна-вул"),
    "узвіз": _keys("узвіз"),
    "тупик": _keys("тупик"),
    "алея": _keys("алея", "ал"),
    "майдан": _keys("майдан"),
}
_STREET_KIND = {w: kind for kind, words in STREET_KINDS.items() for w in words}
# Given names in the genitive, as streets carry them.
GIVEN_NAMES = (
    "Андрія Анатолія Анни Антона Богдана Бориса Валентина Валерія Василя Віктора Віталія Володимира Галини Ганни Георгія Григорія Данила Дарини Дем'яна Дениса Дмитра Євгена Євгенії "
    "Жанни Захара Зінаїди Зої Ігоря Івана Ілька Ірини Катерини Кирила Клима Костянтина Лариси Левка Леоніда Лесі Лідії Любові Людмили Лук'яна Максима Марії Марка Марусі Миколи Михайла "
    "Назара Надії Наталії Нестора Никифора Оксани Олега Олександра Олексія Олени Олеся Ольги Ореста Остапа Павла Панаса Пантелеймона Петра Пилипа Платона Раїси Романа Руслана Світлани "
    "Святослава Семена Сергія Соломії Софії Станіслава Степана Тамари Тараса Тетяни Тимофія Уляни Федора Феодосія Філіпа Христини Цезаря Юлії Юрія Юхима Якова Ярослава"
)
_GIVEN = frozenset(word_key(w.lower()) for w in GIVEN_NAMES.split())
# Ordinal words (stem and endings) and Roman numerals.
_ORDINALS = {word_key(w): n for n, ws in {1: "перша перший перше", 2: "друга другий друге", 3: "третя третій третє", 4: "четверта четвертий четверте", 5: "п'ята п'ятий п'яте", 6: "шоста шостий шосте", 7: "сьома сьомий сьоме"}.items() for w in ws.split()}
_ORDINALS |= {word_key(w): n for n, ws in {1: "первая первый", 2: "вторая второй", 3: "третья третий", 4: "четвертая четвертый"}.items() for w in ws.split()}
_ROMAN = {"i": 1, "і": 1, "ii": 2, "іі": 2, "ii": 2, "iii": 3, "ііі": 3, "iv": 4, "іv": 4, "v": 5, "vi": 6, "vii": 7}
_NUMBERED = re.compile(r"([1-9][0-9]?)(?:-?[^\W\d_]{1,3})?")
_ENDS_IN_NUMBER = re.compile(r"(.*[^\W\d_])-([1-9][0-9]?)")
_SPACED = {ord(c): " " for c in ".,;:()«»\"“”„[]{}/\\|!?*#№_   \t\r\n–—"}
_ADJECTIVE = re.compile(r".*(?:(?:ск|цк|зк|ов|ев|н|т|р|х|л)(?:а|е|ии|и)|(?:широ|висо|глибо|дале)ка)")


class CityCell(NamedTuple):
    """kind; key: the name in the folded alphabet; hints: other words of the cell (region, district)."""

    kind: str
    key: str
    hints: tuple[str, ...]
    index: str


#: A kind written together with the name.
_GLUED = re.compile(r"\b(смт|пгт)(?=[А-ЯІЇЄҐ])")
_LEADING_INDEX = re.compile(r"\s*(\d{4,5})[\s,]+(?=\D)")
_PARENTHESIS = re.compile(r"\(([^)]*)\)?")
_token_key = Memo(word_key)


_WORD = re.compile(f"[^{re.escape(''.join(map(chr, _SPACED)))}\\s]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parse_city(cell: str) -> CityCell:
    """Kind, name and hints of a city cell; the key is empty if the cell names nothing."""
    index = ""
    if m := _LEADING_INDEX.match(cell):
        index, cell = m.group(1).zfill(5), cell[m.end() :]
    hints: list[str] = []
    cell = _GLUED.sub(r"\1 ", cell)
    if "(" in cell:
        for m in _PARENTHESIS.finditer(cell):
            hints += words(m.group(1))
        cell = _PARENTHESIS.sub(" ", cell)
    head, _, rest = cell.partition(",")
    if rest:
        hints += words(rest)
    near = bool(_CYRILLIC.search(cell.lower()))
    kind, name = "", []
    for w in words(head):
        k = _token_key[w] if near else word_key(w, False)
        if k in _CITY_KIND:
            kind = kind or _CITY_KIND[k]
        elif k in _CITY_FILL and not near:
            continue
        elif w.isdigit() and len(w) in (4, 5):
            index = index or w.zfill(5)
        elif any(c.isalpha() for c in k):
            name.append(k.replace("-", " "))
    return CityCell(kind, " ".join(name), tuple(_token_key[w] for w in hints), index)


class StreetName(NamedTuple):
    """kind ('' if not written), ord (0 if none), given ('' if none, one letter for an initial), main word."""

    kind: str
    ord: int
    given: str
    main: str


def parse_street(text: str) -> StreetName:
    """A street as written, without house number; main is empty if the text names none."""
    low = text.lower()
    near = bool(_CYRILLIC.search(low))
    kind, number, roman, names = "", 0, 0, []
    for w in _WORD.findall(low):
        k = _token_key[w] if near else word_key(w, False)
        if k in _STREET_KIND and not kind:
            kind = _STREET_KIND[k]
            continue
        if k in _ORDINALS:
            number = number or _ORDINALS[k]
            continue
        if w[0].isdigit():
            if m := _NUMBERED.fullmatch(w):
                number = number or int(m.group(1))
            continue
        if w in _ROMAN:
            roman = _ROMAN[w]
            if len(w) > 1:
                number = number or roman
                continue
        if w[-1].isdigit() and (m := _ENDS_IN_NUMBER.fullmatch(w)):
            number = number or int(m.group(2))
            k = _token_key[m.group(1)] if near else word_key(m.group(1), False)
        k = k.strip("-")
        if k:
            names.append(k)
    if len(names) == 1:
        return StreetName(kind, number, "", names[0])
    if not names:
        return StreetName(kind, number, "", "")
    known = [n for n in names if n in _GIVEN]
    short = [n for n in names if len(n) == 1]
    rest = [n for n in names if len(n) > 1 and n not in known] or known or names
    main = max(rest, key=len)
    others = [n for n in names if n is not main]
    given = known[0] if known and known[0] != main else short[0] if short else max(others, key=len)
    if roman and len(given) == 1 and not number and _ADJECTIVE.fullmatch(main) and given == word_key("і"):
        return StreetName(kind, roman, "", main)
    if len(given) > 1 and given not in _GIVEN and len(names) == 2 and not near_given(given):
        # Two unknown words: both belong to the name.
        return StreetName(kind, number, "", " ".join(sorted(names)))
    return StreetName(kind, number, _known_given[given], main)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours, or none, turns a into b."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    n = min(la, lb)
    while i < n and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b, each letter once; most + 1 if
    there are more than most."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    two, one = [0] * (lb + 1), list(range(lb + 1))
    for i in range(1, la + 1):
        row = [i] + [0] * lb
        ca = a[i - 1]
        for j in range(1, lb + 1):
            cb = b[j - 1]
            d = min(one[j - 1] + (ca != cb), one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, two[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[lb]


def _nearest_given(given: str) -> str:
    """The given name meant: itself if it is known or an initial, else the only one a typing error away."""
    if len(given) < 2 or given in _GIVEN:
        return given
    near = [g for g in _GIVEN if one_edit(given, g)]
    return near[0] if len(near) == 1 else given


_known_given = Memo(_nearest_given)
near_given = Memo(lambda g: any(one_edit(g, x) for x in _GIVEN)).__getitem__


_FORMER = re.compile(r"\(\s*(?:колишн\w*|стар\w* назва|кол|раніше|бивш\w*|бывш\w*|ex)?[\s.:]*([^)]*)\)|/\s*([^/\d][^/]*|\d-?[^\W\d][^/]*)/", re.I)


def split_former(cell: str) -> tuple[str, str]:
    """A street cell without the former name that it adds in brackets or between slashes, and that name."""
    if "(" not in cell and "/" not in cell:
        return cell, ""
    m = _FORMER.search(cell)
    if not m:
        return cell, ""
    return cell[: m.start()] + " " + cell[m.end() :], (m.group(1) or m.group(2) or "").strip()


# ---- house numbers

_LETTER = r"(?:\s?-?\s?([^\W\d_])(?![^\W_]))?"
_BLOCK = r"(?:[\s,-]*(?:корпус|корп|кор|к|korp|k)[\s.]*(\d+))?"
HOUSE = re.compile(rf"(?<![\d/])(\d{{1,4}}){_LETTER}(?:\s?/\s?(\d{{1,4}}){_LETTER})?{_BLOCK}(?!\d)")
_FLAT = re.compile(r"[\s,;]*(?<![^\W_])(?:кв|квартира|квар|оф|офіс|офис|прим|приміщення|пом|кімн|apt|kv|of)(?:\b|(?=\d))[\s.№]*\w*.*|[#№]\s*\d+.*", re.S)


def house_key(text: str) -> str:
    """Number, letter, fraction and block of a house number in one form; '' if there is none."""
    low = _FLAT.sub("", text.lower().replace(" ", " ")).strip()
    m = HOUSE.search(low)
    return _house(m) if m else ""


def _house(m: re.Match) -> str:
    number, letter, part, part_letter, block = m.groups()
    out = number.lstrip("0") or "0"
    if letter:
        out += word_key(letter.lower())
    if part:
        out += "/" + (part.lstrip("0") or "0") + (word_key(part_letter.lower()) if part_letter else "")
    if block:
        out += "к" + (block.lstrip("0") or "0")
    return out
