"""Problem 9: text that looks the same but is written with other characters.

A batch of texts is exploded to one array of positioned code points. Mapping tables, built by rule from the
character database and from the list of look-alikes below, and of fixed size, are joined to it by code point:
decompositions, full-width forms, non-breaking spaces, ligatures, hyphens and apostrophes of one shape,
look-alike letters, and characters that are not displayed. Combining marks are then ordered by class and
recomposed with their base, and the texts rebuilt. The result, the skeleton, is equal for texts that look
equal. consistent() gives it back in the script of its words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.session import checkpointed, spread

# Cyrillic, Greek and Armenian letters and the Latin letter of the same shape.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS"))
RARE_CYRILLIC_LATIN = dict(zip("ӏѵԌԚԜӀѴҮ", "lvGQWIVY"))
GREEK_LATIN = dict(zip("ονραυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovpaucjABEZHIKMNOPTYXCJ"))
ARMENIAN_LATIN = dict(zip("օոսհցզյՏՕՍԼ", "onuhgqjSOUL"))
SAME_LETTER = CYRILLIC_LATIN | RARE_CYRILLIC_LATIN | GREEK_LATIN | ARMENIAN_LATIN
#: Roman numerals that are written as letters.
_NUMERALS = range(0x2160, 0x2180)
# Hyphens of one shape, and apostrophes of one shape.
SAME_SHAPE = {"‐": "-", "‑": "-", "ʼ": "’"}
_FOLDED_KINDS = ("<wide>", "<narrow>", "<noBreak>")
_LIGATURES = range(0xFB00, 0xFB07)
_ZWJ = 0x200D
_LIMIT = 0x110000


def _hidden(c: str) -> bool:
    """Characters without display: format and control characters, variation selectors."""
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\n\t" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF


def _expand(c: str) -> str:
    """What a character is compared as, marks apart."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return c  # syllables stay whole
    if kind in _FOLDED_KINDS or ord(c) in _LIGATURES or ord(c) in _NUMERALS:
        out = unicodedata.normalize("NFKD", c)
    else:
        out = unicodedata.normalize("NFD", c)
    return "".join(SAME_SHAPE.get(x, SAME_LETTER.get(x, x)) for x in out if not _hidden(x))


class Tables:
    """one: replacement of code points by one other; DROP, or a number below zero that names a sequence."""

    DROP = -1

    def __init__(self):
        self.one = np.arange(_LIMIT, dtype=np.int32)
        self.cls = np.zeros(_LIMIT, np.uint8)
        #: Second characters of compositions, without class.
        self.second = np.zeros(_LIMIT, bool)
        self.pairs: dict[tuple[int, int], int] = {}
        sequences: list[list[int]] = []
        for i in range(_LIMIT):
            if 0x3400 <= i <= 0x9FFF or 0xAC00 <= i <= 0xDFFF or 0xE000 <= i <= 0xF8FF or 0x20000 <= i < 0x2F800 or 0x30000 <= i < 0xE0000 or i >= 0xE0200:
                continue
            c = chr(i)
            self.cls[i] = unicodedata.combining(c)
            if unicodedata.category(c) == "Cn":
                continue
            out = _expand(c) if not _hidden(c) else ""
            if out == c:
                continue
            if len(out) == 1:
                self.one[i] = ord(out)
            elif not out:
                self.one[i] = self.DROP
            else:
                self.one[i] = -2 - len(sequences)
                sequences.append([ord(x) for x in out])
            parts = unicodedata.normalize("NFD", c)
            if not unicodedata.decomposition(c).startswith("<") and len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
                a, b = unicodedata.normalize("NFC", parts[:-1]), parts[-1]
                if len(a) == 1:
                    self.pairs[ord(a), ord(b)] = i
                    if not unicodedata.combining(b):
                        self.second[ord(b)] = True
        self.second[0x1161:0x1176] = True
        self.second[0x11A8:0x11C3] = True
        self.lengths = np.array([len(s) for s in sequences] or [0])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if sequences else np.zeros(1, int)
        self.flat = np.array([x for s in sequences for x in s] or [0], np.int32)

    def compose(self, a: int, b: int) -> int | None:
        if 0x1100 <= a < 0x1113 and 0x1161 <= b < 0x1176:
            return 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
        if 0xAC00 <= a <= 0xD7A3 and (a - 0xAC00) % 28 == 0 and 0x11A8 <= b < 0x11C3:
            return a + b - 0x11A7
        return self.pairs.get((a, b))


@cache
def tables() -> Tables:
    return Tables()


def _emoji(cp: np.ndarray) -> np.ndarray:
    return (cp >= 0x1F000) & (cp < 0x20000) | (cp >= 0x2600) & (cp <= 0x27BF) | (cp == 0xFE0F)


def _order_and_compose(run: list[int], t: Tables) -> list[int]:
    """A base with its marks: marks sorted by class, composed where nothing of their class stands between."""
    out: list[int] = []
    i, n = 0, len(run)
    while i < n:
        j = i + 1
        if t.cls[run[i]]:
            while j < n and t.cls[run[j]]:
                j += 1
            out += sorted(run[i:j], key=lambda c: t.cls[c])
        else:
            out.append(run[i])
        i = j
    base, done, last = -1, [], 0
    for c in out:
        k = int(t.cls[c])
        if base >= 0 and (last < k or last == 0 and base == len(done) - 1) and (x := t.compose(done[base], c)) is not None:
            done[base] = x
            continue
        if k == 0:
            base, last = len(done), 0
        else:
            last = k
        done.append(c)
    return done


def skeletons(texts: list[str]) -> list[str]:
    """The common form of each text."""
    t = tables()
    sizes = np.array([len(x) for x in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    if not len(cp):
        return list(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    new = t.one[cp]
    # A joiner between two emoji shows as one picture and stays.
    joiner = np.flatnonzero(cp == _ZWJ)
    joiner = joiner[(joiner > 0) & (joiner < len(cp) - 1)]
    joiner = joiner[_emoji(cp[joiner - 1]) & _emoji(cp[joiner + 1]) & (doc[joiner - 1] == doc[joiner + 1])]
    new[joiner] = _ZWJ
    if (new < -1).any():
        count = np.where(new >= 0, 1, 0)
        many = new < -1
        count[many] = t.lengths[-2 - new[many]]
        at = np.repeat(np.arange(len(new)), count)
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        source = new[at]
        some = source < -1
        codes = source.copy()
        codes[some] = t.flat[t.starts[-2 - source[some]] + within[some]]
        doc = doc[at]
    else:
        keep = new >= 0
        codes, doc = new[keep], doc[keep]
    # Runs of a base and what follows it as marks are reordered and composed one by one; they are rare.
    follows = (t.cls[codes] > 0) | t.second[codes]
    if len(codes):
        follows[1:] &= doc[1:] == doc[:-1]
    if follows.any():
        at = np.flatnonzero(follows)
        first = at[np.concatenate([[True], np.diff(at) > 1])]
        last = at[np.concatenate([np.diff(at) > 1, [True]])]
        parts, docs, done = [], [], 0
        for a, b in zip(first.tolist(), last.tolist()):
            start = a - 1 if a > 0 and doc[a - 1] == doc[a] else a
            start = max(start, done)
            composed = _order_and_compose(codes[start : b + 1].tolist(), t)
            parts += [codes[done:start], np.array(composed, np.int32)]
            docs += [doc[done:start], np.full(len(composed), doc[a])]
            done = b + 1
        codes, doc = np.concatenate([*parts, codes[done:]]), np.concatenate([*docs, doc[done:]])
    ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


_BACK = {v: k for k, v in CYRILLIC_LATIN.items()}


@cache
def _patterns():
    import re

    word = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
    either = frozenset(_BACK)
    return word, either


def consistent(skeleton: str) -> str:
    """A skeleton with each word in one script: Cyrillic if the word has letters that only Cyrillic has, Latin
    if it has letters that only Latin has, else as most words of the text. A function of the skeleton, so
    texts that look equal stay equal."""
    word, either = _patterns()
    skeleton = unicodedata.normalize("NFD", skeleton)
    found = [(m, {"c" if "Ѐ" <= c <= "ԯ" else "l" if "A" <= c <= "ɏ" and c not in either else "" for c in m.group()}) for m in word.finditer(skeleton)]
    cyrillic = sum("c" in s for _, s in found) >= max(1, sum("l" in s and "c" not in s for _, s in found))
    out, at = [], 0
    for m, s in found:
        out.append(skeleton[at : m.start()])
        w, at = m.group(), m.end()
        out.append("".join(_BACK.get(c, c) for c in w) if "c" in s or cyrillic and "l" not in s else w)
    out.append(skeleton[at:])
    return unicodedata.normalize("NFC", "".join(out))


def _mapped(df: DataFrame, key: str, text: str, f, spread_out: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                texts = c.column(1).to_pylist()
                some = skeletons([x or "" for x in texts])
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([None if x is None else f(y) for x, y in zip(texts, some)], pa.string())], names=["_key", "_text", "_form"])

    own = df.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    return (spread(own, "_key") if spread_out else own).mapInArrow(run, "_key bigint, _text string, _form string")


def consistent_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: every text in the consistent form; NULL stays NULL, empty stays empty."""
    return _mapped(df, key, text, consistent).select(F.col("_key").alias(key), F.col("_form").alias("text"))


def equal_looking(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key_a, key_b (key_a < key_b): rows whose texts differ in characters but have one skeleton.

    Identical texts make no pair; NULL, empty and blank texts none either. Copies of a text are one class:
    classes are paired, and only then replaced by their members, so a text with any number of copies is
    never paired with itself.
    """
    mapped = _mapped(df, key, text, lambda s: s)
    shown = mapped.where(F.col("_form").rlike(r"(?U)\S")).select("_key", F.md5(F.col("_text")).alias("_text"), F.md5(F.col("_form")).alias("_form"))
    members = checkpointed(shown)
    classes = members.groupBy("_form", "_text").agg(F.lit(1).alias("one"))
    several = classes.groupBy("_form").agg(F.count("*").alias("n")).where("n > 1").select("_form")
    kept = members.join(several, "_form")
    texts = classes.join(several, "_form").select("_form", "_text")
    a, b = texts.select("_form", F.col("_text").alias("_a")), texts.select("_form", F.col("_text").alias("_b"))
    pairs = a.join(b, "_form").where("_a < _b")
    left = kept.select("_form", F.col("_text").alias("_a"), F.col("_key").alias("_x"))
    right = kept.select("_form", F.col("_text").alias("_b"), F.col("_key").alias("_y"))
    out = pairs.join(left, ["_form", "_a"]).join(right, ["_form", "_b"])
    return out.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"))
