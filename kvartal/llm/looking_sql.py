"""SQL that pairs equal-looking texts: characters mapped one to one, composed by the checking engine's own normalization."""

from __future__ import annotations

import unicodedata

from kvartal.llm.lookalike import skeletons


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def equal_looking_sql() -> str:
    chars = [chr(i) for i in range(0x30000) if i not in (9, 10) and not (0x20 <= i < 0x7F or 0x3400 <= i <= 0x9FFF or 0xAC00 <= i <= 0xF8FF) and unicodedata.category(chr(i)) != "Cn"] + [chr(i) for i in range(0xE0100, 0xE01F0)]
    chars = [c for c in chars if c != "\0"]
    forms = list(zip(chars, skeletons(chars)))
    one, none = [(c, f) for c, f in forms if len(f) == 1 and f != c], [c for c, f in forms if not f]
    form = "nfc_normalize(text)"
    emoji = r"[\x{1f000}-\x{1ffff}\x{2600}-\x{27bf}\x{fe0f}]"
    # A joiner between two emoji stays, under another sign; twice, as neighbours share an emoji.
    for _ in range(2):
        form = rf"regexp_replace({form}, '({emoji})\x{{200d}}({emoji})', '\1{chr(0xE123)}\2', 'g')"
    for c, f in forms:
        if len(f) > 1 and (ord(c) < 0x600 or 0xFB00 <= ord(c) <= 0xFB06):
            form = f"replace({form}, {_quoted(c)}, {_quoted(f)})"
    form = f"nfc_normalize(translate({form}, {_quoted(''.join(c for c, _ in one) + ''.join(none))}, {_quoted(''.join(f for _, f in one))}))"
    seen = r"[^\s\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
    return f"""WITH f AS MATERIALIZED (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '{seen}')"""
