"""SQL of the queries of the general problems."""

from __future__ import annotations

_FIELD = '(?:"(?:[^"]|"")*"|[^";]*)'


def _bare(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _nth(n: int) -> str:
    return f"regexp_extract(line, '(?s)^(?:{_FIELD};){{{n}}}({_FIELD})(?:;|$)', 1)"


def _unquoted(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '\"') THEN {x}[2:-2] ELSE {x} END"


_MASKED = """regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g')"""
_NUMBER = r"[1-9][0-9]{0,3}(-?\p{L})?(/[0-9]{1,4}\p{L}?)?( корп\. [0-9]+)?"
P1_FOUND = f"""WITH l AS (SELECT raw_id, coalesce(line, '') AS line FROM magistral_raw WHERE line_no IS DISTINCT FROM 1),
    f AS (SELECT raw_id, regexp_full_match(line, '(?s){_FIELD}(?:;{_FIELD})*') AS quoted, length({_MASKED}) - length(replace({_MASKED}, ';', '')) AS cuts, {_nth(5)} AS i, {_nth(7)} AS b FROM l),
    g AS (SELECT raw_id, quoted, cuts, {_bare(_unquoted('i'))} AS i, {_unquoted('b')} AS b FROM f),
    r AS (SELECT raw_id, CASE WHEN NOT quoted THEN 'quoting' WHEN cuts <> 13 THEN 'column_count' WHEN NOT regexp_full_match(i, '([0-9]{{4,5}})?') THEN 'city_index'
        WHEN len(list_filter(list_transform(string_split(translate(b, ';', ','), ','), lambda p: {_bare('p')}), lambda p: p <> '' AND NOT regexp_full_match(p, '{_NUMBER}'))) > 0 THEN 'buildings' ELSE '' END AS reason FROM g)
    SELECT raw_id, reason FROM r WHERE reason <> ''"""

_NAMES = "region old_district new_district otg city city_index street buildings sort_center_1 sort_center_2 delivery_district tech_index features not_working".split()
_CONTENT = ", ".join(f"""replace({_unquoted(f'(CASE WHEN true THEN {_nth(i)} END)')}, '""', '"') AS {n}""" for i, n in enumerate(_NAMES))
P1_VALID = P1_FOUND.replace("SELECT raw_id, reason FROM r WHERE reason <> ''", f"SELECT l.raw_id, {_CONTENT} FROM l JOIN r ON l.raw_id = r.raw_id WHERE reason = ''")

# The first broken field: of the leading fields, the number at which they stop to be well-formed; the first missing or surplus one; or the
# invalid one itself, which the reason names.
_HOLDS = "list_filter(range(0, 14), lambda k: NOT regexp_matches(line, '(?s)^(?:{f};){{' || k || '}}{f}(?:;|$)'))".format(f=_FIELD)
P1_FIELDS = P1_FOUND.replace(
    "SELECT raw_id, reason FROM r WHERE reason <> ''",
    f"""SELECT r.raw_id, reason, CAST(CASE reason WHEN 'quoting' THEN coalesce(({_HOLDS})[1] + 1, 15) WHEN 'column_count' THEN least(cuts + 1, 14) + 1 WHEN 'city_index' THEN 6 ELSE 8 END AS INTEGER) AS field_no
    FROM r JOIN l ON r.raw_id = l.raw_id JOIN f ON r.raw_id = f.raw_id WHERE reason <> ''""",
)


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def orphans(child: str, row_key: str, ref: str, parent: str, key: str) -> str:
    gone = "NULL" if parent == "districts" else "removed_at"
    return f"""SELECT '{child}' AS table_name, CAST(row_key AS VARCHAR) AS row_key, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.born > c.cached_at THEN 'late' WHEN p.gone <= c.cached_at THEN 'deleted' END AS reason, strftime(c.cached_at, '%Y-%m') AS period
        FROM (SELECT cached_at, {row_key} AS row_key, {_trim(ref)} AS ref FROM (SELECT DISTINCT * FROM {child})) c
        LEFT JOIN (SELECT {_trim(key)} AS id, min(cached_at) AS born, CASE WHEN count({gone}) = count(*) THEN max({gone}) END AS gone FROM {parent} GROUP BY 1) p ON c.ref = p.id
        WHERE c.ref <> '' AND (p.id IS NULL OR p.born > c.cached_at OR p.gone <= c.cached_at)"""


_L = "A-Za-zÀ-ɏЀ-ԯ"
P6_FOUND = rf"""WITH c AS (SELECT record_id, list_filter(list_transform(regexp_extract_all(buildings, '"[^"]*"|''[^'']*''|[0-9]+[{_L}]?(?:[/-](?:[0-9]+[{_L}]?|[{_L}]))*(?: [A-ZЀ-ЯҐ])?'), lambda x: trim(regexp_replace(x, '^["'']|["'']$', '', 'g'))), lambda x: regexp_matches(x, '^[0-9]')) AS v
    FROM magistral WHERE regexp_matches(buildings, '[0-9]')) SELECT record_id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS pos, unnest(v) AS building FROM c"""
