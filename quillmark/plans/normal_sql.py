"""The normalization of names and addresses as DuckDB SQL, in steps of its own: without lookaround, parts of an address as rows."""

from __future__ import annotations

from quillmark.functions import tables as T

_DIGITS = "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"
_HOUSE = r"(?:^|[^a-z0-9])([0-9]+)([a-z])?(?:\s*-\s*([0-9]+))?(?:[^a-z0-9]|$)"


def _case(column: str, entries: dict[str, str], other: str) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in entries.items())} ELSE {other} END"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _lower(column: str) -> str:
    for a, b in T.DIGRAPHS.items():
        column = f"replace({column}, '{a}', '{b}')"
    return f"lower(translate({column}, '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'))"


def _unquoted(column: str) -> str:
    """Twice, as the letter that must follow is taken into the match."""
    once = rf"regexp_replace({column}, '\b[ld]''([a-z])', '\1', 'g')"
    return rf"translate(regexp_replace({once}, '\b[ld]''([a-z])', '\1', 'g'), '''`', '')"


def _undotted(column: str) -> str:
    """A sign that no text holds takes the place of a dot, so that a letter between two dots is met again."""
    once = rf"regexp_replace({column}, '\b([a-z])\.([a-z])\b', '\1' || chr(1) || '\2', 'g')"
    return rf"replace(regexp_replace({once}, '\b([a-z])\.([a-z])\b', '\1' || chr(1) || '\2', 'g'), chr(1), '')"


def _squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '[^a-z0-9]+', ' ', 'g'))"


_PHRASED = _squeezed(_undotted(_unquoted(rf"replace(regexp_replace({_lower('business_name')}, '\bm/s\b', ' ', 'g'), '&', ' and ')")))
for _a, _b in T.NAME_PHRASES.items():
    _PHRASED = rf"regexp_replace({_PHRASED}, '\b{_a}\b', '{_b}', 'g')"

_TOKEN = f"CASE WHEN regexp_matches(t, '^[0-9]+$') THEN {_DIGITS.format('t')} WHEN i = 1 AND len(ws) > 1 AND list_contains({_list(T.PART_START)}, t) THEN {_case('t', T.PART_START, 't')} WHEN list_contains({_list(T.STREET_TYPES)}, t) THEN {_case('t', T.STREET_TYPES, 't')} WHEN i = len(ws) AND i > 1 AND list_contains({_list(T.STREET_END_ONLY)}, t) THEN {_case('t', T.STREET_END_ONLY, 't')} ELSE {_case('t', T.ORDINALS, 't')} END"
_CUES = "|".join(T.LANDMARK_CUES)
_KEEP = f"list_filter(string_split({{0}}, ' '), lambda t: t <> '' AND NOT list_contains({_list(T.ADDRESS_DROP)}, t))"
_SPLIT = "list_filter(string_split({0}, ' '), lambda t: t <> '')"

#: The nine views of `rec`, by key.
NORMAL = rf"""
WITH n1 AS (SELECT key, country, src, array_to_string(list_transform(string_split({_PHRASED}, ' '), lambda t: {_case('t', T.NAME_TOKENS, 't')}), ' ') AS name_ascii, {_unquoted(_lower('business_address'))} AS low FROM rec),
n2 AS (SELECT *, {_SPLIT.format('name_ascii')} AS ws, list_filter({_SPLIT.format('name_ascii')}, lambda t: NOT list_contains({_list(T.NAME_STOPWORDS)}, t)) AS fewer, regexp_replace(low, '((?:^|[^a-z0-9]))[0-9]+[a-z]?(?:\s*-\s*[0-9]+)?([^a-z0-9]|$)', '\1x#\2') AS blank, regexp_extract(low, '{_HOUSE}', 1) AS h1, regexp_extract(low, '{_HOUSE}', 2) AS h2, regexp_extract(low, '{_HOUSE}', 3) AS h3 FROM n1),
n3 AS (SELECT *, list_filter(fewer, lambda t: NOT list_contains({_list(T.LEGAL_FORMS)}, t)) AS core FROM n2),
a1 AS (SELECT key, unnest(string_split(low, ',')) AS part, generate_subscripts(string_split(low, ','), 1) AS pos FROM n1),
a2 AS (SELECT key, pos, {_SPLIT.format(_squeezed('part'))} AS ws FROM a1),
a3 AS (SELECT key, pos, ' ' || array_to_string(list_transform(ws, lambda t, i: {_TOKEN}), ' ') || ' ' AS line FROM a2),
a4 AS (SELECT *, regexp_matches(line, ' ({_CUES}) ') AS marked, regexp_extract(line, '^(.*?) (?:{_CUES}) ', 1) AS front FROM a3),
a5 AS (SELECT key, pos, {_KEEP.format('line')} AS kept, list_filter({_KEEP.format('CASE WHEN marked THEN front ELSE line END')}, lambda t: NOT list_contains({_list(T.ADDRESS_DESIGNATORS)}, t)) AS head, CASE WHEN marked THEN array_to_string({_KEEP.format('substr(line, length(front) + 1)')}, ' ') END AS mark FROM a4),
a6 AS (SELECT key, array_to_string(flatten(list(kept ORDER BY pos)), ' ') AS address_norm, array_to_string(flatten(list(head ORDER BY pos)), ' ') AS address_core, coalesce(string_agg(mark, ' ' ORDER BY pos), '') AS landmark FROM a5 WHERE len(kept) > 0 GROUP BY key)
SELECT n3.key, country, src, name_ascii, array_to_string(CASE WHEN len(core) > 0 THEN core WHEN len(fewer) > 0 THEN fewer ELSE ws END, ' ') AS name_core,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(ws, lambda t: list_contains({_list(T.LEGAL_FORMS)}, t)), lambda t: {_case('t', T.LEGAL_FORMS, 't')}))), ' ') AS legal_form,
  coalesce(address_norm, '') AS address_norm, coalesce(address_core, '') AS address_core, coalesce(landmark, '') AS landmark,
  CASE WHEN h1 = '' THEN '' ELSE {_DIGITS.format('h1')} || h2 || CASE WHEN h3 <> '' THEN '-' || {_DIGITS.format('h3')} ELSE '' END END AS house_no,
  regexp_extract(blank, '(?s)^(?:.*[^0-9])?([0-9]{{5,6}})(?:[^0-9]|$)', 1) AS postal,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(low, '[0-9]+'), lambda t: {_DIGITS.format('t')}))), ' ') AS numbers
FROM n3 LEFT JOIN a6 ON n3.key = a6.key"""
