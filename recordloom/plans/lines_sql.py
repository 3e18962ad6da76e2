"""The SQL of the valid call lines."""

from __future__ import annotations

from recordloom.operators.lineparse import CALL_FIELDS

_CSV = "^" + ",".join(['("(?:[^"]|"")*"|[^",]*)'] * 6) + "$"
_ATTR = r"\s+([A-Za-z_][A-Za-z0-9_.-]*)\s*=\s*(" + '"[^"]*"' + "|''[^'']*'')"
_UNQUOTE = """CASE WHEN {0} LIKE '"%' THEN replace(substr({0}, 2, length({0}) - 2), '""', '"') ELSE {0} END"""
_PLAIN = """replace(replace(replace(replace(replace(replace({0}, '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


def valid_lines() -> str:
    """The lines that a regular expression accepts whole and whose values are valid."""
    csv = ", ".join(f"regexp_extract(raw_line, '{_CSV}', {i}) AS {f}" for i, f in enumerate(CALL_FIELDS, 1))
    one = lambda f: f"v[list_position(n, '{f}')]"
    xml = ", ".join(_PLAIN.format(f"substr({one(f)}, 2, length({one(f)}) - 2)") + f" AS {f}" for f in CALL_FIELDS)
    element = rf"\s*<call({_ATTR})*\s*(/>|>\s*</call>)\s*"
    rows = f"""SELECT line_id, device_id, file_name, {", ".join(_UNQUOTE.format(f) + f" AS {f}" for f in CALL_FIELDS)} FROM (SELECT line_id, device_id, file_name, {csv} FROM call_lines WHERE form = 'csv' AND regexp_matches(raw_line, '{_CSV}'))
      UNION ALL SELECT line_id, device_id, file_name, {xml} FROM (SELECT *, regexp_extract_all(raw_line, '{_ATTR}', 1) AS n, regexp_extract_all(raw_line, '{_ATTR}', 2) AS v FROM call_lines
        WHERE form = 'xml' AND regexp_full_match(raw_line, '{element}')) WHERE list_sort(n) = {sorted(CALL_FIELDS)}"""
    return f"""SELECT line_id, device_id, file_name, number, TRY_CAST(duration AS INTEGER) AS duration, TRY_CAST(date AS BIGINT) AS date, TRY_CAST(type AS INTEGER) AS type, readable_date, contact_name FROM ({rows})
      WHERE regexp_full_match(duration, '[+-]?[0-9]+') AND TRY_CAST(duration AS HUGEINT) BETWEEN 0 AND 2147483647 AND regexp_full_match(date, '[+-]?[0-9]+') AND TRY_CAST(date AS HUGEINT) BETWEEN 1 AND 9223372036854775807 AND type IN ('1','2','3','4')"""
