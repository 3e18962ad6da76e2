"""Minimum-cost error parse of call lines.

Every line is read by a small grammar (``csv`` or ``xml``) with dynamic programs
that insert and delete quotes and delimiters. A line that costs nothing and whose
values have the right types loads as a typed call; for every other line the edits
of its cheapest reading are the reason why it was refused:

* quotes first: a program of a few states (outside, in a bare value, in a quoted
  value, behind a closing quote) runs over the quotes and delimiters of the line
  and finds the fewest quotes to insert or delete;
* then delimiters: the pieces between them are aligned with the six fields, a
  delimiter inserted where a field is missing and deleted where there is one too
  many, so that as many values as possible have the type of their field. Two
  neighbouring pieces that only together are a value of their field (a readable
  date, a name with a comma) lack the pair of quotes around them.

Both programs are linear in the line. ``line_edits`` gives the edits themselves.
Lines that a regular expression recognises as free of cost skip the programs.

Each line is in exactly one output: ``refused_lines`` if it has a reason,
``valid_calls`` otherwise.

Defined cases: a null, empty or blank line has no field and is refused as
``columns``; an unknown ``form`` is parsed as csv unless the line starts with
``<``; an element with all six attributes whose end (``/>``, ``></call>``) is
missing or incomplete loads, as no field is affected; text between the attributes
or behind the end is a field too many; repeated lines are judged one by one;
further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

#: The fields of a call in file order.
CALL_FIELDS = ("number", "duration", "date", "type", "readable_date", "contact_name")
#: Largest duration (32 bits) and date (64 bits).
MAX_DURATION, MAX_DATE = 2**31 - 1, 2**63 - 1

#: Costs of the alignment: a pair of quotes that makes a value of its field, a delimiter, and a value that hasn't the type of its field.
PAIR_EDIT, DELIMITER_EDIT, WRONG_TYPE = 4, 12, 1
#: Delimiters of other dialects.
OTHER_DELIMITERS = ";|\t"

_CSV_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
_CSV_LINE = re.compile(",".join([f"({_CSV_FIELD})"] * 6))
_XML_ATTR = re.compile(r"""\s++([A-Za-z_][\w.-]*+)\s*+=\s*+("[^"]*+"|'[^']*+')""")
_XML_LINE = re.compile(rf"""\s*+<call(?:{_XML_ATTR.pattern})*+\s*+(?:/>|>\s*+</call>)\s*+""")
_READABLE = re.compile(r"^\s*[A-Z][a-z]{2,8} \d{1,2}, \d{4}( \d{1,2}:\d{2}(:\d{2})?( [AP]M)?)?\s*$")
_PACKED_NAME = re.compile(r"^[^,]*[^,\s], \S[^,]*$")
_NUMBER = re.compile(r"[-+0-9() .*#/]*[0-9][-+0-9() .*#/]*")
_WHOLE = re.compile(r"[+-]?[0-9]+")

Edit = tuple[str, int]


def bad_values(duration: str | None, date: str | None, kind: str | None) -> list[str]:
    """The names of the values that aren't valid."""

    def whole(text: str | None, low: int, high: int) -> bool:
        return bool(text) and re.fullmatch(r"[+-]?[0-9]+", text) is not None and low <= int(text) <= high

    return [
        *([] if whole(duration, 0, MAX_DURATION) else ["duration"]),
        *([] if whole(date, 1, MAX_DATE) else ["date"]),
        *([] if kind in ("1", "2", "3", "4") else ["type"]),
    ]


def _is_xml(form: str | None, line: str) -> bool:
    return form == "xml" or (form != "csv" and line.startswith("<"))


def zero_cost(form: str | None, line: str | None) -> tuple[str, ...] | None:
    """The six values in file order of a line that one regular expression accepts, else None."""
    if line is None:
        return None
    if _is_xml(form, line):
        if not _XML_LINE.fullmatch(line):
            return None
        return _named([(name, value[1:-1]) for name, value in _XML_ATTR.findall(line)])
    m = _CSV_LINE.fullmatch(line)
    return tuple(_plain(v) for v in m.groups()) if m else None


def _plain(written: str) -> str:
    return written[1:-1].replace('""', '"') if written[:1] == '"' else written


def _named(found: list[tuple[str, str]]) -> tuple[str, ...] | None:
    """The values in file order if each field is there exactly once and nothing else."""
    values = dict(found)
    if len(found) != 6 or len(values) != 6 or not all(f in values for f in CALL_FIELDS):
        return None
    return tuple(unescape(values[f]) if "&" in values[f] else values[f] for f in CALL_FIELDS)


class _Path:
    """The cheapest way to a state: its cost, fields so far and edits (a chain from the last one back)."""

    __slots__ = ("cost", "fields", "edits")

    def __init__(self, cost: int, fields: int, edits: tuple | None = None):
        self.cost, self.fields, self.edits = cost, fields, edits

    def edit(self, what: str, at: int) -> _Path:
        return _Path(self.cost + 1, self.fields, (what, at, self.edits))

    def field(self) -> _Path:
        return _Path(self.cost, self.fields + 1, self.edits)

    def __lt__(self, other: _Path) -> bool:
        return (self.cost, self.fields) < (other.cost, other.fields)


def _chain(edits: tuple | None) -> list[Edit]:
    out = []
    while edits is not None:
        out.append(edits[:2])
        edits = edits[2]
    return out[::-1]


def _csv_quotes(line: str, delimiter: str = ",") -> tuple[int, list[Edit]]:
    """(fields, quote edits) of the cheapest reading of a csv line when only quotes may be edited; of equally cheap ones the one nearest to six fields.

    Runs of other characters count as one step, so the program takes as many steps
    as the line has quotes and delimiters. Beyond seven fields only the fewest are kept.
    """
    Paths = dict[int, _Path]
    start: Paths = {1: _Path(0, 1)}
    bare: Paths = {}
    quoted: Paths = {}
    closed: Paths = {}

    def put(to: Paths, path: _Path) -> None:
        k = min(path.fields, 7)
        if k not in to or path < to[k]:
            to[k] = path

    for m in re.finditer(rf'"|{re.escape(delimiter)}|[^"{re.escape(delimiter)}]+', line):
        i, ch = m.start(), m.group()
        at0, in_bare, in_quoted, behind = Paths(), Paths(), Paths(), Paths()
        if ch == '"':
            for p in start.values():
                put(in_quoted, p)  # opens
                put(in_bare, p.edit("delete quote", i))
            for p in quoted.values():
                put(behind, p)  # closes, or is the first of a doubled pair
                put(in_quoted, p.edit("double quote", i))
            for p in closed.values():
                put(in_quoted, p)  # the second of a doubled pair
            for p in bare.values():
                put(in_bare, p.edit("delete quote", i))
        elif ch == delimiter:
            for paths in (start, bare, closed):
                for p in paths.values():
                    put(at0, p.field())
            for p in quoted.values():
                put(in_quoted, p)  # a delimiter inside quotes is text
                put(at0, p.edit("insert quote", i).field())
        else:
            for p in start.values():
                put(in_bare, p)
                put(in_quoted, p.edit("insert quote", i))
            for p in bare.values():
                put(in_bare, p)
            for p in quoted.values():
                put(in_quoted, p)
            for p in closed.values():
                put(in_quoted, p.edit("delete quote", i - 1))  # the closing quote was one too few
        start, bare, quoted, closed = at0, in_bare, in_quoted, behind
    ends = [p for paths in (start, bare, closed) for p in paths.values()] + [p.edit("insert quote", len(line)) for p in quoted.values()]
    best = min(ends, key=lambda p: (p.cost, abs(p.fields - 6)))
    return best.fields, _chain(best.edits)


def _pieces(line: str, delimiter: str = ",") -> list[tuple[int, str]]:
    """(start, text) of the fields of a line whose quotes are in order under ``delimiter``."""
    d = re.escape(delimiter)
    out, at = [], 0
    piece = re.compile(rf'"(?:[^"]|"")*+"|[^"{d}]*+')
    while True:
        m = piece.match(line, at)
        out.append((at, m.group()))
        if m.end() >= len(line):
            return out
        at = m.end() + 1


def _has_type(field: int, text: str) -> bool:
    text = _plain(text)
    if field == 0:
        return not text or _NUMBER.fullmatch(text) is not None
    if field in (1, 2, 3):
        low, high = ((0, MAX_DURATION), (1, MAX_DATE), (1, 4))[field - 1]
        return len(text) <= 40 and _WHOLE.fullmatch(text) is not None and low <= int(text) <= high
    return field == 5 or not text or _READABLE.match(text) is not None


def _align(pieces: list[tuple[int, str]]) -> list[Edit]:
    """The cheapest edits that make six fields of the pieces between the delimiters of a line."""
    n = len(pieces)
    before: list[tuple[int, tuple | None] | None] = [(0, None)] + [None] * 6
    behind: list = [None] * 7  # of one piece earlier
    for k in range(1, 7):  # fields without a piece at the beginning
        before[k] = (before[k - 1][0] + DELIMITER_EDIT, ("insert delimiter", pieces[0][0], before[k - 1][1]))
    for i, (at, text) in enumerate(pieces):
        now: list = [None] * 7
        paired = None
        if i and '"' not in text + pieces[i - 1][1] and text.startswith(" "):
            paired = pieces[i - 1][1] + "," + text
        for k in range(7):
            best = None
            if before[k] is not None and i:  # joined to the field before it
                best = (before[k][0] + DELIMITER_EDIT + (0 if not text or k == 6 else WRONG_TYPE), ("delete delimiter", at - 1, before[k][1]))
            if k and before[k - 1] is not None:
                cost = before[k - 1][0] + (0 if _has_type(k - 1, text) else WRONG_TYPE)
                if best is None or cost <= best[0]:
                    best = (cost, before[k - 1][1])
            if k >= 5 and paired and behind[k - 1] is not None and (_READABLE if k == 5 else _PACKED_NAME).match(paired):
                cost = behind[k - 1][0] + PAIR_EDIT
                if best is None or cost < best[0]:
                    best = (cost, ("insert pair of quotes", pieces[i - 1][0], behind[k - 1][1]))
            if k and now[k - 1] is not None and (best is None or now[k - 1][0] + DELIMITER_EDIT < best[0]):
                best = (now[k - 1][0] + DELIMITER_EDIT, ("insert delimiter", at + len(text), now[k - 1][1]))
            now[k] = best
        behind, before = before, now
    return _chain(before[6][1])


_XML_HEAD = re.compile(r"\s*+<?call(?![\w.-])")
_XML_EVENT = re.compile(r"""(?<![\w.-])(?P<name>[A-Za-z_][\w.-]*+)\s*+=\s*+|(?P<quote>["'])|(?P<end>/?>)|(?P<text>[^\s"'/>]++)""")
_XML_TAIL = re.compile(r"\s*+(?:<(?:/(?:c(?:a(?:l(?:l(?:\s*+>)?)?)?)?)?)?)?\s*+")
_DOUBLE, _SINGLE, _BARE = '"', "'", ""


class _Reading:
    """A reading of an element up to a place: quote edits, pieces of text of no attribute, and the chains of edits and attributes."""

    __slots__ = ("cost", "junk", "known", "edits", "attrs", "name", "start")

    def __init__(self, cost: int, junk: int, known: int, edits: tuple | None, attrs: tuple | None, name: str = "", start: int = 0):
        self.cost, self.junk, self.known, self.edits, self.attrs, self.name, self.start = cost, junk, known, edits, attrs, name, start

    def edit(self, what: str, at: int) -> _Reading:
        return _Reading(self.cost + 1, self.junk, self.known, (what, at, self.edits), self.attrs, self.name, self.start)

    def stray(self, quotes: int = 0) -> _Reading:
        return _Reading(self.cost + quotes, self.junk + 1, self.known, self.edits, self.attrs, self.name, self.start)

    def value_at(self, name: str, start: int) -> _Reading:
        return _Reading(self.cost, self.junk, self.known, self.edits, self.attrs, name, start)

    def closed(self, line: str, end: int) -> _Reading:
        return _Reading(self.cost, self.junk, self.known + (self.name in CALL_FIELDS), self.edits, (self.name, line[self.start : end], self.attrs))


def _least(*readings: _Reading | None) -> _Reading | None:
    return min((r for r in readings if r is not None), key=lambda r: (r.cost, r.junk, -r.known), default=None)


def _xml_quotes(line: str) -> tuple[list[tuple[str, str]], list[Edit], bool] | None:
    """(attributes as written, quote edits, is there text of no attribute?) of the cheapest reading of a call element; None: no call element.

    One pass over names, quotes and ends with five states: between attributes, behind
    an equals sign, and in a value of either kind of quote or of none. A value ends at
    its quote if a blank or the end of the element follows; it ends at the other
    quote, or where the next attribute or the end of the element begins, at the cost
    of an edit, and each of its quotes inside it costs one. Of equally many edits the
    reading with less text of no attribute counts, then the one with more attributes.
    """
    head = _XML_HEAD.match(line)
    if not head:
        return None
    behind_quotes = line.count('"', head.end()) + line.count("'", head.end())
    between: _Reading | None = _Reading(0, 0, 0, None, None)
    expected: _Reading | None = None
    values: dict[str, _Reading | None] = {_DOUBLE: None, _SINGLE: None, _BARE: None}
    ended: _Reading | None = None
    for m in _XML_EVENT.finditer(line, head.end()):
        kind, i = m.lastgroup, m.start()
        if expected is not None and not (kind == "quote" and i == expected.start):
            values[_BARE] = _least(values[_BARE], expected.edit("insert quote", expected.start))
            expected = None
        open_ = [r for r in values.values() if r is not None]
        if kind == "name":
            ways = [between, *(r.edit("insert quote", i).closed(line, len(line[:i].rstrip()) if i - r.start < 64 else i) for r in open_ if line[i - 1].isspace())]
            way = _least(*ways)
            between, expected = None, way and way.value_at(m.group(kind), m.end())
        elif kind == "quote":
            ch, behind_quotes = m.group(), behind_quotes - 1
            follows = line[i + 1 : i + 2]
            free = not follows or follows.isspace() or follows in "/>"
            ends = [between and between.edit("delete quote", i)]
            for q, r in values.items():
                if r is None:
                    continue
                if free:
                    ends.append((r if q in (ch, _BARE) else r.edit("replace quote", i)).closed(line, i))
                values[q] = r.edit("escape quote", i) if q in (ch, _BARE) else r
            if expected is not None:
                values[ch] = _least(values[ch], expected.value_at(expected.name, i + 1))
                expected = None
            between = _least(*ends)
        elif kind == "end":
            tail = _XML_TAIL.match(line, m.end()).end() == len(line)
            for way in (between, *(r.edit("insert quote", i).closed(line, i) for r in open_)):
                if way is not None:
                    ended = _least(ended, way if tail else way.stray(behind_quotes))
            between = between and between.stray()
        else:
            between = between and between.stray()
    size = len(line)
    if expected is not None:
        values[_BARE] = _least(values[_BARE], expected.edit("insert quote", expected.start))
    best = _least(ended, between, *(r.edit("insert quote", size).closed(line, size) for r in values.values() if r is not None))
    found, attrs = [], best.attrs
    while attrs is not None:
        found.append(attrs[:2])
        attrs = attrs[2]
    edits = _chain(best.edits) or ([("delete quote", size)] if best.cost else [])
    return found[::-1], edits, best.junk > 0


def parse_line(form: str | None, line: str | None) -> tuple[list[str], tuple[str, ...] | None, list[Edit]]:
    """(reasons, values in file order, edits) of a line; without a reason the values are those of a typed call."""
    values = zero_cost(form, line)
    if values:
        return bad_values(*values[1:4]), values, []
    if line is None or not line.strip():
        return ["columns"], None, [("insert delimiter", 0)] * 5
    if _is_xml(form, line):
        read = _xml_quotes(line)
        if read is None:
            return ["columns"], None, [("insert element", 0)]
        attributes, edits, stray = read
        if edits:
            return ["quoting"], None, edits
        values = _named(attributes)
        if stray or values is None:
            names = [name for name, _ in attributes]
            edits = [("delete text", len(line))] if stray else []
            edits += [(f"insert {f}", len(line)) for f in CALL_FIELDS if f not in names]
            edits += [(f"delete {n}", k) for k, n in enumerate(names) if n not in CALL_FIELDS or n in names[:k]]
            return ["columns"], None, edits
        return bad_values(*values[1:4]), values, []
    edits = _csv_quotes(line)[1]
    # a line whose quotes are in order under another delimiter has the wrong delimiter
    for d in (d for d in OTHER_DELIMITERS if line.count(d) >= 5):
        if _csv_quotes(line, d) == (6, []):
            return ["columns"], None, [(f"replace {d!r}", at - 1) for at, _ in _pieces(line, d)[1:]]
    if edits:
        return ["quoting"], None, edits
    edits = _align(_pieces(line))
    return ["quoting" if any(what == "insert pair of quotes" for what, _ in edits) else "columns"], None, edits


def line_reason(form: str | None, line: str | None) -> str:
    """``quoting``, ``columns`` or an empty text for a line with right quotes and columns."""
    reasons = parse_line(form, line)[0]
    return reasons[0] if reasons and reasons[0] in ("quoting", "columns") else ""


def valid_calls(lines: DataFrame) -> DataFrame:
    """The lines without a reason as typed calls: line_id, device_id, file_name and the six fields."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line, device, file, form, raw in batch.itertuples(index=False, name=None):
                reasons, v, _ = parse_line(form, raw)
                if not reasons:
                    rows.append((line, device, file, v[0], int(v[1]), int(v[2]), int(v[3]), v[4], v[5]))
            out = pd.DataFrame(rows, columns=["line_id", "device_id", "file_name", *CALL_FIELDS])
            yield out.astype({"line_id": "int64", "duration": "int32", "date": "int64", "type": "int32"}).assign(device_id=out["device_id"].astype("Int32"))

    schema = "line_id bigint, device_id int, file_name string, number string, duration int, date bigint, type int, readable_date string, contact_name string"
    return lines.select("line_id", "device_id", "file_name", "form", "raw_line").mapInPandas(load, schema)


def refused_lines(lines: DataFrame) -> DataFrame:
    """One row per refused line and reason: line_id, reason."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, reasons = [], []
            for i, form, raw in zip(batch["line_id"], batch["form"], batch["raw_line"]):
                for r in parse_line(form, raw)[0]:
                    ids.append(i)
                    reasons.append(r)
            yield pd.DataFrame({"line_id": pd.Series(ids, dtype="int64"), "reason": pd.Series(reasons, dtype="object")})

    return lines.select("line_id", "form", "raw_line").mapInPandas(judge, "line_id bigint, reason string")


def line_edits(lines: DataFrame) -> DataFrame:
    """line_id, edits, cost of the refused lines: the operations (with their place in the line) that make a row of six fields; a line refused for its values only has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, form, raw in zip(batch["line_id"], batch["form"], batch["raw_line"]):
                reasons, _, edits = parse_line(form, raw)
                if reasons:
                    rows.append((i, [f"{what} at {at}" for what, at in edits], len(edits)))
            out = pd.DataFrame(rows, columns=["line_id", "edits", "cost"])
            yield out.astype({"line_id": "int64", "cost": "int32"})

    return lines.select("line_id", "form", "raw_line").mapInPandas(run, "line_id bigint, edits array<string>, cost int")
