"""Dictionary-guided segmentation of fields that hold several values.

A cell is cut at delimiters that no quote or escape protects. A multi-pattern
automaton over the known whole values finds the places where one of them is written
out; a dynamic program then picks the cheapest cover of the cell, in which an
unknown piece costs most, a known value with a delimiter inside less and a known
piece least. So a known value that stands between two boundaries keeps its inner
delimiters, unless all of its pieces are known values as well.

Only known values with a delimiter and those that equal a piece of one can change a
cover, so the automaton holds no others. It travels to the tasks only up to
``BROADCAST_ROWS`` values and ``DICTIONARY_CHARS`` characters (checked by an
aggregate). Beyond that the pieces and spans of the cells are joined with the
dictionary, which gives the same result.

Defined cases: null cells and null or blank elements hold no value; an empty
piece takes no position; a quote that isn't closed before a delimiter is text;
repeated rows give their values again under their own row_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import BROADCAST_ROWS, small_enough

#: Characters that separate values; a slash does so only between blanks.
DELIMITERS = ",;|~\t\n\r"
_QUOTES = "\"'"
HAS_DELIMITER = r"[,;|~\t\n\r/]"
#: Costs of a cover: an unknown piece, a known value with a delimiter inside, a known piece.
UNKNOWN, KNOWN_SPAN, KNOWN_PIECE = 1.0, 0.5, 0.25
#: Characters of the dictionary that travels to the tasks.
DICTIONARY_CHARS = 4_000_000


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """(value, end) of the quoted value that begins at ``at``, if a delimiter or the end follows its closing quote."""
    quote, out, i, n = text[at], [], at + 1, len(text)
    while i < n:
        ch = text[i]
        if ch == "\\" and i + 1 < n and (text[i + 1] in DELIMITERS or text[i + 1] in _QUOTES or text[i + 1] == "\\"):
            out.append(text[i + 1])
            i += 2
        elif ch == quote:
            if quote == '"' and text[i + 1 : i + 2] == '"':
                out.append('"')
                i += 2
                continue
            j = i + 1
            while j < n and text[j] == " ":
                j += 1
            if j >= n or text[j] in DELIMITERS or _slash(text, j):
                return "".join(out), j
            if quote == '"':
                return None
            out.append(ch)  # an apostrophe inside single quotes
            i += 1
        else:
            out.append(ch)
            i += 1
    return None


def _slash(text: str, i: int) -> bool:
    return text[i : i + 1] == "/" and (i == 0 or text[i - 1].isspace()) and (i + 1 >= len(text) or text[i + 1].isspace())


def _pieces(text: str) -> list[tuple[int, int, str, bool]]:
    """Pieces between unprotected delimiters: (start, end, value, protected by quotes or escapes?)."""
    out, i, n = [], 0, len(text)
    while True:
        start, j = i, i
        while j < n and text[j] == " ":
            j += 1
        if j < n and text[j] in _QUOTES and (found := _quoted(text, j)):
            value, i = found
            out.append((start, i, value, True))
        else:
            chars, escaped = [], False
            while i < n and text[i] not in DELIMITERS and not _slash(text, i):
                if text[i] == "\\" and i + 1 < n and (text[i + 1] in DELIMITERS or text[i + 1] in "\\/" or text[i + 1] in _QUOTES):
                    i += 1
                    escaped = True
                chars.append(text[i])
                i += 1
            out.append((start, i, "".join(chars), escaped))
        if i >= n:
            return out
        i += 1


def spans(text: str, widest: int) -> Iterable[tuple[int, int, str]]:
    """Runs of one to ``widest`` neighbouring bare pieces as written, if there are two at all: (first piece, last piece, text)."""
    pieces = _pieces(text)
    for a in range(len(pieces) if len(pieces) > 1 else 0):
        for b in range(a, min(len(pieces), a + widest)):
            if pieces[b][3] or pieces[a][3]:
                break
            yield a, b, text[pieces[a][0] : pieces[b][1]].strip()


def segment(text: str | None, known_at: list[tuple[int, int]] | None = None) -> list[str]:
    """Values of one cell in order. ``known_at``: character ranges at which a known value is written."""
    if text is None:
        return []
    pieces = _pieces(text)
    if not known_at or len(pieces) < 2:
        return [v for _, _, value, _ in pieces if (v := value.strip())]
    ranges = set(known_at)
    bounds = []
    for start, end, _, kept in pieces:
        raw = text[start:end]
        bounds.append((start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip()), kept))
    # cost[i]: of the cheapest cover of the pieces from i on
    n = len(pieces)
    cost, step = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        own = 0.0 if not pieces[i][2].strip() else KNOWN_PIECE if (bounds[i][0], bounds[i][1]) in ranges else UNKNOWN
        cost[i], step[i] = own + cost[i + 1], 1
        for j in range(i + 1, n):
            if bounds[i][2] or bounds[j][2]:
                break
            if (bounds[i][0], bounds[j][1]) in ranges and cost[j + 1] + KNOWN_SPAN < cost[i]:
                cost[i], step[i] = cost[j + 1] + KNOWN_SPAN, j - i + 1
    out, i = [], 0
    while i < n:
        value = pieces[i][2] if step[i] == 1 else text[pieces[i][0] : pieces[i + step[i] - 1][1]]
        if value.strip():
            out.append(value.strip())
        i += step[i]
    return out


def _automaton(words: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, len(w))
    machine.make_automaton()
    return machine


def split_values(cells: DataFrame, dictionary: DataFrame, *, limit: int = BROADCAST_ROWS, least: int = 1) -> DataFrame:
    """Values of packed fields: src, row_id, pos, val.

    cells: src string, row_id bigint, texts array<string> (the elements of one field);
    dictionary: val string (known whole values). Every field with ``least`` values or
    more gives all its values, ``pos`` counting over its elements from 1.
    """
    cells = cells.select("src", "row_id", "texts")
    known_values = dictionary.select(F.trim("val").alias("val")).where(F.length("val") > 0).distinct()
    spanning = known_values.where(F.col("val").rlike(HAS_DELIMITER))
    parts = spanning.select(F.explode(F.split("val", HAS_DELIMITER)).alias("val")).select(F.trim("val").alias("val")).distinct()
    words = spanning.unionByName(known_values.where(~F.col("val").rlike(HAS_DELIMITER)).join(parts, "val", "left_semi"))
    schema = "src string, row_id bigint, pos bigint, val string"

    def emit(batch: pd.DataFrame, values_of) -> pd.DataFrame:
        src, row, pos, val = [], [], [], []
        for s, r, texts, *rest in batch.itertuples(index=False, name=None):
            values = [v for i, text in enumerate(texts if texts is not None else ()) for v in values_of(i, text, *rest)]
            if len(values) < least:
                continue
            src += [s] * len(values)
            row += [r] * len(values)
            pos += range(1, len(values) + 1)
            val += values
        return pd.DataFrame({"src": pd.Series(src, dtype="object"), "row_id": pd.Series(row, dtype="int64"), "pos": pd.Series(pos, dtype="int64"), "val": pd.Series(val, dtype="object")})

    if small_enough(words, limit) and (words.agg(F.sum(F.length("val"))).first()[0] or 0) <= DICTIONARY_CHARS:
        known = [r[0] for r in words.limit(limit).collect()]  # at most ``limit`` rows, checked above

        def by_automaton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = _automaton(known) if known else None

            def values_of(_: int, text: str | None) -> list[str]:
                if not text or machine is None:
                    return segment(text)
                return segment(text, [(end - size + 1, end + 1) for end, size in machine.iter(text)])

            for batch in batches:
                yield emit(batch, values_of)

        return cells.mapInPandas(by_automaton, schema)

    widest = int(words.select(F.max(F.length(F.regexp_replace("val", r"[^,;|~\t\n\r/]", "")))).first()[0]) + 1

    def all_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (s, r, i, a, b, t)
                for s, r, texts in batch.itertuples(index=False, name=None)
                for i, text in enumerate(texts if texts is not None else ())
                if text
                for a, b, t in spans(text, widest)
            ]
            yield pd.DataFrame(rows, columns=["src", "row_id", "element", "first", "last", "val"]).astype({"row_id": "int64", "element": "int32", "first": "int32", "last": "int32"})

    hits = (
        cells.mapInPandas(all_spans, "src string, row_id bigint, element int, first int, last int, val string")
        .join(words, "val", "left_semi")
        .groupBy("src", "row_id")
        .agg(F.collect_list(F.struct("element", "first", "last")).alias("hits"))
    )

    def by_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def values_of(i: int, text: str | None, found) -> list[str]:
            if not text or found is None:
                return segment(text)
            pieces, ranges = _pieces(text), []
            for h in found:
                if h["element"] == i:
                    raw = text[pieces[h["first"]][0] : pieces[h["last"]][1]]
                    begin = pieces[h["first"]][0] + len(raw) - len(raw.lstrip())
                    ranges.append((begin, begin + len(raw.strip())))
            return segment(text, ranges)

        for batch in batches:
            yield emit(batch, values_of)

    return cells.join(hits, ["src", "row_id"], "left").select("src", "row_id", "texts", "hits").mapInPandas(by_join, schema)


def packed_values(imports: DataFrame, unprocessed: DataFrame, contacts: DataFrame, *, limit: int = BROADCAST_ROWS, least: int = 1) -> DataFrame:
    """Values of ``imports.contact_name`` and ``unprocessed.contact_names``: src, row_id, pos, val; of fields with ``least`` values or more."""
    cells = imports.select(F.lit("imports").alias("src"), F.col("import_id").alias("row_id"), F.array("contact_name").alias("texts")).unionByName(
        unprocessed.select(F.lit("unprocessed").alias("src"), F.col("entry_id").alias("row_id"), F.col("contact_names").alias("texts"))
    )
    return split_values(cells, contacts.select(F.col("name").alias("val")), limit=limit, least=least)


def several_values(values: DataFrame) -> DataFrame:
    """The fields of ``split_values`` that hold two or more values."""
    several = values.where(F.col("pos") == 2).select("src", "row_id")
    return values.join(several, ["src", "row_id"], "left_semi")
