import random
import re

import pytest

from recordloom.operators import lineparse as L
from tests.conftest import rows

GOOD = '5551234567,12,1415054053956,1,"Nov 3, 2014 5:34:13 PM",Jane Doe'
XML = '<call number="5551234567" duration="12" date="1415054053956" type="1" readable_date="Nov 3, 2014 5:34:13 PM" contact_name="Jane &quot;J&quot; Doe" />'


@pytest.mark.parametrize("form,line,reasons", [
    ("csv", GOOD, []), ("xml", XML, []), ("xml", XML.replace(" />", "></call>").replace('"', "'"), []), ("csv", GOOD.replace("Jane Doe", '"Jane ""J"" Doe"'), []), ("csv", GOOD.replace("Jane Doe", ""), []),
    ("csv", GOOD.replace('PM"', "PM"), ["quoting"]), ("csv", GOOD.replace('"Nov', "Nov"), ["quoting"]), ("csv", GOOD.replace('"', ""), ["quoting"]), ("csv", GOOD.replace("Jane Doe", '"Jane "J" Doe"'), ["quoting"]), ("csv", GOOD.replace("Jane Doe", '"Jane'), ["quoting"]),
    ("csv", GOOD + ",", ["columns"]), ("csv", GOOD.replace("12,", "", 1), ["columns"]), ("csv", GOOD.replace(",12,", ",12,x,"), ["columns"]), ("csv", GOOD.replace(",", ";"), ["columns"]), ("csv", "", ["columns"]), ("csv", None, ["columns"]), ("csv", "   ", ["columns"]),
    ("csv", GOOD.replace(",12,", ",-1,").replace(",1,", ",9,"), ["duration", "type"]), ("csv", GOOD.replace("1415054053956", "12/16/23"), ["date"]), ("csv", GOOD.replace(",12,", ",2147483648,"), ["duration"]), ("csv", GOOD.replace("1415054053956", "9223372036854775808"), ["date"]), ("csv", GOOD.replace(",12,", ", 12,"), ["duration"]),
    ("xml", XML.replace('"12"', "12"), ["quoting"]), ("xml", XML.replace('"12"', '"12'), ["quoting"]), ("xml", XML.replace('"12"', "\"12'"), ["quoting"]), ("xml", XML[:55], ["quoting"]), ("xml", XML.replace("&quot;J&quot;", '"J"'), ["quoting"]),
    ("xml", XML.replace('type="1" ', ""), ["columns"]), ("xml", XML.replace('type="1"', 'type="1" type="1"'), ["columns"]), ("xml", XML.replace("type=", "types="), ["columns"]), ("xml", '<call number="1" ', ["columns"]), ("xml", "", ["columns"]),
    ("xml", XML.replace('type="1"', 'type="missed"'), ["type"]), ("xml", XML.replace('date="1415054053956"', 'date="0"'), ["date"]), (None, XML, []), (None, GOOD, []),
])
def test_reasons(spark, form, line, reasons):
    df = spark.createDataFrame([(1, form, line)], "line_id bigint, form string, raw_line string")
    assert sorted(r.reason for r in L.refused_lines(df).collect()) == sorted(reasons)


def test_valid_calls_are_typed_and_nothing_is_lost(spark):
    data = [(1, 7, "f", "csv", GOOD, "x"), (2, None, None, "xml", XML, "x"), (2, None, None, "xml", XML, "x"), (3, 1, "f", "csv", None, None), (4, 1, "f", "xml", "<call " + "a=" * 50_000, None), (5, 1, "f", "csv", '"' * 100_001, None)]
    df = spark.createDataFrame(data, "line_id bigint, device_id int, file_name string, form string, raw_line string, reason string")
    valid = L.valid_calls(df)
    assert rows(valid.select("line_id", "number", "duration", "date", "type", "contact_name")) == [(1, "5551234567", 12, 1415054053956, 1, "Jane Doe"), *[(2, "5551234567", 12, 1415054053956, 1, 'Jane "J" Doe')] * 2]
    refused = L.refused_lines(df).select("line_id").distinct()
    assert valid.select("line_id").distinct().count() + refused.count() == 5
    empty = df.limit(0)
    assert L.valid_calls(empty).count() == 0 and L.refused_lines(empty).count() == 0


def test_every_line_is_in_exactly_one_output(spark):
    """Lines with random characters deleted, inserted, doubled and exchanged, and ends of elements in every state."""
    rng = random.Random(5)
    lines = [(f, t) for t in (XML[:-3], XML[:-3] + ">", XML[:-3] + " /", XML[:-3] + "/> x", XML[:-3] + "></call", XML + XML, XML[:-1], XML[:-2]) for f in ("xml", None)]
    lines += [("xml", XML[:-3] + ' contact_name="a "b ' + "=" * n + '" />') for n in (150, 200, 5000)]
    for _ in range(3000):
        form = rng.choice(("xml", "csv"))
        t = list(GOOD if form == "csv" else rng.choice((XML, XML.replace('"', "'"))))
        for _ in range(rng.randint(1, 4)):
            if not t:
                break
            at = rng.randrange(len(t))
            how = rng.randrange(4)
            if how == 0:
                del t[at]
            elif how == 1:
                t.insert(at, rng.choice("\"',;=<>/ \n\\ax0"))
            elif how == 2:
                t[at] = t[at] * 2
            else:
                t = t[: max(1, at)]
        lines.append((form, "".join(t)))
    df = spark.createDataFrame([(i, 1, "f", f, t) for i, (f, t) in enumerate(lines)], "line_id bigint, device_id int, file_name string, form string, raw_line string")
    valid = [r.line_id for r in L.valid_calls(df).collect()]
    refused = {r.line_id for r in L.refused_lines(df).collect()}
    assert len(valid) == len(set(valid)) and not refused & set(valid)
    assert refused | set(valid) == set(range(len(lines)))
    edits = {r.line_id: r for r in L.line_edits(df).collect()}
    assert set(edits) == refused
    for r in L.refused_lines(df).where("reason in ('quoting', 'columns')").collect():
        assert edits[r.line_id].cost > 0, lines[r.line_id]


@pytest.mark.parametrize("form,line,edits", [
    ("csv", GOOD.replace('PM"', "PM"), [f"insert quote at {GOOD.index('PM') + 2}"]), ("csv", GOOD + ",", [f"delete delimiter at {len(GOOD)}"]), ("csv", GOOD.replace("12,", "", 1), [f"insert delimiter at {GOOD.index(',')}"]),
    ("csv", GOOD.replace('"', ""), [f"insert pair of quotes at {GOOD.index('Nov') - 1}"]), ("xml", XML.replace('"12"', "\"12'"), [f"replace quote at {XML.index('duration=') + 12}"]), ("csv", GOOD.replace(",12,", ",-1,"), []),
])
def test_edits_are_the_reason(spark, form, line, edits):
    df = spark.createDataFrame([(1, form, line)], "line_id bigint, form string, raw_line string")
    (row,) = L.line_edits(df).collect()
    assert row.edits == edits and row.cost == len(edits)


@pytest.mark.parametrize("form,line,kinds", [
    ("csv", GOOD.replace("Jane Doe", '"Jane "J" Doe"'), {"double quote"}), ("csv", GOOD.replace('"', "").replace(",", ";").replace("3; ", "3, "), {"replace ';'"}), ("xml", XML.replace('type="1" ', ""), {"insert type"}), ("xml", XML.replace("type=", "types="), {"insert type", "delete types"}),
])
def test_kinds_of_edits(form, line, kinds):
    assert {what for what, _ in L.parse_line(form, line)[2]} == kinds


def test_quote_program_is_minimal():
    """The program over quotes against a search of all single and double edits on short lines."""

    def in_order(t):
        return re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', t) is not None

    def edited(t):
        return {t[:i] + t[i + 1 :] for i in range(len(t)) if t[i] == '"'} | {t[:i] + '"' + t[i:] for i in range(len(t) + 1)}

    rng = random.Random(9)
    for _ in range(400):
        t = "".join(rng.choice('"",,ab ') for _ in range(rng.randint(1, 9)))
        cost, seen = 0, {t}
        while not any(in_order(x) for x in seen):
            seen, cost = {y for x in seen for y in edited(x)}, cost + 1
        assert len(L._csv_quotes(t)[1]) == cost, t
