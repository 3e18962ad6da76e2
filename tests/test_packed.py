import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.operators import packed
from tests.conftest import rows


@pytest.mark.parametrize("text,values", [
    (None, []), ("", []), ("  ", []), (",,;|", []), ("A", ["A"]), ("A,B", ["A", "B"]), ("A ; B|C~D\tE\nF", list("ABCDEF")), ("A / B", ["A", "B"]),
    ("X A/C Service", ["X A/C Service"]), ('"Doe, J." / B', ["Doe, J.", "B"]), ("'Doe, J.';B", ["Doe, J.", "B"]), ("Doe\\, J., B", ["Doe, J.", "B"]),
    ('"A ""Ace"" B",C', ['A "Ace" B', "C"]), ("O'Neil's Bakery, B", ["O'Neil's Bakery", "B"]), ('"open, B', ['"open', "B"]), ("(Unknown),,B", ["(Unknown)", "B"]), ('"", B', ["B"]),
])
def test_segment(text, values):
    assert packed.segment(text) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ,;|~/\"\\'", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=5), st.sampled_from([",", ";", "|", "~", " / ", "\t"]))
def test_quoted_values_come_back(values, delimiter):
    quoted = ['"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values]
    assert packed.segment(delimiter.join(quoted)) == values


def test_known_value_keeps_its_delimiter():
    text = "Smith, John; Doe"
    assert packed.segment(text) == ["Smith", "John", "Doe"]
    assert packed.segment(text, [(0, 11)]) == ["Smith, John", "Doe"]
    assert packed.segment("A Smith, John B", [(2, 13)]) == ["A Smith", "John B"]


def _cells(spark, data):
    return spark.createDataFrame(data, "src string, row_id bigint, texts array<string>, val string, pos int")


def test_split_values_both_ways(spark):
    long = ";".join(f"n{i}" for i in range(3000))
    cells = _cells(spark, [("a", 1, ["Smith, John; Doe", None, ""], "x", 9), ("a", 1, ["B"], "x", 9), ("a", 2, None, None, None), ("b", 1, [], None, None), ("b", 2, ["Q", "R~S"], None, None), ("b", 3, [long], None, None)])
    words = spark.createDataFrame([("Smith, John",), ("Smith, John",), (None,), ("plain",), ("Other; One",), ("",)], "val string")
    by_automaton, by_join = packed.split_values(cells.where("not (src = 'a' and texts[0] = 'B')"), words), packed.split_values(cells.where("not (src = 'a' and texts[0] = 'B')"), words, limit=1)
    assert rows(by_automaton) == rows(by_join)
    got = [tuple(r) for r in rows(by_automaton) if r[1] != 3]
    assert got == [("a", 1, 1, "Smith, John"), ("a", 1, 2, "Doe"), ("b", 2, 1, "Q"), ("b", 2, 2, "R"), ("b", 2, 3, "S")]
    assert packed.several_values(by_automaton).where("src = 'b' and row_id = 3").count() == 3000


def test_empty_tables(spark):
    i = spark.createDataFrame([], "import_id bigint, contact_name string")
    u = spark.createDataFrame([], "entry_id bigint, contact_names array<string>")
    c = spark.createDataFrame([], "contact_id bigint, name string")
    assert packed.several_values(packed.packed_values(i, u, c)).count() == 0


def test_known_pieces_decide_the_cover(spark):
    """A known value with a delimiter stays whole, unless its pieces are known values themselves; both ways."""
    cells = _cells(spark, [("a", 1, ["Smith, John; Doe"], None, None), ("a", 2, ["Ann, Bob, Cy"], None, None), ("a", 3, ["Ann, Lee, Cy"], None, None), ("a", 4, ["Lee, Cy, Dan"], None, None)])
    words = spark.createDataFrame([("Smith, John",), ("Ann, Bob",), ("Ann",), ("Bob",), ("Ann, Lee",), ("Lee, Cy",)], "val string")
    want = [(1, 1, "Smith, John"), (1, 2, "Doe"), (2, 1, "Ann"), (2, 2, "Bob"), (2, 3, "Cy"), (3, 1, "Ann"), (3, 2, "Lee, Cy"), (4, 1, "Lee, Cy"), (4, 2, "Dan")]
    for limit in (100, 1):
        assert rows(packed.split_values(cells, words, limit=limit).select("row_id", "pos", "val")) == want
