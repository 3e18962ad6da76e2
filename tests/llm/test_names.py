import random

import pytest

from recordloom.llm import names
from tests.conftest import rows


@pytest.mark.parametrize("text,expected", [
    ("Ann Marlowe", (["ann", "marlowe"], [], [])), ("MARLOWE, Ann B.", (["marlowe", "ann"], ["b"], [])), ("Dr. Ánn_Marlowe (work)", (["ann", "marlowe"], [], [])), ("AnnMarlowe - home", (["ann", "marlowe"], [], [])), ('Ann "Ace" Marl.', (["ann"], [], ["marl"])),
    ("Marlowe's A/C Service Ltd.", (["marlowe", "a/c", "service"], [], [])), ("(Unknown)", ([], [], [])), ("null", ([], [], [])), ("", ([], [], [])), (None, ([], [], [])), ("李 小龙", (["小龙"], ["李"], [])),
])
def test_parse(text, expected):
    assert names.parse_name(text) == expected


def test_distance_against_brute_force():
    rnd = random.Random(1)

    def brute(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(2))
        assert min(names._distance(a, b, 2), 3) == min(brute(a, b), 3)


def test_prefix_filter_loses_no_single_error(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(5, 10))) for _ in range(60)]
    data, pairs = [(w, 10, 1) for w in set(words)], set()
    for w in set(words):
        i = rnd.randrange(len(w) - 1)
        e = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
        if e != w and e not in words:
            pairs.add((e, w))
    data += [(e, 1, 0) for e in {p[0] for p in pairs}]
    df = spark.createDataFrame(data, "token string, freq bigint, contacts bigint")
    assert pairs <= {(r.token, r.other) for r in names.similar_tokens(df).collect()}


def test_candidates_lose_no_two_errors_in_long_tokens(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdefghij") for _ in range(n)) for n in (9, 10, 12, 24, 25, 26, 27, 40) for _ in range(25)})

    def error(w):
        i = rnd.randrange(1, len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    pairs = {(e, w) for w in words for e in [error(error(w))] if e not in words and min(len(e), len(w)) >= 9 and names._distance(e, w, 2) == 2}
    data = [(w, 10, 1) for w in words] + [(e, 1, 0) for e in {p[0] for p in pairs}]
    got = names.similar_tokens(spark.createDataFrame(data, "token string, freq bigint, contacts bigint"))
    assert len(pairs) > 100 and pairs <= {(r.token, r.other) for r in got.collect()}


@pytest.mark.parametrize("short,long,expected", [("plbg", "plumbing", True), ("svc", "service", True), ("marl", "marlowe", True), ("ma", "marlowe", False), ("bakery", "bakery", False), ("bob", "robert", False)])
def test_abbreviations(short, long, expected):
    assert names.abbreviates(short, long) == expected


def tables(spark, contacts, imports, unprocessed=(), nicknames=(("Robert", "Bob"),)):
    return (
        spark.createDataFrame([(i, n, None, "x", "y") for i, n in contacts], "contact_id bigint, name string, numbers array<string>, val string, token string"),
        spark.createDataFrame([(i, n, "x", "y") for i, n in imports], "import_id bigint, contact_name string, val string, src string"),
        spark.createDataFrame(list(unprocessed), "entry_id bigint, contact_names array<string>"),
        spark.createDataFrame(list(nicknames), "given string, nick string"),
    )


def test_variants_are_linked_and_others_are_not(spark):
    rnd = random.Random(5)
    given, syllables = ["Robert", "Ann", "Clara", "Derek", "Edith", "Fiona", "Gordon", "Hilda", "Ivor", "Julia"], ["mar", "low", "tin", "bec", "dor", "fel", "gus", "hin", "jol", "kep", "nov", "pam", "quo", "rus", "sim", "tov"]
    surnames = sorted({"".join(rnd.sample(syllables, 3)).capitalize() for _ in range(80)})
    people = [(i, f"{given[i % 10]} {s}") for i, s in enumerate(surnames, 1)]
    n = len(people)
    shops = [(n + 1, "Zebrowin Bakery Limited"), (n + 2, "Zebrowin Bkry"), (n + 3, "Yaxonbur Bakery Limited")]
    who, g, s = people[9][0], *people[9][1].split()
    h, t = people[10][1].split()
    variants = [f"{s}, {g}", f"{s} {g[0]}.", f"Dr. {g} {s[:3] + s[4] + s[3] + s[5:]}", f"Bob {s}", f"{g.lower()} {s.lower()} (work)", f"{g} {s[:6]}."]
    strangers = [f"{h} Qqqzzzxxx", f"Hilda {s}", f"{given[3]} {t}", "(Unknown)", None, ""]
    imports = [(i, '"' + v + '"') for i, v in enumerate(variants, 1)] + [(100 + i, v) for i, v in enumerate(strangers)] + [(200, f"{g} {s}"), (201, "Yaxonbur Plumbing Limited"), (202, "zebrowin bakery")]
    got = rows(names.variant_records(*tables(spark, [*people, *shops], imports, [(1, [f"{s} {g}", None]), (2, None), (1, [f"{s} {g}", None])])))
    expected = [(who, "imports", i) for i in range(1, 7)] + [(who, "unprocessed", 1), (n + 1, "contacts", n + 2), (n + 1, "imports", 202)]
    assert got == sorted(expected)


def test_variants_under_a_surname_of_a_third_of_the_contacts(spark):
    rnd = random.Random(7)
    syllables = ["mar", "low", "tin", "bec", "dor", "fel", "gus", "hin", "jol", "kep", "nov", "pam", "quo", "rus", "sim", "tov"]
    given = ["Robert", "Zelda", "Wanda", "Clara", "Derek", "Edith", "Fiona", "Gordon", "Hilda", "Ivor", "Julia", "Karl", "Lorna", "Miles", "Nadia", "Oscar", "Pedro", "Quentin", "Rupert", "Selma"]
    surnames = sorted({"".join(rnd.sample(syllables, 3)).capitalize() for _ in range(140)})
    names_ = [f"{given[(i + k) % 20]} {s}" for i, s in enumerate(surnames) for k in (0, 7, 13)] + [f"{s} Plumbing" for s in surnames[:30]]
    names_ += [f"{g} Vandyke" for g in given] + [f"{g} {x}. Vandyke" for g in given[3:] for x in "ABDEGHKLMNOPST"] + ["Bob Gordon Vandyke"]
    at = {n: i for i, n in enumerate(names_, 1)}
    assert 3 * sum("Vandyke" in n for n in names_) > len(names_)
    linked = {
        "Bob Vandyke": "Robert Vandyke", "Vandyke, Robert": "Robert Vandyke", "Z. Vandyke": "Zelda Vandyke", "Vandyke W.": "Wanda Vandyke", "Zelda Vandy.": "Zelda Vandyke", "Wnd Vandyke": "Wanda Vandyke",
        "Zelda Plumbing Vandyke": "Zelda Vandyke", "Vandyke Zelda M.": "Zelda Vandyke", "Vandyke Hilda B.": "Hilda B. Vandyke", "Wanda Oscar Vandyke": None, "C. Vandyke": None, "Vandyke": None, "Zelda": None,
    }
    got = rows(names.variant_records(*tables(spark, list(enumerate(names_, 1)), [(i, f'"{v}"') for i, v in enumerate(linked, 1)])))
    assert {list(linked)[i - 1]: c for c, src, i in got if src == "imports"} == {v: at[n] for v, n in linked.items() if n}
    assert [(c, i) for c, src, i in got if src == "contacts" and i != c] == [(at["Robert Vandyke"], at["Bob Gordon Vandyke"])]


def test_empty_null_and_long(spark):
    assert names.variant_records(*tables(spark, [], [])).count() == 0
    assert names.variant_records(*tables(spark, [(1, None), (2, ""), (3, "A")], [(1, None), (2, "x" * 50_000), (3, " ".join(["word"] * 5000))])).count() == 0
