import random

import pytest

from recordloom.llm import truncation
from tests.conftest import rows

WORDS = "parcel bakery harbour lantern window garden market bicycle library kitchen weather mountain station theatre picture blanket".split()
PLACES = "near behind beside under above".split()


def sentence(rnd):
    a, b, c = rnd.sample(WORDS, 3)
    return rnd.choice([f"The {a} was left {rnd.choice(PLACES)} the {b} on Monday", f"Please bring the {a} and the {b} before noon", f"We saw a {c} that nobody could repair yesterday"])


def corpus(seed, n=3000):
    """(doc_id, text, is it cut?)"""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text = ". ".join(sentence(rnd) for _ in range(rnd.randint(1, 5))) + rnd.choice([".", ".", "!", "", ". cheers", " ok", ". :)"])
        cut = rnd.random() < 0.15
        if cut:
            at = rnd.randrange(10, len(text))
            words = text[:at]
            cut = not any(words.rstrip().endswith(e) for e in (".", "!", "Monday", "noon", "yesterday", ":)", "cheers", "ok", ":"))
            text = words
        out.append((i, text, cut))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "sms", 0, 1) for i, t, *_ in data], "doc_id bigint, text string, lang string, source string, h1 int, key int")


def test_planted_cuts_are_found(spark):
    data = corpus(1)
    got = {r.doc_id for r in truncation.found(frame(spark, data)).collect()}
    want = {i for i, _, c in data if c}
    hit = len(got & want)
    assert hit / len(want) > 0.95 and hit / len(got) > 0.9


def test_repetition_does_not_hide_a_cut(spark):
    data = corpus(2, 1500)
    text = "Please bring the lantern and the gar"
    many = [(10_000 + i, text) for i in range(700)]
    got = {r.doc_id for r in truncation.found(frame(spark, [*data, *many])).collect()}
    assert all(i in got for i, _ in many)


def test_defined_cases(spark):
    data = [*corpus(3, 800), (9001, None), (9002, ""), (9003, " \n\t "), (9004, "Please bring the par�"), (9005, "x" * 60_000), (9006, "Please bring the parcel and the garden before noon. " * 2000)]
    df = frame(spark, data)
    got = {r.doc_id for r in truncation.found(df).collect()}
    assert not got & {9001, 9002, 9003, 9006} and 9004 in got
    share = truncation.shares(df).collect()
    assert len(share) == 1 and share[0]["documents"] == len(data) and share[0]["cut_documents"] == len(got)
    assert truncation.found(df.limit(0)).count() == 0 and truncation.shares(df.limit(0)).count() == 0


def test_null_columns(spark):
    df = spark.createDataFrame([(1, "The parcel was", None, None), (2, "The parcel was left", None, None), (None, None, None, None)], "doc_id bigint, text string, lang string, source string")
    truncation.found(df).count()
    assert rows(truncation.shares(df).select("documents")) == [(3,)]


@pytest.mark.parametrize("text,tokens", [("Call 555-1234.", ["Call", "000-0000", "."]), ("a b\n\nc", ["a", "b", "\n", "c"]), ("", []), ("J. Doe", ["J.", "Doe"]), ("電話です。", list("電話です。"))])
def test_tokens(text, tokens):
    assert truncation.tokens_of(text)[0] == tokens
