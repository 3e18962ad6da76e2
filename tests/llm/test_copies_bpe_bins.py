import collections
import random

import pytest

from recordloom.llm import bins, bpe, copies
from tests.conftest import rows

tokenizers = pytest.importorskip("tokenizers")


def dump(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts, 1)], "dump_id bigint, record_text string, key string, id string, n int")


def test_copies(spark):
    texts = [
        'number="+1 555" date="1,600" duration="5" type="Voice mail"', "<call TYPE='voicemail' Duration=' 5 ' DATE='1600' NUMBER='1-555' />", '{date: "1600"; number: "1555"; type: "VoiceMail."; duration: "5"}', 'number="1555" date="1600" duration="6" type="voicemail"',
        'number="1555" date="1600" duration="5" type="4"', None, None, "", "", "no fields", "No  fields!", 'number="1555"', 'Number: "1555;"', 'number="15" date="551600" duration="5" type="voicemail"',
    ]
    assert rows(copies.found(dump(spark, texts))) == [(1, 3), (8, 2), (10, 2), (12, 2)]
    assert copies.found(dump(spark, [])).count() == 0


def test_copies_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(3000):
        fields = [("number", str(rnd.randint(1, 9) * 1111)), ("date", str(rnd.randint(1, 4))), ("duration", str(rnd.randint(0, 3))), ("type", rnd.choice(["1", "Incoming"]))]
        rnd.shuffle(fields)
        texts.append(rnd.choice([" ", ", ", "\t"]).join(f'{rnd.choice([k, k.upper()])}{rnd.choice(["=", ": "])}"{rnd.choice(["", " "])}{rnd.choice([v, v.lower()])}{rnd.choice(["", "."])}"' for k, v in fields) if rnd.random() < 0.7 else 'number="7" date="7" duration="7" type="7"')
    import re

    want = collections.defaultdict(list)
    for i, t in enumerate(texts, 1):
        found = {k.lower(): re.sub(r"\W", "", v).lower() for k, v in re.findall(r'(\w+)[=:] ?"([^"]*)"', t)}
        want[tuple(sorted(found.items()))].append(i)
    expected = sorted((min(v), len(v)) for v in want.values() if len(v) > 1)
    assert rows(copies.found(dump(spark, texts).repartition(7))) == expected


def reference():
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefgh eéß漢字🙂\n\t 0123'\".,<|>") for _ in range(rnd.randint(1, 80))) for _ in range(2000)]
    texts += ["", " ", "a" * 20_000, "ab" * 5000, "<|endoftext|>", "it's  we'll\r\n\r\n  x", "\u00a0\u2003x", "\U0001f469\u200d\U0001f467", "x" * 3 + " " * 999]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(10**6, None, None)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.token_ids(df).collect()}
    want = [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want and got[10**6] == [] and got[texts.index("")] == []
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()}
    assert all(counts[k] == len(v) for k, v in got.items())
    assert bpe.token_ids(df.limit(0)).count() == 0


def test_every_token_encodes_to_itself():
    import numpy as np

    enc = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    merged = np.flatnonzero(enc.rank)
    words = {}
    for i in range(enc.size):
        words[i] = words[int(enc.left[i])] + words[int(enc.right[i])] if enc.rank[i] else bytes([enc.byte_ids.index(i)])
    assert all(enc.exact(words[int(i)]) == [int(i)] for i in merged)


def check(patterns, counts, capacity):
    used = collections.Counter()
    for contents, n in patterns:
        assert sum(contents) <= capacity and n > 0
        for s in contents:
            used[s] += n
    assert used == collections.Counter({s: n for s, n in counts.items() if n})


def test_packing_is_valid_and_near_the_bound():
    rnd = random.Random(2)
    for trial in range(30):
        counts = collections.Counter(rnd.randint(1, 100) for _ in range(rnd.randint(1, 200)))
        p = bins.pack(counts, 100, 2000)
        check(p, counts, 100)
        n = sum(k for _, k in p)
        assert bins.lower_bound(counts, 100) <= n <= sum(k for _, k in bins.best_fit(counts, 100))
    assert bins.pack({}, 100) == [] and bins.pack({100: 7}, 100) == [((100,), 7)]


def test_search_beats_best_fit_on_small_cases():
    rnd = random.Random(7)
    better = 0
    for _ in range(40):
        counts = collections.Counter(rnd.randint(20, 70) for _ in range(30))
        better += sum(k for _, k in bins.best_fit(counts, 100)) - sum(k for _, k in bins.pack(counts, 100, 5000))
    assert better > 0


def test_containers(spark):
    rnd = random.Random(5)
    texts = [" ".join(["word"] * rnd.choice([1, 5, 5, 5, 5, 40, 700, 1500, 3000])) for _ in range(300)] + ["", None, " "]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(7, texts[7], 1, 2)], "doc_id bigint, text string, tokens int, piece int")
    got = bins.fill_containers(df, capacity=1024).collect()
    size = {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()}
    load, pieces = collections.Counter(), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        if r.container_id is not None:
            load[r.container_id] += r.tokens
    assert set(pieces) == set(size) and max(load.values()) <= 1024
    for d, p in pieces.items():
        times = 2 if d == 7 else 1
        assert sum(r.tokens for r in p) == times * size[d] and (len(p) == times if size[d] <= 1024 else all(r.tokens == 1024 or r.piece == max(x.piece for x in p) for r in p))
        assert all((r.container_id is None) == (size[d] == 0) for r in p)
    counts = collections.Counter(r.tokens for r in got if r.tokens)
    assert len(load) <= bins.lower_bound(counts, 1024) + 1
    assert bins.fill_containers(df.limit(0)).count() == 0
