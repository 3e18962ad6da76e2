import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import history, survivor
from tests.conftest import rows

SCHEMA = "call_id bigint, batch_no int, device_id int, received_at timestamp, number string, duration string, date string, type string, readable_date string, contact_name string, num string, cell string, first string, n string, block string"


def calls(spark, data):
    full = [(*d, *[None] * (10 - len(d)), "c", "l", "a", "s", "h") for d in data]
    return spark.createDataFrame(full, SCHEMA)


def brute_classes(data):
    """call_id -> class by comparing all pairs."""
    usable = []
    for d in data:
        n = "".join(c for c in d[4] or "" if c.isdigit()) if d[4] and not any(c.isalpha() for c in d[4]) else ""
        n = n[2:] if n.startswith("00") else n
        n = n[1:] if len(n) == 11 and n[0] == "1" else n
        ms, dur = (d[6] or "").strip(), (d[5] or "").strip()
        if len(n) >= 3 and ms.isdigit() and int(ms) > 0 and dur.isdigit():
            usable.append((d[0], d[1], n, int(ms), int(dur)))
    parent = list(range(len(usable)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(usable):
        for j, b in enumerate(usable[:i]):
            if a[2] == b[2] and abs(a[3] - b[3]) <= 2000 and abs(a[4] - b[4]) <= 2:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    classes = {}
    for i, u in enumerate(usable):
        classes.setdefault(root(i), []).append(u)
    return list(classes.values())


def random_calls(seed, n=400, span=60_000):
    rnd = random.Random(seed)
    forms = ["{0}", "+1{0}", "1{0}", "001{0}", "(555) 000-{1}", " {0} "]
    out = []
    for i in range(n):
        k = rnd.randint(1000, 1003)
        number = rnd.choice([*forms * 5, "", None, "-", "Private 555"])
        number = number and number.format(f"555000{k}", k)
        date = str(1_600_000_000_000 - 86_400_000 // 2 + rnd.randint(0, span)) if rnd.random() < 0.95 else rnd.choice(["0", "", None, "x"])
        out.append((i + 1, min(6, i * 7 // n), 1, None, number, rnd.choice([str(rnd.randint(0, 20)), f" {rnd.randint(0, 20)} ", None]), date, "1", None, None))
    return out


@pytest.mark.parametrize("seed,block,margin", [(1, history.BLOCK_CELLS, history.MARGIN_CELLS), (2, 5, 2), (3, 4, 1)])
def test_classes_equal_brute_force(spark, seed, block, margin):
    data = random_calls(seed)
    usable = history.usable_calls(calls(spark, data), "batch_no")
    labels = history.class_labels(usable, True, block, margin)
    got = {r.call_id: r.first_call_id for r in usable.join(labels, ["num", "cell", "dur"]).collect()}
    want = {u[0]: min(x[0] for x in c) for c in brute_classes(data) if len(c) > 1 for u in c}
    assert got == want


def test_found_equals_brute_force(spark):
    data = random_calls(4, span=200_000)
    want = sorted((min(x[0] for x in c), u[0]) for c in brute_classes(data) for u in c if u[1] >= 1 and min(x[1] for x in c) < u[1])
    assert rows(history.found(calls(spark, data))) == want and want


def test_exact_limits_and_repetitions(spark):
    base = 1_600_000_000_000
    data = [(1, 0, 1, None, "5551234567", "10", str(base)), (2, 1, 1, None, "+15551234567", "12", str(base + 2000)), (3, 1, 1, None, "5551234567", "10", str(base - 2001)), (4, 1, 1, None, "5551234567", "13", str(base)), (5, 2, 1, None, "0015551234567", "10", str(base)), (5, 2, 1, None, "0015551234567", "10", str(base))]
    # 4 joins by way of 2, whose duration is 12
    assert rows(history.found(calls(spark, data))) == [(1, 2), (1, 4), (1, 5), (1, 5)]


def test_long_chain_is_one_class(spark):
    base = 1_600_000_000_000
    data = [(i, 0 if i == 0 else 1, 1, None, "5551234567", "10", str(base + 1900 * i)) for i in range(60)]
    usable = history.usable_calls(calls(spark, data), "batch_no")
    labels = history.class_labels(usable, True, block=6, margin=2)
    assert labels.select("first_call_id", "members").distinct().collect() == [(0, 60)]


def test_empty_and_nulls(spark):
    empty = calls(spark, [])
    devices = spark.createDataFrame([], "device_id int, trust int")
    assert history.found(empty).count() == 0 and survivor.survivors(empty, devices).count() == 0
    nulls = calls(spark, [(None, None, None, None, None, None, None), (1, 1, None, None, "x" * 50_000, "9" * 5000, "9" * 5000), (2, 1, None, None, "5" * 500, "1", "1600000000000"), (3, 2, None, None, "5" * 500, "1", "1600000000000")])
    assert rows(history.found(nulls)) == [(2, 3)]


def test_persisted_history_equals_one_pass(spark, tmp_path):
    data = random_calls(5, span=200_000)
    df = calls(spark, data)
    h, got = history.History(spark, f"file://{tmp_path}/index"), []
    for k in range(7):
        batch = df.where(F.col("batch_no") == k)
        if k:
            # a repetition of an earlier batch; those within the batch itself don't count
            got += [r.call_id for r in h.repeats(batch).collect()]
        h.accept(batch)
    assert sorted(got) == sorted(r.call_id for r in history.found(df).collect())
    assert len(h.segments()) <= 4
    sizes = [n for _, n in h.segments()]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_survivors(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2020, 1, d)
    n, d, r = "5551234567", "1600000000000", "Sep 13, 2020 12:26:40 PM"
    data = [
        (1, 0, 1, at(5), n, "1", d, "1", "Sep 13", "Ann Le"), (2, 0, 2, at(1), n, "1", d, "1", r, "Ann Lee"), (3, 0, 3, at(9), n, "1", d, "1", r, "Ann L…"), (4, 0, 2, at(3), n, "1", d, "9", "Jan 1, 1970 12:00:00 AM", "(Unknown)"), (5, 0, 2, at(2), n, "1", d, "1", None, "Anne Lee"),
        (6, 0, 1, at(1), "777777", "1", d, "1", r, "Bo"), (7, 0, 9, at(1), "777777", "1", d, "1", r, "Bo"), (8, 0, 1, at(1), "888888", "1", d, "1", r, None), (9, 0, 1, at(1), "888888", "1", d, "1", r, "888888"), (10, 0, 1, at(1), "999999", "1", d, "1", r, "Solo"),
    ]
    devices = spark.createDataFrame([(1, 1, "x"), (2, 5, "x"), (3, 5, "x"), (3, None, "x")], "device_id int, trust int, name string")
    assert rows(survivor.survivors(calls(spark, data), devices)) == [(1, 5, 3), (6, 6, 6)]


def test_missing_times_take_the_learned_order(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2020, 1, d)
    n, d, r = "5551234567", 1_600_000_000_000, "Sep 13, 2020 12:26:40 PM"
    learned = [(20 + i, 0, 1, at(1 + i), n, "1", str(d + 10_000_000 * (i + 1)), "1", r, name) for i, name in enumerate(["Old Name", "Old Name", "New Name"])]
    group = [(1, 0, 1, None, n, "1", str(d), "1", r, "New Name"), (2, 0, 1, at(28), n, "1", str(d), "1", r, "Old Name"), (3, 0, 1, None, n, "1", str(d), "1", r, "Never Seen")]
    devices = spark.createDataFrame([(1, 1)], "device_id int, trust int")
    # "Old Name" was also delivered last, on the 28th, so it is the latest value; without that row "New Name" is
    assert rows(survivor.survivors(calls(spark, learned + group), devices))[0][1] == 2
    assert rows(survivor.survivors(calls(spark, learned + [group[0], group[2], (4, 0, 1, at(2), n, "1", str(d), "1", r, "Old Name")]), devices))[0][1] == 1


def test_currency_equals_brute_force(spark):
    """Rows with and without time: the survivor of each call against transitions, partial order and longest chains written out in Python."""
    import datetime as dt

    rnd = random.Random(11)
    names = ["Ann", "Bob", "Cyd", "Dee", "Eve"]
    data, i = [], 0
    for number in ("5551230001", "5551230002", "5551230003"):
        for call in range(14):
            for _ in range(rnd.randint(1, 4)):
                i += 1
                at = None if rnd.random() < 0.4 else dt.datetime(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(3000))
                data.append((i, 0, 1, at, number, "5", str(1_600_000_000_000 + call * 60_000), "1", None, rnd.choice(names)))
    devices = spark.createDataFrame([(1, 1)], "device_id int, trust int")
    got = {r[0]: r[1] for r in survivor.survivors(calls(spark, data).repartition(5), devices).collect()}

    places = {}
    for number in {d[4] for d in data}:
        line = sorted((d[3], d[0], d[9]) for d in data if d[4] == number and d[3])
        steps, last = {}, {}
        for (_, _, a), (t, _, b) in zip(line, line[1:]):
            if a != b:
                n, _ = steps.get((a, b), (0, None))
                steps[a, b] = (n + 1, t)
        for t, _, n in line:
            last[n] = t
        before = {n: {a for a, b in steps if b == n and ((b, a) not in steps or steps[a, b] > steps[b, a])} for n in last}
        level = {}
        while True:
            new = {n: max((level[a] + 1 for a in before[n]), default=0) for n in last if n not in level and before[n] <= set(level)}
            if not new:
                break
            level |= new
        top, rest = max(level.values(), default=-1), sorted({last[n] for n in last if n not in level})
        for n in last:
            places[number, n] = level[n] + 1 if n in level else top + 2 + rest.index(last[n])
    want = {}
    for key in {(d[4], d[6]) for d in data}:
        group = [d for d in data if (d[4], d[6]) == key]
        if len(group) < 2:
            continue
        timed = [d for d in group if d[3]]
        stand = places.get((key[0], max(timed, key=lambda d: (d[3], -d[0]))[9]), 0) if timed else 0
        lacks = len(timed) < len(group)
        rank = lambda d: ((stand if d[3] else places.get((key[0], d[9]), 0)) if lacks else 0, d[3] or dt.datetime(1970, 1, 1), -d[0])
        want[min(d[0] for d in group)] = max(group, key=rank)[0]
    assert got == want


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    """Row groups read by a batch of one number don't grow with the history."""
    data = [(i, 0, 1, None, f"555{1_000_000 + i // 4}", "10", str(1_600_000_000_000 + i * 5000), "1", None, None) for i in range(40_000)]
    df = spark.createDataFrame([(*d, "c", "l", "a", "s", "h") for d in data], SCHEMA)
    h = history.History(spark, f"file://{tmp_path}/index", buckets=4)
    history.ROW_GROUP, kept = 4096, history.ROW_GROUP
    try:
        h.accept(df)
    finally:
        history.ROW_GROUP = kept
    loaded = h.touched.value
    batch = calls(spark, [(10**6, 1, 1, None, "+1 555-100-2500", "11", str(1_600_000_000_000 + 10_000 * 5000), "1", None, None)])
    found = h.repeats(batch).collect()
    assert [(r.first_call_id, r.call_id) for r in found] == [(10_000, 10**6)] and 0.5 < found[0].covered < 1
    assert h.touched.value - loaded <= 8 < loaded
