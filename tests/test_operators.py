import os

import pytest
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import attachments, coalesce, contacts, graphs, integrity, quality, stats, textscan
from recordloom.sinks import store
from recordloom.sources import xmlrecords, yamlfiles
from tests.conftest import rows

CALLS = """<?xml version='1.0' encoding='UTF-8' standalone='yes' ?>
<calls count="5">
  <call number="+15550100" duration="12" date="1415054053956" type="1" readable_date="x" contact_name="Ann" />
  <call number="0049123" duration="0" date="1388534400000" type="3" readable_date="x" contact_name="(Unknown)" />
  <call number="+15550100" duration="12" date="1415054053956" type="1" readable_date="y" contact_name="Other" />
  <call number="" duration=" 5 " date="x" type="9" />
</calls>
"""
MESSAGES = """<smses count="2">
  <sms protocol="0" address="+1555" date="1373929642000" type="1" subject="null" body="null" read="1" locked="x" date_sent="0" service_center="null" contact_name="null" />
  <mms date="1414697344000" msg_box="1" address="+1~+2" sub="null" m_id="null" text_only="1"><parts><part seq="0" ct="text/plain" text="null" cl="null"/><part seq="1" ct="image/png" data="QUJD"/></parts><addrs><addr address="+1" type="137" charset="106"/></addrs></mms>
</smses>
"""


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("text,expected", [("+1 (555) 123-4567", "5551234567"), ("15551234567", "5551234567"), ("25551234567", "25551234567"), ("a@b.c000", "000"), ("", ""), (None, None)])
def test_phone(spark, text, expected):
    assert one(spark, S.normalize_phone(F.lit(text).cast("string")))[0] == expected


def test_scalars(spark):
    r = one(
        spark, S.readable_date(F.lit(1415054053956)), S.decode_base64(F.lit("QU\nJD")), S.decode_base64(F.lit("QUJ")), S.decode_base64(F.lit("null ")), S.normalize_mime(F.lit(" IMAGE/JPEG ; q=1")), S.mime_extension(F.lit("x/y")),
        S.safe_filename(F.lit("../a:b")), S.sniff_type(F.unhex(F.lit("89504E470D0A1A0A00"))), S.hash_of_path(F.lit("attachments/ab/" + "a" * 64 + "/f")), S.parse_size(F.lit("1.5 KB")), S.format_size(F.lit(1536)), S.slug(F.lit("A b, C!")), S.strict_int(F.lit(" 5")), S.extension_mime(F.lit("a.JPEG")),
    )
    assert r[0] == "Nov 3, 2014 5:34:13 PM" and bytes(r[1]) == b"ABC" and r[2] is None and r[3] is None and r[4] == "image/jpeg" and r[5] == "bin"
    assert r[6] == "__a_b" and r[7] == "image/png" and r[8] == "a" * 64 and r[9] == 1536 and r[10] == "1.5 KB" and r[11] == "a-b-c" and r[12] is None and r[13] == "image/jpeg"


def test_calls_xml_to_store_and_back(spark, tmp_path):
    (tmp_path / "calls-2014.xml").write_text(CALLS)
    path = f"file://{tmp_path}/calls-2014.xml"
    calls = xmlrecords.read_calls_with_position(spark, path)
    assert calls.count() == 4 and calls.first()["declared"] == 5
    assert rows(calls.where("pos = 3").select("duration", "date", "parse_errors")) == [(None, None, ["parse-error: duration", "parse-error: date"])]
    assert xmlrecords.read_calls(spark, path).count() == 4
    assert rows(xmlrecords.declared_counts(spark, path, "calls").select("declared")) == [(5,)]
    good, refused = quality.split_rows(calls, quality.call_violations())
    assert refused.count() == 1 and set(refused.first()["violations"]) == {"missing-timestamp", "missing-number", "invalid-type: 9"}
    kept = coalesce.coalesce(good.limit(0), good, coalesce.call_key(), F.col("pos"))
    assert rows(coalesce.coalesce_statistics(kept)) == [(0, 2, 1, 2, 0)]
    first = kept.where("rn = 1").select("number", "duration", "date", "type", "readable_date", "contact_name")
    folder = f"file://{tmp_path}/store"
    store.write_years(first, folder, "calls")
    store.write_years(first.where("year(timestamp_millis(date)) = 2014").limit(1), folder, "calls")
    assert store.read_store(spark, folder, "calls", 2014).count() == 1
    again = coalesce.coalesce(first, good, coalesce.call_key(), F.lit(0))
    assert rows(coalesce.coalesce_statistics(again).select("added", "duplicates")) == [(0, 3)]
    assert store.export_year(first, str(tmp_path / "out.xml"), "calls", "call", ["number", "duration", "date", "type", "contact_name"], ["date"]) == 2
    assert xmlrecords.read_calls_with_position(spark, f"file://{tmp_path}/out.xml").select("declared").first()[0] == 2
    store.write_refused(refused.select("pos", "number", "violations"), f"file://{tmp_path}/refused", "calls")
    assert spark.read.json(f"file://{tmp_path}/refused").count() == 1


def test_survivors_equal_first_wins(spark):
    old = spark.createDataFrame([(1, "a", 1, 5, 1), (2, "b", 1, 5, 1)], "call_id long, number string, duration int, date long, type int")
    new = spark.createDataFrame([(3, "a", 1, 5, 1), (4, "c", 1, 5, 1), (5, "c", 1, 5, 1), (6, None, 1, 5, 1)], old.schema)
    ranked = coalesce.coalesce(old, new, coalesce.call_key(), F.col("call_id")).where("rn = 1").select("call_id")
    assert rows(ranked) == rows(coalesce.survivors(old, new, coalesce.call_key(), F.col("call_id")).select("call_id")) == [(1,), (2,), (4,), (6,)]
    assert rows(coalesce.new_only(old, new, coalesce.call_key()).select("call_id")) == [(4,), (5,), (6,)]


def test_messages_xml(spark, tmp_path):
    (tmp_path / "sms.xml").write_text(MESSAGES)
    m = xmlrecords.read_messages(spark, f"file://{tmp_path}/sms.xml")
    s = m.where("kind = 'sms'").first()
    assert (s["subject"], s["body"], s["contact_name"], s["locked"], s["read"], s["date_sent"], s["service_center"]) == (None, "null", "null", 0, 1, 0, None)
    p = m.where("kind = 'mms'").first()
    assert p["type"] == 1 and p["sub"] is None and p["m_id"] == "null" and [x["ct"] for x in p["parts"]] == ["text/plain", "image/png"] and p["parts"][0]["text"] == "null" and p["parts"][0]["cl"] is None and p["addrs"][0]["type"] == 137
    assert xmlrecords.read_messages(spark, f"file://{tmp_path}/sms.xml").where("kind = 'mms'").select(F.size(quality.missing_part_types())).first()[0] == 0


@pytest.mark.parametrize("text", ["", "<", "<calls", "<calls><call number='1'", "<!DOCTYPE x [<!ENTITY e SYSTEM 'file:///etc/passwd'>]><calls><call number='&e;' date='1' duration='1' type='1'/></calls>", "x" * 10_000])
def test_malformed_xml_does_not_crash(spark, tmp_path, text):
    (tmp_path / "calls.xml").write_text(text)
    got = xmlrecords.read_calls(spark, f"file://{tmp_path}/calls.xml").collect()
    assert all("root:" not in (r["number"] or "") for r in got)


def test_contacts(spark):
    c = spark.createDataFrame([(2, "Bo", ["+15551234567", "x"]), (1, "Al", ["5551234567"]), (3, "Cy", None), (4, None, []), (5, "Al", ["(555) 000-1111"])], "contact_id long, name string, numbers array<string>")
    r = spark.createDataFrame([(1, "15551234567", "old"), (2, "777", "Ann, Bob ,(Unknown)"), (3, "777", None), (4, None, "Z"), (5, "888", "(Unknown)")], "id long, number string, contact_name string")
    assert rows(contacts.resolve_names(r, c).select("id", "contact_name")) == [(1, "Al"), (2, "Ann, Bob ,(Unknown)"), (3, None), (4, "Z"), (5, "(Unknown)")]
    assert rows(contacts.unprocessed_names(r, c)) == [("777", ["Ann", "Bob"]), ("888", ["(Unknown)"])]
    assert rows(contacts.number_conflicts(c)) == [("5551234567", 2)]
    assert ("no-numbers" in {f for i, f in rows(contacts.contact_faults(c)) if i == 3}) and (2, "bad-number") in rows(contacts.contact_faults(c)) and (5, "duplicate-name") in rows(contacts.contact_faults(c))
    m = spark.createDataFrame([("m", "+1~+2", "A, B"), ("n", "+1", "A,B")], "id string, address string, names string")
    assert rows(contacts.paired_addresses(m)) == [("m", 0, "+1", "A"), ("m", 1, "+2", "B")]
    assert rows(contacts.unreferenced_names(r.select(F.col("contact_name").alias("name")), c.limit(0)).select("severity").distinct()) == [("warning",)]


def test_yaml_and_contacts_tables(spark):
    text = 'contacts:\n  - name: "Ann \\"A\\""\n    numbers:\n      - "1"\n      - \'2\'\n  - name: Bo\n    numbers: []\nunprocessed:\n  - "5: Cy"\n  - "5: Di"\n'
    c, u = yamlfiles.contacts_tables(spark, text)
    assert rows(c) == [(1, 'Ann "A"', ["1", "2"]), (2, "Bo", [])] and rows(u) == [(1, "5", ["Cy", "Di"])]
    data = yamlfiles.upgrade_contacts(yamlfiles.load(text))
    assert yamlfiles.load(yamlfiles.dump(data)) == data
    assert yamlfiles.contacts_tables(spark, "")[0].count() == 0


def test_attachments(spark, tmp_path):
    import hashlib

    content = [(hashlib.sha256(b"abc").hexdigest(), bytearray(b"abc")), (hashlib.sha256(b"abc").hexdigest(), bytearray(b"abc")), ("0" * 64, bytearray(b"bad"))]
    df = spark.createDataFrame(content, "hash string, content binary")
    assert {s for _, s in rows(store.write_attachments(df, str(tmp_path)))} == {"written", "corrupt"}
    assert {s for _, s in rows(store.write_attachments(df, str(tmp_path)))} == {"present", "corrupt"}
    text = store.write_manifest(spark, str(tmp_path), "2024-01-01T00:00:00Z")
    assert yamlfiles.load(text)["files"][0]["size"] == 3 and os.path.exists(tmp_path / "files.yaml.sha256")
    a, r = spark.createDataFrame([("a",), ("b",)], "hash string"), spark.createDataFrame([("b",), ("c",), ("c",)], "hash string")
    assert rows(attachments.reference_check(a, r)) == [("a", "orphaned"), ("c", "missing")]


def test_integrity_and_reports(spark):
    schema = "name string, size long, checksum string"
    m, a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], schema), spark.createDataFrame([("b", 1, "x"), ("c", 2, "x"), ("d", 1, "y"), ("e", 1, "x")], schema)
    assert rows(integrity.compare_manifest(m, a)) == [("a", "missing_file"), ("c", "size_mismatch"), ("d", "checksum_mismatch"), ("e", "extra_file")]
    report = spark.createDataFrame([("t", "error", "f", "m", 2), ("t", "error", "g", "m", 1), ("u", "warning", None, "m", 3)], "type string, severity string, file string, message string, seq long")
    assert rows(quality.filter_report(report, per_type=1).select("seq")) == [(1,), (3,)]
    assert rows(quality.report_status(report)) == [(False, False, 2, 1)] and rows(quality.report_status(report.limit(0))) == [(True, True, 0, 0)]


def test_graphs(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("c", "a")], "node string, needs string")
    assert rows(graphs.levels(e)) == [("a", 0), ("b", 1), ("c", 2)]
    t = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "node string, duration int")
    assert rows(graphs.critical_path(t, e)) == [("a", 3), ("b", 5), ("c", 6)]
    c = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x"), ("w", None)], "node string, next string")
    assert rows(graphs.cycles(c)) == [("x",), ("y",)]


def test_text(spark):
    d = spark.createDataFrame([(1, "# A\ntext\n```\n# no\n```\n## B\nmore (x"), (2, None)], "id int, text string")
    s = textscan.containing_section(textscan.sections(textscan.lines_of(d, "text", "id"), "id"), "id")
    assert [(r.line_no, r.section, r.title) for r in s.orderBy("line_no").collect()] == [(1, 1, "A"), (2, 1, "A"), (3, 1, "A"), (4, 1, "A"), (5, 1, "A"), (6, 2, "B"), (7, 2, "B")]
    r = one(spark, textscan.balanced(F.lit("([]{})")), textscan.balanced(F.lit("([)]")), textscan.balanced(F.lit(")")), textscan.checkbox(F.lit("- [X] a")), textscan.words(F.lit(" a  b ")), textscan.safe_path(F.lit("a/%2e%2e/b")))
    assert tuple(r) == (True, False, False, "done", 2, False)


def test_statistics(spark):
    e = spark.createDataFrame([("a", "error"), ("a", "ok"), ("b", "ok")], "g string, s string")
    assert rows(stats.worst(e.withColumn("status", F.col("s")), "status", {"error": 2, "ok": 0}, "g")) == [("a", "error"), ("b", "ok")]
    assert rows(stats.coverage(e, F.col("s") == "ok", "g")) == [(None, 3, 2, 66.67), ("a", 2, 1, 50.0), ("b", 1, 1, 100.0)]


def test_stream_import_is_idempotent(spark, tmp_path):
    from recordloom.streaming import imports

    calls = spark.createDataFrame([(i, 0, f"n{i % 3}", 1, 5, 1) for i in range(9)], "call_id long, batch_no int, number string, duration int, date long, type int")
    for k in range(2):
        calls.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = imports.stream_table(spark, f"{tmp_path}/in", calls.schema, 1)
        imports.import_stream(s, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/store").count() == 3


def test_attachment_scan(spark, tmp_path):
    import hashlib

    from recordloom.sources import attachments as scan

    whole, broken = hashlib.sha256(b"abc").hexdigest(), "ff" + "0" * 62
    for digest, name, content in ((whole, None, b"abc"), (broken, "x.png", b"zz")):
        folder = tmp_path / "attachments" / digest[:2]
        folder.mkdir(parents=True, exist_ok=True)
        if name:
            (folder / digest).mkdir()
            (folder / digest / name).write_bytes(content)
            (folder / digest / "metadata.yaml").write_text("a: 1")
        else:
            (folder / digest).write_bytes(content)
    files = scan.scan(spark, f"file://{tmp_path}")
    assert rows(scan.layout(files)) == sorted([(whole, "legacy"), (broken, "new")])
    assert rows(scan.faults(files)) == [(broken, "corrupted")]
    moves = scan.migration(files, spark.createDataFrame([(whole, "png")], "hash string, extension string"))
    assert rows(moves.select("hash", "target")) == [(whole, f"attachments/{whole[:2]}/{whole}/attachment.png")]


def test_message_key_holds_all_fields(spark):
    from recordloom.operators.coalesce import message_key

    part = "array<struct<seq int, ct string, name string, text string, data string, path string>>"
    schema = f"id string, kind string, address string, date long, type int, body string, read int, m_id string, parts {part}, addrs array<struct<address string, type int, charset int>>, contact_name string"
    png = (0, "image/png", "a", None, "x", None)
    base = ("a", "mms", "1", 5, 1, None, None, "m", [png], [("1", 151, 106)], "n")
    rows_ = [base, ("same", *base[1:10], "other name"), ("part", *base[1:8], [(0, "image/png", "b", None, "x", None)], base[9], "n"), ("two", *base[1:8], [png, png], base[9], "n"), ("addr", *base[1:9], [("2", 151, 106)], "n"), ("data", *base[1:8], [(0, "image/png", "a", None, "y", None)], base[9], "n"), ("path", *base[1:8], [(0, "image/png", "a", None, None, "p")], base[9], "n"), ("none", *base[1:8], None, None, "n")]
    rows_ += [("s", "sms", "1", 5, 1, "hi", 1, None, None, None, None), ("s2", "sms", "1", 5, 1, "hi", 0, None, None, None, None), ("s3", "sms", None, 5, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows_, schema)
    keys = {r[0]: r[1] for r in df.select("id", message_key(df)).collect()}
    assert keys["a"] == keys["same"] == keys["data"]  # only that there is data counts
    assert len(set(keys.values())) == len(rows_) - 2
    short = {r[0] for r in df.where("address = '1'").select(message_key(df, "short")).collect()}
    assert len(short) == 1


def test_graphs_with_cycles_and_long_chains(spark):
    import random

    rnd = random.Random(2)
    pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(16)}
    reach = {a: {b for x, b in pairs if x == a} for a in range(12)}
    for _ in range(12):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    e = spark.createDataFrame([*pairs, (None, 1), (1, None)], "node int, next int")
    assert rows(graphs.closure(e)) == sorted((a, b) for a, bs in reach.items() for b in bs)
    assert rows(graphs.cycles(e)) == sorted((a,) for a in reach if a in reach[a])
    chains = {r.node: r.chain for r in graphs.cycle_chains(e).collect()}
    assert set(chains) == {a for a in reach if a in reach[a]} and all(c[0] == c[-1] == a and all(x in pairs for x in zip(c, c[1:])) for a, c in chains.items())
    ladder = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 7)], *[(i, i - 2) for i in range(2, 7)], (90, 91), (91, 90), (92, 90)], "node int, needs int")
    assert rows(graphs.levels(ladder)) == [(i, i) for i in range(7)]
    assert graphs.levels(ladder.limit(0)).count() == 0 and graphs.cycles(e.limit(0)).count() == 0


def test_validation_cases(spark):
    from recordloom.operators import validation as V

    times = ["2024-02-29T10:00:00Z", "2023-02-29T10:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01 10:00:00Z", "2024-01-01T10:00:00+01:30", "2024-01-01T10:00:00", "", None]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert [r[0] for r in df.select(V.is_rfc3339(F.col("t"))).collect()] == [True, False, False, False, True, False, False, False]
    none = spark.createDataFrame([], "present boolean, version string, created_at string, created_by string")
    assert V.marker_report(none).count() == 0
    bad = spark.createDataFrame([(True, "9", "2024-01-01T00:00:00Z", "x")], none.schema)
    other = V.count_report(spark.createDataFrame([("f", 3)], "file string, n int"), spark.createDataFrame([("f", 2)], "file string, n int"))
    assert rows(V.full_report(V.marker_report(bad), other).select("type")) == [("unsupported_version",)]
    good = spark.createDataFrame([(True, "1", "2024-01-01T00:00:00Z", "x")], none.schema)
    assert rows(V.full_report(V.marker_report(good), other).select("type", "expected", "actual")) == [("count_mismatch", "2", "3")]
    assert rows(V.status(other.limit(0))) == [(0, 0, "valid")]
    paths = spark.createDataFrame([("/in/calls-1.xml",), ("/s/calls/calls-1.xml",), ("/in/sms.xml",), ("/in/x.xml",), ("/in/callsheet.xml",), (None,)], "path string")
    assert rows(V.wanted_inputs(paths)) == [("/in/calls-1.xml",), ("/in/callsheet.xml",), ("/in/sms.xml",)] and rows(V.wanted_inputs(paths, "sms")) == [("/in/sms.xml",)]
