"""Queries over call and message records: keys, coalescing, validation, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import coalesce as C
from recordloom.operators import contacts as K
from recordloom.operators import quality as Q
from recordloom.operators import stats as A
from recordloom.plans.registry import Registry
from recordloom.sources.tables import table

query = Registry()

#: Calls with typed fields: rows whose fields aren't numbers are left to the validation queries.
TYPED = """(SELECT call_id, batch_no, device_id, number, CAST(trim(duration) AS INTEGER) AS duration, CAST(trim(date) AS BIGINT) AS date, CAST(trim(type) AS INTEGER) AS type, contact_name
  FROM calls WHERE number IS NOT NULL AND regexp_full_match(trim(date), '[0-9]{1,18}') AND regexp_full_match(trim(duration), '[0-9]{1,9}') AND trim(type) IN ('1','2','3','4'))"""
PHONE = "regexp_replace(regexp_replace({0}, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\\1')"
KEY = "sha256(concat('number:', number, '|duration:', duration, '|date:', date, '|type:', type, '|'))"
YEAR = "CAST(year(make_timestamp(date * 1000)) AS INTEGER)"


def typed_calls(spark: SparkSession, sf: str) -> DataFrame:
    """call_id, batch_no, device_id and typed fields of the calls whose fields are numbers."""
    d, n, t = F.trim("date"), F.trim("duration"), F.trim("type")
    good = F.col("number").isNotNull() & d.rlike("^[0-9]{1,18}$") & n.rlike("^[0-9]{1,9}$") & t.isin("1", "2", "3", "4")
    return table(spark, sf, "calls").where(good).select("call_id", "batch_no", "device_id", "number", n.cast("int").alias("duration"), d.cast("bigint").alias("date"), t.cast("int").alias("type"), "contact_name")


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    calls = typed_calls(spark, sf)
    return C.coalesce(calls.where("batch_no = 0"), calls.where("batch_no > 0"), C.call_key(), F.col("batch_no"), F.col("call_id"))


_RANKED = f"(SELECT *, CASE WHEN batch_no = 0 THEN 0 ELSE 1 END AS src, row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN batch_no = 0 THEN 0 ELSE 1 END, batch_no, call_id) AS rn FROM {TYPED})"


@query(f"SELECT {KEY} AS key, call_id, batch_no FROM {_RANKED} WHERE rn = 1")
def coalesce_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving call of each key: existing first, then batches in order."""
    calls = typed_calls(spark, sf)
    return C.survivors(calls.where("batch_no = 0"), calls.where("batch_no > 0"), C.call_key(), F.col("batch_no"), F.col("call_id")).select("key", "call_id", "batch_no")


_STATS = "count(*) FILTER (src = 0 AND rn = 1) AS initial, count(*) FILTER (src = 1 AND rn = 1) AS added, count(*) FILTER (src = 1 AND rn > 1) AS duplicates, count(*) FILTER (rn = 1) AS final, count(*) FILTER (src = 0) AS initial_rows"


@query(f"SELECT {YEAR} AS year, type, {_STATS} FROM {_RANKED} GROUP BY ALL")
def coalesce_stats_by_year_type(spark: SparkSession, sf: str) -> DataFrame:
    """Coalesce counters by year and type."""
    return C.coalesce_statistics(_ranked(spark, sf).withColumn("year", S.utc_year("date")), "year", "type")


@query(f"SELECT {_STATS} FROM {_RANKED}")
def coalesce_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Coalesce counters in all."""
    return C.coalesce_statistics(_ranked(spark, sf))


@query(f"SELECT batch_no, {YEAR} AS year, {_STATS} FROM {_RANKED} WHERE src = 1 GROUP BY ROLLUP (batch_no, year)")
def import_stats_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each incoming batch and year, with totals."""
    r = _ranked(spark, sf).where("src = 1").withColumn("year", S.utc_year("date"))
    return r.rollup("batch_no", "year").agg(
        F.count_if((F.col("src") == 0) & (F.col("rn") == 1)).alias("initial"),
        F.count_if((F.col("src") == 1) & (F.col("rn") == 1)).alias("added"), F.count_if((F.col("src") == 1) & (F.col("rn") > 1)).alias("duplicates"),
        F.count_if(F.col("rn") == 1).alias("final"), F.count_if(F.col("src") == 0).alias("initial_rows"),
    )


@query(f"SELECT call_id, {KEY} AS key FROM {TYPED} t WHERE batch_no > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT {KEY} AS k FROM {TYPED} WHERE batch_no = 0) e WHERE e.k = {KEY.replace('number,', 't.number,')})")
def new_calls_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming calls whose key the history doesn't hold."""
    calls = typed_calls(spark, sf)
    return C.new_only(calls.where("batch_no = 0"), calls.where("batch_no > 0"), C.call_key()).select("call_id", "key")


_EVENT_KEY = "sha256(concat_ws('|', user_id, event_type, epoch_us(ts)))"


@query("SELECT user_id, minute, event_id FROM (SELECT user_id, date_trunc('minute', ts) AS minute, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_user_minute(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and minute."""
    e = table(spark, sf, "events").withColumn("minute", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    return e.groupBy("user_id", "minute").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"SELECT call_id, {KEY} AS key, substr({KEY}, 1, 16) AS short_id FROM {TYPED}")
def record_key_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The key of each call and its first eight bytes."""
    return typed_calls(spark, sf).select("call_id", C.call_key().alias("key"), F.substring(C.call_key(), 1, 16).alias("short_id"))


_MESSAGES = "(SELECT doc_id, coalesce(address, '') AS address, epoch_us(sent_at) // 1000 AS date, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS type, source AS kind, text AS body FROM documents WHERE source IN ('sms','mms'))"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """The short and picture messages of ``documents``: doc_id, address, date, type (from the id, as the table has none), kind, body."""
    d = table(spark, sf, "documents").where(F.col("source").isin("sms", "mms"))
    return d.select("doc_id", F.coalesce("address", F.lit("")).alias("address"), S.epoch_ms("sent_at").alias("date"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("type"), F.col("source").alias("kind"), F.col("text").alias("body"))


@query(f"SELECT {YEAR} AS year, count(*) AS n, min(date) AS earliest, max(date) AS latest FROM {TYPED} GROUP BY ROLLUP (year)")
def calls_per_year_range(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, earliest and latest date of each year, and in all."""
    return A.per_year(typed_calls(spark, sf))


@query(f"SELECT {YEAR} AS year, count(*) AS total, count(*) FILTER (kind = 'sms') AS sms, count(*) FILTER (kind = 'mms') AS mms, min(date) AS earliest, max(date) AS latest FROM {_MESSAGES} GROUP BY ROLLUP (year)")
def message_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages by year and kind, and in all."""
    return A.kinds_per_year(messages(spark, sf))


_LOOSE = """(SELECT call_id, number, CASE WHEN regexp_full_match(duration, '[+-]?[0-9]{1,9}') THEN CAST(duration AS INTEGER) END AS duration, CASE WHEN regexp_full_match(date, '[+-]?[0-9]{1,18}') THEN CAST(date AS BIGINT) END AS date,
  CASE WHEN regexp_full_match(type, '[+-]?[0-9]{1,9}') THEN CAST(type AS INTEGER) END AS type FROM calls)"""
_VIOLATIONS = f"""(SELECT call_id, unnest(list_filter([CASE WHEN coalesce(date, 0) <= 0 THEN 'missing-timestamp' END, CASE WHEN trim(coalesce(number, '')) = '' THEN 'missing-number' END,
  CASE WHEN NOT coalesce(type IN (1,2,3,4), false) THEN 'invalid-type: ' || coalesce(CAST(type AS VARCHAR), '0') END, CASE WHEN coalesce(duration, 0) < 0 THEN 'negative-duration' END], lambda x: x IS NOT NULL)) AS violation FROM {_LOOSE})"""


def _loose_calls(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "calls")
    strict = lambda name, kind, digits: F.when(F.col(name).rlike(rf"^[+-]?[0-9]{{1,{digits}}}$"), F.col(name).cast(kind)).alias(name)
    return c.select("call_id", "number", strict("duration", "int", 9), strict("date", "bigint", 18), strict("type", "int", 9))


@query(f"SELECT call_id, violation FROM {_VIOLATIONS}")
def call_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per call and violation; texts that aren't whole numbers (blanks count) are missing values."""
    _, refused = Q.split_rows(_loose_calls(spark, sf), Q.call_violations())
    return refused.select("call_id", F.explode("violations").alias("violation"))


@query(f"SELECT violation, count(*) AS n FROM {_VIOLATIONS} GROUP BY violation")
def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by kind."""
    _, refused = Q.split_rows(_loose_calls(spark, sf), Q.call_violations())
    return Q.violation_counts(refused)


@query(f"SELECT (SELECT count(*) FROM calls) - count(DISTINCT call_id) AS good, count(DISTINCT call_id) AS refused FROM {_VIOLATIONS}")
def reject_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Good and refused calls."""
    checked = _loose_calls(spark, sf).select(F.size(Q.call_violations()).alias("n"))
    return checked.agg(F.count_if(F.col("n") == 0).alias("good"), F.count_if(F.col("n") > 0).alias("refused"))


@query(f"SELECT doc_id, unnest(list_filter([CASE WHEN coalesce(date, 0) = 0 THEN 'missing-timestamp' END, CASE WHEN address = '' THEN 'missing-address' END], lambda x: x IS NOT NULL)) AS violation FROM {_MESSAGES}")
def message_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per message and violation."""
    return messages(spark, sf).select("doc_id", F.explode(Q.message_violations()).alias("violation"))


@query(f"SELECT doc_id, strlen(address) + 50 + strlen(coalesce(body, '')) AS bytes FROM {_MESSAGES} WHERE strlen(address) + 50 + strlen(coalesce(body, '')) > 400")
def message_size_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Messages above a size limit of 400 bytes."""
    m = messages(spark, sf).withColumn("bytes", Q.message_bytes(F.col("address"), F.col("body")).cast("bigint"))
    return m.where("bytes > 400").select("doc_id", "bytes")


@query(f"SELECT call_id, date FROM {TYPED} WHERE {YEAR} = 2020")
def year_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of one year in order of date and id."""
    return typed_calls(spark, sf).where(S.utc_year("date") == 2020).orderBy("date", "call_id").select("call_id", "date")


_LOOKUP = f"(SELECT k, arg_min(name, contact_id) AS known FROM (SELECT contact_id, name, {PHONE.format('u.number')} AS k FROM contacts, unnest(numbers) AS u(number)) WHERE k <> '' GROUP BY k)"


@query(f"SELECT call_id, coalesce(l.known, c.contact_name) AS contact_name FROM calls c LEFT JOIN {_LOOKUP} l ON l.k = {PHONE.format('c.number')}")
def contact_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Each call with the name of the contact that owns its number."""
    return K.resolve_names(table(spark, sf, "calls").select("call_id", "number", "contact_name"), table(spark, sf, "contacts")).select("call_id", "contact_name")


@query(f"""WITH f AS (SELECT DISTINCT {PHONE.format('number')} AS number_key, trim(u.name) AS name FROM imports, unnest(string_split(contact_name, ',')) AS u(name) WHERE {PHONE.format('number')} <> ''),
  g AS (SELECT f.*, name NOT IN ('', '(Unknown)', 'null') AS actual FROM f WHERE NOT EXISTS (SELECT 1 FROM {_LOOKUP} l WHERE l.k = f.number_key)),
  h AS (SELECT *, bool_or(actual) OVER (PARTITION BY number_key) AS any_actual FROM g)
  SELECT number_key, string_agg(name, '|' ORDER BY name) AS names FROM h WHERE actual OR NOT any_actual GROUP BY number_key""")
def unprocessed_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Names (split at commas) of numbers without a contact; placeholders give way to real names."""
    out = K.unprocessed_names(table(spark, sf, "imports"), table(spark, sf, "contacts"))
    return out.select("number_key", F.array_join("names", "|").alias("names"))


@query(f"SELECT contact_id, u.number, {PHONE.format('u.number')} AS number_key FROM contacts, unnest(numbers) AS u(number)")
def contact_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per contact and number, as written and normalised."""
    return table(spark, sf, "contacts").select("contact_id", F.explode("numbers").alias("number")).withColumn("number_key", S.normalize_phone("number"))


@query(f"SELECT k AS number_key, count(DISTINCT name) AS owners FROM (SELECT name, {PHONE.format('u.number')} AS k FROM contacts, unnest(numbers) AS u(number)) WHERE k <> '' GROUP BY k HAVING count(DISTINCT name) > 1")
def number_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of several contacts."""
    return K.number_conflicts(table(spark, sf, "contacts"))


@query("""WITH m AS (SELECT entry_id AS id, array_to_string(list_transform(contact_names, lambda x: phone_number), '~') AS a, array_to_string(contact_names, ',') AS n FROM unprocessed WHERE len(contact_names) > 0),
  s AS (SELECT id, string_split(a, '~') AS a, string_split(n, ',') AS n FROM m)
  SELECT id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS address, trim(n[i]) AS name FROM s, unnest(range(1, len(a) + 1)) AS u(i) WHERE len(a) = len(n)""")
def multi_address_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses joined by ``~`` paired with as many names joined by commas."""
    u = table(spark, sf, "unprocessed").where(F.size("contact_names") > 0)
    joined = u.select(F.col("entry_id").alias("id"), F.array_join(F.transform("contact_names", lambda x: F.coalesce(F.col("phone_number"), F.lit(""))), "~").alias("address"), F.array_join("contact_names", ",").alias("names"))
    return K.paired_addresses(joined)


@query(f"SELECT call_id, {PHONE.format('number')} AS number_key, strftime(make_timestamp(date * 1000), '%Y-%m-%d') AS day FROM {TYPED}")
def phone_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised number and UTC day of each call."""
    return typed_calls(spark, sf).select("call_id", S.normalize_phone("number").alias("number_key"), F.date_format(F.timestamp_millis("date"), "yyyy-MM-dd").alias("day"))


@query()
def readable_date(spark: SparkSession, sf: str) -> DataFrame:
    """The readable date of each call in New York; DuckDB has no zones here, so vectors test it."""
    return typed_calls(spark, sf).select("call_id", S.readable_date("date").alias("readable_date"))


@query("""SELECT contact_id, fault FROM (
  SELECT contact_id, unnest(list_filter([CASE WHEN trim(coalesce(name, '')) = '' THEN 'empty-name' END, CASE WHEN name IS NOT NULL AND row_number() OVER (PARTITION BY name ORDER BY contact_id) > 1 THEN 'duplicate-name' END, CASE WHEN coalesce(len(numbers), 0) = 0 THEN 'no-numbers' END], lambda x: x IS NOT NULL)) AS fault FROM contacts
  UNION ALL
  SELECT contact_id, unnest(list_filter([CASE WHEN NOT regexp_full_match(number, '\\+?[0-9\\s().-]+') THEN 'bad-number' END, CASE WHEN row_number() OVER (PARTITION BY number ORDER BY contact_id, i) > 1 THEN 'duplicate-number' END], lambda x: x IS NOT NULL))
  FROM (SELECT contact_id, numbers[i] AS number, i FROM contacts, unnest(range(1, len(numbers) + 1)) AS u(i)))""")
def contact_data_check(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the address book."""
    return K.contact_faults(table(spark, sf, "contacts"))
