"""Queries of the operators for training data, and their SQL where DuckDB can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bins, bpe, copies, history, names, survivor, truncation
from recordloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of new batches that repeat a call, each with the call's smallest call_id."""
    return history.found(table(spark, sf, "calls"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that write the name of a contact's person or organisation otherwise than its first contact does."""
    return names.variant_records(table(spark, sf, "contacts"), table(spark, sf, "imports"), table(spark, sf, "unprocessed"), table(spark, sf, "nicknames"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the call dump with copies, and how many."""
    return copies.found(table(spark, sf, "call_dump"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """For each call the rows whose contact_name and readable_date survive."""
    return survivor.survivors(table(spark, sf, "calls"), table(spark, sf, "devices"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.token_ids(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text or piece of a text."""
    return bins.fill_containers(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.found(table(spark, sf, "documents"))


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.shares(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    """Query by name."""
    return {f.__name__: f for f in (p1_found, p4_found, p6_found, p7_found, p8_ids, p9_containers, p10_found, p10_shares)}


#: Comparable calls as SQL: number without punctuation, country code 1, 00 or +; start and duration as numbers.
_NUM = "regexp_extract(regexp_replace(regexp_replace(number, '[^0-9A-Za-z]', '', 'g'), '^00', ''), '^(1([0-9]{10})|([0-9]{3,}))$', 0)"
_COMPARABLE = f"""c AS (SELECT *, CASE WHEN length(n) = 11 AND n LIKE '1%' THEN substr(n, 2) ELSE n END AS num FROM (
  SELECT call_id, batch_no, device_id, received_at, contact_name, readable_date, {_NUM} AS n, TRY_CAST(trim(date) AS BIGINT) AS ms, TRY_CAST(trim(duration) AS INTEGER) AS dur FROM calls) WHERE n <> '' AND ms > 0 AND dur >= 0)"""
_CLASSES = "g AS (SELECT a.call_id, min(b.call_id) AS f, min(b.batch_no) AS mb, count(*) AS members FROM c a JOIN c b ON a.num = b.num AND abs(a.ms - b.ms) <= 2000 AND abs(a.dur - b.dur) <= 2 GROUP BY a.call_id)"
_ELL = "regexp_replace({0}, '(\\.{{2,}}|…)\\s*$', '')"
_NAME = "trim(" + _ELL.format("contact_name") + ")"
_FIELD = "regexp_replace(lower(regexp_extract(record_text, '(?i)\\b{0}\\s*[=:]\\s*(\"[^\"]*\"|''[^'']*'')', 1)), '[^a-z0-9]', '', 'g')"


def oracle_sql() -> dict[str, str]:
    """SQL by query name; queries without an entry are tested against brute force in tests/llm.

    The statements for calls link rows directly, which equals classes as long as the
    rows of a class all lie within the limits.
    """
    placeholders = ", ".join("'" + x + "'" for x in survivor.NAME_PLACEHOLDERS)
    return {
        "p1_found": f"WITH {_COMPARABLE}, {_CLASSES} SELECT g.f AS first_call_id, c.call_id FROM c JOIN g USING (call_id) WHERE c.batch_no >= 1 AND c.batch_no > g.mb",
        "p6_found": "SELECT min(dump_id) AS dump_id, count(*) AS copies FROM call_dump WHERE record_text IS NOT NULL GROUP BY " + ", ".join(_FIELD.format(f) for f in copies.KEY_FIELDS) + " HAVING count(*) >= 2",
        "p7_found": f"""WITH {_COMPARABLE}, {_CLASSES},
          r AS (SELECT g.f, c.*, d.trust, CASE WHEN lower({_NAME}) IN ({placeholders}) OR regexp_full_match({_NAME}, '[-+0-9() .#*/]*') THEN NULL ELSE {_NAME} END AS name,
            NOT regexp_matches(trim(contact_name), '(\\.{{2,}}|…)\\s*$') AS entire, coalesce(regexp_full_match(trim(readable_date), '[A-Z][a-z]{{2}} [0-9]{{1,2}}, [0-9]{{4}} [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}} [AP]M') AND NOT regexp_matches(readable_date, '^(Dec 31, 1969|Jan 1, 1970)'), false) AS stated
            FROM c JOIN g USING (call_id) LEFT JOIN devices d USING (device_id) WHERE g.members >= 2),
          w AS (SELECT *, name IS NOT NULL AND entire AND NOT EXISTS (SELECT 1 FROM r o WHERE o.f = r.f AND o.name <> r.name AND starts_with(o.name, r.name)) AS entire_name FROM r)
          SELECT f AS first_call_id, arg_max(call_id, (trust, received_at, -call_id)) FILTER (entire_name) AS name_call_id, arg_max(call_id, (stated, trust, received_at, -call_id)) AS readable_call_id
          FROM w GROUP BY f HAVING bool_or(entire_name)""",
    }
